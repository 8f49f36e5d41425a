"""Partitioned feature store and keyed tables on Parquet."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barometry.operators.ordered import latest_n
from barometry.sources.landing import time_range


class FeatureStore:
    """Parquet below one path, partitioned by ticker and sorted by time within files."""

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 2_000_000, salts: int = 16):
        self.spark, self.path, self.rows_per_file, self.salts = spark, path, rows_per_file, salts

    def write(self, df: DataFrame, partition_by: Sequence[str] = ("ticker",)) -> None:
        """Replace the partitions present in ``df``; others stay. An empty frame changes nothing.

        Rows are spread by partition and a salt from their time, so one large ticker is written by many tasks and
        the input is computed once; ranges would be sampled first.
        """
        salt = F.pmod(F.xxhash64("time"), F.lit(self.salts))
        (
            df.repartition(*partition_by, salt)
            .sortWithinPartitions(*partition_by, "time")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", self.rows_per_file)
            .partitionBy(*partition_by).parquet(self.path)
        )

    def scan(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(
        self, tickers: Sequence[str] | None = None, start: str | None = None, end: str | None = None
    ) -> DataFrame:
        """Rows of the tickers (any case) between the bounds, both included, sorted."""
        df = self.scan().filter(time_range(start, end))
        if tickers is not None:
            df = df.filter(F.col("ticker").isin([t.upper() for t in tickers]))
        return df.orderBy("ticker", "time")

    def one(self, ticker: str) -> DataFrame:
        """One partition; the partition column comes back with it."""
        return self.scan().filter(F.col("ticker") == ticker)

    def latest(self, tickers: Sequence[str] | None = None, n: int = 1) -> DataFrame:
        df = self.scan()
        if tickers is not None:
            df = df.filter(F.col("ticker").isin([t.upper() for t in tickers]))
        return latest_n(df, n)

    def tickers(self) -> DataFrame:
        return self.scan().select("ticker").distinct()

    def date_range(self) -> DataFrame:
        return date_range(self.scan())


def save_bucketed(
    df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int, sort: Sequence[str] = ("time",)
) -> DataFrame:
    """Store ``df`` as a table in a fixed number of buckets by the hash of ``keys``, and return it.

    Joins and groupings on exactly ``keys`` read it without an exchange; another table saved with as many buckets meets
    it bucket by bucket. Each bucket is one sorted file, so filters on keys and ``sort`` skip row groups by
    their statistics. ``keys`` should cut a hot ticker, as (ticker, day) does.
    """
    (
        df.repartition(buckets, *keys)  # the hash of buckets, so a task holds one bucket
        .write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *sort).option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def date_range(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``target`` with the rows of ``new`` inserted or, where the key exists, put in place.

    A match takes every column of the new row, nulls too, but for the ``keep`` columns, which hold
    their old value. Both sides must be unique per key.
    """
    values = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*values).alias("_old"))
    fresh = new.select(*keys, F.struct(*values).alias("_new"))
    joined = old.join(fresh, list(keys), "full")

    def pick(c: str):
        replaced = F.col("_new").isNotNull()
        if c in keep:
            replaced = F.col("_old").isNull()
        return F.when(replaced, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)

    return joined.select(*[F.col(c) if c in keys else pick(c) for c in target.columns])


def upsert_bars(target: DataFrame, new: DataFrame) -> DataFrame:
    """Prices, volume and vwap are replaced; ``source`` keeps its first value."""
    keys = ["ticker", "interval", "time"] if "interval" in target.columns else ["ticker", "time"]
    return upsert(target, new, keys, keep=["source"])


def upsert_macro(target: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(target, new, ["series_id", "time"])


def apply_retention(df: DataFrame, as_of: str, years: int, column: str = "time") -> DataFrame:
    """Rows not older than ``years`` at ``as_of``."""
    oldest = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(years=F.lit(years))
    return df.filter(F.col(column) >= oldest)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_signals(predictions: DataFrame, path: str, model_version: str = "latest") -> None:
    """One row per ticker and run."""
    append(predictions.withColumn("model_version", F.lit(model_version)), path)


def run_log(spark: SparkSession, path: str, run_id: str, params: dict, metrics: dict) -> None:
    """Append the parameters and metrics of one training run."""
    rows = [(run_id, "param", k, str(v)) for k, v in params.items()]
    rows += [(run_id, "metric", k, str(v)) for k, v in metrics.items()]
    append(spark.createDataFrame(rows, "run_id string, kind string, name string, value string"), path)
