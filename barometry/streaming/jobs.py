"""Structured Streaming jobs. Batches reuse the batch operators; all state lives in the shared folder.

Every sink is replay-safe: a batch writes below its own id, or replaces whole (ticker,
period) partitions, so a batch that is retried after a failure gives the same tables.
"""

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from barometry.constants import FLUSH_SECONDS, LOOKBACK, ZSCORE_WINDOW
from barometry.operators.aggregates import daily_aggregates
from barometry.operators.alerts import alert_rules, regime_transitions
from barometry.operators.ordered import dedupe_keep_last, latest_n
from barometry.operators.reads import stitch_history
from barometry.plans.features import INDICATOR_REACH, feature_pipeline
from barometry.plans.training import Models, infer_all
from barometry.sources.envelopes import (
    TOPICS, dead_letters, explode_envelope, publish_latest_features, publish_signal,
)
from barometry.sources.store import upsert, upsert_bars

# Consumers that rebuild tables start from the first message, the others from the newest.
START_OFFSETS = {"features": "earliest", "inference": "latest", "alerts": "latest", "broadcast": "latest"}


def kafka_source(spark: SparkSession, servers: str, topics: Sequence[str], job: str) -> DataFrame:
    """Messages (topic, key, value) of a broker; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", START_OFFSETS[job]).load())
    return raw.select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def file_source(
    spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet",
    glob: str | None = None, files_per_batch: int = 1,
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(kind).load(path)


def each_batch(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False
) -> DataStreamWriter:
    """Run ``handle`` on every micro-batch. An error fails the query, and the batch is tried again."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{FLUSH_SECONDS} seconds")


def read_if_written(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


# -- keyed tables, partitioned by ticker and period ---------------------------------------------------

PERIOD = "year"  # partitions of daily bars; use "month" or "day" for bars of minutes or seconds
#: Up to so many touched partitions become literal filters; a batch that touches more joins them instead.
MAX_TOUCHED = 2_000


def period_of(column: str = "time", period: str = PERIOD) -> Column:
    return F.to_date(F.date_trunc(period, F.col(column)))


def only_touched(stored: DataFrame, fresh: DataFrame, key: str = "ticker") -> DataFrame:
    """The rows of ``stored`` in partitions (key, period) that ``fresh`` has rows for, the others unread."""
    touched = fresh.select(key, "period").distinct()
    pairs = touched.limit(MAX_TOUCHED + 1).collect()
    if len(pairs) > MAX_TOUCHED:
        return stored.join(touched, [key, "period"], "left_semi")
    periods: dict[str, list] = {}
    for name, period in pairs:
        periods.setdefault(name, []).append(period)
    wanted = F.lit(False)
    for name, own in periods.items():
        wanted = wanted | ((F.col(key) == F.lit(name)) & F.col("period").isin(own))
    return stored.where(wanted)


def upsert_partitions(
    batch: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], period: str = PERIOD,
    key: str = "ticker",
) -> None:
    """Merge a batch into a table partitioned by (key, period), reading and rewriting touched partitions only."""
    fresh = batch.withColumn("period", period_of(period=period))
    stored = read_if_written(batch.sparkSession, path)
    if stored is not None:
        own = only_touched(stored.select(*fresh.columns), fresh, key)
        fresh = merge(own.select(*batch.columns), batch).withColumn("period", period_of(period=period))
    replace_partitions(fresh, path, key)


def replace_partitions(rows: DataFrame, path: str, key: str = "ticker") -> None:
    """Write rows with their ``period``, replacing the partitions they belong to.

    Rows go to tasks by key, period and a salt from their time: unlike ranges, that needs no sampling, which
    would compute them twice, and a large partition is still written by several tasks.
    """
    salt = F.pmod(F.xxhash64("time"), F.lit(8))
    (
        rows.repartition(key, "period", salt).sortWithinPartitions(key, "period", "time")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(key, "period").parquet(path))


def late_data_upsert(batch: DataFrame, path: str, arrival: Sequence[str] = ()) -> DataFrame:
    """Late and repeated bars replace the row of the same key, however late they come; returns the rows that stay.

    Of several rows of a key in one batch the last in ``arrival`` (columns that are not stored) wins; rows that
    are equal there are ordered by their values.
    """
    unique = dedupe_keep_last(batch, ["ticker", "time"], [*arrival, "close", "open", "high", "low", "volume"]).drop(*arrival)
    upsert_partitions(unique, path, upsert_bars)
    return unique


def upsert_macro_rows(batch: DataFrame, path: str, order: str, period: str = PERIOD) -> None:
    """Macro rows by (series, time), the last in ``order`` kept; only touched series and periods are rewritten."""
    keys = ["series_id", "time"]

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return dedupe_keep_last(old.unionByName(new), keys, [order])

    upsert_partitions(dedupe_keep_last(batch, keys, [order]), path, merge, period, "series_id")


def distinct_within(stream: DataFrame, delay: str, keys: Sequence[str], time: str = "time") -> DataFrame:
    """Drop repeats that come within ``delay``, with state bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def state_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The state version that a batch starts from: none for the first, else it must be there."""
    return spark.read.parquet(f"{path}/version={batch_id - 1}") if batch_id else None


def new_version(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write the state after a batch and read it back. A retried batch needs the version before its own, so two stay."""
    spark, target = rows.sparkSession, f"{path}/version={batch_id}"
    rows.write.mode("overwrite").parquet(target)
    if batch_id >= 2:
        _delete(spark, f"{path}/version={batch_id - 2}")
    return spark.read.schema(rows.schema).parquet(target)


def upsert_latest(batch: DataFrame, path: str, batch_id: int, keys: Sequence[str], order: str) -> DataFrame:
    """Latest row per key after this batch, kept as one version per batch; returns that version.

    For state of one row per key.
    """
    spark = batch.sparkSession
    newest = dedupe_keep_last(batch, keys, [order])
    before = state_before(spark, path, batch_id)
    merged = newest if before is None else dedupe_keep_last(before.select(*newest.columns).unionByName(newest), keys, [order])
    return new_version(merged, path, batch_id)


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a state table."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def apply_retention_to_table(spark: SparkSession, path: str, as_of: str, years: int, key: str = "ticker") -> int:
    """Remove the partitions (key, period) of a stored table that lie wholly before the retention period.

    Returns how many. Only periods are looked at: the one that the limit falls into stays whole.
    """
    rows = spark.read.parquet(path)
    oldest = F.to_date(F.date_trunc(PERIOD, F.lit(as_of).cast("timestamp_ntz") - F.make_interval(years=F.lit(years))))
    aged = rows.select(key, "period").distinct().where(F.col("period") < oldest).collect()  # one row per partition
    for name, period in aged:
        _delete(spark, f"{path}/{key}={name}/period={period}")
    return len(aged)


# -- jobs ----------------------------------------------------------------------------------------------

def with_lookback(stored: DataFrame, first: DataFrame, reach: int) -> DataFrame:
    """The partitions of ``stored`` from the one on that holds the ``reach``-th row before each ticker's first period.

    Rows are counted by partition, one number each; the bounds become literal filters, so older files stay unread.
    """
    begins = {r["ticker"]: r["_first"] for r in first.limit(MAX_TOUCHED + 1).collect()}
    if len(begins) > MAX_TOUCHED:
        return stored.join(first.select("ticker"), "ticker", "left_semi")
    own = stored.where(F.col("ticker").isin(list(begins)))
    counts = own.groupBy("ticker", "period").count().collect()  # one row per partition of these tickers
    wanted = F.lit(False)
    for name, begin in begins.items():
        start, seen = begin, 0
        for period, n in sorted(((r["period"], r["count"]) for r in counts if r["ticker"] == name and r["period"] < begin), reverse=True):
            start, seen = period, seen + n
            if seen >= reach:
                break
        wanted = wanted | ((F.col("ticker") == F.lit(name)) & (F.col("period") >= F.lit(start)))
    return own.where(wanted)


def feature_batches(
    macro: Callable[[], DataFrame | None], options: Callable[[], DataFrame | None],
    bars_path: str, features_path: str, messages_path: str, with_history: bool = True, arrival: Sequence[str] = (),
) -> Callable[[DataFrame, int], None]:
    """Handler: bars of a batch to stored features and one message with the newest row per ticker.

    Indicators need history, so the last stored bars of the batch's tickers are put in front of it;
    ``with_history=False`` works on the batch alone. ``macro`` and ``options`` are read per batch.
    ``arrival`` names the columns that order repeated bars.
    """
    reach = INDICATOR_REACH + ZSCORE_WINDOW

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bars = batch.persist()
        try:
            if bars.isEmpty():
                return
            rows = late_data_upsert(bars, bars_path, arrival)
            if with_history:
                # Late bars change all that follows, hence all rows from the first touched period on.
                first = rows.groupBy("ticker").agg(F.min(period_of()).alias("_first"))
                stored = with_lookback(spark.read.parquet(bars_path), first, reach).join(first, "ticker")
                after = stored.filter(F.col("period") >= F.col("_first"))
                before = latest_n(stored.filter(F.col("period") < F.col("_first")), reach)
                rows = before.unionByName(after).select(*rows.columns)
            features = feature_pipeline(rows, macro(), options())
            if with_history:
                features = features.join(first, "ticker").filter(
                    period_of() >= F.col("_first")).select(*features.columns)
            features = features.persist()
            if with_history:  # every period from the first touched one on is complete
                replace_partitions(features.withColumn("period", period_of()), features_path)
            else:
                upsert_partitions(features, features_path, lambda old, new: upsert(old, new, ["ticker", "time"]))
            publish_latest_features(features).write.mode("overwrite").parquet(
                f"{messages_path}/batch={batch_id}")
            features.unpersist()
        finally:
            bars.unpersist()

    return handle


def feature_job(
    bars_path: str, macro_path: str, options_path: str, features_path: str, messages_path: str,
) -> Callable[[DataFrame, int], None]:
    """Handler: messages of the three topics to features, with macro rows and options metrics kept as state.

    ``messages`` have topic and value. Records of a batch are applied in the order of their arrival: macro rows by
    (series, time), options metrics by ticker, then bars with features over both. Messages that yield no row are
    written below ``messages_path/dead``.
    """
    arrival = ("ingested_at", "position")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        messages = batch.persist()
        try:
            dead_letters(messages).write.mode("overwrite").parquet(f"{messages_path}/dead/batch={batch_id}")
            rows = {t: explode_envelope(messages, t, schema, arrival=True).withColumn(
                "arrived", F.struct(*arrival)).drop(*arrival) for t, schema in TOPICS.items()}
            bars = rows["ohlcv"].withColumn("time", F.col("time").cast("timestamp_ntz"))
            macro = rows["macro"].withColumn("time", F.col("time").cast("timestamp_ntz"))
            if not macro.isEmpty():
                upsert_macro_rows(macro, macro_path, "arrived")
            options = upsert_latest(rows["options"], options_path, batch_id, ["ticker"], "arrived")
            known = read_if_written(spark, macro_path)
            feature_batches(
                lambda: None if known is None else known.select("time", "series_id", "value"),
                lambda: options.drop("arrived"), bars_path, features_path, messages_path + "/features",
                arrival=("arrived",))(bars.drop("interval"), batch_id)
        finally:
            messages.unpersist()

    return handle


def inference_batches(
    models: Models, features_path: str, signals_path: str, messages_path: str, lookback: int = LOOKBACK
) -> Callable[[DataFrame, int], None]:
    """Handler: live feature rows, stitched to stored history, to one signal per ticker."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        stored = read_if_written(batch.sparkSession, features_path)
        if stored is None:
            history = batch
        else:
            first = batch.groupBy("ticker").agg(F.min(period_of()).alias("_first"))
            own = with_lookback(stored, first, lookback) if "period" in stored.columns else stored.join(
                first.select("ticker"), "ticker", "left_semi")
            history = stitch_history(own.select(*batch.columns), batch, lookback)
        signals = infer_all(history, models, lookback).withColumn("model_version", F.lit("latest"))
        signals = signals.persist()
        signals.write.mode("overwrite").parquet(f"{signals_path}/batch={batch_id}")
        publish_signal(signals).write.mode("overwrite").parquet(f"{messages_path}/batch={batch_id}")
        signals.unpersist()

    return handle


def alert_batches(state_path: str, transitions_path: str, alerts_path: str) -> Callable[[DataFrame, int], None]:
    """Handler: signals to regime transitions and alerts. The last regime per ticker is carried along."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        signals = batch.persist()
        try:
            known = state_before(spark, state_path, batch_id)
            moves = regime_transitions(signals, known)
            moves.write.mode("overwrite").parquet(f"{transitions_path}/batch={batch_id}")
            alert_rules(spark.read.parquet(f"{transitions_path}/batch={batch_id}")).write.mode(
                "overwrite").parquet(f"{alerts_path}/batch={batch_id}")
            upsert_latest(signals.select("ticker", "time", "regime"), state_path, batch_id, ["ticker"], "time")
        finally:
            signals.unpersist()

    return handle


def tumbling_bars(bars: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Daily bars of a stream of bars. A day is final once the watermark passes its end; rows that come for it later
    are dropped by the watermark. ``event_time.daily_bar_batches`` keeps them."""
    day = F.window("time", "1 day")
    return bars.withWatermark("time", lateness).groupBy(day, "ticker").agg(*daily_aggregates()).select(
        F.col("window.start").alias("bucket"), "ticker", "open", "high", "low", "close", "volume")


def signal_expiry(latest: DataFrame, as_of: str, ttl_seconds: int) -> DataFrame:
    """Latest signals not older than their time to live."""
    return latest.filter(F.col("time") > F.lit(as_of).cast("timestamp_ntz") - F.make_interval(
        secs=F.lit(ttl_seconds)))
