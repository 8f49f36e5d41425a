"""From landed files to canonical rows: bars, macro observations, validation, date windows."""

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barometry import schemas
from barometry.constants import MACRO_SOURCES, OHLCV_SOURCES
from barometry.functions.scalar import normalise_ticker
from barometry.operators.ordered import dedupe_keep_last

_PRICES = ["Open", "High", "Low", "Close"]


def read_landed(spark, path: str, kind: str = "csv", split: bool = True) -> tuple[DataFrame, DataFrame] | DataFrame:
    """Landed price files with a fixed schema: readable rows, and unreadable ones as text with their file.

    Each frame reads the files for itself. ``split=False`` gives one frame of all rows, for who needs both in one
    pass: ``_corrupt`` holds the text of the unreadable ones and is null in the others, ``file`` names the file.

    Files are read line by line (``csv`` with the schema's order of columns, or ``json``), so either frame can be
    counted, filtered and joined like any other. Header lines and blank lines are no rows. A quoted line break is not supported.
    """
    prices = schemas.LANDED_PRICES
    whole = T.StructType([*prices.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    if kind == "csv":
        # The first column is called Date or Datetime.
        others = ",".join(f.lower() for f in prices.names[1:])
        lines = lines.where(~F.translate(F.lower("value"), "\"' \r", "").isin(f"date,{others}", f"datetime,{others}"))
        parsed = F.from_csv("value", whole.simpleString()[len("struct<"):-1].replace(":", " "), options)
    else:
        parsed = F.from_json("value", whole, options)
    # A generator: a filter on a plain column would be pushed below it and parse every line a second time.
    rows = lines.select("file", F.inline(F.array(parsed)))
    if not split:
        return rows
    return rows.where("_corrupt is null").select(*prices.names), rows.where("_corrupt is not null").select("_corrupt", "file")


def scan_bars(landed: DataFrame, order: Sequence[str], ticker: str = "ticker") -> DataFrame:
    """Landed prices to bars: names in title case, copies of a time dropped, no null prices.

    ``order`` names the columns that say which copy came last.
    """
    titled = landed.withColumnsRenamed({
        c: c.title() for c in landed.columns if c.lower() in ("date", "datetime", "open", "high", "low", "close", "volume")})
    titled = titled.withColumnRenamed("Datetime", "Date")
    last = dedupe_keep_last(titled.filter(F.col("Date").isNotNull()), [ticker, "Date"], order)
    return last.dropna(subset=_PRICES).select(
        F.col("Date").alias("time"), normalise_ticker(F.col(ticker)).alias("ticker"),
        *[F.col(c).cast("double").alias(c.lower()) for c in _PRICES],
        F.coalesce(F.col("Volume"), F.lit(0)).cast("long").alias("volume"))


def scan_universe(bars: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Bars of the configured tickers. A ticker without any bar still shows, as one row of nulls."""
    universe = bars.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    return universe.join(bars.filter(F.col("ticker").isin(list(tickers))), "ticker", "left")


def parse_macro_observations(responses: DataFrame, body: str = "body") -> DataFrame:
    """Service responses (``series_id``, JSON body) to macro rows.

    The missing mark ".", values that are no number and entries without a date are dropped.
    """
    entry = F.explode(F.from_json(body, schemas.OBSERVATIONS)["observations"])
    rows = responses.select("series_id", entry.alias("o"))
    parsed = rows.filter(F.col("o.value") != ".").select(
        F.try_to_timestamp("o.date", F.lit("yyyy-MM-dd")).cast("timestamp_ntz").alias("time"),
        "series_id", F.col("o.value").try_cast("double").alias("value"), F.lit("fred").alias("source"))
    return parsed.dropna(subset=["time", "value"])


def scan_macro_series(macro: DataFrame, series: Sequence[str], start: str, end: str) -> DataFrame:
    """The configured series between two dates, both included."""
    return macro.filter(F.col("series_id").isin(list(series)) & time_range(start, end))


def time_range(start: str | None = None, end: str | None = None, column: str = "time") -> Column:
    """Inclusive bounds as a predicate that reaches the file scan."""
    kept = F.lit(True)
    if start is not None:
        kept = kept & (F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        kept = kept & (F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return kept


def ingest_window(df: DataFrame, as_of: str, kind: str, years: int | None = None) -> DataFrame:
    """Rows of one ingestion run: ``eod`` = 5 days, ``weekly`` = 7 days, ``backfill`` = 1 to 20 years."""
    if kind == "backfill":
        if years is None or not 1 <= years <= 20:
            raise ValueError("years must be between 1 and 20")
        span = F.make_interval(years=F.lit(years))
    else:
        span = F.make_interval(days=F.lit({"eod": 5, "weekly": 7}[kind]))
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.filter(F.col("time").between(end - span, end))


def _rules(kind: str) -> dict[str, Column]:
    """Rule name -> condition that must hold. A null in a required column breaks the rule."""
    c = F.col
    if kind == "bars":
        rules = {f"{p}_positive": c(p) > 0 for p in ("open", "high", "low", "close")}
        return rules | {
            "volume_not_negative": c("volume") >= 0, "high_not_below_low": c("high") >= c("low"),
            "known_source": c("source").isin(OHLCV_SOURCES)}
    if kind == "macro":
        return {"value_present": c("value").isNotNull(), "known_source": c("source").isin(MACRO_SOURCES)}
    optional = {f"{p}_not_negative": c(p).isNull() | (c(p) >= 0)
                for p in ("implied_volatility", "open_interest", "volume")}
    return {"strike_positive": c("strike") > 0, "known_side": c("option_type").isin("call", "put")} | optional


def check_records(df: DataFrame, kind: str) -> DataFrame:
    """Normalise tickers and add ``failed``: the names of the broken rules."""
    if "ticker" in df.columns:
        df = df.withColumn("ticker", normalise_ticker(F.col("ticker")))
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in _rules(kind).items()]
    return df.withColumn("failed", F.array_compact(F.array(*marks)))


def validate_records(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Split into clean rows and quarantined rows with their broken rules."""
    checked = check_records(df, kind)
    bad = F.size("failed") > 0
    return checked.filter(~bad).drop("failed"), checked.filter(bad)


def write_validated(df: DataFrame, kind: str, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Clean and quarantined rows as one table, written in one pass that also counts them.

    Returns both parts and the figures: all rows, clean rows and the rows that break each rule. They are gathered in the
    tasks that write the files, which count once even if a lost executor makes them run again.
    """
    checked = check_records(df, kind).withColumn("clean", F.size("failed") == 0)
    figures = Observation(f"validated-{uuid.uuid4().hex}")
    broken = [F.count_if(F.array_contains("failed", name)).alias(name) for name in _rules(kind)]
    checked.observe(figures, F.count(F.lit(1)).alias("rows"), F.count_if("clean").alias("clean_rows"), *broken).write.mode(
        "overwrite").partitionBy("clean").parquet(path)
    stored = df.sparkSession.read.schema(checked.schema).parquet(path)
    return stored.where("clean").drop("failed", "clean"), stored.where("not clean").drop("clean"), dict(figures.get)
