"""Message envelopes: packing rows for a topic and unpacking them again."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barometry import schemas
from barometry.operators.ordered import IDX, LOOSE, TICKER_TIME, Series, latest_n, row_index

# Topic -> record schema. Names are defaults; jobs take their own mapping.
TOPICS = {
    "ohlcv": schemas.BARS,
    "macro": schemas.MACRO,
    "options": schemas.OPTIONS_METRICS,
}
MAX_RECORDS = 5_000
# JSON times keep their microseconds.
JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def publish_envelope(
    df: DataFrame, data_type: str, series: Series = TICKER_TIME, max_records: int = MAX_RECORDS,
    source: str = "ingestion-service",
) -> DataFrame:
    """Rows to messages (``key``, ``value``), one batch of at most ``max_records`` rows per message.

    Batches are cut by position in the series, so a long series becomes many messages of bounded
    size. The batch id is a hash of key, type and batch number, which makes a replay repeat it.
    """
    names = df.columns
    # Rows without a place in their series go by a hash.
    loose = -1 - F.pmod(F.xxhash64(*names), F.lit(LOOSE))
    batched = row_index(df, series).withColumn("_batch", F.coalesce(F.expr(f"_idx div {max_records}L"), loose))
    packed = batched.groupBy(series.key, "_batch").agg(
        F.array_sort(F.collect_list(F.struct(IDX, F.struct(*names).alias("r")))).alias("_rows"),
        F.count(F.lit(1)).alias("record_count"))
    value = F.to_json(F.struct(
        F.sha2(F.concat_ws("|", F.col(series.key), F.lit(data_type), F.col("_batch").cast("string")), 256)
        .alias("batch_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ingested_at"),
        F.lit(source).alias("source"), F.lit(data_type).alias("data_type"), "record_count",
        F.transform("_rows", lambda x: x["r"]).alias("records")), JSON_TIMES)
    return packed.select(F.col(series.key).alias("key"), value.alias("value"))


def publish_latest_features(features: DataFrame, data_type: str = "features") -> DataFrame:
    """The newest row of each ticker, one message each."""
    return publish_envelope(latest_n(features, 1), data_type, source="feature-service")


def publish_signal(signals: DataFrame) -> DataFrame:
    """One JSON message per signal, keyed by ticker."""
    return signals.select(F.col("ticker").alias("key"), F.to_json(
        F.struct(*signals.columns), JSON_TIMES).alias("value"))


def explode_envelope(
    messages: DataFrame, topic: str, records: T.StructType, value: str = "value", arrival: bool = False,
) -> DataFrame:
    """Messages of one topic to typed rows. Works on batches and on streams.

    With ``arrival``, ``ingested_at`` and ``position`` (the place in its message) tell in which order rows came.
    Messages without records are those of ``dead_letters``.
    """
    parsed = F.from_json(F.col(value).cast("string"), schemas.envelope(records))
    rows = messages.filter(F.col("topic") == topic).select(parsed.alias("m"))
    placed = rows.select("m.ingested_at", F.posexplode("m.records").alias("position", "r"))
    return placed.select("r.*", *(["ingested_at", "position"] if arrival else []))


def dead_letters(messages: DataFrame, topics: dict[str, T.StructType] = TOPICS, value: str = "value") -> DataFrame:
    """Messages that yield no row, with the ``reason``: unknown topic, unreadable, or no records."""
    text = F.col(value).cast("string")
    # Only the outer form is looked at: records of any topic read as texts.
    parsed = F.from_json(text, "records array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    reason = F.when(~F.coalesce(F.col("topic").isin(*topics), F.lit(False)), "unknown topic").when(
        text.isNull() | parsed["_bad"].isNotNull(), "unreadable").when(
        F.coalesce(F.size(parsed["records"]), F.lit(0)) < 1, "no records")
    return messages.withColumn("reason", reason).where("reason is not null")


def route(messages: DataFrame, topics: dict[str, T.StructType] = TOPICS) -> dict[str, DataFrame]:
    """One typed frame per known topic; other topics are ignored."""
    return {topic: explode_envelope(messages, topic, records) for topic, records in topics.items()}
