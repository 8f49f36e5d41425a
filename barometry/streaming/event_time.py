"""Event time in streams: signals that expire by themselves, and rows that come too late kept apart.

A watermark follows Spark's rule: in a batch it is the largest time of the batches before, less the lateness
allowed. Spark's own stateful operators drop what lies behind it; ``split_late`` keeps it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barometry.constants import SIGNAL_TTL_SECONDS
from barometry.streaming.jobs import latest_state, new_version, state_before


def signal_expiries(signals: DataFrame, ttl_seconds: int = SIGNAL_TTL_SECONDS, lateness: str = "0 seconds") -> DataFrame:
    """Expiries of a stream of signals: the last signal of a ticker, once it has outlived its time to live.

    Signals of a ticker that follow one another within the time to live are one session, one row of the state store
    however many they are. The watermark is the timer: when it passes the end of a session, its last signal has
    expired, whether or not its ticker ever sends another. A signal at the very end still renews the one before, as
    Spark joins sessions that touch. Of several signals at one time the largest by its values counts. A null ticker is a ticker; rows
    without time never live nor expire.
    """
    rest = [c for c in signals.columns if c not in ("ticker", "time")]
    timed = signals.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", lateness)
    session = F.session_window("time", f"{ttl_seconds} seconds").alias("session")
    ended = timed.groupBy("ticker", session).agg(
        F.max(F.struct("time", *rest)).alias("last"), F.count(F.lit(1)).alias("n_signals"))
    return ended.select("ticker", "last.*", F.col("session.start").alias("live_from"),
                        F.col("session.end").alias("expired_at"), "n_signals")


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Handler: every batch below its own id, so one that is retried replaces itself."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def seen_until(batch: DataFrame, path: str, batch_id: int) -> tuple[Column, Column]:
    """The largest time before this batch and with it, as literals (null at first); kept as one row per version."""
    before = state_before(batch.sparkSession, path, batch_id)
    times = batch.select("time")
    if before is not None:
        times = times.unionByName(before.select("time"))
    new_version(times.agg(F.max("time").alias("time")), path, batch_id)
    kind = batch.schema["time"].dataType

    def literal(version: int) -> Column:
        rows = state_before(batch.sparkSession, path, version)
        return F.lit(None if rows is None else rows.first()[0]).cast(kind)

    return literal(batch_id), literal(batch_id + 1)


def split_late(batch: DataFrame, ends: Column, watermark: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose window is open, and those whose window ``ends`` at or before the watermark or that have no time."""
    late = F.coalesce(ends <= watermark, F.lit(False)) | ends.isNull()
    return batch.where(~late), batch.where(late)


def _open_days(rows: DataFrame) -> DataFrame:
    """Days that are not final yet, from bars or from parts of days."""
    return rows.groupBy("ticker", "bucket").agg(
        F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max("last").alias("last"), F.sum("volume").alias("volume"), F.sum("n").alias("n"))


def _bars(days: DataFrame) -> DataFrame:
    return days.select("bucket", "ticker", F.col("first.open").alias("open"), "high", "low",
                       F.col("last.close").alias("close"), "volume", "n")


def daily_bar_batches(state_path: str, bars_path: str, late_path: str, lateness: str = "7 days") -> Callable[[DataFrame, int], None]:
    """Handler: bars to daily bars that are written once, when final; bars that come too late go to ``late_path``.

    A day is final once the watermark passes its end. What comes for it later is written below ``late_path`` with the
    watermark that it missed, as are rows without time: final days, open days and late rows together hold every row once. State is the largest
    time seen and one row per open day and ticker; batches are summed up before they are shuffled. Of bars at one
    time the smallest open and the largest close count.
    """
    lag, day = F.expr(f"interval {lateness}"), F.expr("interval 1 day")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema["time"].dataType
        rows = batch.withColumn("bucket", F.date_trunc("day", "time").cast(kind)).persist()
        try:
            before, after = seen_until(rows, f"{state_path}/seen", batch_id)
            kept, late = split_late(rows, F.col("bucket") + day, before - lag)
            late.withColumn("watermark", before - lag).write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
            parts = kept.select(
                "ticker", "bucket", F.struct("time", "open").alias("first"), "high", "low",
                F.struct("time", "close").alias("last"), "volume", F.lit(1).cast("long").alias("n"))
            known = state_before(spark, f"{state_path}/days", batch_id)
            if known is not None:  # days that the batch before made final are gone from the rows that count
                parts = parts.unionByName(known.where("not final").drop("final"))
            final = F.coalesce(F.col("bucket") + day <= after - lag, F.lit(False))
            days = new_version(_open_days(parts).withColumn("final", final), f"{state_path}/days", batch_id)
            _bars(days.where("final")).write.mode("overwrite").parquet(f"{bars_path}/batch={batch_id}")
        finally:
            rows.unpersist()

    return handle


def open_days(spark: SparkSession, state_path: str) -> DataFrame:
    """Bars of the days that may still change."""
    return _bars(latest_state(spark, f"{state_path}/days").where("not final"))
