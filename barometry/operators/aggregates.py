"""Grouped summaries: daily bars, period figures, service metrics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barometry.constants import DURATION_BUCKETS, REGIME_NAMES, TRAIN_SPLIT
from barometry.operators.ordered import IDX, SINGLE_INTRADAY, latest_n, row_index


def daily_aggregates() -> list[Column]:
    return [
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume")]


def bars_daily(bars: DataFrame) -> DataFrame:
    """One bar per ticker and day. Partial sums per map task, so a hot ticker does not matter."""
    kind = bars.schema["time"].dataType
    return bars.groupBy("ticker", F.date_trunc("day", "time").cast(kind).alias("bucket")).agg(
        *daily_aggregates())


def bars_daily_refresh(daily: DataFrame, bars: DataFrame, as_of: str) -> DataFrame:
    """``daily`` with the buckets between 7 days and 1 hour before ``as_of`` computed anew.

    Only whole buckets inside the window are replaced, as a partly covered day would lose bars.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    start = F.date_trunc("day", now - F.expr("interval 7 days") + F.expr("interval 1 day")
                         - F.expr("interval 1 microsecond")).cast("timestamp_ntz")
    end = F.date_trunc("day", now - F.expr("interval 1 hour")).cast("timestamp_ntz")
    fresh = bars_daily(bars.filter((F.col("time") >= start) & (F.col("time") < end)))
    kept = daily.filter((F.col("bucket") < start) | (F.col("bucket") >= end))
    return kept.unionByName(fresh)


def period_stats(bars: DataFrame, n: int) -> DataFrame:
    """Per ticker over its last ``n`` bars: last close, highest high, change from first to last close."""
    first, last = F.min_by("close", "time"), F.max_by("close", "time")
    return latest_n(bars, n).groupBy("ticker").agg(
        last.alias("last_close"), F.max("high").alias("max_high"), ((last - first) / first).alias("change"))


def regime_counts(latest: DataFrame) -> DataFrame:
    """Number of tickers in each of the four regimes, zeros kept; one pass, no join."""
    counts = latest.agg(*[
        F.count(F.when(F.col("regime") == i, 1)).alias(name) for i, name in enumerate(REGIME_NAMES)])
    pairs = F.array(*[
        F.struct(F.lit(name).alias("regime_name"), F.col(name).alias("n")) for name in REGIME_NAMES])
    return counts.select(F.inline(pairs))


def time_split(df: DataFrame, share: float = TRAIN_SPLIT) -> DataFrame:
    """The time at position ``int(share * n)`` of the sorted distinct times, as one row."""
    times = df.select("time").where("time is not null").distinct()
    ranked = row_index(times.withColumn(SINGLE_INTRADAY.key, F.lit(0)), SINGLE_INTRADAY)
    wanted = times.agg(F.floor(F.count(F.lit(1)) * share).cast("long").alias(IDX))
    return ranked.join(wanted, IDX).select(F.col("time").alias("split_time"))


def counter_rate_per_min(events: DataFrame, label: str, value: str, time: str = "ts") -> DataFrame:
    """Records and summed value per minute and label."""
    kind = events.schema[time].dataType
    minute = F.window(time, "1 minute")["start"].cast(kind).alias("minute")
    return events.groupBy(minute, label).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def duration_p95(
    events: DataFrame, label: str, seconds: str, time: str = "ts", q: float = 0.95,
    bounds: Sequence[float] = DURATION_BUCKETS,
) -> DataFrame:
    """Quantile of durations per label and 5 minutes from cumulative bucket counts.

    Linear inside a bucket; beyond the last bound the last bound itself. The state per group is one
    count per bucket, however many durations a group holds.
    """
    kind = events.schema[time].dataType
    start = F.window(time, "5 minutes")["start"].cast(kind).alias("start")
    counts = events.groupBy(start, label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col(seconds) <= b, 1)).alias(f"_le{i}") for i, b in enumerate(bounds)])
    rank = F.col("n") * q
    value = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = F.lit(float(bounds[i - 1])) if i else F.lit(0.0)
        below = F.col(f"_le{i - 1}") if i else F.lit(0)
        inside = F.col(f"_le{i}") - below
        at = low + (F.lit(float(bounds[i])) - low) * (rank - below) / F.greatest(inside, F.lit(1))
        value = F.when(F.col(f"_le{i}") >= rank, at).otherwise(value)
    return counts.select("start", label, value.alias("p95"))


def status_totals(events: DataFrame, label: str) -> DataFrame:
    """Totals by label with successes and errors, 0 where there are none."""
    return events.groupBy(label).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("status") == "success", 1)).alias("successes"),
        F.count(F.when(F.col("status") == "error", 1)).alias("errors"))
