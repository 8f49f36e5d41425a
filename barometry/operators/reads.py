"""Read models: what dashboards and clients ask for."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barometry.constants import SIGNAL_TTL_SECONDS
from barometry.operators.ordered import IDX, TICKER_TIME, Series, dedupe_keep_last, latest_n, row_index


def recent(df: DataFrame, ticker: str, n: int) -> DataFrame:
    """Newest ``n`` rows of a ticker, oldest first."""
    newest = df.filter(F.col("ticker") == ticker).orderBy(F.col("time").desc()).limit(n)
    return newest.orderBy("time")


def recent_bars(bars: DataFrame, ticker: str, n: int = 252) -> DataFrame:
    return recent(bars, ticker, n)


def regime_history(signals: DataFrame, ticker: str, n: int = 100) -> DataFrame:
    return recent(signals, ticker, n)


def unread_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.col("read"))


def recent_alerts(alerts: DataFrame, n: int = 50, unread_only: bool = False) -> DataFrame:
    """Newest ``n`` alerts; equal times are ordered by id."""
    kept = unread_alerts(alerts) if unread_only else alerts
    return kept.orderBy(F.col("time").desc(), F.col("id")).limit(n)


def latest_signals(signals: DataFrame) -> DataFrame:
    """The newest signal of each ticker, by partial aggregation."""
    rest = [c for c in signals.columns if c != "ticker"]
    return signals.groupBy("ticker").agg(F.max_by(F.struct(*rest), "time").alias("s")).select("ticker", "s.*")


def latest_signal_cache(signals: DataFrame, as_of: str, ttl: int = SIGNAL_TTL_SECONDS) -> DataFrame:
    """Latest signals as a cache would hold them at ``as_of``: gone ``ttl`` seconds after the write."""
    now = F.lit(as_of).cast("timestamp_ntz")
    alive = signals.filter(
        (F.col("time") <= now) & (F.col("time") > now - F.make_interval(secs=F.lit(ttl))))
    return latest_signals(alive)


def snapshot_plus_updates(snapshot: DataFrame, updates: DataFrame) -> DataFrame:
    """Fold updates into a snapshot: the newest row per ticker wins."""
    return latest_signals(snapshot.unionByName(updates))


def regime_board(latest: DataFrame, by: str = "ticker") -> DataFrame:
    return latest.orderBy(by, "ticker") if by != "ticker" else latest.orderBy("ticker")


def bars_with_regime(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Bars with the last regime of their day, null where none was given."""
    return with_regime_of_day(bars.withColumn("_date", F.to_date("time")), signals.withColumn("_date", F.to_date("time")), "_date")


def with_regime_of_day(bars: DataFrame, signals: DataFrame, day: str = "day") -> DataFrame:
    """The same where both sides hold their day: tables bucketed by (ticker, day) are read without an exchange."""
    daily = signals.groupBy("ticker", day).agg(
        F.max_by("regime", F.struct("time", "seq") if "seq" in signals.columns else F.col("time")).alias("regime"))
    return bars.join(daily, ["ticker", day], "left").drop(day)


def stitch_history(stored: DataFrame, live: DataFrame, lookback: int, margin: int = 10) -> DataFrame:
    """Last stored rows of each ticker and the live rows; for equal keys the live row wins."""
    past = latest_n(stored, lookback + margin).withColumn("_live", F.lit(0))
    return union_history_live(past, live.withColumn("_live", F.lit(1)))


def union_history_live(past: DataFrame, live: DataFrame) -> DataFrame:
    both = past.unionByName(live, allowMissingColumns=True)
    return dedupe_keep_last(both, ["ticker", "time"], ["_live"]).drop("_live")


def positions(df: DataFrame, series: Series = TICKER_TIME) -> DataFrame:
    """0-based position of each row in its ticker, as ``row_idx``."""
    return row_index(df, series).withColumnRenamed(IDX, "row_idx")
