"""Macro series: wide frame, derived columns, joins onto bars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barometry.constants import MACRO_JOINED, MACRO_NAMES, MACRO_TERM_LAG, ZSCORE_CLIP, ZSCORE_WINDOW
from barometry.operators.ordered import (
    IDX, SINGLE, TICKER_TIME, Series, latest_n, over_blocks, rolling_zscores, row_index,
)
from barometry.operators.ranges import asof_join

def recode_series(df: DataFrame) -> DataFrame:
    """Keep the five used series and replace their ids by column names (``name``)."""
    names = F.create_map(*[F.lit(x) for pair in MACRO_NAMES.items() for x in pair])
    return df.filter(F.col("series_id").isin(list(MACRO_NAMES))).withColumn("name", names[F.col("series_id")])


def pivot_macro(df: DataFrame, order: str | None = "seq") -> DataFrame:
    """One row per time, one column per series (null where absent).

    Of several values the last in ``order`` wins; of values that are equal there, and without an order, the largest.
    """
    last = F.struct(*([order] if order else []), "value")
    return recode_series(df).groupBy("time").pivot("name", list(MACRO_NAMES.values())).agg(F.max_by("value", last))


def macro_features(wide: DataFrame, series: Series = SINGLE) -> DataFrame:
    """Forward-fill the wide frame and add the derived macro columns."""
    filled = row_index(wide.withColumn(series.key, F.lit(0)), series, fill=list(MACRO_NAMES.values()))

    def step(d: DataFrame) -> DataFrame:
        before = F.lag("vix", MACRO_TERM_LAG).over(series.window())
        d = rolling_zscores(d, {"vix_zscore": "vix", "hy_spread_zscore": "hy_spread"},
                            ZSCORE_WINDOW, ZSCORE_CLIP, series)
        return d.withColumns({
            "vix_term_slope": F.col("vix") - before,
            "yc_inverted": (F.col("yield_curve_slope") < 0).cast("double"),
        })

    return over_blocks(filled, step, ZSCORE_WINDOW, series).drop(series.key, IDX)


def by_date(macro: DataFrame) -> DataFrame:
    """The joined macro columns, one row per calendar date (the last of a date)."""
    dated = macro.withColumn("_date", F.to_date("time"))
    return dated.groupBy("_date").agg(
        F.max_by(F.struct(*MACRO_JOINED), "time").alias("_m")
    ).select("_date", "_m.*")


def attach_macro(bars: DataFrame, macro: DataFrame, series: Series = TICKER_TIME) -> DataFrame:
    """Bars left-joined to macro by date, macro forward-filled per ticker; keeps ``_idx``."""
    joined = bars.withColumn("_date", F.to_date("time")).join(
        by_date(macro), "_date", "left").drop("_date")
    return row_index(joined, series, fill=MACRO_JOINED)


def join_macro_date_ffill(bars: DataFrame, macro: DataFrame, series: Series = TICKER_TIME) -> DataFrame:
    return attach_macro(bars, macro, series).drop(IDX)


def join_macro_asof(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """Each bar gets the latest macro row of its calendar date or an earlier one, for daily bars and macro rows of days.

    On intraday bars ``join_macro_asof_time`` is the one that does not look ahead within the day.

    Every macro row is repeated for the calendar days until the next one, which turns the as-of join
    into a join on equal dates. The repeated frame has one row per calendar day.
    """
    dated = bars.withColumn("_date", F.to_date("time"))
    days = by_date(macro)
    last_bar = dated.select(F.max("_date")).scalar()
    spine = row_index(
        days.withColumns({SINGLE.key: F.lit(0), "time": F.col("_date").cast("timestamp_ntz")}), SINGLE)
    following = spine.select((F.col(IDX) - 1).alias(IDX), F.col("_date").alias("_next"))
    end = F.coalesce(F.date_sub("_next", 1), F.greatest(F.col("_date"), last_bar))
    daily = spine.join(following, IDX, "left").select(
        F.explode(F.sequence("_date", end)).alias("_date"), *MACRO_JOINED)
    return dated.join(daily, "_date", "left").drop("_date")


def join_macro_asof_time(bars: DataFrame, macro: DataFrame, time: str = "time") -> DataFrame:
    """Each bar gets the latest macro row stamped at or before it, to the microsecond.

    A bar of 09:30 sees nothing that is stamped later the same day. Both sides become one series in range
    partitions; bars without a time get nulls.
    """
    return asof_join(bars, macro.select(F.col("time").alias(time), *MACRO_JOINED), time)


def macro_term_slope(macro: DataFrame, n: int = 20) -> DataFrame:
    """Per series, (last - first) / count over the last ``n`` observations; null below two."""
    recent = latest_n(macro, n, key="series_id")
    change = F.max_by("value", "time") - F.min_by("value", "time")
    count = F.count(F.lit(1))
    return recent.groupBy("series_id").agg(
        F.when(count >= 2, F.round(change / count, 4)).alias("slope"))
