"""Volatility indicators. Input: time, ticker, open, high, low, close, volume.

Each public function adds columns to a frame. The ``*_columns`` functions give the same columns as
expressions over a laid-out frame, so that the pipeline can compute many in one window.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barometry.constants import ATR_PERIOD, RV_WINDOWS, TRADING_DAYS, ZSCORE_CLIP, ZSCORE_WINDOW
from barometry.functions.scalar import clip
from barometry.operators.ordered import (
    TICKER_TIME, Ewm, Series, ewm_mean, ewm_reach, over_blocks, rolling_std, rolling_zscores,
)

ATR_MEAN = Ewm("atr_14", "_tr", 2.0 / (ATR_PERIOD + 1), adjust=True)
RV_REACH = max(RV_WINDOWS) + 1
ATR_REACH = ewm_reach(ATR_MEAN.alpha) + 1


def log_return_columns(series: Series) -> dict[str, Column]:
    return {"log_return": F.log("close") - F.log(F.lag("close", 1).over(series.window()))}


def true_range_columns(series: Series) -> dict[str, Column]:
    """True range; ``greatest`` skips the nulls of the first bar, which leaves high - low."""
    before = F.lag("close", 1).over(series.window())
    return {"_tr": F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))}


def realized_vol_columns(series: Series) -> dict[str, Column]:
    return {
        f"rv_{n}d": rolling_std(F.col("log_return"), n, series) * math.sqrt(TRADING_DAYS)
        for n in RV_WINDOWS
    }


def vol_ratio_columns() -> dict[str, Column]:
    short, long = F.col(f"rv_{RV_WINDOWS[0]}d"), F.col(f"rv_{RV_WINDOWS[-1]}d")
    return {"rv_ratio": clip(short / clip(long, low=1e-8), 0.1, 5.0)}


def log_return(df: DataFrame, series: Series = TICKER_TIME) -> DataFrame:
    """Add ``log_return``, close to close."""
    return over_blocks(df, lambda d: d.withColumns(log_return_columns(series)), 1, series)


def realized_vol(df: DataFrame, series: Series = TICKER_TIME) -> DataFrame:
    """Add annualised ``rv_5d``, ``rv_21d``, ``rv_63d``."""
    def step(d: DataFrame) -> DataFrame:
        if "log_return" not in d.columns:
            d = d.withColumns(log_return_columns(series))
        return d.withColumns(realized_vol_columns(series))

    return over_blocks(df, step, RV_REACH, series)


def vol_ratio(df: DataFrame, series: Series = TICKER_TIME) -> DataFrame:
    """Add ``rv_ratio``: shortest over longest realised volatility, within [0.1, 5]."""
    if not {f"rv_{RV_WINDOWS[0]}d", f"rv_{RV_WINDOWS[-1]}d"} <= set(df.columns):
        df = realized_vol(df, series)
    return df.withColumns(vol_ratio_columns())


def atr(df: DataFrame, series: Series = TICKER_TIME) -> DataFrame:
    """Add ``atr_14`` (weighted true range, weights normalised) and ``atr_pct``."""
    def step(d: DataFrame) -> DataFrame:
        d = ewm_mean(d.withColumns(true_range_columns(series)), [ATR_MEAN], series)
        return d.withColumn("atr_pct", F.col("atr_14") / F.col("close")).drop("_tr")

    return over_blocks(df, step, ATR_REACH, series)


def rv_zscore(df: DataFrame, window: int | None = None, series: Series = TICKER_TIME) -> DataFrame:
    """Add ``rv_21d_zscore`` against the last ``window`` bars (252)."""
    n = window or ZSCORE_WINDOW

    def step(d: DataFrame) -> DataFrame:
        if "rv_21d" not in d.columns:
            d = realized_vol(d, series)
        return rolling_zscores(d, {"rv_21d_zscore": "rv_21d"}, n, ZSCORE_CLIP, series)

    return over_blocks(df, step, RV_REACH + n, series)
