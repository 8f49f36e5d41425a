"""Momentum and trend indicators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barometry.constants import (
    MOMENTUM_WINDOWS, RSI_PERIOD, TREND_WINDOW, TSI_FAST, TSI_SIGNAL, TSI_SLOW,
)
from barometry.functions.scalar import clip
from barometry.operators.ordered import (
    TICKER_TIME, Ewm, Series, ewm_mean, ewm_reach, over_blocks, rolling_mean,
)

RSI_ALPHA = 1.0 / RSI_PERIOD
SLOW_ALPHA, FAST_ALPHA, SIGNAL_ALPHA = (2.0 / (n + 1) for n in (TSI_SLOW, TSI_FAST, TSI_SIGNAL))
RSI_MEANS = [Ewm("_gain", "_up", RSI_ALPHA), Ewm("_loss", "_down", RSI_ALPHA)]
TSI_SLOW_MEANS = [Ewm("_move1", "_move", SLOW_ALPHA), Ewm("_size1", "_size", SLOW_ALPHA)]
TSI_FAST_MEANS = [Ewm("_move2", "_move1", FAST_ALPHA), Ewm("_size2", "_size1", FAST_ALPHA)]
TSI_SIGNAL_MEAN = Ewm("tsi_signal", "tsi", SIGNAL_ALPHA)
RSI_REACH = ewm_reach(RSI_ALPHA) + 1
TSI_REACH = sum(ewm_reach(a) for a in (SLOW_ALPHA, FAST_ALPHA, SIGNAL_ALPHA)) + 1


def move_columns(series: Series) -> dict[str, Column]:
    return {"_move": F.col("close") - F.lag("close", 1).over(series.window())}


def gain_loss_columns() -> dict[str, Column]:
    return {"_up": clip(F.col("_move"), low=0), "_down": clip(-F.col("_move"), low=0)}


def rsi_columns() -> dict[str, Column]:
    strength = F.col("_gain") / clip(F.col("_loss"), low=1e-10)
    return {"rsi_14": 100.0 - 100.0 / (1.0 + strength)}


def rsi_norm_columns() -> dict[str, Column]:
    return {"rsi_norm": (F.col("rsi_14") - 50.0) / 50.0}


def tsi_columns() -> dict[str, Column]:
    return {"tsi": 100.0 * F.col("_move2") / clip(F.col("_size2"), low=1e-10)}


def momentum_columns(series: Series) -> dict[str, Column]:
    return {
        f"mom_{n}d": F.col("close") / F.lag("close", n).over(series.window()) - 1.0
        for n in MOMENTUM_WINDOWS
    }


def detrended_columns(window: int, series: Series) -> dict[str, Column]:
    return {"_dc": F.col("close") - rolling_mean(F.col("close"), window, series)}


def trend_columns(window: int, series: Series) -> dict[str, Column]:
    lead = (window - 1) / 2.0
    joint = rolling_mean(F.col("_dc"), window, series) * lead
    scale = F.sqrt(rolling_mean(F.col("_dc") * F.col("_dc"), window, series) * (lead * lead))
    return {"trend_r": clip(joint / clip(scale, low=1e-10), -1.0, 1.0)}


def rsi(df: DataFrame, series: Series = TICKER_TIME) -> DataFrame:
    """Add ``rsi_14`` (0..100, Wilder smoothing) and ``rsi_norm`` (-1..1)."""
    def step(d: DataFrame) -> DataFrame:
        d = d.withColumns(move_columns(series)).withColumns(gain_loss_columns())
        d = ewm_mean(d, RSI_MEANS, series).withColumns(rsi_columns()).withColumns(rsi_norm_columns())
        return d.drop("_move", "_up", "_down", "_gain", "_loss")

    return over_blocks(df, step, RSI_REACH, series)


def tsi(df: DataFrame, series: Series = TICKER_TIME) -> DataFrame:
    """Add ``tsi``, the twice smoothed move over the twice smoothed absolute move, and ``tsi_signal``."""
    def step(d: DataFrame) -> DataFrame:
        d = d.withColumns(move_columns(series)).withColumn("_size", F.abs("_move"))
        d = ewm_mean(ewm_mean(d, TSI_SLOW_MEANS, series), TSI_FAST_MEANS, series)
        d = ewm_mean(d.withColumns(tsi_columns()), [TSI_SIGNAL_MEAN], series)
        return d.drop("_move", "_size", "_move1", "_size1", "_move2", "_size2")

    return over_blocks(df, step, TSI_REACH, series)


def momentum(df: DataFrame, series: Series = TICKER_TIME) -> DataFrame:
    """Add the price change over 5, 21 and 63 bars as ``mom_{n}d``."""
    return over_blocks(
        df, lambda d: d.withColumns(momentum_columns(series)), max(MOMENTUM_WINDOWS), series)


def trend_strength(df: DataFrame, window: int = TREND_WINDOW, series: Series = TICKER_TIME) -> DataFrame:
    """Add ``trend_r``: rolling co-movement of the detrended close with time, within [-1, 1].

    Time minus its own rolling mean is the constant (window - 1) / 2, so only the close is rolled.
    """
    def step(d: DataFrame) -> DataFrame:
        return d.withColumns(detrended_columns(window, series)).withColumns(
            trend_columns(window, series)).drop("_dc")

    return over_blocks(df, step, 2 * window, series)
