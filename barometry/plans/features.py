"""The feature pipeline: every indicator in one layout of the series."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barometry.constants import MIN_FEATURE_SHARE, TREND_WINDOW, ZSCORE_CLIP, ZSCORE_WINDOW
from barometry.functions.scalar import count_present
from barometry.operators import momentum, volatility
from barometry.operators.macro import attach_macro, macro_features, pivot_macro
from barometry.operators.normalise import feature_columns, numeric_columns
from barometry.operators.options import join_options_metrics
from barometry.operators.ordered import (
    BLOCK, IDX, RUN, STRETCH, TICKER_TIME, Series, ewm_mean, over_blocks, rolling_zscores, row_index,
)

# Deepest indicator, then the z-score window on top of it.
INDICATOR_REACH = max(
    volatility.RV_REACH + ZSCORE_WINDOW, volatility.ATR_REACH, momentum.RSI_REACH, momentum.TSI_REACH)


RAW_COLUMNS = [
    "log_return", "rv_5d", "rv_21d", "rv_63d", "rv_ratio", "atr_14", "atr_pct", "rv_21d_zscore",
    "rsi_14", "rsi_norm", "tsi", "tsi_signal", "mom_5d", "mom_21d", "mom_63d", "trend_r",
]


def indicators(d: DataFrame, series: Series = TICKER_TIME) -> DataFrame:
    """All raw indicators but the volatility z-score, on a laid-out frame, one window per dependency level."""
    d = d.withColumns({
        **volatility.log_return_columns(series), **volatility.true_range_columns(series),
        **momentum.move_columns(series), **momentum.momentum_columns(series),
        **momentum.detrended_columns(TREND_WINDOW, series),
    })
    d = d.withColumns({
        **volatility.realized_vol_columns(series), **momentum.trend_columns(TREND_WINDOW, series),
        **momentum.gain_loss_columns(), "_size": F.abs("_move"),
    })
    d = ewm_mean(d, [volatility.ATR_MEAN, *momentum.RSI_MEANS, *momentum.TSI_SLOW_MEANS], series)
    d = ewm_mean(d, momentum.TSI_FAST_MEANS, series)
    d = d.withColumns({
        **volatility.vol_ratio_columns(), "atr_pct": F.col("atr_14") / F.col("close"),
        **momentum.rsi_columns(), **momentum.tsi_columns(),
    })
    return ewm_mean(d, [momentum.TSI_SIGNAL_MEAN], series).withColumns(momentum.rsi_norm_columns())


def min_non_null_rows(df: DataFrame, columns: list[str], share: float = MIN_FEATURE_SHARE) -> DataFrame:
    """Keep rows in which at least ``int(share * n)`` of the columns are present."""
    return df.filter(count_present(columns) >= int(len(columns) * share))


def feature_pipeline(
    bars: DataFrame,
    macro: DataFrame | None = None,
    options_metrics: DataFrame | None = None,
    normalise: bool = True,
    macro_order: str | None = None,
    series: Series = TICKER_TIME,
) -> DataFrame:
    """Bars to features. ``macro`` is long (time, series_id, value); options hold one row per ticker.

    ``macro_order`` names the column that says which of several macro values of one time came last.
    Macro and options columns are joined before the series is laid out, so that indicators and
    z-scores share a single shuffle; columns still come out in the usual order.
    """
    names = list(bars.columns)
    if macro is None:
        df, joined = row_index(bars, series), []
    else:
        df = attach_macro(bars, macro_features(pivot_macro(macro, macro_order)), series)
        joined = [c for c in df.columns if c not in names and c != IDX]
    if options_metrics is not None:
        df = join_options_metrics(df, options_metrics)
        joined += ["iv_skew_proxy", "put_call_ratio", "gex_proxy"]

    def step(d: DataFrame) -> DataFrame:
        d = indicators(d, series)
        scored = numeric_columns(d.select(*names, *[c for c in RAW_COLUMNS if c in d.columns], *joined))
        scores = {"rv_21d_zscore": "rv_21d"}
        if normalise:
            scores |= {f"{c}_z": c for c in scored}
        d = rolling_zscores(d, scores, ZSCORE_WINDOW, ZSCORE_CLIP, series)
        added = [c for c in scores if c.endswith("_z")]
        return d.select(*names, *RAW_COLUMNS, *joined, *added, IDX, BLOCK, STRETCH, RUN)

    out = over_blocks(df, step, INDICATOR_REACH + ZSCORE_WINDOW, series).drop(IDX)
    return min_non_null_rows(out, feature_columns(out))


def sorted_by_ticker_time(df: DataFrame) -> DataFrame:
    """Global sort, for output only: windows sort for themselves."""
    return df.orderBy("ticker", F.col("time"))
