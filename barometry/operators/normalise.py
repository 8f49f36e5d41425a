"""Column selection by name and type, and rolling z-scores over all eligible columns."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barometry.constants import NOT_FEATURES, PASS_THROUGH, ZSCORE_CLIP, ZSCORE_SKIP, ZSCORE_WINDOW
from barometry.operators.ordered import TICKER_TIME, Series, over_blocks, rolling_zscores

_NUMERIC = (T.FloatType, T.DoubleType, T.IntegerType, T.LongType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that get a z-score: numeric, not on the skip list, not internal."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, _NUMERIC) and f.name not in ZSCORE_SKIP and not f.name.startswith("_")
    ]


def feature_columns(df: DataFrame, normalised_only: bool = False) -> list[str]:
    names = [c for c in df.columns if c not in NOT_FEATURES and not c.startswith("_")]
    return [c for c in names if c.endswith("_z")] if normalised_only else names


def model_feature_columns(df: DataFrame) -> list[str]:
    """Sorted names of the z-scored columns and of the pass-through columns present."""
    present = [c for c in PASS_THROUGH if c in df.columns]
    return sorted({*feature_columns(df, normalised_only=True), *present})


def add_rolling_zscores(
    df: DataFrame, window: int | None = None, clip: float = ZSCORE_CLIP, series: Series = TICKER_TIME
) -> DataFrame:
    """Add ``{column}_z`` for every eligible column."""
    n = window or ZSCORE_WINDOW
    names = numeric_columns(df)
    return over_blocks(
        df, lambda d: rolling_zscores(d, {f"{c}_z": c for c in names}, n, clip, series), n, series)
