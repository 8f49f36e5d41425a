"""Training rows and sliding windows of feature vectors."""

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barometry.constants import (
    HMM_FEATURES, LOOKBACK, MIN_LABEL_CONFIDENCE, SEQUENCE_FEATURES, TRAIN_START,
)
from barometry.operators.ordered import TICKER_TIME, Series, over_blocks
from barometry.sources.landing import time_range


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def prepare_training(df: DataFrame, start: str = TRAIN_START) -> DataFrame:
    """Rows since ``start`` with every model feature present. Sorting is left to the consumers."""
    required = list(dict.fromkeys(present(df, HMM_FEATURES + SEQUENCE_FEATURES)))
    return df.filter(time_range(start)).dropna(subset=required)


def sliding_sequences(
    df: DataFrame, features: Sequence[str], lookback: int = LOOKBACK, include_current: bool = False,
    series: Series = TICKER_TIME,
) -> DataFrame:
    """Add ``seq``: the feature vectors of ``lookback`` consecutive rows of the ticker.

    Training looks at the rows before the labelled one; inference includes the latest row. Rows
    without enough history are dropped. A row comes out ``lookback`` times as large, so blocks are smaller by that factor.
    """
    series = replace(series, block_rows=max(series.block_rows // lookback, lookback))
    first, last = (1 - lookback, 0) if include_current else (-lookback, -1)

    def step(d: DataFrame) -> DataFrame:
        vector = F.array(*[F.col(c).cast("double") for c in features])
        frame = series.window().rowsBetween(first, last)
        return d.withColumn("seq", F.collect_list(vector).over(frame))

    return over_blocks(df, step, lookback, series).filter(F.size("seq") == lookback)


def confidence_filter(labels: DataFrame, least: float = MIN_LABEL_CONFIDENCE) -> DataFrame:
    return labels.filter(F.col("confidence") >= least)


def kept_share(labels: DataFrame, least: float = MIN_LABEL_CONFIDENCE) -> DataFrame:
    return labels.agg(F.avg((F.col("confidence") >= least).cast("double")).alias("kept_share"))


def validation_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of predictions equal to their label."""
    return predictions.agg(F.avg((F.col("regime") == F.col("label")).cast("double")).alias("accuracy"))
