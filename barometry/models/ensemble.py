"""Blending both models' probabilities into one signal; all in generated code."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barometry.constants import HMM_WEIGHT, SEQUENCE_WEIGHT
from barometry.functions.probability import argmax, blend, regime_name, rounded


def align_predictions(hmm: DataFrame, seq: DataFrame) -> DataFrame:
    """Both probability vectors of the same bar."""
    return hmm.join(seq, ["ticker", "time"])


def ensemble_predict(
    df: DataFrame, hmm_weight: float = HMM_WEIGHT, seq_weight: float = SEQUENCE_WEIGHT
) -> DataFrame:
    """Add regime, name, confidence and blended probabilities to rows with both vectors."""
    p = F.col("_p")
    named = df.withColumn("_p", blend(F.col("hmm_prob"), F.col("seq_prob"), hmm_weight, seq_weight))
    named = named.withColumn("regime", argmax(p))
    return named.withColumns({
        "regime_name": regime_name(F.col("regime")),
        "confidence": F.round(F.array_max(p), 4),
        "hmm_prob": rounded(F.col("hmm_prob")),
        "seq_prob": rounded(F.col("seq_prob")),
        "ensemble_prob": rounded(p),
    }).drop("_p")
