"""Sequence classifier on windows of feature vectors, trained by Spark ML."""

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barometry.constants import LOOKBACK, N_STATES
from barometry.session import written


def as_vectors(sequences: DataFrame) -> DataFrame:
    """``seq`` (rows of feature vectors) flattened into one ML vector."""
    return sequences.withColumn("window", array_to_vector(F.flatten("seq")))


def fit_classifier(
    sequences: DataFrame, n_features: int, lookback: int = LOOKBACK, hidden: int = 16,
    max_iter: int = 40, block_size: int = 64, seed: int = 42,
) -> PipelineModel:
    """Fit on ``seq`` and ``label``. Gradients are summed over partitions; no row leaves its task."""
    network = MultilayerPerceptronClassifier(
        layers=[lookback * n_features, hidden, N_STATES], featuresCol="scaled", labelCol="label",
        maxIter=max_iter, blockSize=block_size, seed=seed)
    scaler = StandardScaler(inputCol="window", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, network]).fit(as_vectors(sequences))


@dataclass
class Training:
    """A fitted classifier, the held-out loss after each round, the round that it comes from, and why training ended."""
    model: PipelineModel
    losses: list[float]
    best: int
    reason: str


def held_out_loss(scored: DataFrame) -> float | None:
    """Mean negative log probability of the labels; none without rows."""
    p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    return scored.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12))))).first()[0]


def fit_with_early_stopping(
    sequences: DataFrame, held_out: DataFrame, n_features: int, lookback: int = LOOKBACK, hidden: int = 16,
    steps: int = 5, max_rounds: int = 20, patience: int = 10, least_gain: float = 1e-4, block_size: int = 64, seed: int = 42,
) -> Training:
    """Rounds of ``steps`` solver steps, each from the weights of the last, until the held-out loss stops falling.

    Training ends after ``patience`` rounds in a row without a gain of ``least_gain`` over the best loss, or after
    ``max_rounds``; the weights of the best round stay. Gradients and losses are summed over partitions. Without held-out
    rows there is nothing to judge by: all rounds run, and the last stays. Both frames are scaled and written once.
    """
    scaler = StandardScaler(inputCol="window", outputCol="scaled", withMean=True, withStd=True).fit(as_vectors(sequences))

    def scaled(df: DataFrame, name: str) -> DataFrame:
        return written(scaler.transform(as_vectors(df)).select("scaled", F.col("label").cast("double").alias("label")), name)

    train, valid = scaled(sequences, "train-windows"), scaled(held_out, "held-out-windows")
    losses, best, least, weights, reason = [], 0, float("inf"), None, "rounds"
    for step in range(max_rounds):
        network = MultilayerPerceptronClassifier(
            layers=[lookback * n_features, hidden, N_STATES], featuresCol="scaled", labelCol="label",
            maxIter=steps, blockSize=block_size, seed=seed)
        if weights is not None:
            network.setInitialWeights(weights)
        fitted = network.fit(train)
        weights = fitted.weights
        loss = held_out_loss(fitted.transform(valid))
        if loss is None:
            kept, best = fitted, step
            continue
        losses.append(loss)
        if loss < least - least_gain:
            kept, best, least = fitted, step, loss
        elif step - best >= patience:
            reason = "patience"
            break
    return Training(PipelineModel(stages=[scaler, kept]), losses, best, reason)


def classify(model: PipelineModel, sequences: DataFrame) -> DataFrame:
    """Add ``seq_prob``, the four class probabilities."""
    scored = model.transform(as_vectors(sequences))
    return scored.withColumn("seq_prob", vector_to_array("probability")).drop(
        "window", "scaled", "rawPrediction", "probability", "prediction")
