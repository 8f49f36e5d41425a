"""Training and inference jobs over the feature table."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barometry.constants import (
    HMM_FEATURES, HMM_ITERATIONS, LOOKBACK, MIN_LABEL_CONFIDENCE, SEQUENCE_FEATURES, TRAIN_START,
)
from barometry.models.classifier import classify, fit_with_early_stopping
from barometry.models.ensemble import align_predictions, ensemble_predict
from barometry.models.hmm import HmmModel, hmm_decode, hmm_fit
from barometry.models.sequences import (
    confidence_filter, kept_share, prepare_training, present, sliding_sequences, validation_accuracy,
)
from barometry.operators.aggregates import time_split
from barometry.operators.ordered import latest_n
from barometry.session import written
from barometry.sources.store import run_log


@dataclass
class Models:
    hmm: HmmModel
    classifier: PipelineModel
    features: list[str]

    def save(self, spark: SparkSession, path: str) -> None:
        self.hmm.save(spark, f"{path}/hmm")
        self.classifier.write().overwrite().save(f"{path}/classifier")
        spark.createDataFrame([(self.features,)], "features array<string>").write.mode("overwrite").parquet(
            f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Models":
        features = list(spark.read.parquet(f"{path}/features").first().features)
        return Models(HmmModel.load(spark, f"{path}/hmm"), PipelineModel.load(f"{path}/classifier"), features)


def pseudo_labels(df: DataFrame, hmm: HmmModel) -> DataFrame:
    """Regime label and confidence of every row, decoded per ticker."""
    return hmm_decode(df, hmm)


def labelled_sequences(df: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """Windows before each row with the row's own label, as often as the row has one.

    Labels join the rows, not the windows, which hold each row once per place: those are never shuffled.
    """
    keys = ["ticker", "time"]
    given = [c for c in labels.columns if c not in keys]
    own = labels.groupBy(*keys).agg(F.collect_list(F.struct(*given)).alias("_own"))
    windows = sliding_sequences(df.join(own, keys, "left"), features).filter(F.col("_own").isNotNull())
    return windows.select(*keys, "seq", F.inline("_own"))


def train_job(
    features: DataFrame, start: str = TRAIN_START, hmm_iterations: int = HMM_ITERATIONS,
    log_path: str | None = None, run_id: str = "run",
) -> tuple[Models, DataFrame]:
    """Fit both models and return them with the validation accuracy as a one-row frame.

    The classifier stops by its loss on the windows of the validation rows; each of labels, windows and accuracy
    is computed once and written.
    """
    spark = features.sparkSession
    clean = written(prepare_training(features, start), "training-rows")
    split = time_split(clean).first().split_time
    train, valid = clean.filter(F.col("time") < split), clean.filter(F.col("time") >= split)

    hmm, history = hmm_fit(train, present(train, HMM_FEATURES), max_iter=hmm_iterations)
    labels = written(pseudo_labels(train, hmm), "pseudo-labels")
    valid_labels = written(pseudo_labels(valid, hmm), "validation-labels")
    names = present(train, SEQUENCE_FEATURES)
    windows = labelled_sequences(train, confidence_filter(labels), names)
    held_out = labelled_sequences(valid, confidence_filter(valid_labels), names)
    training = fit_with_early_stopping(windows, held_out, len(names))

    scored = classify(training.model, sliding_sequences(valid, names).select("ticker", "time", "seq"))
    # The ensemble rounds its probabilities and keeps the label for the comparison.
    both = align_predictions(valid_labels.drop("confidence"), scored.drop("seq"))
    accuracy = written(validation_accuracy(ensemble_predict(both)), "accuracy")
    models = Models(hmm, training.model, names)
    if log_path:
        run_log(spark, log_path, run_id,
                {"lookback": LOOKBACK, "train_start": start, "hmm_iterations": hmm_iterations, "n_features": len(names),
                 "stop_reason": training.reason},
                {"log_likelihood": history[-1], "hmm_steps": len(history), "rounds": len(training.losses),
                 "best_round": training.best, "held_out_loss": min(training.losses, default=None),
                 "pseudo_label_kept_share": kept_share(
                    labels, MIN_LABEL_CONFIDENCE).first().kept_share, "accuracy": accuracy.first().accuracy})
    return models, accuracy


def infer_all(history: DataFrame, models: Models, lookback: int = LOOKBACK) -> DataFrame:
    """One signal per ticker with at least ``lookback`` complete rows, all tickers in one job.

    The hidden Markov model sees the latest bar alone, the classifier the last ``lookback`` bars.
    """
    needed = list(dict.fromkeys([*models.hmm.features, *models.features]))
    # The newest rows as they are: a ticker whose newest rows are incomplete gets no signal, not one for an older bar.
    last = latest_n(history, lookback).dropna(subset=needed)
    windows = sliding_sequences(last, models.features, lookback, include_current=True)
    now = windows.select("ticker", "time", "seq", *models.hmm.features)
    single = hmm_decode(now.select("ticker", "time", *models.hmm.features), models.hmm)
    scored = classify(models.classifier, now.select("ticker", "time", "seq")).drop("seq")
    both = align_predictions(single.drop("label", "confidence"), scored)
    return ensemble_predict(both)
