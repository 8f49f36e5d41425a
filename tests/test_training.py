"""Early stopping by held-out loss, what the registered training is given, and alert ids."""

import inspect
import random

import pytest
from pyspark.sql import functions as F

from barometry.constants import HMM_ITERATIONS
from barometry.models import classifier
from barometry.models.sequences import sliding_sequences
from barometry.operators import alerts
from barometry.plans import training
from barometry.plans.training import labelled_sequences
from contract import queries


def windows(spark, n, seed, noise):
    """Windows of two rows whose label is the quadrant of their mean, wrong with probability ``noise``."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
        label = 2 * (x > 0) + (y > 0) if rng.random() >= noise else rng.randrange(4)
        rows.append(([[x + rng.gauss(0, 0.1), y], [x, y + rng.gauss(0, 0.1)]], label))
    return spark.createDataFrame(rows, "seq array<array<double>>, label int")


def test_early_stopping(spark):
    train, held_out = windows(spark, 60, 1, 0.4), windows(spark, 200, 2, 0.4)
    made = classifier.fit_with_early_stopping(train, held_out, 2, lookback=2, steps=3, max_rounds=30, patience=3, seed=1)
    assert made.reason == "patience" and len(made.losses) < 30
    # The best round is the last that gained, and three rounds without a gain follow it.
    assert made.best == len(made.losses) - 4
    assert all(loss >= made.losses[made.best] - 1e-4 for loss in made.losses)
    scored = made.model.transform(classifier.as_vectors(held_out))
    assert classifier.held_out_loss(scored) == pytest.approx(made.losses[made.best], abs=1e-9)


def test_rounds_start_from_the_last_weights(spark):
    train, held_out = windows(spark, 300, 3, 0.0), windows(spark, 300, 4, 0.0)
    made = classifier.fit_with_early_stopping(train, held_out, 2, lookback=2, steps=2, max_rounds=6, patience=6)
    assert made.reason == "rounds" and made.best >= 3 and made.losses[-1] < 0.8 * made.losses[0]


def test_without_held_out_rows_all_rounds_run(spark):
    train = windows(spark, 50, 5, 0.0)
    made = classifier.fit_with_early_stopping(train, train.limit(0), 2, lookback=2, steps=1, max_rounds=2)
    assert (made.losses, made.best, made.reason) == ([], 1, "rounds")
    assert classifier.classify(made.model, train).count() == 50


def _rows_and_labels(spark):
    """Rows of two tickers with a time and a row without its keys; labels that miss rows, repeat, and lack a key."""
    rows = [(t, d, float(d + (t == "B"))) for t in ("A", "B") for d in range(12)] + [(None, 3, 1.0), ("A", None, 2.0)]
    labels = [("A", d, d % 4, 0.5) for d in range(0, 12, 2)] + [("A", 6, 3, 0.9), ("B", 5, 1, None), (None, 3, 2, 0.1),
                                                               ("A", None, 2, 0.1), ("C", 5, 0, 0.2)]
    timed = "ticker", "timestamp_seconds(day * 86400) as time"
    return (spark.createDataFrame(rows, "ticker string, day int, x double").selectExpr(*timed, "x"),
            spark.createDataFrame(labels, "ticker string, day int, label int, confidence double").selectExpr(
                *timed, "label", "confidence"))


def test_labelled_windows_are_those_of_a_join(spark, monkeypatch):
    rows, labels = _rows_and_labels(spark)
    made = labelled_sequences(rows, labels, ["x"])
    assert made.columns == ["ticker", "time", "seq", "label", "confidence"] and made.count() == 0  # 60 rows are asked for
    monkeypatch.setattr("barometry.plans.training.sliding_sequences", lambda d, f: sliding_sequences(d, f, 3))
    made = labelled_sequences(rows, labels, ["x"])
    plain = sliding_sequences(rows, ["x"], 3).select("ticker", "time", "seq").join(labels, ["ticker", "time"])
    assert made.columns == plain.columns and made.count() == 6
    assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))


def test_windows_are_not_shuffled(spark):
    """A window is 60 times its row: labels are joined before the rows become windows."""
    rows, labels = _rows_and_labels(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = labelled_sequences(rows, labels, ["x"])._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    windows = next(i for i, line in enumerate(lines) if "Window [collect_list" in line)
    assert not [line for line in lines[:windows] if "Join" in line or "Exchange" in line]


def test_blocks_of_windows_are_smaller(spark):
    rows, _ = _rows_and_labels(spark)
    plan = sliding_sequences(rows, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "div 4369" in plan and "div 262144" not in plan


@pytest.fixture
def training_call(spark, monkeypatch):
    """What the registered training hands to ``train_job``, and the frames it is given."""
    rows = spark.createDataFrame([("A", 1, 0.0)], "ticker string, time long, x double")
    signature, calls = inspect.signature(training.train_job), []

    def train_job(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        calls.append(bound.arguments)
        return "models", "accuracy"

    monkeypatch.setattr(training, "train_job", train_job)
    monkeypatch.setattr(queries, "features", lambda spark, folder: rows)
    monkeypatch.setattr(queries, "_kept", {})
    return calls, rows


def test_registered_classifier_is_trained_on_labels_of_a_whole_fit(spark, training_call):
    calls, rows = training_call
    assert queries.trained(spark, "own")[0] == "models"
    assert calls[0]["hmm_iterations"] == HMM_ITERATIONS and calls[0]["features"] is rows


def test_registered_accuracy_is_that_of_the_same_whole_fit(spark, training_call):
    calls, _ = training_call
    assert queries.QUERIES["validation_accuracy"](spark, "own") == "accuracy"
    assert queries.trained(spark, "own") == ("models", "accuracy") and len(calls) == 1
    assert calls[0]["hmm_iterations"] == HMM_ITERATIONS and calls[0]["start"] == queries.TRAIN_FROM


def test_alert_ids_differ(spark):
    rows = spark.createDataFrame(
        [("A", 1, 3, 0.9, 0), (None, 1, 3, 0.9, 0), ("A", None, 3, 0.9, 0), (None, None, 3, 0.9, 0)],
        "ticker string, t int, regime int, confidence double, prev_regime int").selectExpr(
        "ticker", "timestamp_seconds(t) as time", "regime", "confidence", "prev_regime", "'x' as regime_name",
        "array(0.1D) as ensemble_prob")
    raised = alerts.alert_rules(rows).where("alert_type = 'REGIME_SHIFT'")
    assert raised.count() == 4 and raised.select("id").distinct().count() == 4
    assert raised.exceptAll(alerts.alert_rules(rows).where(F.col("alert_type") == "REGIME_SHIFT")).count() == 0
