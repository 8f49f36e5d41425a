"""Hidden Markov model against brute force, labelling, ensemble and alert rules."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barometry.models import hmm, sequences
from barometry.models.ensemble import ensemble_predict
from barometry.operators import alerts

RNG = np.random.default_rng(42)


def model(k=3, d=2):
    means = RNG.normal(0, 2, (k, d))
    trans = RNG.dirichlet(np.ones(k) * 2, k)
    return hmm.HmmModel([f"x{i}" for i in range(d)], RNG.dirichlet(np.ones(k)), trans, means,
                        np.stack([np.eye(d) * (s + 1) for s in range(k)]), [2, 0, 1][:k])


def brute_force(m, x):
    """Posteriors, best path and log-likelihood by enumerating every path."""
    logb = hmm.log_density(x, m.means, m.covs)
    paths = list(itertools.product(range(len(m.start)), repeat=len(x)))
    scores = np.array([
        np.log(m.start[p[0]]) + logb[0, p[0]]
        + sum(np.log(m.trans[a, b]) + logb[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))
        for p in paths])
    total = np.logaddexp.reduce(scores)
    gamma = np.zeros((len(x), len(m.start)))
    for p, s in zip(paths, np.exp(scores - total)):
        gamma[np.arange(len(x)), p] += s
    return gamma, np.array(paths[int(scores.argmax())]), total


@pytest.mark.parametrize("block_rows", [3, 100])
def test_decode_matches_brute_force(spark, block_rows):
    m = model()
    x = RNG.normal(0, 2, (8, 2))
    pdf = pd.DataFrame(x, columns=["x0", "x1"]).assign(ticker="A", time=pd.date_range("2024-01-01", periods=8))
    df = spark.createDataFrame(pdf, "x0 double, x1 double, ticker string, time timestamp_ntz")
    got = hmm.hmm_decode(df, m, block_rows).orderBy("time").toPandas()
    gamma, path, total = brute_force(m, x)
    assert np.allclose(np.stack(got.hmm_prob)[:, m.regime_of], gamma)
    assert got.label.tolist() == [m.regime_of[s] for s in path]
    stats = hmm._statistics(hmm.hmm_rows(df, m.features, block_rows), m)
    assert stats[0] == pytest.approx(total)
    assert stats[1:4] == pytest.approx(gamma[0]) and stats[4:13].sum() == pytest.approx(7)


@pytest.mark.parametrize("fan", [2, 3])
def test_tree_scan_matches_brute_force(spark, monkeypatch, fan):
    """Blocks of one row, scanned over several levels, and a second ticker of one block."""
    monkeypatch.setattr(hmm, "FAN", fan)
    test_decode_matches_brute_force(spark, 1)
    m = model()
    x = np.random.default_rng(1).normal(0, 2, (9, 2))
    pdf = pd.DataFrame(x, columns=["x0", "x1"]).assign(ticker=["A"] * 8 + ["B"], time=pd.date_range("2024-01-01", periods=9))
    df = spark.createDataFrame(pdf, "x0 double, x1 double, ticker string, time timestamp_ntz")
    got = hmm.hmm_decode(df, m, 1).orderBy("ticker", "time").toPandas()
    for ticker, own in (("A", x[:8]), ("B", x[8:])):
        gamma, path, _ = brute_force(m, own)
        mine = got[got.ticker == ticker]
        assert np.allclose(np.stack(mine.hmm_prob)[:, m.regime_of], gamma)
        assert mine.label.tolist() == [m.regime_of[s] for s in path]
    assert hmm.hmm_decode(df.limit(0), m).count() == 0


def test_many_blocks_of_one_ticker(spark):
    """Ten thousand blocks of three rows: the same as one chain worked through in order."""
    m = model()
    x = np.random.default_rng(3).normal(0, 2, (30_000, 2))
    pdf = pd.DataFrame(x, columns=["x0", "x1"]).assign(ticker="A", time=pd.date_range("2000-01-01", periods=len(x), freq="min"))
    df = spark.createDataFrame(pdf, "x0 double, x1 double, ticker string, time timestamp_ntz").repartition(8)
    rows = hmm.hmm_rows(df, m.features, 3)
    ends = hmm._ends(rows, m, decode=True)
    assert ends.count() == 10_000
    whole = hmm.log_transfers(x, m, True)
    k = len(m.start)
    gamma, _ = hmm.forward_backward(whole, np.full(k, -np.log(k)), np.zeros(k), len(x))
    d = hmm.entering(hmm.products(whole, True), np.zeros(k), True)
    path = hmm.best_path(whole, np.zeros(k), int(d[-1].argmax()), len(x))
    got = hmm.hmm_decode(df, m, 3).orderBy("time").toPandas()
    assert np.allclose(np.stack(got.hmm_prob)[:, m.regime_of], gamma, atol=1e-9)
    assert got.label.tolist() == [m.regime_of[s] for s in path]
    assert sum(r.loglik for r in ends.select("loglik").collect()) == pytest.approx(
        float(hmm.np.logaddexp.reduce(hmm.entering(hmm.products(whole, False), np.full(k, -np.log(k)), False)[-1])))


def test_fit_on_random_data(spark):
    pdf = pd.DataFrame(np.random.default_rng(42).normal(size=(500, 4)), columns=["a", "b", "c", "d"])
    pdf["ticker"], pdf["time"] = "A", pd.date_range("2020-01-01", periods=500)
    df = spark.createDataFrame(pdf, "a double, b double, c double, d double, ticker string, time timestamp_ntz")
    fitted, history = hmm.hmm_fit(df, ["a", "b", "c", "d"], max_iter=4, block_rows=128)
    assert all(b >= a - 1.0 for a, b in zip(history, history[1:]))
    assert sorted(fitted.regime_of) == [0, 1, 2, 3]
    got = hmm.hmm_decode(df, fitted, 128).toPandas()
    assert len(got) == 500 and got.label.between(0, 3).all()
    assert np.allclose(np.stack(got.hmm_prob).sum(1), 1)
    other = hmm.hmm_decode(df, fitted, 4096).toPandas()
    assert (got.sort_values("time").label.to_numpy() == other.sort_values("time").label.to_numpy()).all()


def test_label_states(spark):
    rows = [(0, 0.0, 0.0, 0.9, 1.0, 0.0), (1, 3.0, 2.0, 0.0, 0.0, 0.0), (2, 0.0, 0.1, 0.1, -30.0, 0.1), (3, 0.0, 0.0, 0.0, 1.0, 0.0)]
    means = spark.createDataFrame(
        rows, "state int, rv_21d_zscore double, vix_zscore double, trend_r double, tsi double, mom_21d double")
    assert {r.state: r.regime for r in hmm.label_states(means).collect()} == {0: 0, 1: 3, 2: 1, 3: 2}


def test_sequences(spark, bars):
    train = sequences.sliding_sequences(bars, ["close"], 60)
    latest = sequences.sliding_sequences(bars, ["close"], 60, include_current=True)
    assert train.count() == 3 * 240 and latest.count() == 3 * 241
    r = latest.filter("ticker = 'SPY'").orderBy(F.col("time").desc()).first()
    assert r.seq[-1][0] == r.close


def test_ensemble(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0])], "hmm_prob array<double>, seq_prob array<double>")
    r = ensemble_predict(df).first()
    assert r.ensemble_prob == [0.4, 0, 0, 0.6] and r.regime == 3
    assert r.confidence == 0.6 and r.regime_name == "high_vol"


@pytest.mark.parametrize("ticker, before, now, confidence, expected", [
    ("SPY", 0, 3, 0.85, [("HIGH_VOL_ENTERED", 3), ("REGIME_SHIFT", 3)]),
    ("QQQ", 1, 1, 0.35, [("CONFIDENCE_LOW", 1)]),
    ("AAPL", 0, 0, 0.92, []),
    ("IWM", 2, 0, 0.9, [("REGIME_SHIFT", 2)]),
    ("NEW", None, 3, None, [("HIGH_VOL_ENTERED", 3)]),
])
def test_alert_rules(spark, ticker, before, now, confidence, expected):
    df = spark.createDataFrame(
        [("2024-01-02", ticker, now, "name", confidence, [0.1])],
        "time string, ticker string, regime int, regime_name string, confidence double, ensemble_prob array<double>",
    ).withColumn("time", F.col("time").cast("timestamp_ntz"))
    known = spark.createDataFrame([(ticker, before)] if before is not None else [], "ticker string, regime int")
    got = alerts.alert_rules(alerts.regime_transitions(df, known)).collect()
    assert sorted((r.alert_type, r.severity) for r in got) == expected
