"""Gaussian hidden Markov model fitted and decoded block by block.

A chain is sequential, but its transfer matrices multiply: a block of rows is summarised by one
``k x k`` product (sums for probabilities, maxima for the best path). Per pass:

1. every block is reduced to its product, in parallel;
2. the products, one small row per block, are scanned per ticker by a tree: products of ``FAN`` neighbours upwards until
   few are left, then what enters and leaves them downwards, so no task holds all blocks of a ticker;
3. every block is worked out exactly between its two ends, in parallel.

The model update needs only summed statistics; the driver sees a few hundred numbers.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barometry.constants import HMM_ITERATIONS, N_STATES
from barometry.operators.ordered import BLOCK, IDX, TICKER_TIME, Series, row_index
from barometry.session import written

HMM_BLOCK_ROWS = 65_536
_STRETCH = 256  # rows worked through one by one, all stretches of a block side by side
_MIN_COVARIANCE, _PRIOR_COVARIANCE = 1e-3, 1e-2


@dataclass
class HmmModel:
    features: list[str]
    start: np.ndarray    # (k,)
    trans: np.ndarray    # (k, k)
    means: np.ndarray    # (k, d)
    covs: np.ndarray     # (k, d, d)
    regime_of: list[int]  # state -> regime

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.features, self.start.tolist(), self.trans.ravel().tolist(),
               self.means.ravel().tolist(), self.covs.ravel().tolist(), self.regime_of)
        spark.createDataFrame([row], _MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "HmmModel":
        r = spark.read.schema(_MODEL_SCHEMA).parquet(path).first()
        k, d = len(r.start), len(r.features)
        return HmmModel(
            list(r.features), np.array(r.start), np.array(r.trans).reshape(k, k),
            np.array(r.means).reshape(k, d), np.array(r.covs).reshape(k, d, d), list(r.regime_of))


_MODEL_SCHEMA = ("features array<string>, start array<double>, trans array<double>, "
                 "means array<double>, covs array<double>, regime_of array<int>")


# -- small matrix helpers, run inside tasks ------------------------------------------------------

def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for s, (m, c) in enumerate(zip(means, covs)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, s] = -0.5 * ((z * z).sum(0) + len(m) * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()
    return out


def log_transfers(x: np.ndarray, model: HmmModel, first: bool) -> np.ndarray:
    """Log transfer matrix of every row as (stretches, rows, k, k), filled up with identities.

    The first row of a chain has the start distribution in every row of its matrix, so whatever
    enters it has no influence.
    """
    k = len(model.start)
    with np.errstate(divide="ignore"):
        rows = np.log(model.trans)[None] + log_density(x, model.means, model.covs)[:, None, :]
        if first:
            rows[0] += np.log(model.start)[None] - np.log(model.trans)
        identity = np.log(np.eye(k))
    width = min(_STRETCH, len(x))
    pad = -len(x) % width
    rows = np.concatenate([rows, np.broadcast_to(identity, (pad, k, k))])
    return rows.reshape(-1, width, k, k)


def _times(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    """Product of log matrices: log-sum-exp of sums, or their maximum."""
    s = a[..., :, :, None] + b[..., None, :, :]
    top = s.max(-2)
    if best:
        return top
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(s - safe[..., None, :]).sum(-2))


def products(m: np.ndarray, best: bool) -> np.ndarray:
    """Product of each stretch, (stretches, k, k)."""
    p = m[:, 0]
    for t in range(1, m.shape[1]):
        p = _times(p, m[:, t], best)
    return p


def entering(p: np.ndarray, into: np.ndarray, best: bool) -> np.ndarray:
    """Log vector entering each of a list of products, and the one after the last."""
    rows = [into]
    for one in p:
        rows.append(_times(rows[-1][None, :], one, best)[0])
    return np.stack(rows)


def leaving(p: np.ndarray, out_of: np.ndarray) -> np.ndarray:
    """Log backward vector at the end of each product, and the one before the first (at index 0)."""
    rows = [out_of]
    for one in p[::-1]:
        rows.append(_times(one, rows[-1][:, None], False)[:, 0])
    return np.stack(rows[::-1])


def best_exits(p: np.ndarray, into: np.ndarray, final: int) -> list[int]:
    """State leaving each product on the best path that ends in ``final``."""
    d = entering(p, into, True)
    exits = [final]
    for c in range(len(p) - 1, 0, -1):
        exits.append(int(np.argmax(d[c] + p[c][:, exits[-1]])))
    return exits[::-1]


def forward_backward(m: np.ndarray, into: np.ndarray, out_of: np.ndarray, n: int):
    """Log posteriors (n, k) and log pair posteriors (n, k, k) of a block between its two ends."""
    p = products(m, False)
    a = entering(p, into, False)[:-1]
    b = leaving(p, out_of)[1:]
    width, k = m.shape[1], m.shape[2]
    before = np.empty((len(m), width, k))
    after = np.empty((len(m), width, k))
    for t in range(width):
        before[:, t] = a
        a = _times(a[:, None, :], m[:, t], False)[:, 0]
        back = width - 1 - t
        after[:, back] = b
        b = _times(m[:, back], b[:, :, None], False)[:, :, 0]
    pairs = (before[..., :, None] + m + after[..., None, :]).reshape(-1, k, k)[:n]
    pairs -= pairs.max((1, 2), keepdims=True)
    pairs = np.exp(pairs)
    pairs /= pairs.sum((1, 2), keepdims=True)
    return pairs.sum(1), pairs


def best_path(m: np.ndarray, into: np.ndarray, final: int, n: int) -> np.ndarray:
    """Most likely states of a block, given what enters and the state it ends in."""
    p = products(m, True)
    state = np.array(best_exits(p, into, final))
    d = entering(p, into, True)[:-1]
    came_from = np.empty(m.shape[:3], dtype=np.int64)
    for t in range(m.shape[1]):
        scores = d[:, :, None] + m[:, t]
        came_from[:, t] = scores.argmax(1)
        d = scores.max(1)
    path = np.empty(m.shape[:2], dtype=np.int64)
    for t in range(m.shape[1] - 1, -1, -1):
        path[:, t] = state
        state = came_from[np.arange(len(m)), t, state]
    return path.ravel()[:n]


# -- Spark passes ------------------------------------------------------------------------------------

def hmm_rows(df: DataFrame, features: Sequence[str], block_rows: int = HMM_BLOCK_ROWS,
             series: Series = TICKER_TIME) -> DataFrame:
    """Rows laid out for the passes: ticker, time, position, block and feature vector."""
    vector = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    return row_index(df.select(series.key, series.order, vector), series).withColumn(
        BLOCK, F.expr(f"_idx div {block_rows}L"))


def _features_of(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["x"].to_numpy())


def last_block(rows: DataFrame) -> int | None:
    return rows.agg(F.max(BLOCK)).first()[0]  # one number


def _ends(rows: DataFrame, model: HmmModel, decode: bool, last: int | None = None) -> DataFrame:
    """What enters and leaves each block, one row per block. ``last`` is the highest block number, if known."""
    k = len(model.start)

    def reduce_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        m = log_transfers(_features_of(pdf), model, pdf[IDX].iloc[0] == 0)
        out = {"ticker": key[0], BLOCK: key[1]}
        for name, best in (("total", False), ("best", True)):
            p = products(m, best) if not best or decode else m[:1, 0]
            q = p[0]
            for one in p[1:]:
                q = _times(q, one, best)
            out[name] = q.ravel().tolist()
        return pd.DataFrame([out])

    reduced = rows.groupBy("ticker", BLOCK).applyInPandas(
        reduce_block, f"ticker string, {BLOCK} long, total array<double>, best array<double>")
    last = last_block(rows) if last is None else last
    if last is None or last < FAN:
        return _scan_top(reduced, k, decode)
    # Up: products of FAN neighbours, until few are left per ticker. The tables hold one small row per block.
    levels = [written(reduced, "hmm-level")]
    while last >= FAN:
        levels.append(written(_products_above(levels[-1], k, decode), "hmm-level"))
        last //= FAN
    # Down: what enters and leaves a product, carried on to those it is made of.
    ends = _scan_top(levels.pop(), k, decode)
    while levels:
        ends = written(_ends_below(levels.pop(), ends, k), "hmm-ends")
    return ends


#: Block products that are multiplied or scanned in one task.
FAN = 64
_ENDS = (f"ticker string, {BLOCK} long, into array<double>, out_of array<double>, loglik double, "
         "into_best array<double>, exit_state long")


def _matrices(column: pd.Series, k: int) -> np.ndarray:
    return np.stack(column.to_numpy()).reshape(-1, k, k)


def _folded(column: pd.Series, k: int, best: bool) -> np.ndarray:
    out, *others = _matrices(column, k)
    for one in others:
        out = _times(out, one, best)
    return out


def _products_above(level: DataFrame, k: int, decode: bool) -> DataFrame:
    """The products of ``FAN`` neighbours each, numbered like blocks."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        total = _folded(pdf["total"], k, False).ravel().tolist()
        best = _folded(pdf["best"], k, True).ravel().tolist() if decode else total
        return pd.DataFrame([{"ticker": key[0], BLOCK: key[1], "total": total, "best": best}])

    above = level.withColumn("_above", F.expr(f"{BLOCK} div {FAN}L"))
    return above.groupBy("ticker", "_above").applyInPandas(fold, level.schema)


def _inner_ends(pdf: pd.DataFrame, k: int, into, out_of, into_best, exit_state: int | None, loglik: float | None) -> pd.DataFrame:
    """What enters and leaves each of a list of neighbouring products, between the ends of the whole list.

    Without an exit state the best one is taken; without a likelihood the list's own."""
    p, b = _matrices(pdf["total"], k), _matrices(pdf["best"], k)
    ahead, back = entering(p, into, False), leaving(p, out_of)[1:]
    best = entering(b, into_best, True)
    out = pdf[["ticker", BLOCK]].copy()
    out["into"] = list(ahead[:-1] - ahead[:-1].max(1, keepdims=True))
    out["out_of"] = list(back - back.max(1, keepdims=True))
    out["loglik"] = 0.0
    out.loc[out.index[-1], "loglik"] = float(np.logaddexp.reduce(ahead[-1])) if loglik is None else loglik
    out["into_best"] = list(best[:-1] - best[:-1].max(1, keepdims=True))
    out["exit_state"] = best_exits(b, into_best, int(best[-1].argmax()) if exit_state is None else exit_state)
    return out


def _scan_top(level: DataFrame, k: int, decode: bool) -> DataFrame:
    """The ends of at most ``FAN`` products a ticker, from the beginning to the end of its chain."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        if not decode:
            pdf["best"] = pdf["total"]
        return _inner_ends(pdf, k, np.full(k, -np.log(k)), np.zeros(k), np.zeros(k), None, None)

    return level.groupBy("ticker").applyInPandas(scan, _ENDS)


def _ends_below(level: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """The ends of the products of a level from those of the level above."""

    def spread(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or above.empty:
            return pd.DataFrame({c: [] for c in ("ticker", BLOCK, "into", "out_of", "loglik", "into_best", "exit_state")})
        end = above.iloc[0]
        vector = lambda name: np.array(end[name])
        return _inner_ends(pdf.sort_values(BLOCK), k, vector("into"), vector("out_of"), vector("into_best"),
                           int(end["exit_state"]), float(end["loglik"]))

    below = level.withColumn("_above", F.expr(f"{BLOCK} div {FAN}L"))
    return below.groupBy("ticker", "_above").cogroup(ends.groupBy("ticker", BLOCK)).applyInPandas(spread, _ENDS)


def _statistics(rows: DataFrame, model: HmmModel, last: int | None = None) -> np.ndarray:
    """Summed expected statistics of all blocks as one flat vector."""
    k = len(model.start)

    def block_statistics(key: tuple, pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or ends.empty:
            return pd.DataFrame({"stats": []})
        pdf, end = pdf.sort_values(IDX), ends.iloc[0]
        x, first = _features_of(pdf), pdf[IDX].iloc[0] == 0
        m = log_transfers(x, model, first)
        gamma, pairs = forward_backward(m, np.array(end["into"]), np.array(end["out_of"]), len(x))
        start = gamma[0] if first else np.zeros(k)
        trans = pairs[1:].sum(0) if first else pairs.sum(0)
        flat = np.concatenate([
            [end["loglik"]], start, trans.ravel(), gamma.sum(0), (gamma.T @ x).ravel(),
            np.einsum("ns,ni,nj->sij", gamma, x, x, optimize=True).ravel()])
        return pd.DataFrame({"stats": [flat]})

    ends = _ends(rows, model, decode=False, last=last)
    stats = rows.groupBy("ticker", BLOCK).cogroup(ends.groupBy("ticker", BLOCK)).applyInPandas(
        block_statistics, "stats array<double>")
    summed = stats.select(F.posexplode("stats").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
    return np.array([r.v for r in summed.orderBy("pos").collect()])


def _updated(model: HmmModel, stats: np.ndarray) -> tuple[float, HmmModel]:
    k, d = model.means.shape
    cuts = np.cumsum([1, k, k * k, k, k * d])
    loglik, start, trans, weight, first, second = np.split(stats, cuts)
    weight = np.maximum(weight, 1e-10)
    means = first.reshape(k, d) / weight[:, None]
    second = second.reshape(k, d, d)
    spread = second - weight[:, None, None] * means[:, :, None] * means[:, None, :]
    covs = (spread + _PRIOR_COVARIANCE * np.eye(d)) / weight[:, None, None]
    covs = (covs + covs.transpose(0, 2, 1)) / 2
    lowest = np.linalg.eigvalsh(covs)[:, 0]
    covs += np.maximum(1e-6 - lowest, 0)[:, None, None] * np.eye(d)
    trans = trans.reshape(k, k) + 1e-12
    start = start + 1e-12
    return float(loglik[0]), HmmModel(
        model.features, start / start.sum(), trans / trans.sum(1, keepdims=True), means, covs, model.regime_of)


def hmm_fit(
    df: DataFrame, features: Sequence[str], n_states: int = N_STATES, max_iter: int = HMM_ITERATIONS,
    tol: float = 1e-2, seed: int = 42, block_rows: int = HMM_BLOCK_ROWS,
) -> tuple[HmmModel, list[float]]:
    """Fit by expectation maximisation; returns the model and the log-likelihood of each step.

    The rows are kept partitioned by block, so a step shuffles one small row per block only.
    """
    features = list(features)
    rows = hmm_rows(df, features, block_rows).repartition("ticker", BLOCK).persist()
    try:
        mixture = GaussianMixture(k=n_states, seed=seed, maxIter=20).fit(
            rows.select(array_to_vector("x").alias("features")))
        parts = mixture.gaussians
        d = len(features)
        model = HmmModel(
            features, np.full(n_states, 1.0 / n_states), np.full((n_states, n_states), 1.0 / n_states),
            np.array([g.mean.toArray() for g in parts]),
            np.array([g.cov.toArray() + _MIN_COVARIANCE * np.eye(d) for g in parts]), list(range(n_states)))
        history: list[float] = []
        last = last_block(rows)
        for _ in range(max_iter):
            loglik, better = _updated(model, _statistics(rows, model, last))
            history.append(loglik)
            if len(history) > 1 and history[-1] - history[-2] < tol:
                break
            model = better
    finally:
        rows.unpersist()
    model.regime_of = state_regimes(df.sparkSession, model)
    return model, history


def hmm_decode(df: DataFrame, model: HmmModel, block_rows: int = HMM_BLOCK_ROWS) -> DataFrame:
    """Best-path regime (``label``), its regime probabilities (``hmm_prob``) and ``confidence`` per row."""
    regimes = list(model.regime_of)

    def decode_block(key: tuple, pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or ends.empty:
            return pd.DataFrame({"ticker": [], "time": [], "label": [], "hmm_prob": []})
        pdf, end = pdf.sort_values(IDX), ends.iloc[0]
        x = _features_of(pdf)
        m = log_transfers(x, model, pdf[IDX].iloc[0] == 0)
        gamma, _ = forward_backward(m, np.array(end["into"]), np.array(end["out_of"]), len(x))
        path = best_path(m, np.array(end["into_best"]), int(end["exit_state"]), len(x))
        by_regime = np.empty_like(gamma)
        by_regime[:, regimes] = gamma
        return pd.DataFrame({
            "ticker": pdf["ticker"].to_numpy(), "time": pdf["time"].to_numpy(),
            "label": np.array(regimes)[path], "hmm_prob": list(by_regime)})

    rows = hmm_rows(df, model.features, block_rows)
    time_type = df.schema["time"].dataType.simpleString()
    out = rows.groupBy("ticker", BLOCK).cogroup(
        _ends(rows, model, decode=True).groupBy("ticker", BLOCK)
    ).applyInPandas(decode_block, f"ticker string, time {time_type}, label int, hmm_prob array<double>")
    return out.withColumn("confidence", F.array_max("hmm_prob"))


# -- states to regimes -------------------------------------------------------------------------------

def state_means(posteriors: DataFrame, features: Sequence[str]) -> DataFrame:
    """Posterior-weighted mean of each feature per state (``probs``: array of state probabilities)."""
    per_state = posteriors.select(F.posexplode("probs").alias("state", "_w"), *features)
    return per_state.groupBy("state").agg(*[
        (F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in features])


def label_states(means: DataFrame) -> DataFrame:
    """Regime per state from the state means, one row per state, found by column name.

    Highest volatility is high_vol; of the rest the highest trend is trending; of the rest the
    largest momentum is mean_reverting; the last is choppy. Ties go to the state the sort meets.
    """
    def col(name: str):
        return F.col(name) if name in means.columns else F.lit(0.0)

    scored = means.select(
        "state", (col("rv_21d_zscore") + col("vix_zscore")).alias("_vol"), col("trend_r").alias("_trend"),
        F.abs(col("tsi") + col("mom_21d")).alias("_mom"), F.lit(None).cast("int").alias("regime"))
    for regime, order in (
        (3, [F.col("_vol").desc(), F.col("state").desc()]),
        (0, [F.col("_trend").desc(), F.col("state")]),
        (1, [F.col("_mom").desc(), F.col("state")]),
    ):
        # One row per hidden state: four rows in all.
        first = F.row_number().over(Window.partitionBy(F.col("regime").isNull()).orderBy(*order)) == 1
        scored = scored.withColumn(
            "regime", F.when(F.col("regime").isNull() & first, regime).otherwise(F.col("regime")))
    return scored.select("state", F.coalesce("regime", F.lit(2)).alias("regime"))


def state_regimes(spark: SparkSession, model: HmmModel) -> list[int]:
    names = ", ".join(f"{c} double" for c in model.features)
    rows = [(s, *map(float, m)) for s, m in enumerate(model.means)]
    labelled = label_states(spark.createDataFrame(rows, f"state int, {names}"))
    return [r.regime for r in labelled.orderBy("state").collect()]
