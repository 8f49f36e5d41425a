"""Block-wise operators against plain pandas, with blocks far smaller than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barometry.operators import ordered
from barometry.operators.ordered import Ewm, Series

SMALL = Series(block_rows=50, run_rows=20, runs=2)


@pytest.fixture(scope="module")
def data(spark):
    """A hot ticker, a short one, leading and interior nulls, a constant stretch."""
    rng = np.random.default_rng(7)
    frames = []
    for ticker, n in (("HOT", 700), ("ONE", 1), ("FEW", 30)):
        x = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        if n > 500:
            x[300:380] = x[300]
        late = pd.Series(x).where(np.arange(n) >= 5)
        holes = pd.Series(x).where(np.arange(n) % 7 != 3)
        frames.append(pd.DataFrame({
            "ticker": ticker, "time": pd.date_range("2020-01-01", periods=n, freq="h"),
            "x": x, "late": late, "holes": holes}))
    pdf = pd.concat(frames, ignore_index=True)
    schema = "ticker string, time timestamp_ntz, x double, late double, holes double"
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema).repartition(4)
    return pdf, df.cache()


def compare(pdf, expected, df, name, tol=1e-9):
    got = df.select("ticker", "time", name).toPandas().merge(
        pdf[["ticker", "time"]].assign(want=expected.to_numpy()), on=["ticker", "time"])
    assert len(got) == len(pdf) == df.count()
    assert (got[name].isna() == got.want.isna()).all()
    assert np.allclose(got[name].fillna(0).astype(float), got.want.fillna(0).astype(float), rtol=tol, atol=tol)


def test_row_index_counts_across_buckets(data):
    pdf, df = data
    compare(pdf, pdf.groupby("ticker").cumcount(),
            ordered.row_index(df, Series(bucket="day")).withColumnRenamed("_idx", "i"), "i")


def test_forward_fill(data):
    pdf, df = data
    compare(pdf, pdf.groupby("ticker").holes.ffill(), ordered.forward_fill(df, ["holes"], Series(bucket="day")), "holes")


@pytest.mark.parametrize("column", ["x", "late", "holes"])
def test_rolling(data, column):
    pdf, df = data
    groups = pdf.groupby("ticker")[column]
    out = ordered.over_blocks(df, lambda d: d.withColumns({
        "m": ordered.rolling_mean(F.col(column), 9, SMALL), "s": ordered.rolling_std(F.col(column), 9, SMALL)}), 9, SMALL)
    compare(pdf, groups.transform(lambda g: g.rolling(9).mean()), out, "m")
    compare(pdf, groups.transform(lambda g: g.rolling(9).std()), out, "s", 1e-6)


@pytest.mark.parametrize("n", [20, 33])  # the length of a run, and another
@pytest.mark.parametrize("column", ["x", "late", "holes"])
def test_rolling_zscores(data, column, n):
    pdf, df = data

    def want(g):
        out = []
        for i in range(len(g)):
            frame = g.iloc[max(0, i - n + 1):i + 1]
            if len(frame) < n or frame.isna().any():
                out.append(np.nan)
            elif frame.min() == frame.max():
                out.append(0.0)
            else:
                out.append(np.clip((frame.iloc[-1] - frame.mean()) / max(frame.std(), 1e-8), -2, 2))
        return pd.Series(out, g.index)

    out = ordered.over_blocks(df, lambda d: ordered.rolling_zscores(d, {"z": column}, n, 2.0, SMALL), n, SMALL)
    compare(pdf, pdf.groupby("ticker")[column].transform(want), out, "z", 1e-7)


@pytest.mark.parametrize("alpha", [0.5, 2 / 15, 0.02])  # the last needs runs longer than the default
@pytest.mark.parametrize("adjust", [False, True])
def test_ewm(data, alpha, adjust):
    pdf, df = data
    series = Series(block_rows=300, run_rows=20, runs=6)
    out = ordered.over_blocks(
        df, lambda d: ordered.ewm_mean(d, [Ewm("y", "x", alpha, adjust), Ewm("y2", "late", alpha, adjust)], series),
        ordered.ewm_reach(alpha), series)
    for name, column in (("y", "x"), ("y2", "late")):
        compare(pdf, pdf.groupby("ticker")[column].transform(
            lambda g: g.ewm(alpha=alpha, adjust=adjust).mean()), out, name, 1e-10)


@pytest.mark.parametrize("alpha", [0.1, 0.5, 0.9, 0.99])
@pytest.mark.parametrize("adjust", [False, True])
def test_ewm_with_inner_nulls_and_any_alpha(data, alpha, adjust):
    """Time goes on over a null: pandas' rule without ignore_na. A null has no result of its own."""
    pdf, df = data
    for series in (ordered.TICKER_TIME, Series(block_rows=200, run_rows=20, runs=3)):
        out = ordered.over_blocks(
            df, lambda d: ordered.ewm_mean(d, [Ewm("y", "holes", alpha, adjust)], series), ordered.ewm_reach(alpha), series)
        compare(pdf, pdf.groupby("ticker")["holes"].transform(
            lambda g: g.ewm(alpha=alpha, adjust=adjust).mean().where(g.notna())), out, "y", 1e-10)


def test_rows_without_key_or_time_are_kept(spark):
    rows = [("A", i, float(i)) for i in range(1, 91)] + [("A", None, -1.0)] * 3 + [(None, 5, -2.0), (None, None, -3.0)]
    df = spark.createDataFrame(rows, "ticker string, day int, close double").selectExpr(
        "ticker", "timestamp_seconds(day * 86400) as time", "close")
    for series in (ordered.TICKER_TIME, Series(block_rows=7), ordered.INTRADAY):
        out = ordered.diff(df, {"move": "close"}, 1, series).toPandas()
        assert len(out) == len(rows)
        placed = out[out.ticker.notna() & out.time.notna()].sort_values("time")
        assert placed.move.iloc[1:].eq(1.0).all() and np.isnan(placed.move.iloc[0])
        assert out[out.ticker.isna() | out.time.isna()].move.isna().all()
        filled = ordered.forward_fill(df.withColumn("v", F.expr("if(close > 10, null, close)")), ["v"], series).toPandas()
        assert len(filled) == len(rows) and filled[filled.close > 10].v.eq(10.0).all()


def test_blocks_do_not_change_results(data):
    _, df = data
    whole = ordered.diff(df, {"d": "x"}, 3)
    cut = ordered.diff(df, {"d": "x"}, 3, Series(block_rows=2))
    assert whole.exceptAll(cut).count() == 0 == cut.exceptAll(whole).count()


def test_latest_and_dedupe(data):
    pdf, df = data
    assert ordered.latest_n(df, 5).count() == 11
    twice = df.withColumn("v", F.lit(1)).unionByName(df.withColumn("v", F.lit(2)))
    kept = ordered.dedupe_keep_last(twice, ["ticker", "time"], ["v"])
    assert kept.count() == len(pdf) and kept.filter("v = 1").count() == 0


def test_one_shuffle_for_all_windows(data):
    _, df = data
    out = ordered.over_blocks(df, lambda d: ordered.rolling_zscores(
        ordered.ewm_mean(d, [Ewm("y", "x", 0.1)]), {"z": "y"}, 252, 4.0), 1500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") - plan.count("_bucket") <= 2
    assert sum("Exchange hashpartitioning" in line and "_block" in line for line in plan.splitlines()) == 1
