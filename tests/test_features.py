"""Properties of the indicators and of the feature table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barometry.operators import macro, momentum, normalise, options, volatility
from barometry.operators.ordered import Series
from barometry.plans.features import feature_pipeline


@pytest.fixture(scope="module")
def table(bars):
    return feature_pipeline(bars).cache()


@pytest.fixture(scope="module")
def macro_rows(spark):
    rows = [(f"2021-{m:02d}-{d:02d}", s, 10.0 + m + d / 10 - 12 * (s == "T10Y2Y"), m * 100 + d)
            for m in range(1, 13) for d in range(1, 29) for s in ("VIXCLS", "T10Y2Y", "BAMLH0A0HYM2")]
    rows += [(f"2022-{m:02d}-{d:02d}", "VIXCLS", 20.0 + d, 2000 + m * 100 + d) for m in range(1, 13) for d in (3, 9)]
    df = spark.createDataFrame(rows, "day string, series_id string, value double, seq long")
    return df.select(F.col("day").cast("timestamp_ntz").alias("time"), "series_id", "value", "seq")


def test_first_log_return_is_null(bars):
    out = volatility.log_return(bars)
    assert out.filter("log_return is null").count() == 3


def test_realized_vol(bars):
    pdf = volatility.realized_vol(bars).toPandas()
    assert (pdf[["rv_5d", "rv_21d", "rv_63d"]].dropna() >= 0).all().all()
    assert pdf.rv_5d.std() > pdf.rv_63d.std()


def test_ranges(bars):
    pdf = momentum.momentum(momentum.rsi(volatility.atr(bars))).toPandas()
    assert pdf.atr_pct.between(0, 1, inclusive="left").all()
    assert pdf.rsi_14.dropna().between(0, 100).all() and pdf.rsi_norm.dropna().between(-1, 1).all()
    assert pdf[["mom_5d", "mom_21d", "mom_63d"]].abs().max().max() < 0.5


def test_table_without_macro(table):
    assert len(normalise.feature_columns(table)) == 30
    counts = {r.ticker: r["count"] for r in table.groupBy("ticker").count().collect()}
    assert counts == {"SPY": 44, "QQQ": 44, "IWM": 44}
    scores = table.select(*normalise.feature_columns(table, normalised_only=True)).toPandas()
    assert scores.abs().max().max() <= 4
    assert len(normalise.model_feature_columns(table)) > 5


def test_table_with_macro_and_options(bars, macro_rows, spark):
    metrics = spark.createDataFrame(
        [("spy", 0.1, 1.2, 5.0)], "ticker string, iv_skew_proxy double, put_call_ratio double, gex_proxy double")
    assert len(normalise.feature_columns(feature_pipeline(bars, macro_rows, macro_order="seq"))) == 41
    out = feature_pipeline(bars, macro_rows, metrics, macro_order="seq")
    assert len(normalise.feature_columns(out)) == 46
    last = out.filter("ticker = 'SPY'").orderBy(F.col("time").desc()).first()
    assert last.iv_skew_proxy == 0.1 and last.gex_proxy_z == 0.0  # constant over the window


def test_block_size_does_not_matter(bars, table):
    cut = feature_pipeline(bars, series=Series(block_rows=128))
    a = table.orderBy("ticker", "time").toPandas()
    b = cut.orderBy("ticker", "time").toPandas()
    assert list(a.columns) == list(b.columns)
    for c in a.columns[2:]:
        assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_macro_join_fills_from_the_last_matching_bar(bars, macro_rows):
    wide = macro.macro_features(macro.pivot_macro(macro_rows))
    out = macro.join_macro_date_ffill(bars, wide).filter("ticker = 'SPY'").orderBy("time").toPandas()
    assert out.vix.iloc[0] == 23.0 and out.vix.iloc[5] == 23.0 and out.vix.iloc[6] == 29.0
    asof = macro.join_macro_asof(bars, wide).filter("ticker = 'SPY'").orderBy("time").toPandas()
    assert (asof.vix == out.vix).all()


def test_options_metrics(spark):
    rows = [("X", 90.0 + i, "put", 0.2 + i / 100, 100, 0.01, i) for i in range(8)]
    rows += [("X", 100.0 + i, "call", 0.1 + i / 100, 50, 0.02, 100 + i) for i in range(8)]
    rows += [("X", 1.0, "put", 0.0, None, None, 200), ("Y", 5.0, "put", 0.3, 10, 0.1, 300)]
    chain = spark.createDataFrame(
        rows, "ticker string, strike double, option_type string, implied_volatility double,"
              " open_interest long, gamma double, n long")
    got = {r.ticker: r for r in options.options_metrics(chain, ["n"]).collect()}
    assert got["X"].put_call_ratio == 2.0
    assert got["X"].iv_skew_proxy == pytest.approx(0.22 - 0.15)
    assert got["X"].gex_proxy == pytest.approx(8 * 0.02 * 50 * 100 - 8 * 0.01 * 100 * 100)
    assert got["Y"].put_call_ratio is None and got["Y"].iv_skew_proxy is None
    assert got["Y"].gex_proxy == pytest.approx(-100.0)
