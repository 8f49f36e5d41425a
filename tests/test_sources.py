"""Landing, validation, stores, envelopes and read models."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from barometry import schemas
from barometry.operators import aggregates, reads
from barometry.sources import envelopes, landing, store


def test_landed_csv_to_bars(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{path}/p.csv", "w") as f:
        f.write("Date,ticker,Open,High,Low,Close,Volume\n"
                "2024-01-02T00:00:00Z,spy,472,475,471,474,100\n2024-01-03T00:00:00Z, spy ,474,475,470,473,110\n"
                "2024-01-04T00:00:00Z,SPY,473,474,470,,120\n")
        f.write("not a date,SPY,x,y,z,w,v\n")
    landed, bad = landing.read_landed(spark, path)
    assert [r._corrupt for r in bad.collect()] == ["not a date,SPY,x,y,z,w,v"]
    out = landing.scan_bars(landed, ["Volume"]).orderBy("time").collect()
    assert [(r.ticker, r.close, r.volume) for r in out] == [("SPY", 474.0, 100), ("SPY", 473.0, 110)]
    assert landing.scan_bars(landed.limit(0), ["Volume"]).count() == 0


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_landed_frames_take_any_action(spark, kind):
    """Both frames can be counted; malformed lines keep their text and file."""
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    lines = {"csv": ["Datetime,Ticker,Open,High,Low,Close,Volume", "2024-01-02,SPY,1,2,1,2,5", "", "2024-01-03,SPY,1,2", "x,y,z,1,2,3,4"],
             "json": ['{"Date": "2024-01-02T00:00:00Z", "ticker": "SPY", "Close": 2.0}', "", '{"Date": "2024', '[1']}[kind]
    with open(f"{path}/p.{kind}", "w") as f:
        f.write("\n".join(lines))
    rows, bad = landing.read_landed(spark, path, kind)
    assert rows.count() == 1 and bad.count() == 2
    assert {r._corrupt for r in bad.collect()} == set(lines[-2:])
    assert all(r.file.endswith(f"p.{kind}") for r in bad.collect())
    assert rows.where("Close = 2").count() == 1 and bad.where("_corrupt is null").count() == 0


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_landed_lines_are_parsed_once(spark, kind):
    """No frame parses a line twice, and one frame may hold readable and unreadable rows."""
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    lines = {"csv": ["\"Date\", Ticker,Open,High,Low,Close,Volume", "2024-01-02,SPY,1,2,1,2,5", "date,SPY,1", "\t", "x,y,z,1,2,3,4"],
             "json": ['{"Date": "2024-01-02T00:00:00Z", "ticker": "SPY", "Close": 2.0}', '{"Date": "2024', "\t", "{}"]}[kind]
    with open(f"{path}/p.{kind}", "w") as f:
        f.write("\n".join(lines))
    frames = [*landing.read_landed(spark, path, kind), landing.read_landed(spark, path, kind, split=False)]
    for df in frames:
        assert df._jdf.queryExecution().optimizedPlan().toString().count(f"from_{kind}(") == 1
    rows, bad, both = frames
    assert rows.columns == schemas.LANDED_PRICES.names and bad.columns == ["_corrupt", "file"]
    assert both.where("_corrupt is null").select(*rows.columns).exceptAll(rows).isEmpty()
    assert both.where("_corrupt is not null").select(*bad.columns).exceptAll(bad).isEmpty()
    assert (rows.count(), bad.count(), both.count()) == {"csv": (1, 3, 4), "json": (3, 1, 4)}[kind]


def test_failing_ticker_is_isolated(bars):
    out = landing.scan_universe(bars, ["SPY", "BAD", "QQQ"])
    n = {r.ticker: r.n for r in out.groupBy("ticker").agg(F.count("close").alias("n")).collect()}
    assert n == {"SPY": 300, "BAD": 0, "QQQ": 300}


def test_macro_observations(spark):
    body = ('{"observations":[{"date":"2024-01-03","value":"4.1"},{"date":"2024-01-02","value":"."},'
            '{"date":"2024-01-04","value":"4.3"},{"date":"2024-01-05","value":"x"},{"value":"1"},'
            '{"date":"2024-01-06","value":"4.2"}]}')
    got = landing.parse_macro_observations(spark.createDataFrame([("DGS10", body)], "series_id string, body string"))
    assert [r.value for r in got.orderBy("time").collect()] == [4.1, 4.3, 4.2]


def test_validation(bars):
    one = bars.limit(1).withColumn("source", F.lit("yfinance"))
    dirty = (one.withColumn("ticker", F.lit(" spy "))
             .unionByName(one.withColumns({"high": F.lit(460.0), "low": F.lit(469.0)}))
             .unionByName(one.withColumn("volume", F.lit(-100).cast("long")))
             .unionByName(one.withColumn("close", F.lit(None).cast("double"))))
    clean, bad = landing.validate_records(dirty, "bars")
    assert [r.ticker for r in clean.collect()] == ["SPY"]
    assert sorted(sum((r.failed for r in bad.collect()), [])) == [
        "close_positive", "high_not_below_low", "volume_not_negative"]


def test_ingest_window_checks_years(bars):
    with pytest.raises(ValueError):
        landing.ingest_window(bars, "2022-06-01", "backfill", 21)
    assert landing.ingest_window(bars, "2022-06-01", "eod").count() == 3 * 6


def test_upsert_is_idempotent_and_keeps_source(bars):
    old = bars.withColumns({"vwap": F.lit(1.0), "source": F.lit("yfinance")})
    new = old.filter("day(time) = 5").withColumns({"vwap": F.lit(None).cast("double"), "source": F.lit("polygon")})
    once = store.upsert_bars(old, new)
    again = store.upsert_bars(once, new)
    assert once.exceptAll(again).count() == 0 and once.count() == old.count()
    assert once.filter("source = 'polygon'").count() == 0
    assert once.filter("vwap is null").count() == new.count()


def test_feature_store(spark, bars):
    s = store.FeatureStore(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/store")
    s.write(bars)
    s.write(bars)
    s.write(bars.limit(0))
    assert s.scan().count() == 900
    s.write(bars.filter("ticker = 'SPY'").limit(10))
    assert s.one("SPY").count() == 10 and s.one("QQQ").count() == 300
    read = s.read(["qqq"], "2022-01-05", "2022-01-07")
    assert [r.time.day for r in read.collect()] == [5, 6, 7]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*ticker", plan) and "GreaterThanOrEqual(time" in plan
    assert s.latest(n=2).count() == 6 and s.tickers().count() == 3 and s.date_range().count() == 3


def test_envelopes_round_trip(bars):
    sent = envelopes.publish_envelope(bars, "ohlcv", max_records=128)
    assert sent.count() == 9
    messages = sent.withColumn("topic", F.lit("ohlcv"))
    back = envelopes.explode_envelope(messages, "ohlcv", schemas.BARS).select(
        F.col("time").cast("timestamp_ntz").alias("time"), *bars.columns[1:])
    assert back.exceptAll(bars).count() == 0 and back.count() == 900
    assert envelopes.route(messages)["macro"].count() == 0


def test_reads(spark, bars):
    last = reads.recent_bars(bars, "SPY", 5).collect()
    assert len(last) == 5 and last[0].time < last[-1].time
    signals = bars.select("ticker", "time", F.lit(3).alias("regime"))
    latest = reads.latest_signals(signals)
    assert {r.regime_name: r.n for r in aggregates.regime_counts(latest).collect()} == {
        "trending": 0, "mean_reverting": 0, "choppy": 0, "high_vol": 3}
    live = bars.filter("time >= '2022-10-01'").withColumn("close", F.lit(0.0))
    stitched = reads.stitch_history(bars, live, 60)
    assert stitched.groupBy("ticker", "time").count().filter("count > 1").count() == 0
    assert stitched.filter("close = 0").count() == live.count()


def test_bucketed_tables_meet_without_an_exchange(spark):
    days = spark.range(4000).selectExpr(
        "if(id % 3 = 0, 'HOT', concat('T', id % 7)) as ticker", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as time",
        "cast(id as double) as close", "cast(id % 4 as int) as regime").withColumn("day", F.to_date("time"))
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    bars, signals = (store.save_bucketed(days.select("ticker", "day", "time", value), f"bucketed_{value}", f"{path}/{value}", ["ticker", "day"], 8)
                     for value in ("close", "regime"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = reads.with_regime_of_day(bars, signals)
        got = joined.collect()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = reads.bars_with_regime(days.select("ticker", "time", "close"), days.select("ticker", "time", "regime")).collect()
    assert sorted((r.ticker, r.time, r.close, r.regime) for r in got) == sorted((r.ticker, r.time, r.close, r.regime) for r in want)
    sizes = [r[0] for r in bars.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 4000 / 3  # the hot ticker lies in several buckets


@pytest.mark.parametrize("n", [0, 6])
def test_figures_counted_while_written(spark, n):
    rows = [("a", 1.0, "yfinance", 5), ("b", -1.0, "yfinance", 5), (None, 1.0, "other", -5), ("c", None, None, None),
            ("a", 1.0, "yfinance", 5), ("", 2.0, "polygon", 0)][:n]
    df = spark.createDataFrame(rows, "ticker string, open double, source string, volume bigint").selectExpr(
        "*", "open as high", "open as low", "open as close")
    clean, bad, figures = landing.write_validated(df, "bars", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    assert (clean.count(), bad.count()) == (figures["clean_rows"], figures["rows"] - figures["clean_rows"]) == ((3, 3) if n else (0, 0))
    marks = [m for r in bad.collect() for m in r.failed]
    assert all(figures[name] == marks.count(name) for name in landing._rules("bars"))
