"""A stream cut into several files gives what one batch gives."""

import tempfile

import pytest
from pyspark.sql import functions as F

from barometry.operators import aggregates, alerts, ordered
from barometry.plans import views
from barometry.plans.features import feature_pipeline
from barometry.sources import store
from barometry.streaming import jobs

SF = "/root/testdata/sf0.001"


def folder() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def in_files(df, n: int, order: str = "time"):
    """``df`` written as ``n`` files in time order, read back as a stream of one file per batch."""
    path = folder()
    cuts = df.approxQuantile("_t", [i / n for i in range(1, n)], 0.0) if n > 1 else []
    edges = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(edges, edges[1:]):
        df.filter((F.col("_t") > low) & (F.col("_t") <= high)).drop("_t").coalesce(1).write.mode("append").parquet(path)
    return jobs.file_source(df.sparkSession, path, df.drop("_t").schema)


def timed(df):
    return df.withColumn("_t", F.unix_seconds(F.col("time").cast("timestamp")).cast("double"))


def run(stream, handle, checkpoint=None, mode="append"):
    jobs.each_batch(stream, handle, checkpoint or folder(), available_now=True).outputMode(mode).start().awaitTermination()


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_alerts_carry_state_over_batches(spark):
    signals = views.signals(spark, SF)
    out = folder()
    run(in_files(timed(signals), 4), jobs.alert_batches(f"{out}/state", f"{out}/moves", f"{out}/alerts"))
    want = alerts.regime_transitions(signals)
    got = spark.read.parquet(f"{out}/moves/*").select(*want.columns)
    assert spark.read.parquet(f"{out}/state/version=3").count() == 15
    same(got.drop("ensemble_prob"), want.drop("ensemble_prob"))
    same(spark.read.parquet(f"{out}/alerts/*").select("id"), alerts.alert_rules(want).select("id"))


def test_replayed_batch_changes_nothing(spark):
    signals = views.signals(spark, SF)
    out = folder()
    handle = jobs.alert_batches(f"{out}/state", f"{out}/moves", f"{out}/alerts")
    handle(signals, 0)
    first = spark.read.parquet(f"{out}/alerts/*").select("id").count()
    handle(signals, 0)
    assert spark.read.parquet(f"{out}/alerts/*").select("id").count() == first


def test_tumbling_bars_equal_daily_bars(spark):
    ticks = views.ticks(spark, SF).withColumn("time", F.col("time").cast("timestamp"))
    out = folder()
    run(jobs.tumbling_bars(in_files(timed(ticks), 3)),
        lambda b, i: b.withColumn("n", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}"), mode="update")
    rows = spark.read.parquet(f"{out}/*")
    got = ordered.dedupe_keep_last(rows, ["ticker", "bucket"], ["n"]).drop("n")
    same(got, aggregates.bars_daily(ticks).select(*got.columns))


def test_late_and_repeated_bars(spark):
    stored, late = views.stored_bars(spark, SF), views.incoming_bars(spark, SF)
    out = folder()
    for batch in (stored, late, late):
        jobs.late_data_upsert(batch, out)
    same(spark.read.parquet(out).select(*stored.columns), store.upsert_bars(stored, late))


def test_feature_batches_equal_batch(spark, bars):
    out = folder()
    handle = jobs.feature_batches(lambda: None, lambda: None, f"{out}/bars", f"{out}/features", f"{out}/messages")
    run(in_files(timed(bars), 2), handle)
    got = spark.read.parquet(f"{out}/features")
    want = feature_pipeline(bars)
    same(got.select("ticker", "time"), want.select("ticker", "time"))
    diff = got.select("ticker", "time", F.col("close_z").alias("z")).join(want, ["ticker", "time"]).agg(
        F.max(F.abs(F.col("z") - F.col("close_z")))).first()[0]
    assert diff < 1e-9
    assert spark.read.parquet(f"{out}/messages/*").filter("key = 'SPY'").count() >= 1


def test_distinct_within(spark):
    ticks = views.ticks(spark, SF).withColumn("time", F.col("time").cast("timestamp"))
    stream = in_files(timed(ticks.unionByName(ticks)), 1)
    out = folder()
    run(jobs.distinct_within(stream, "7 days", ["ticker", "time"]), lambda b, i: b.write.mode("append").parquet(out))
    assert spark.read.parquet(out).count() == ticks.count()


def test_missing_table_is_none(spark):
    assert jobs.read_if_written(spark, folder() + "/nothing") is None
    with pytest.raises(Exception):
        spark.read.parquet(folder() + "/nothing")
