"""Signals that expire by themselves, and rows that come too late."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from barometry.streaming import event_time, jobs

DAY = dt.datetime(2024, 1, 1)
BARS = "time timestamp_ntz, ticker string, open double, high double, low double, close double, volume bigint"


def folder() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def bar(spark, *rows):
    """Bars from (days after the first, ticker, price)."""
    return spark.createDataFrame([
        (None if d is None else DAY + dt.timedelta(days=d), t, p, p + 1, p - 1, p, 1) for d, t, p in rows], BARS)


BATCHES = [
    [(0.2, "A", 5.0), (0.1, "A", 4.0), (0.5, "B", 9.0), (3.5, "A", 6.0)],
    # The watermark is at 2.5 days: the first day is over for every ticker, the third is not.
    [(0.9, "A", 1.0), (0.3, None, 2.0), (2.1, "B", 7.0), (None, "A", 3.0), (6.0, "B", 8.0)],
    [(2.2, "B", 1.0), (6.1, "A", 2.0), (6.1, "A", 2.0)],
]


def tables(spark, out):
    final = spark.read.parquet(f"{out}/bars/*").withColumn("state", F.lit("final"))
    both = final.unionByName(event_time.open_days(spark, f"{out}/state").withColumn("state", F.lit("open")))
    days = sorted(((r["bucket"] - DAY).days, r["ticker"], r["open"], r["high"], r["low"], r["close"], r["n"], r["state"])
                  for r in both.collect())
    late = sorted((r["open"], r["ticker"] or "") for r in spark.read.parquet(f"{out}/late/*").collect())
    return days, late


@pytest.mark.parametrize("again", [[], [0], [1], [2], [0, 1, 2]])
def test_final_open_and_late_rows(spark, again):
    out = folder()
    handle = event_time.daily_bar_batches(f"{out}/state", f"{out}/bars", f"{out}/late", "1 day")
    for n, rows in enumerate(BATCHES):
        for _ in range(2 if n in again else 1):  # a batch that is retried changes nothing
            handle(bar(spark, *rows), n)
    days, late = tables(spark, out)
    assert days == [
        (0, "A", 4.0, 6.0, 3.0, 5.0, 2, "final"), (0, "B", 9.0, 10.0, 8.0, 9.0, 1, "final"),
        (2, "B", 7.0, 8.0, 6.0, 7.0, 1, "final"), (3, "A", 6.0, 7.0, 5.0, 6.0, 1, "final"),
        (6, "A", 2.0, 3.0, 1.0, 2.0, 2, "open"), (6, "B", 8.0, 9.0, 7.0, 8.0, 1, "open")]
    assert late == [(1.0, "A"), (1.0, "B"), (2.0, ""), (3.0, "A")]
    assert sum(d[6] for d in days) + len(late) == sum(map(len, BATCHES))


def test_empty_batches(spark):
    out = folder()
    handle = event_time.daily_bar_batches(f"{out}/state", f"{out}/bars", f"{out}/late", "1 day")
    handle(bar(spark), 0)
    handle(bar(spark, (0.2, "A", 5.0)), 1)
    handle(bar(spark), 2)
    days, late = tables(spark, out)
    assert days == [(0, "A", 5.0, 6.0, 4.0, 5.0, 1, "open")] and late == []


def expired(spark, batches, ttl, lateness="0 seconds"):
    path, out = folder(), folder()
    schema = "time timestamp, ticker string, regime int"
    for n, rows in enumerate(batches):
        spark.createDataFrame([(None if s is None else DAY + dt.timedelta(seconds=s), t, r) for s, t, r in rows], schema) \
            .coalesce(1).write.parquet(f"{path}/part={n}")
    stream = event_time.signal_expiries(jobs.file_source(spark, f"{path}/*", spark.read.parquet(f"{path}/part=0").schema), ttl, lateness)
    jobs.each_batch(stream, event_time.write_batches(out), folder(), available_now=True).outputMode("append").start().awaitTermination()
    return sorted((r["ticker"] or "", r["regime"], int((r["expired_at"] - DAY).total_seconds()), r["n_signals"])
                  for r in spark.read.parquet(f"{out}/*").collect())


def test_signals_expire_without_another_message(spark):
    batches = [[(0, "A", 1), (10, "A", 2), (10, "A", 3), (5, "B", 1), (None, "C", 1)], [(60, "C", 1)], [(70, None, 1), (130, "D", 1)]]
    # A and B never send again; C and the null ticker are over too; D lives, and a row without time never did.
    assert expired(spark, batches, 60) == [("", 1, 130, 1), ("A", 3, 70, 3), ("B", 1, 65, 1), ("C", 1, 120, 1)]


def test_signal_at_the_end_of_a_session(spark):
    # A signal at the very end renews the one before; one that comes a second later does not.
    assert expired(spark, [[(0, "A", 1), (60, "A", 2)], [(121, "A", 3)], [(400, "B", 0)]], 60, "90 seconds") == [
        ("A", 2, 120, 2), ("A", 3, 181, 1)]
