"""Range partitions: positions, carried values and as-of joins against plain pandas and SQL."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barometry.operators import ordered, ranges
from barometry.operators.ordered import Series

RANGED = Series(bucket="range")


def made_rows(n, seed=3):
    """One ticker with nearly all rows within a minute, short ones, nulls in key and order."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ticker = rng.choice(["HOT"] * 30 + ["A", "B", None])
        at = None if rng.random() < 0.01 else 1_700_000_000_000_000 + rng.randrange(60_000_000)
        rows.append((ticker, at, i, rng.choice([None, None, None, float(i)]), rng.choice([None, None, (i, f"s{i}")])))
    return rows


SCHEMA = "ticker string, micros long, seq long, v double, pair struct<a: long, b: string>"


def plain(rows):
    """seq -> (position, filled v, filled pair)."""
    by_key, out = defaultdict(list), {}
    for r in rows:
        if r[0] is None or r[1] is None:
            out[r[2]] = (None, r[3], r[4])
        else:
            by_key[r[0]].append(r)
    for own in by_key.values():
        v = pair = None
        for at, r in enumerate(sorted(own, key=lambda r: (r[1], r[2]))):
            v, pair = r[3] if r[3] is not None else v, r[4] or pair
            out[r[2]] = (at, v, pair)
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_range_index(spark, parts):
    rows = made_rows(4000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ranges.range_index(df, ["ticker"], "micros", "at", ["seq"], ["v", "pair"], parts).collect()
    assert len(got) == len(rows)
    assert {r.seq: (r["at"], r.v, tuple(r.pair) if r.pair else None) for r in got} == plain(rows)


def test_batches_within_a_partition(spark):
    rows = made_rows(3000, 5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = ranges.range_index(spark.createDataFrame(rows, SCHEMA), ["ticker"], "micros", "at", ["seq"], ["v", "pair"], 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.seq: (r["at"], r.v, tuple(r.pair) if r.pair else None) for r in got} == plain(rows)


def test_a_minute_of_one_ticker_is_spread(spark):
    df = spark.createDataFrame(made_rows(8000), SCHEMA).where("ticker = 'HOT' and micros is not null")
    laid = ranges.ranged(df, ["ticker"], "micros", ["seq"], [], 16)
    sizes = [r["count"] for r in laid.groupBy(ranges.PART).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16


def test_one_scan_and_one_exchange(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame(made_rows(500), SCHEMA).write.parquet(path)
    laid = ranges.ranged(spark.read.parquet(path), ["ticker"], "micros", ["seq"], ["v"])
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_no_rows_and_one_series(spark):
    df = spark.createDataFrame(made_rows(300), SCHEMA)
    assert ranges.range_index(df.limit(0), ["ticker"], "micros").count() == 0
    got = ranges.range_index(df, [], "micros", "at", ["seq"], parts=4).where("micros is not null").orderBy("micros", "seq").collect()
    assert [r["at"] for r in got] == list(range(len(got)))


def test_series_by_ranges(spark):
    """The same operators on a series without calendar buckets."""
    rows = [r for r in made_rows(1500, 9)]
    unique = {(r[0], r[1]): r for r in rows}
    df = spark.createDataFrame(list(unique.values()), SCHEMA).selectExpr("ticker", "timestamp_micros(micros) as time", "seq", "v")
    for by in (lambda s: ordered.row_index(df, s, fill=["v"]), lambda s: ordered.diff(df, {"d": "seq"}, 3, s)):
        a, b = by(Series(block_rows=50)), by(Series(block_rows=50, bucket="range"))
        assert a.exceptAll(b.select(*a.columns)).count() == 0 == b.select(*a.columns).exceptAll(a).count()


@pytest.mark.parametrize("by", [[], ["ticker"]])
def test_asof_join(spark, by):
    rng = random.Random(2)
    left = [(rng.choice(["A", "B", None]), rng.choice([None, *range(0, 400, 7)]), i) for i in range(400)]
    right = [(rng.choice(["A", "B", None]), rng.choice([None, *range(50, 420, 5)]), float(rng.randrange(50)), rng.choice([None, "x"])) for i in range(150)]
    l = spark.createDataFrame(left + left[:5], "ticker string, t int, row int")
    r = spark.createDataFrame(right, "ticker string, t int, value double, name string")
    r = r if by else r.drop("ticker")

    def want(ticker, t):
        if t is None or (by and ticker is None):
            return (None, None)
        fits = [x for x in right if x[1] is not None and x[1] <= t and (not by or x[0] == ticker)]
        if not fits:
            return (None, None)
        newest = max(x[1] for x in fits)
        return max(((x[2], x[3]) for x in fits if x[1] == newest), key=lambda x: (x[0], x[1] is not None))

    got = ranges.asof_join(l, r, "t", by, parts=6)
    assert got.columns == ["ticker", "t", "row", "value", "name"]
    assert Counter(tuple(x) for x in got.collect()) == Counter((*x, *want(x[0], x[1])) for x in left + left[:5])
    assert ranges.asof_join(l.limit(0), r, "t", by).count() == 0
    assert ranges.asof_join(l, r.limit(0), "t", by).where("value is null").count() == len(left) + 5
    with pytest.raises(ValueError):
        ranges.asof_join(l.withColumn("value", F.lit(1)), r, "t", by)
