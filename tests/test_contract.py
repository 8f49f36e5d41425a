"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


# Compared with a batch in test_streaming.py, on fewer bars.
SLOW = {"stream_feature_batches"}


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - SLOW))
def test_query(spark, duck, name):
    got, want = queries()[name](spark, SF).toPandas(), duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns)
    keys = [c for c in columns if got[c].dtype.kind != "f"] + [c for c in columns if got[c].dtype.kind == "f"]
    got = got[columns].sort_values(keys, ignore_index=True)
    want = want[columns].sort_values(keys, ignore_index=True)
    for c in columns:
        if got[c].dtype.kind == "f":
            a, b = got[c], pd.to_numeric(want[c]).astype(float)
            assert ((a == b) | (a.isna() & b.isna()) | ((a - b).abs() <= 1.1e-4)).all(), c
        else:
            assert ((got[c].astype(str) == want[c].astype(str)) | (got[c].isna() & want[c].isna())).all(), c
