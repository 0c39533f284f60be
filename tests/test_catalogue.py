"""Each query against its SQL on the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tracefold.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if pd.isna(v):
            return None
        if isinstance(v, int | float | np.number) and not isinstance(v, bool):
            return int(v) if v == int(v) else round(float(v), 6)
        return v

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(x == y or all(p == q or (p is not None and q is not None and abs(p - q) < 1e-6) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


def test_stream_finds_what_the_batch_finds(spark):
    batch, stream = (rows(catalogue.QUERIES[f"stage_due_{k}"](spark, DIR).toPandas()) for k in ("batch", "stream"))
    assert batch and batch == stream


def test_search_scans_only_what_it_needs(spark):
    plan = catalogue.QUERIES["search_bm25"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "Python" not in plan
