"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import near_truth, plain_lines, plain_repeats
from tests.test_catalogue import DIR, TABLES, rows
from tracefold.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, DIR).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, DIR).cache()
        assert after.columns == docs.columns and after.count() > 0
        seen.append((name, kept, after))
        kept = after
    by_name = {name: (before, after) for name, before, after in seen}
    texts = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    before, after = by_name["lines"]
    assert dict(texts(after)) == {i: t for i, (t, *_) in plain_lines(texts(before)).items()}
    before, after = by_name["near_duplicates"]
    _, label = near_truth(texts(before), 80)
    assert {i for i, _ in texts(after)} == {i for i in label if label[i] == i}
    before, after = by_name["suffixes"]
    own = texts(before)
    want = {i: w[1] for (i, _), w in zip(own, plain_repeats([t.encode() for _, t in own]), strict=True)}
    got = {r.doc_id: r.n for r in after.select("doc_id", F.octet_length("text").alias("n")).collect()}
    size = {i: len(t.encode()) for i, t in own}
    assert all(0 <= size[i] - want[i] - got[i] <= 3 * 40 for i in got)  # less what is left of cut characters
    assert all(r.n_chars == len(r.text) for r in after.collect())
    packed = corpus_pipeline.run(spark, DIR).toPandas()
    assert set(packed["doc_id"]) == set(got) and packed.groupby("sequence_id")["length"].sum().max() <= 2048
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    before, after = by_name["toxicity"]
    gone = {i for i, _ in texts(before)} - {i for i, _ in texts(after)}
    assert sum(labels.get(i) == 0 for i in gone) <= 2
