"""The named queries against their SQL, and the pipeline end to end."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from wayside.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    got, want = QUERIES[name](spark, FOLDER), con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert set(got.columns) == set(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes, last = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, last, FOLDER)
        assert out.columns == docs.columns
        last = corpus_pipeline.staged(out, "test-stage")
        sizes.append(last.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() == sizes[4] and got.where("n_tokens = 0 and decoded <> ''").count() == 0
