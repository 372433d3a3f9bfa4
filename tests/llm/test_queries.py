"""Registered queries: names, and rows against DuckDB where SQL can say them."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from basketry.llm.queries import QUERIES, SQL

from .conftest import SF001


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(entry.queries())


def plain(rows):
    return sorted(tuple(None if v != v else v for v in r) for r in rows) if rows else []


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    got = QUERIES[name](spark, SF001)
    res = con.execute(SQL[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(res.fetchall(), key=key)
