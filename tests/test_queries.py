"""Every query against its SQL in DuckDB, over whole tables of the smallest scale."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

from assayloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        return float(v)
    return str(v)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert got == want


def test_ranking_scores_every_document(spark, duck):
    got = {r["index"] for r in QUERIES["tfidf_scores"](spark, SF).collect()}
    assert got == {r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()}
    ranked = {r["index"] for r in QUERIES["rank_topk"](spark, SF).collect()}
    assert ranked - {r[0] for r in duck.execute("SELECT doc_id FROM documents WHERE lang = 'en'").fetchall()}
