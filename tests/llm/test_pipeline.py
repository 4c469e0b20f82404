"""The pipeline over the smallest tables: what each stage takes out, against plain versions."""

from __future__ import annotations

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    from assayloom.llm.common import stored, table

    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        seen[name] = [r.asDict() for r in docs.collect()]
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {n: {r["doc_id"] for r in rows} for n, rows in seen.items()}
    assert ids["toxicity"] >= ids["near_dedup"] >= ids["decontamination"] >= ids["mixing"] == ids["sharding"]
    shingles = {}
    for r in seen["near_dedup"]:
        w = r["text"].encode().lower().split()
        shingles[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    every = sorted(shingles)
    for i, a in enumerate(every):
        for b in every[:i]:
            x, y = shingles[a], shingles[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)):
                assert len(x & y) < 0.8 * len(x | y)
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [f" {words(r.text)} " for r in table(spark, SF, "benchmark").collect()]
    assert not [r["doc_id"] for r in seen["decontamination"] if any(i in f" {words(r['text'])} " for i in items)]
    assert len(ids["mixing"]) >= 0.95 * len(ids["decontamination"])
    assert {r["shard"] for r in seen["sharding"]} == set(range(pipeline.N_SHARDS))


def test_mixing_cuts_no_document_whatever_the_languages(spark):
    from pyspark.sql import functions as F

    from assayloom.llm.mixing import token_count

    for shares in ({"en": 25, "de": 25, "fr": 25, "es": 25}, {"en": 40, "de": 11, "fr": 10, "es": 39}, {"en": 40, "de": 44, "fr": 10, "es": 6}, {"de": 90, "it": 10}):
        rows = [(f"{lang}{i}", f"word{i:04d} " * 20, lang, f"src{i % 3}") for lang, n in shares.items() for i in range(4 * n)]
        docs = spark.createDataFrame([*rows, ("none", None, "en", "src0")], "doc_id string, text string, lang string, source string")
        got = pipeline.mixing(spark, docs, SF).select("doc_id", token_count().alias("n"))
        tokens = docs.agg(F.sum(token_count())).first()[0]
        times = {r.doc_id: (r["count"], r.n) for r in got.groupBy("doc_id").agg(F.count("*").alias("count"), F.first("n").alias("n")).collect()}
        assert {r[0] for r in rows} <= set(times) and max(k for k, _ in times.values()) <= 2
        assert abs(sum(k * n for k, n in times.values()) - pipeline.BUDGET_SHARE * tokens) < 0.03 * tokens
