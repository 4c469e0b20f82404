"""TF-IDF from postings: against plain Python over several articles, packing, what is shuffled, ties."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import postings as P
from assayloom.operators import retrieval as R


def grams(text: str | None) -> Counter:
    w = (text or "").split()
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


def scores(texts: list[str | None], query: str) -> list[float]:
    docs = [grams(query), *map(grams, texts)]
    df = Counter(t for d in docs for t in d)
    vec = [{t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in d.items()} for d in docs]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
    return [sum(vec[0].get(t, 0) * x for t, x in v.items()) / (norm[0] * n) if n and norm[0] else 0.0 for v, n in zip(vec[1:], norm[1:], strict=True)]


def test_packed_postings_come_back():
    r = np.random.default_rng(1)
    slot, n = 700, 5000
    key = np.unique(r.integers(0, 1 << 54, n, dtype=np.uint64) | np.uint64(slot << 54))
    key[-1], key[0] = np.uint64((slot << 54) + (1 << 54) - 1), np.uint64(slot << 54)
    place, count = r.integers(0, 60_000, len(key)), r.integers(-3, 2**31 - 1, len(key))
    got = P._unpacked(P._packed(key, place, count, 60_000), slot)
    for a, b in zip(got, (key, place, count, 60_000), strict=True):
        assert np.array_equal(a, b)


def test_scores_of_many_articles(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["km", "vmax", "müller", "1.5%"]
    texts = {(a, i): " ".join(r.choices(words, k=r.choice([0, 1, 2, 30, 300]))) for a in ("a", "b", "c", "") for i in range(r.choice([1, 20, 60]))}
    texts["a", 999] = None
    asked = {"a": "km vmax km w3 w3", "b": "w1", "c": "absent words", "": "km km vmax"}
    df = spark.createDataFrame([(a, i, t, asked[a]) for (a, i), t in texts.items()], "article_id string, index int, text string, query string").repartition(3)
    rows = R.tfidf_scores(df, F.col("query")).collect()
    got = {(x.article_id, x["index"]): x.tfidf for x in rows}
    assert len(rows) == len(texts)
    for a in asked:
        of = [k for k in texts if k[0] == a]
        assert [got[k] for k in of] == pytest.approx(scores([texts[k] for k in of], asked[a]), abs=1e-12)


@pytest.mark.parametrize("op", [R.tfidf_scores, R.rank_chunks])
def test_a_shuffle_of_few_bytes_a_posting(spark, op):
    r = random.Random(4)
    rows = [("a", i, " ".join(f"{r.choice('abcdef')}{r.randrange(10**5)}" for _ in range(200))) for i in range(400)]
    df = spark.createDataFrame(rows, "article_id string, index int, text string").withColumn("section_title", F.lit("Results")).repartition(2, "index").localCheckpoint()
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)

    def shuffled() -> int:
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = shuffled()
    op(df, F.lit("a1 b2")).write.format("noop").mode("overwrite").save()
    assert shuffled() - before < 12 * sum(len(grams(t)) for _, _, t in rows)


def test_sums_that_differ_in_their_last_bits_are_ties(spark):
    # all words are in one text only, so equal counts make equal scores, in whatever order they are added
    r = random.Random(5)
    rows = []
    for i in range(60):
        counts = [1, 2, 3, 5, 7, 11, 13]
        r.shuffle(counts)
        rows.append(("a", i, "Conclusion", " ".join(["km", *(f"t{i}x{k}" for k, n in enumerate(counts) for _ in range(n))])))
    df = spark.createDataFrame(rows, "article_id string, index int, section_title string, text string").repartition(3)
    got = [x["index"] for x in R.rank_chunks(df, F.lit("km"), 60).orderBy("rank").collect()]
    assert got == list(range(60))


def test_matched_terms_keep_the_order_of_the_query(spark):
    df = spark.createDataFrame([("Km and vmax, km; IC50",), ("a b",), ("",), (None,)], "t string")
    asked = F.lit("ic50 vmax km a km absent")
    got = [r[0] for r in df.select(R.matched_terms(asked, F.col("t"))).collect()]
    assert got == [["ic50", "vmax", "km"], [], [], []]
