"""Each training-data operator on small fixtures: nulls, empty and long texts, ties, empty tables, odd columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.llm import common, decontam, doc_stats, mixing, near_dup, pii, quality_classifier, quality_rules, sharding, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "one", "one", "a b", "É à 😀 x", "w " * 30000]


def docs(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, (langs or ["en", "de"])[k % 2], f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """More columns, with names that operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("id", "t", "h", "n", "size", "slot", "shard", "sh", "g", "node", "score", "spans", "y")})


def rand_texts(n, seed=1, vocabulary=300, words=40):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(vocabulary)}" for _ in range(words)) for _ in range(n)]


def test_word_hashes():
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice("ab \n\té\x1c") for _ in range(r.randrange(60))).encode()
        words = t.split()
        h = common.hash_words(t, r.choice([3, 7, 1 << 16]))
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
        seen = {}
        assert all(seen.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True))


# sharding


def test_sharding(spark):
    df = clashing(docs(spark, [*ODD, *rand_texts(300)], ids=[None, *range(307)]))
    got = sharding.shard_places(df, n_shards=4, n_slots=128).collect()
    assert len(got) == 308
    assert sorted(zlib.crc32((t or "").encode()) for t in [*ODD, *rand_texts(300)]) == sorted(r.text_crc32 for r in got)
    load = collections.Counter()
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        load[s] = sum(r["size"] for r in got if r.shard == s)
    assert sum(load.values()) == sum(len((t or "").encode()) + 1 for t in [*ODD, *rand_texts(300)])
    assert sharding.shard_places(df.limit(0)).count() == 0


def test_shards_are_even_and_grow_by_moves_to_new_ones_only(spark):
    df = docs(spark, rand_texts(3000, words=8))
    old = sharding.build_map(sharding.slot_sizes(df, 512), 8)
    folder = common.fresh_path(spark, "test-map")
    sharding.save_map(old, folder)
    sharding.save_map(sharding.grow_map(sharding.load_map(spark, folder), 10), folder)
    new = {r.slot: r for r in sharding.load_map(spark, folder).collect()}
    before = {r.slot: r for r in sharding.load_map(spark, folder, 1).collect()}
    assert {r.version for r in new.values()} == {2} and len(new) == len(before) == 512
    sums = collections.Counter()
    for r in before.values():
        sums[r.shard] += r.bytes
    assert max(sums.values()) < 1.01 * min(sums.values())
    assert {new[s].shard for s in new if new[s].shard != before[s].shard} == {8, 9}
    grown = collections.Counter()
    for r in new.values():
        grown[r.shard] += r.bytes
    assert max(grown.values()) < 1.2 * min(grown.values())
    placed = sharding.assign_shards(clashing(df).drop("shard"), sharding.load_map(spark, folder))
    assert placed.count() == 3000 and {"virtual_slot", "shard", "text"} <= set(placed.columns)


# decontamination


def multiset(words, k):
    k = min(k, len(words))
    return collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else collections.Counter()


def test_decontamination_against_a_loop(spark):
    r = random.Random(4)
    items = [*rand_texts(6, seed=9, words=25), "only three words", "", None]
    texts = rand_texts(40, seed=5, words=60)
    for k in range(0, 30, 3):
        w = items[k % 6].split()
        if k % 2:
            w[r.choice([0, -1])] = "changed"
        texts[k] = texts[k].upper() + "\n" + ", ".join(w) + " " + texts[k + 1]
    texts += ["x only THREE words y", "", None, items[0], items[0]]
    df = clashing(docs(spark, texts))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontam.leaks(df, bench).collect()}
    want = {}
    clean = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            v, w = clean(item), clean(t)
            if not v:
                continue
            for a in range(max(1, len(w) - len(v) + 1) if w else 0):
                x, y = multiset(w[a : a + len(v)], 5), multiset(v, 5)
                s = sum((x & y).values()) / sum((x | y).values())
                if s >= 0.8:
                    want[i, j] = max(s, want.get((i, j), 0))
    assert len(want) > 10 and {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    kept = {x.doc_id for x in decontam.without_leaks(df, bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def test_hamming_blocks_cover_the_radius():
    r = random.Random(6)
    masks = set(decontam.near_masks(3))
    for _ in range(300):
        flips = sum(1 << b for b in r.sample(range(64), r.randrange(16)))
        assert any((flips >> (16 * k)) & 0xFFFF in masks for k in range(4))


# token files


def test_token_files(spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from assayloom.llm.queries import tokenizer_file

    texts = [*ODD, "<|endoftext|> x", "  lead", "trail ", "a  b\n c", *rand_texts(20)]
    ids = list(range(len(texts)))[::-1]
    got = sorted(tokens.token_files(clashing(docs(spark, texts, ids)), tokenizer_file()).collect(), key=lambda r: r.doc_id)
    t = Tokenizer.from_file(tokenizer_file())
    start = 0
    for r, text in zip(got, texts[::-1], strict=True):
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert tokens.token_files(docs(spark, ["x"]).limit(0), tokenizer_file()).count() == 0
    some = ["a b", None, "c d<|endoftext|> e f", "a b", ""]
    rows = sorted((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_files(docs(spark, some, [5, None, 3, 5, None]), tokenizer_file()).collect())
    ids = lambda x: [*t.encode(x, add_special_tokens=False).ids, 0]
    want, start = [], 0
    for i, x in ((None, ""), (None, ""), (3, some[2]), (5, "a b"), (5, "a b")):
        want.append((i is not None, i, start, len(ids(x)), zlib.crc32(np.array(ids(x), "<u4").tobytes())))
        start += len(ids(x))
    assert rows == want


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 70000])
def test_frames_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 50257, n).astype(np.uint32)
    ids[::97] = 4_294_967_295
    f = tokens.TokenFile(tokens.encode_file(ids, np.arange(2), np.array([n, 0])))
    assert (f.ids() == ids).all() and (f.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()


# near duplicates


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(3)
    texts = list(ODD)
    for g in range(5):
        base = [f"{r.choice('abcdef')}{g}{r.randrange(50)}" for _ in range(60)]
        for _ in range(22):
            t = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                t[r.randrange(len(t))] = f"v{r.randrange(60)}"
            texts.append(" ".join(t))
    r.shuffle(texts)
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = near_dup.near_duplicates(clashing(docs(spark, texts)), shingle_words=2, chunk=8).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_of_nothing_and_repeated_rows(spark):
    df = docs(spark, ["a b c d e f g", "a b c d e f g", "x", None], ids=[7, 7, None, None])
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    assert sorted((str(r.doc_id), str(r.text)) for r in near_dup.without_near_duplicates(df).collect()) == [("7", "a b c d e f g"), ("None", "None"), ("None", "x")]


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    loops = {x for a, b in edges if a == b for x in (a,)}
    got = {x.node: x.root for x in near_dup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items()} == {k: find(k) for k in root if k not in loops or k in got}


# quality rules and classifier


def test_base_rules():
    text = "# a b\n\na b\na b \n" + "q r s t u v w x y " * 2
    m = dict(zip(doc_stats.NAMES, doc_stats.measure(text.encode()), strict=True))
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"]) == (25, 25, 1, 0) and m["n_repeat_words"] == 18
    r = random.Random(5)
    for _ in range(200):
        w = [r.choice(["a", "b", "c"]) for _ in range(r.randrange(40))]
        count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        b = [x.encode() for x in w]
        assert doc_stats.repeat_words(b" ".join(b), b) == len(covered)
    assert doc_stats.measure(None) == doc_stats.measure(b"") == [0] * len(doc_stats.NAMES)


def labelled(spark, n=400):
    good = rand_texts(n, seed=11, words=60)
    texts = [t if i % 10 else " ".join(w + "###" for w in t.split()[: 20 + i % 40]) for i, t in enumerate(good)]
    texts = [f"{t} idiot moron" if i % 5 == 0 else t for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), int(i % 5 == 0)) for i in range(n)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    return clashing(docs(spark, texts)), labels


def test_quality_rules(spark):
    df, labels = labelled(spark)
    forest = quality_rules.fit_forest(df, labels, trees=60)
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, forest).collect()}
    right = [r.kept == bool(i % 10) for i, r in got.items()]
    assert len(got) == 400 and np.mean(right) > 0.95
    odd = quality_rules.quality_rules(docs(spark, ODD), forest).collect()
    assert len(odd) == len(ODD) and all(r.base_failed and not r.kept for r in odd)
    empty = quality_rules.fit_forest(df, labels.limit(0))
    assert quality_rules.quality_rules(df.limit(0), empty).count() == 0


def test_quality_classifier(spark):
    df, labels = labelled(spark)
    got = quality_classifier.quality_scores(df, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and 80 < len(held) < 200
    assert np.mean([r.predicted == int(r.doc_id % 10 != 0) for r in held]) > 0.95
    odd = quality_classifier.quality_scores(docs(spark, ODD, ids=[None, *range(7)]), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)


def test_toxicity(spark):
    df, labels = labelled(spark)
    got = toxicity.toxicity_scores(df, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.95
    assert toxicity.toxicity_scores(docs(spark, ODD), labels.limit(0)).where("score between 0 and 1").count() == len(ODD)
    model = toxicity.ToxicityModel({b"idiot": 5.0}, -2.0)
    assert [r.text for r in toxicity.without_toxic(docs(spark, ["an Idiot!", None, "fine"]), model).orderBy("doc_id").collect()] == [None, "fine"]


def test_counterfactual_pairs_level_group_words(spark):
    r = random.Random(12)
    texts, toxic = [], []
    for i in range(400):
        t, bad = rand_texts(1, seed=i, words=12)[0], i % 2
        group = "muslims " if (bad and r.random() < 0.8) or (not bad and r.random() < 0.1) else "hindus " if r.random() < 0.2 else ""
        texts.append(f"{group}{t} {'scum' if bad and r.random() < 0.7 else ''}")
        toxic.append(bad)
    df = docs(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    gap = []
    for fairness in (0.0, 20.0):
        m = toxicity.fit_toxicity(df, labels, F.lit(True), fairness=fairness)
        gap.append(abs(m.logit(b"muslims w1 w2") - m.logit(b"christians w1 w2")))
    assert gap[1] < 0.5 * gap[0]


def test_small_tables_keep_features_by_the_same_floor(spark):
    # "weak" has a chi-squared of 6.7 over 100 rows, "strong" one of 100
    texts = [f"{'strong' if i < 50 else 'mild'} {'weak' if i < 20 or 50 <= i < 58 else 'plain'}" for i in range(100)]
    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(100)], "doc_id long, toxic int")
    weight = toxicity.fit_toxicity(docs(spark, texts), labels, F.lit(True)).weight
    assert b"strong" in weight and b"weak" not in weight


# personal data


def plain_spans(t):
    rules = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(d):
        s = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in s) % 10 == 0

    out = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if [True, k == 1 and all(int(p) <= 255 for p in m.group().split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_a_loop(spark):
    r = random.Random(5)
    parts = ["1", "22", ".", "@", "a.b", "+", "-", " ", "555", "4111 1111 1111 1111", "_", "é", "😀", "300", "(", ")", "x@y.z"]
    texts = [*ODD, *["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(800)], "9" * 20000, "a.b@" * 3000]
    got = {x.doc_id: x for x in pii.span_digests(clashing(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in want) for j in range(4)]
    assert pii.span_digests(docs(spark, ["x"]).limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"please call me at +1 (415) 555-260{i} now" for i in range(6)] + ["please call me at 415-555-7788 now", "nothing here 12", "version 3.0 is out", None]
    found = {r.doc_id: [(s.start, s.kind_no, s.stop) for s in r.extra] for r in pii.find_spans(docs(spark, texts)).collect()}
    assert found == {i: [(18, 3, 30)] if i == 6 else [] for i in range(10)}
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert clean[0] == clean[6] == "please call me at [PHONE] now" and clean[9] == ""


def test_contexts_find_spaced_and_bracketed_identifiers(spark):
    numbers = ["415 555 7788", "(415) 555-7788", "415 - 555 - 7788", "415-555 7788x12"]
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "6011 1111 1111 1117", "3530 1113 3330 0000", "5105 1051 0510 5100"]
    texts = [f"please call me at +1 (415) 555-260{i} now" for i in range(12)] + [f"please call me at {x} now" for x in numbers]
    texts += [f"paid by card {x} today" for x in [*cards, "4111 1111 1111 1112"]] + ["please call me at 415 555 7788. 12 apples", "please call me at 415 555 7786 10.0.0.1 up"]
    clean = [r.text for r in pii.redact(docs(spark, texts)).orderBy("doc_id").collect()]
    assert clean[:16] == ["please call me at [PHONE] now"] * 16
    assert clean[16:23] == ["paid by card [CARD] today"] * 7
    assert clean[23:] == ["please call me at [PHONE] 12 apples", "please call me at [PHONE] [IP] up"]


# mixing


def test_more_children_than_rounds_and_empty_leaves(spark):
    leaves = spark.createDataFrame([("a", f"l{i:02d}", "s", 2**i) for i in range(20)], "domain string, lang string, source string, tokens long")
    weights = {"lang": {f"l{i:02d}": 2.0 for i in range(20)}}
    assert sum(r.budget for r in mixing.budgets(leaves, weights, total=2.0**20, max_epochs=1.5).collect()) == pytest.approx(2**20)
    df = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (2, "", "de", "s", 0), (3, None, "de", "s", 0), (4, "", "fr", "s", 0)], SCHEMA)
    assert sorted((r.doc_id, r.mix_epoch) for r in mixing.mix(df, {"lang": {"fr": 0}}).collect()) == [(1, 0), (2, 0), (3, 0)]


def test_mixing_follows_weights(spark):
    texts = rand_texts(1200, seed=21, words=30)
    df = clashing(docs(spark, [*texts, None, ""], langs=["en", "de"]))
    got = mixing.mix(df, {"lang": {"en": 0.75, "de": 0.25}}, max_epochs=2.0).select("lang", "mix_epoch", "doc_id", mixing.token_count().alias("n")).collect()
    total = sum(r.n for r in got)
    assert abs(sum(r.n for r in got if r.lang == "en") / total - 0.75) < 0.01
    assert max(collections.Counter((r.doc_id, r.mix_epoch) for r in got).values()) == 1
    whole = {r.doc_id for r in got if r.mix_epoch == 0 and r.lang == "en" and r.n}
    assert len(whole) == 600
    assert {r.mix_epoch for r in got} == {0, 1}
    assert mixing.mix(df.limit(0), {}).count() == 0
    assert mixing.mix(df, {}).select("doc_id").distinct().count() >= 1200


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 100), ("a", "y", "2", 1000), ("b", "z", "3", 1000)], "domain string, lang string, source string, tokens long")
    w = {"domain": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.5, "y": 0.5}}
    got = {r.source: r.budget for r in mixing.budgets(leaves, w, total=1000, max_epochs=1).collect()}
    assert got == {"1": pytest.approx(100), "2": pytest.approx(400), "3": pytest.approx(500)}
    got = {r.source: r.budget for r in mixing.budgets(leaves, w, total=4000, max_epochs=1).collect()}
    assert got == {"1": pytest.approx(100), "2": pytest.approx(1000), "3": pytest.approx(1000)}


def test_prefix_is_the_longest_that_fits(spark):
    df = docs(spark, rand_texts(300, seed=31, words=12), langs=["en", "en"]).withColumn("source", F.lit("s"))
    total = df.agg(F.sum(mixing.token_count())).first()[0]
    got = {r.doc_id for r in mixing.mix(df, {}, total=total * 0.37, seed=3).collect()}
    rows = sorted((int(hashlib.md5(f"3:0:{r.doc_id}".encode()).hexdigest()[:15], 16), r.doc_id, -(-len(r.text.encode()) // 4)) for r in df.collect())
    want, run = set(), 0
    for _, i, n in rows:
        run += n
        if run > total * 0.37:
            break
        want.add(i)
    assert got == want


# archives


def test_archives(spark):
    pages = [(1, "http://www.A.com/x#f", "a"), (2, None, None), (3, "::bad", ""), (4, "http://[bad", "a"), (5, "http://a.com:8080?q=1", "a"), (None, "http://n.com", "a"), (6, "http://b.com/\r\nX: y", "é" * 50000), (7, "http://a.com/x", "a")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "sha": F.lit("s"), "first": F.lit(2)})
    got = warc.warc_round_trip(df).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(pages)
    for page_id, _, html in pages:
        p = (html or "").encode()
        r = by_id[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        least = min(i for i, _, h in pages if i is not None and (h or "") == (html or ""))
        want = ("response", None) if page_id in (None, least) else ("revisit", least)
        assert (r.record_type, r.refers_to) == want
    order = sorted(got, key=lambda r: (r.part, r.row))
    assert [(r.urlkey, r.ts) for r in order] == sorted((r.urlkey, r.ts) for r in got)
    assert {r.page_id: r.record_type for r in warc.warc_round_trip(df, least_bytes=2).collect()}[7] == "response"
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_loser_tree():
    r = random.Random(1)
    for k in range(12):
        sources = [sorted((r.randrange(9), i) for _ in range(r.randrange(6))) for i in range(k)]
        assert list(warc.LoserTree([iter(s) for s in sources])) == sorted(x for s in sources for x in s)
