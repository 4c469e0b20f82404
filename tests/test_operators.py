"""Operators on small hand-made rows."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from assayloom.functions import chem
from assayloom.functions.exprs import number, strip
from assayloom.operators import aggregate as A
from assayloom.operators import chunk as C
from assayloom.operators import evaluate as E
from assayloom.operators import extract as X
from assayloom.operators import lineage as L
from assayloom.operators import retrieval as R
from assayloom.operators import text as T
from assayloom.operators import vision as V
from assayloom.sources import readers, writers


def rows(spark, *dicts):
    keys = list(dict.fromkeys(k for d in dicts for k in d))
    data = [tuple(None if d.get(k) is None else str(d[k]) for k in keys) + (i,) for i, d in enumerate(dicts)]
    return spark.createDataFrame(data, ", ".join(f"`{k}` string" for k in keys) + ", _row_order int")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_same_value_twice_is_one_row(spark):
    r = A.aggregate_molecules(rows(spark, {"smiles": "C(C)O", "canonical_smiles": "CCO", "value": "5.1234"}, {"smiles": "CCO", "canonical_smiles": "CCO", "value": "5.1234"}))
    assert [(x.canonical_smiles, x.value, x.property_name) for x in r.clean.collect()] == [("CCO", 5.123, "pMIC")]
    assert r.conflicts.count() == 0


def test_tables_win_over_text(spark):
    r = A.aggregate_molecules(rows(spark, {"smiles": "CCO", "value": "4.0", "source_type": "text", "source_id": "chunk-1"}, {"smiles": "CCO", "value": "6.0", "source_type": "docling_table", "source_id": "table-1"}))
    assert r.clean.first().value == 6.0
    c = r.conflicts.first()
    assert (c.resolution, c.rejected_value, c.source_id) == ("table_priority", 4.0, "chunk-1")


def test_first_seen_wins_at_equal_priority(spark):
    r = A.aggregate_molecules(rows(spark, {"smiles": "CCO", "value": "4.0", "source_type": "text"}, {"smiles": "CCO", "value": "5.0", "source_type": "chunk"}))
    assert r.clean.first().value == 4.0
    assert r.conflicts.first().resolution == "first_seen_same_priority"


def test_unusable_rows_are_dropped(spark):
    r = A.aggregate_molecules(rows(spark, {"smiles": "", "value": "1"}, {"smiles": "C", "value": ""}, {"smiles": "C", "value": "NaN"}, {"smiles": "C", "value": "1", "property_name": "  "}))
    assert r.clean.count() == 0 and r.conflicts.count() == 0


def test_quality_of_a_table_row(spark):
    c = A.aggregate_molecules(rows(spark, {"smiles": "CCO", "value": "5", "source_type": "docling_table", "unit": "uM", "evidence": "Table 1"})).clean.first()
    assert (c.quality_score, c.quality_flags) == (90, "from_table;valid_smiles;has_unit;has_evidence")


def test_per_article_keeps_articles_apart(spark):
    df = rows(spark, {"smiles": "C", "value": "1", "article_id": "a"}, {"smiles": "C", "value": "2", "article_id": "b"})
    assert A.aggregate_molecules(df).clean.count() == 1
    assert A.aggregate_molecules(df, per_article=True).clean.count() == 2


def test_nano_conflict_vision_and_rejected(spark):
    base = {"material_formula": "Mn3O4", "property_name": "particle diameter", "unit": "nm", "assay": "SEM"}
    r = A.aggregate_nano(rows(spark, {**base, "value": "800", "source_type": "text"}, {**base, "value": "810", "source_type": "table"}, {**base, "material_formula": "Xx2O", "value": "1"}, {**base, "assay": "CV", "value": "12.5", "source_type": "cv", "evidence": "e"}))
    clean = {x.assay: x for x in r.clean.collect()}
    assert clean["SEM"].value == 810.0 and clean["CV"].source_type == "vision" and clean["CV"].quality_score == 85
    assert r.conflicts.first().resolution == "table_priority"
    assert [(x.reason, x.validator, x.normalized_formula) for x in r.rejected.collect()] == [("missing_or_invalid_required_field", "nano_aggregation", "")]


def test_article_cleaning(spark):
    text = "# Introduction\nJournal of Example Chemistry\n1\nText.\n2 of 12\nDownloaded from publisher.example\nResults kept\n## References\n1. gone\n## Table 1 (page 2)\n\n| a |\n| 12 |\n"
    got = T.clean_markdown(spark.createDataFrame([(text,)], "markdown string")).first().markdown
    assert "gone" not in got and "2 of 12" not in got and "Downloaded" not in got
    assert "Journal of Example Chemistry" in got and got.endswith("| a |\n| 12 |")


def test_mentions(spark):
    df = spark.createDataFrame([(1, "MIC was 12.5 ug/mL and 6.25-12.5 µg per ml, ca. 3,5 mcg/mL"), (2, None), (3, "")], "id int, t string")
    m = T.mentions(df, "id", "t", F.lit(46.069)).orderBy("id", "mention").collect()
    assert [(x.value_ug_ml, x.upper_value_ug_ml, x.relation) for x in m] == [(12.5, None, None), (6.25, 12.5, None), (3.5, None, "~")]
    text = df.first().t
    assert all(text[x.start_char : x.end_char].strip() == x.raw_text for x in m)
    assert one(spark, T.pmic(F.lit(46.069), F.lit(46.069)).alias("p")).p == pytest.approx(3.0)


def test_sections_and_chunks(spark):
    text = "Title\n\nIntroduction\nintro\n\n## Experimental Section\nmade\n\n2. Results and Discussion\nfound\n\nConclusion\nend"
    df = spark.createDataFrame([("a", text), ("b", "no headings at all"), ("c", None)], "id string, t string")
    got = [(x.id, x["index"], x.section_title, x.text) for x in C.chunk_articles(df, "id", "t").orderBy("id", "index").collect()]
    assert got == [("a", 0, "Experimental Section", "## Experimental Section\n\nmade"), ("a", 1, "Results and Discussion", "## Results and Discussion\n\nfound"), ("b", 0, "Document", "## Document\n\nno headings at all")]
    with pytest.raises(ValueError):
        C.chunk_articles(df, "id", "t", max_chars=499)


def plain_bounds(t, most, overlap):
    out, at = [], 0
    while at < len(t):
        hard = min(at + most, len(t))
        end = hard
        if hard < len(t):
            window = t[at:hard]
            for s in ("\n\n", ". ", "; ", "\n"):
                if (k := window.rfind(s)) >= int(len(window) * 0.5):
                    end = at + k + len(s)
                    break
        out.append((at, end))
        if end >= len(t):
            break
        at = end - overlap if end - overlap > at else end
    return out


def test_chunk_bounds_against_a_loop(spark):
    texts = ["x" * n + ". " + "y; " * (n // 3) + "\n\n" + "é\n" * n for n in (0, 1, 300, 700, 1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most, overlap in ((500, 0), (500, 100), (600, 599)):
        got = [[(b.start, b.stop) for b in r.b] for r in df.select(C.bounds(F.col("t"), F.length("t"), most, overlap).alias("b")).collect()]
        assert got == [plain_bounds(t, most, overlap) for t in texts]


def test_ranking(spark):
    chunks = spark.createDataFrame([("a", 0, "Conclusion", "nothing of note"), ("a", 1, "Results", "nanoparticles with Vmax and Km"), ("a", 2, "Experimental", "buffers")], "article_id string, index int, section_title string, text string")
    got = R.rank_chunks(chunks, R.query_of(F.lit("Nanozymes")), 1).first()
    assert got["index"] == 1 and {"nanoparticles", "vmax"} <= set(got.matched_terms) and got.retrieval_method == "tfidf"
    assert R.rank_chunks(chunks, F.lit("km"), 0).count() == 0
    vectors = chunks.withColumn("v", F.when(F.col("index") == 1, F.array(F.lit(1.0), F.lit(0.0)))).withColumn("q", F.array(F.lit(1.0), F.lit(0.0)))
    got = {r["index"]: r for r in R.rank_chunks(vectors, F.lit("km"), 3, chunk_vector="v", query_vector="q").collect()}
    assert (got[1].retrieval_method, got[1].embedding_score) == ("hybrid", 1.0) and got[0].retrieval_method == "tfidf_fallback"


def test_tfidf_against_plain_python(spark):
    texts = ["km of ceria km", "vmax and km", "nothing"]
    q = "km vmax"
    grams = lambda t: (w := t.split()) + [f"{a} {b}" for a, b in zip(w, w[1:])]
    docs = [grams(q)] + [grams(t) for t in texts]
    idf = lambda t: math.log((1 + len(docs)) / (1 + sum(t in d for d in docs))) + 1
    vec = [{t: d.count(t) * idf(t) for t in d} for d in docs]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = [sum(vec[0].get(t, 0) * x for t, x in v.items()) / (norm(vec[0]) * norm(v)) for v in vec[1:]]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "article_id string, index int, text string")
    got = {r["index"]: r.tfidf for r in R.tfidf_scores(df, F.lit(q)).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(want)


@pytest.mark.parametrize(
    ("said", "n"),
    [('{"rows": [{"a": 1}, {"a": 2}]}', 2), ('```json\n[{"a": 1}]\n```', 1), ('Sure: {"data": [{"a": "}{"}]} bye }', 1), ('{"a": 1}', 1), ("none", 0), (None, 0), ('{"rows": [1, {"a": 1}]}', 1), ('{"open": ', 0)],
)
def test_envelopes(spark, said, n):
    df = spark.createDataFrame([(said,)], "t string")
    assert df.select(F.explode(X.envelope_rows(X.payload(F.col("t"))))).count() == n


def test_nano_row_aliases(spark):
    said = json.dumps({"id": "x", "material": "rod of Fe2O3 here", "property": "Km", "value": "0,02715 mM", "units": "mM"})
    r = spark.createDataFrame([(said,)], "t string").select(*X.nano_row(F.parse_json("t"))).first()
    assert (r.material_id, r.material_formula, r.value, r.unit) == ("x", "Fe2O3", 0.02715, "mM")


def test_retries(spark):
    a = spark.createDataFrame([(1, 1, False, 1, ["e1"]), (1, 2, False, 0, []), (1, 3, False, 2, ["no"]), (2, 1, True, 1, ["x"]), (2, 2, False, 1, ["x", "y"]), (3, 1, True, 1, ["z"])], "c int, attempt int, failed boolean, n_errors int, errors array<string>")
    final = X.final_attempts(a, ["c"], 3)
    assert {r.c: (r.attempt, r.status) for r in final.collect()} == {1: (2, "valid"), 2: (2, "invalid"), 3: (1, "failed")}
    assert {r.c: r.error_log for r in X.error_log(a, final, ["c"]).collect()} == {1: ["e1"], 2: ["x", "y"], 3: ["z"]}


def test_plug_in_responses(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "c int, text string")
    assert {r.c: r.response for r in X.respond(df, lambda p: p["text"].str.upper(), ["c"]).collect()} == {1: "A", 2: "B"}


@pytest.mark.parametrize(("f", "n"), [("Mn3O4", 0), ("Xx2O", 1), ("", 1), ("M-W/SBA-15 (M = Ni, Pd, Zn, Cu)", 0), ("Fe₃O₄", 0), ("Fe0", 1)])
def test_formulas(spark, f, n):
    assert one(spark, F.size(chem.formula_errors(F.lit(f))).alias("n")).n == n


def test_property_names_and_limits(spark):
    assert one(spark, chem.canonical_property(F.lit("nanoparticle diameter")).alias("x")).x == "particle diameter"
    assert one(spark, chem.canonical_property(F.lit("sorbitol yield")).alias("x")).x == "sorbitol yield"
    assert not one(spark, chem.property_allowed(F.lit("random score")).alias("x")).x
    assert "below 0.1 nm" in one(spark, chem.sanity_errors(F.lit("particle_size"), F.lit(0.01), F.lit("nm")).alias("x")).x[0]
    assert "finite" in one(spark, chem.sanity_errors(F.lit("Km"), F.lit(float("nan")), F.lit("mM")).alias("x")).x[0]


def test_evaluation(spark):
    rec = lambda *rs: spark.createDataFrame([(*r, i) for i, r in enumerate(rs)], "smiles string, property_name string, value string, `order` int")
    m = E.metrics(rec(("CCO", "pMIC", "1.000"), ("CCN", "pMIC", "2.000")), rec(("CCO", "pMIC", "1.000"), ("CCC", "pMIC", "3.000"))).first()
    assert (m.shared_keys, m.missing_keys, m.extra_keys, m.exact_matches, m.macro_f1) == (1, 1, 1, 1, 0.25)
    empty = E.metrics(rec(("a", "b", "1")).limit(0), rec(("a", "b", "1")).limit(0)).first()
    assert (empty.key_f1, empty.macro_f1) == (0.0, 0.0)
    assert one(spark, E.value_text(F.lit("1.23456")).alias("v")).v == "1.235"


def test_references(spark):
    df = spark.createDataFrame([("abc", "10.1000/Example", "", "1", 0), ("", "10.1000/example", "T", "1", 1), ("def", "10.1000/closed", "", "0", 2)], "pdf string, doi string, title string, access string, o int")
    got = E.article_references(df, "pdf", "doi", "title", "access", "o", only_access="1").collect()
    assert [(r.pdf, r.doi, r.title, r.row_count) for r in got] == [("abc", "10.1000/Example", "T", 2)]


@pytest.mark.parametrize(("label", "nm"), [("100 nm", 100.0), ("0.5 um", 500.0), ("0,5 µm", 500.0), ("2 mm", 2e6), ("scale bar", None), (None, None)])
def test_scale_labels(spark, label, nm):
    assert one(spark, V.label_nm(F.lit(label).cast("string")).alias("n")).n == nm


def test_numbers_and_strip(spark):
    said = ["1,5", " 2_0 ", "1d", "0x1", "nan", "inf", "", None, "1e400", "+.5"]
    got = [r.n for r in spark.createDataFrame([(s,) for s in said], "s string").select(number("s").alias("n")).collect()]
    assert got == [1.5, 20.0, None, None, None, None, None, None, None, 0.5]
    assert one(spark, strip(F.lit("　\x1c a \x85")).alias("s")).s == "a"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "state.json").write_text('{"validated_objects": [{"smiles": "CCO", "value": 1.5}]}')
    (tmp_path / "rows.jsonl").write_text('{"smiles": "CCO", "value": "1"}\n\n{"rows": [{"smiles": "CCN", "value": 2}]}\n')
    (tmp_path / "t.csv").write_text("﻿smiles,value\nCCC,3\n", encoding="utf-8")
    df = readers.read_rows(spark, [str(tmp_path / n) for n in ("state.json", "rows.jsonl", "t.csv")])
    assert [r.smiles for r in df.orderBy("_row_order").collect()] == ["CCO", "CCO", "CCN", "CCC"]
    assert A.aggregate_molecules(df).clean.count() == 3
    with pytest.raises(ValueError):
        readers.read_rows(spark, ["x.txt"])
    assert readers.pick_column(["Canonical SMILES"], ["smiles", "canonical_smiles"]) == "Canonical SMILES"
    writers.write_aggregated(A.aggregate_molecules(df), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "clean")).count() == 3
    writers.write_jsonl(spark.createDataFrame([(b"ab", 1)], "b binary, a int"), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value)["b"]["size"] == 2



def test_routing_and_manifest(spark):
    text = "Mn3O4 nanoparticles showed oxidase-like activity with Vmax"
    assert one(spark, L.effective_domain(F.lit("Oxazolidinones"), F.lit(text)).alias("d")).d == "Nanozymes"
    assert one(spark, L.effective_domain(F.lit("Oxazolidinones"), F.lit(text), can_switch=False).alias("d")).d == "Oxazolidinones"
    a = spark.createDataFrame([("a",), ("b",)], "article_id string")
    m = {r.article_id: r.clean_rows for r in L.manifest(a, "article_id", clean_rows=a.where("article_id = 'a'")).collect()}
    assert m == {"a": 1, "b": 0}


def test_stream(spark, tmp_path):
    from assayloom.streaming.articles import chunk_stream, read_articles

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.md").write_text("Abstract\nno\n\nResults\nyes\n")
    q = chunk_stream(read_articles(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("stream_chunks").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.article_id, r.text) for r in spark.table("stream_chunks").collect()] == [("x", "## Results\n\nyes")]
