"""Schema gates, chemistry checks, the retry loop, exact rounding, streams."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayloom.functions.exprs import fixed, rounded, short
from assayloom.operators import extract as X
from assayloom.operators import validate as V


def test_rounding_and_short_form_as_c_does(spark):
    r = random.Random(4)
    xs = [0.0, -0.0, 2.5, 2.6755, 8.3455, 1.2345, 0.5075, 4.0125, 0.0005, 1e15, 2.0**52, 2.0**60, 123456.7895, 999999.5, 1e-4, 1.5e-5, 12.5, 100000.0, 1e22, 3e-300]
    xs += [r.choice([1, -1]) * round(r.random() * 10 ** r.randrange(-3, 9), r.randrange(8)) for _ in range(2000)] + [k / 16 + 0.0005 for k in range(200)] + [k / 2000 for k in range(1, 400)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in df.select("x", rounded("x", 3).alias("a"), rounded("x", 6).alias("b"), fixed("x", 3).alias("c"), short("x").alias("d")).collect():
        assert (row.a, row.b) == (round(row.x, 3), round(row.x, 6)), row.x
        if abs(row.x) < 2.0**52:
            assert row.c == f"{row.x:.3f}"
        if abs(row.x) > 1e-3 and len(repr(abs(row.x)).replace(".", "").strip("0")) < 16:
            assert row.d == f"{row.x:g}".replace("-0", "0" if row.x == 0 else "-0"), row.x
    assert spark.range(1).select(short(F.lit(None).cast("double")), rounded(F.lit(None).cast("double"), 3)).first() == (None, None)


def test_one_bad_row_fails_a_small_molecule_batch(spark):
    good = '{"compound_id": "1", "smiles": "CCO", "property_name": "pMIC", "value": 5, "unit": ""}'
    bad = '{"compound_id": "2", "smiles": "", "property_name": "pMIC", "value": true, "unit": "pMIC"}'
    df = spark.createDataFrame([(1, 1, f"[{good}]"), (2, 1, f"[{good}, {bad}]"), (3, 1, None)], "k long, attempt int, response string")
    got = {r.k: r for r in V.outcome(V.molecule_attempts(df, ["k"]), ["k"]).collect()}
    assert got[1].status == "valid" and got[1].validated[0].unit == "pMIC" and got[1].validated[0].canonical_smiles == "CCO"
    assert got[2].status == "failed" and got[2].validated == [] and got[2].error_log == ["extractor output validation failed: rows.1.smiles: String should have at least 1 character; rows.1.value: Input should be a valid number"]
    assert got[3].status == "failed" and got[3].n_candidates == 0


def test_rows_handed_over_as_they_are_need_exact_names_and_types(spark):
    exact = '{"material_id": "m", "material_name": "ceria", "material_formula": "CeO2", "property_name": "Km", "value": 2, "unit": "mM"}'
    odd = '{"Material": "ceria", "material_id": 5, "material_formula": "CeO2", "property_name": "", "value": "2", "unit": "mM", "note": ""}'
    df = spark.createDataFrame([(1, 1, f"[{exact}, {odd}]")], "k long, attempt int, response string")
    one = V.outcome(V.nano_attempts(df, ["k"], aliases=False), ["k"]).first()
    assert [r.property_name for r in one.validated] == ["Km"]
    reason = one.rejected[0].reason
    assert reason.startswith("row 2: material_id: Input should be a valid string; material_name: Field required; property_name: String should have at least 1 character; value: Input should be a valid number") and "note: Extra inputs are not permitted" in reason and one.rejected[0].validator == "nano_extractor_schema"


def test_the_model_is_asked_again_until_its_rows_hold(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    row = '{"rows": [{"id": "m", "formula": "%s", "property": "Km", "value": 2, "units": "mM"}]}'
    chunks = spark.createDataFrame([(1, "good"), (2, "second"), (3, "never")], "k long, text string")

    def ask(df):
        assert {"attempt", "errors"} <= set(df.columns)
        fine = (F.col("text") == "good") | ((F.col("text") == "second") & (F.col("attempt") > 1) & F.exists("errors", lambda e: F.contains(e, F.lit("Xx"))))
        return df.select("k", F.when(fine, row % "CeO2").otherwise(row % "Xx2").alias("response"))

    got = {r.k: r for r in V.with_retries(chunks, ask, ["k"], nano=True).collect()}
    assert [(got[k].attempts, got[k].status, len(got[k].validated), len(got[k].rejected)) for k in (1, 2, 3)] == [(1, "valid", 1, 0), (2, "valid", 1, 1), (3, "invalid", 0, 3)]
    assert len(got[3].error_log) == 1  # the same text thrice


def test_a_raising_model_spares_the_rows_beside_it(spark):
    def model(pdf):
        if (pdf["text"] == "bad").any():
            raise ValueError("no answer")
        return pd.Series(["said " + t for t in pdf["text"]], index=pdf.index)

    chunks = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "k long, text string").coalesce(1)
    got = {r.k: (r.response, r.error) for r in X.respond(chunks, model, ["k"]).collect()}
    assert got == {1: ("said a", None), 2: (None, "no answer"), 3: ("said c", None)}


def test_prompts_answers_and_secrets(spark):
    df = spark.createDataFrame([('{"choices": [{"message": {"content": "A"}}]}',), ('{"choices": [{"text": "B"}]}',), ('{"generated_text": "C"}',), ("plain",), ('{"x": 1}',)], "body string")
    assert [r[0] for r in df.select(V.message_text(F.col("body"))).collect()] == ["A", "B", "C", "plain", None]
    p = spark.range(1).select(V.prompt(F.lit("chunk text"), F.lit(2), F.array(F.lit("e1"), F.lit("e2")), "Find values.", list(V.MOLECULE_FIELDS), "{}")).first()[0]
    assert "Attempt: 2" in p and "- e1\n- e2" in p and p.index("chunk text") < p.index("JSON object")
    assert spark.range(1).select(V.redacted(F.lit("key k1 k2"), "k1", None)).first()[0] == "key <redacted> k2"
    assert set(V.json_schema(V.NANO_FIELDS)["properties"]["rows"]["items"]["required"]) == set(V.NANO_FIELDS) - {"assay", "condition"}
    states = V.outcome(V.nano_attempts(V.empty_responses(df.select(F.lit(1).alias("k")).limit(1), ["k"]), ["k"]), ["k"]).first()
    assert (states.status, states.n_candidates, states.validated) == ("valid", 0, [])


@pytest.mark.parametrize("text,kept", [('x {"a": "}{", "b": "\\\\"} y {"c": 1}', '{"a": "}{", "b": "\\\\"}'), ('{"a": {"b": 1}} tail', '{"a": {"b": 1}}'), ('{"a": "open', None), ("none", None), ('{"a": "\n}"}', '{"a": "\n}"}')])
def test_first_object_minds_strings(spark, text, kept):
    assert spark.createDataFrame([(text,)], "t string").select(X.first_object(F.col("t"))).first()[0] == kept


def test_streams_cut_whole_articles_without_sections(spark, tmp_path):
    from assayloom.streaming import articles

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("No headings at all here.")
    (tmp_path / "in" / "b.md").write_text("Abstract\nx\nResults\nSome results.")
    query = articles.chunk_stream(articles.read_articles(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("cut").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.article_id, r.section_title) for r in spark.table("cut").collect()} == {("a", "Document"), ("b", "Results")}


def test_streams_keep_the_best_row_of_each_key(spark, tmp_path):
    from assayloom.streaming import articles

    folder, keys = tmp_path / "rows", "smiles string, property_name string, value string, source_type string, _row_order int"
    for n, batch in enumerate([[("C", "MIC", "1", "text", 1)], [("C", "MIC", "2", "table", 2), ("N", "MIC", "3", "text", 3)]]):
        spark.createDataFrame(batch, keys).write.mode("append").json(str(folder))
        rows = spark.readStream.schema(keys).json(str(folder))
        articles.upsert_measurements(rows, str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
        best = {(r.canonical_smiles, r.value) for r in spark.read.parquet(str(tmp_path / "t" / f"v{n}")).collect()}
        assert best == ({("C", 1.0)} if n == 0 else {("C", 2.0), ("N", 3.0)})
