"""Chat plug-ins, chemistry plug-ins, the service's functions and display helpers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from assayloom import service
from assayloom.operators import lineage as L
from assayloom.operators import models as M
from assayloom.operators import validate as V


def test_a_chat_model_is_asked_in_the_format_it_takes(spark):
    def post(request):
        if request["response_format"]["type"] == "json_schema":
            raise OSError("no schemas, key s3cret")
        asked = request["messages"][1]["content"]
        if "broken" in asked:
            raise OSError("down, key s3cret")
        row = {"formula": "CeO2" if "Xx2" in asked.split("Article chunk:")[0] or "fine" in asked else "Xx2", "property": "Km", "value": 2, "units": "mM"}
        return json.dumps({"choices": [{"message": {"content": json.dumps({"rows": [row]})}}]})

    chunks = spark.createDataFrame([(1, "fine"), (2, "wrong at first"), (3, "broken")], "k long, text string")
    ask = M.chat_asker(post, "m", nano=True, token="s3cret")
    got = {r.k: r for r in V.with_retries(chunks, ask, ["k"], nano=True, max_attempts=2).collect()}
    assert [(got[k].status, got[k].attempts) for k in (1, 2, 3)] == [("valid", 1), ("valid", 2), ("failed", 2)]
    errors = ask(chunks.where("k = 3").withColumns({"attempt": F.lit(1), "errors": F.array().cast("array<string>")})).first().error
    assert "<redacted>" in errors and "s3cret" not in errors
    assert M.headers("t", {"OPENROUTER_APP_TITLE": "a"}) == {"Authorization": "Bearer t", "X-Title": "a"} and M.headers(None, {}) == {}
    assert "response_format" not in M.request("m", "p", {}, None) and M.request("m", "p", {}, "json_object")["temperature"] == 0


def test_chemistry_without_its_library(spark):
    try:
        import rdkit  # noqa: F401
    except ImportError:
        df = spark.createDataFrame([("CCO",), (None,)], "s string")
        assert [r[0] for r in df.select(M.rdkit_canonical(F.col("s"))).collect()] == ["CCO", None]
        assert [r[0] for r in df.select(M.rdkit_weight(F.col("s"))).collect()] == [None, None]


def test_requests(spark):
    assert service.health() == {"status": "ok"}
    assert [c["section_title"] for c in service.chunk_text(spark, {"text": "Abstract\nx\nResults\ny"})["chunks"]] == ["Results"]
    got = service.run_agent(spark, {"task": "find", "text": "Results\ny\nMethods\nz"})
    assert got["selected_sections"] == ["Methods", "Results"] and got["context"] == "## Results\n\ny\n\n## Methods\n\nz" and len(got["steps"]) == len(got["trace"]) == 3
    for call, status in ((lambda: service.chunk_text(spark, {}), 422), (lambda: service.chunk_text(spark, {"text": "x", "max_chars": 10}), 422), (lambda: service.parse_pdf("a.txt", b"x", dict), 400), (lambda: service.parse_pdf("a.pdf", b"", dict), 400), (lambda: service.parse_pdf("a.PDF", b"x", lambda d: 1 / 0), 500)):
        with pytest.raises(service.RequestError) as e:
            call()
        assert e.value.status == status
    assert service.parse_pdf("a.pdf", b"x", lambda d: {"n": len(d)}) == {"n": 1}


def test_display_helpers(spark):
    label = L.evidence_label(F.lit(0), F.lit(" "), F.lit("Km"), F.lit("2"), F.lit("mM"))
    assert spark.range(1).select(label).first()[0] == "1: row 1 | Km = 2 mM"
    assert L.preferred_first(spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(3).alias("c")), ["c", "x", "b"]).columns == ["c", "b", "a"]
    names = {v: spark.range(1).select(L.safe_filename(F.lit(" é.a/b__ "), v)).first()[0] for v in ("runs", "chars", "plain")}
    assert names == {"runs": "a_b", "chars": "é.a_b", "plain": "é_a_b"}
    view = spark.createDataFrame([(1, True, 2), (2, False, None), (0, True, 1)], "index int, selected boolean, retrieval_rank int")
    assert [r["index"] for r in L.for_display(view, ["index"]).collect()] == [0, 1, 2]
