"""Responses to validated rows: schema gates, chemistry checks, and the retry loop around a model.

A response is the text a model gave for a chunk at an attempt. ``molecule_attempts`` and ``nano_attempts`` judge each
response by itself, its rows in an array; ``outcome`` gathers a chunk's few attempts and keeps what counts. Small-molecule
responses stand or fall as a whole, nano responses row by row, and rejected nano rows of all attempts are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.chem import canonical_property, clean_formula, formula_errors, property_allowed, sanity_errors
from assayloom.functions.exprs import let, letters_key, strip, text
from assayloom.operators.extract import first_object, nano_row, ordered_union, unfenced
from assayloom.tables import stored

# The fields of a row, in the order in which they are checked; those with a default may be missing.
MOLECULE_FIELDS = {"compound_id": None, "smiles": None, "property_name": None, "value": None, "unit": None}
NANO_FIELDS = {"material_id": None, "material_name": None, "material_formula": None, "property_name": None, "value": None, "unit": None, "assay": "", "condition": ""}
# What is said of a field.
MISSING, NO_STRING, NO_NUMBER, EMPTY, EXTRA = "Field required", "Input should be a valid string", "Input should be a valid number", "String should have at least 1 character", "Extra inputs are not permitted"
NO_LIST, NO_ROW = "Input should be a valid list", "Input should be a valid dictionary"
FAILED = "extractor output validation failed: "
_MAP = "map<string,variant>"
_NONE = "array<string>"


def quoted(x: Column) -> Column:
    """A text as Python shows it: in single quotes, or in double ones where it holds only single ones."""
    t = F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))


def parsed(response: Column) -> tuple[Column, Column]:
    """(payload, error) of a response: its text or the first object in it as VARIANT, or why there is none."""
    t = unfenced(response)
    payload = let(t, lambda x: F.coalesce(F.try_parse_json(x), F.try_parse_json(first_object(x))))
    why = let(t, lambda x: F.when(~F.contains(x, F.lit("{")), "No JSON object found in extractor response.").when(first_object(x).isNull(), "Unterminated JSON object in extractor response.").otherwise("Extractor response is not valid JSON."))
    kind = lambda p: F.schema_of_variant(p)
    error = let(payload, lambda p: F.when(p.isNull(), why).when(~kind(p).startswith("OBJECT") & ~kind(p).startswith("ARRAY"), "Extractor JSON payload must be an object or list."))
    return payload, error


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def field_errors(entries: Column, fields: dict, where: Column) -> Column:
    """What is wrong with a row given as a map of VARIANT, as texts ``where`` + field + what, in the order of the fields, others last."""
    said = lambda name, what: F.concat(where, name if isinstance(name, Column) else F.lit(name), F.lit(f": {what}"))
    out = []
    for name, default in fields.items():
        v = F.try_element_at(entries, F.lit(name))
        known = F.array_contains(F.map_keys(entries), name)
        missing = F.lit(None).cast("string") if default is not None else said(name, MISSING)
        if name == "value":
            wrong = F.when(~_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), said(name, NO_NUMBER))
        else:
            wrong = F.when(~_kind(v).startswith("STRING"), said(name, NO_STRING))
            if default is None:
                wrong = wrong.when(F.try_variant_get(v, "$", "string") == "", said(name, EMPTY))
        out.append(F.when(~known, missing).otherwise(wrong))
    names = F.array(*[F.lit(f) for f in fields])
    extra = F.transform(F.array_except(F.map_keys(entries), names), lambda k: said(k, EXTRA))
    return F.concat(F.filter(F.array(*out), lambda e: e.isNotNull()), extra)


def molecule_rows(payload: Column) -> tuple[Column, Column]:
    """(rows, errors): a payload's rows as structs, and what is wrong with any of them or with the payload itself.

    A blank unit of the property pMIC is pMIC. Any error empties the whole batch.
    """

    def whole(p: Column) -> Column:
        is_list = _kind(p).startswith("ARRAY")
        top = F.when(~is_list, F.try_variant_get(p, "$", _MAP))
        given = F.when(is_list, p).otherwise(F.try_element_at(top, F.lit("rows")))
        items = F.try_variant_get(given, "$", "array<variant>")
        extra = F.coalesce(F.transform(F.array_except(F.map_keys(top), F.array(F.lit("rows"))), lambda k: F.concat(k, F.lit(f": {EXTRA}"))), F.array().cast(_NONE))
        no_list = F.when(F.array_contains(F.map_keys(top), "rows") & items.isNull(), F.array(F.lit(f"rows: {NO_LIST}"))).otherwise(F.array().cast(_NONE))

        def row(v: Column, i: Column) -> Column:
            def checked(m: Column) -> Column:
                said = lambda k: F.coalesce(F.try_variant_get(F.try_element_at(m, F.lit(k)), "$", "string"), F.lit(""))
                filled = (F.lower(strip(said("property_name"))) == "pmic") & (strip(said("unit")) == "")
                unit = F.when(filled, F.parse_json(F.lit('"pMIC"'))).otherwise(F.try_element_at(m, F.lit("unit")))
                own = F.map_concat(F.map_filter(m, lambda k, _: k != "unit"), F.when(filled | F.array_contains(F.map_keys(m), "unit"), F.map_from_arrays(F.array(F.lit("unit")), F.array(unit))).otherwise(F.map_from_arrays(F.array().cast(_NONE), F.array().cast("array<variant>"))))
                where = F.concat(F.lit("rows."), i.cast("string"), F.lit("."))
                errors = let(own, lambda o: F.when(m.isNull(), F.array(F.concat(F.lit("rows."), i.cast("string"), F.lit(f": {NO_ROW}")))).otherwise(field_errors(o, MOLECULE_FIELDS, where)))
                value = F.try_variant_get(F.try_element_at(m, F.lit("value")), "$", "double")
                return F.struct(errors.alias("errors"), *[(value if k == "value" else F.when(filled, F.lit("pMIC")).otherwise(said(k)) if k == "unit" else said(k)).alias(k) for k in MOLECULE_FIELDS])

            return let(F.when(_kind(v).startswith("OBJECT"), F.try_variant_get(v, "$", _MAP)), checked)

        made = F.coalesce(F.transform(items, row), F.array())
        return let(made, lambda rows: F.struct(rows.alias("rows"), F.concat(no_list, F.flatten(F.transform(rows, lambda r: r["errors"])), extra).alias("errors")))

    out = let(payload, whole)
    return out["rows"], out["errors"]


Lifted = Callable[[Column], Column]


def each(one: Lifted) -> Lifted:
    """A plug-in on one text as one on an array of texts."""
    return lambda xs: F.transform(xs, one)


_ROW = "row:int,state:string,reason:string,errors:array<string>"
_MOLECULE = "array<struct<" + ",".join(f"{k}:{'double' if k == 'value' else 'string'}" for k in MOLECULE_FIELDS) + f",canonical_smiles:string,{_ROW}>>"
_NANO = "array<struct<" + ",".join(f"{k}:{'double' if k == 'value' else 'string'}" for k in NANO_FIELDS) + f",normalized_formula:string,{_ROW},validator:string,row_index:int>>"


def _checked(rows: Column, kind: str, judge: Callable[[Column, Column, Column], Column]) -> Column:
    """Rows judged one after the other: ``judge(row, number, seen)`` gives (counts, key, out); keys of valid rows are seen from then on."""
    zero = F.struct(F.lit(0).alias("n"), F.array().cast(_NONE).alias("seen"), F.array().cast(kind).alias("out"))

    def step(s: Column, r: Column) -> Column:
        def put(j: Column) -> Column:
            seen = F.when(j["out"]["state"] == "valid", F.concat(s["seen"], F.array(j["key"]))).otherwise(s["seen"])
            return F.struct((s["n"] + j["counts"]).alias("n"), seen.alias("seen"), F.concat(s["out"], F.array(j["out"])).alias("out"))

        return let(judge(r, s["n"] + 1, s["seen"]), put)

    return F.aggregate(rows, zero, step, lambda s: s["out"])


def _molecule(r: Column, n: Column, seen: Column) -> Column:
    place = F.concat(F.lit("row "), n.cast("string"), F.lit(" compound_id="), r["compound_id"])
    key = F.to_json(F.struct(r["canonical_smiles"].alias("a"), r["property_name"].alias("b")))
    again = F.array_contains(seen, key)
    state = F.when(r["canonical_smiles"].isNull(), "error").when(again, "duplicate").otherwise("valid")
    reason = F.when(r["canonical_smiles"].isNull(), F.concat(place, F.lit(": RDKit could not parse SMILES "), quoted(r["smiles"]))).when(again, F.concat(place, F.lit(": duplicate "), r["property_name"], F.lit(" for "), r["canonical_smiles"], F.lit(" skipped"))).otherwise(F.lit(""))
    told = lambda x: F.when(x != "", F.array(x)).otherwise(F.array().cast(_NONE))
    out = F.struct(*[r[k].alias(k) for k in MOLECULE_FIELDS], r["canonical_smiles"].alias("canonical_smiles"), n.alias("row"), state.alias("state"), reason.alias("reason"), told(reason).alias("errors"))
    return F.struct(F.lit(1).alias("counts"), key.alias("key"), out.alias("out"))


def _attempts(df: DataFrame, keys: list[str], warn: list[str]) -> DataFrame:
    """(keys, attempt, failed, n_candidates, errors, warnings, n_errors, rows) of (keys, attempt, bad, rows)."""
    told = lambda states: F.flatten(F.transform(F.filter("rows", lambda r: r["state"].isin(states)), lambda r: r["errors"]))
    failure = F.when(F.col("bad").isNotNull(), F.array(F.concat(F.lit(FAILED), F.col("bad")))).otherwise(F.array().cast(_NONE))
    df = df.withColumns({"errors": F.concat(failure, told(["error"])), "warnings": told(warn), "n_candidates": F.size(F.filter("rows", lambda r: r["row"] > 0)).cast("long")})
    return df.select(*keys, "attempt", F.col("bad").isNotNull().alias("failed"), "n_candidates", "errors", "warnings", F.size("errors").alias("n_errors"), "rows")


def molecule_attempts(responses: DataFrame, keys: list[str], response: str = "response", canonical: Lifted | None = None) -> DataFrame:
    """Small-molecule responses (keys, attempt, response) judged: (keys, attempt, failed, n_candidates, errors, warnings, n_errors, rows).

    ``rows`` has each candidate with its number from 1, canonical_smiles, ``state`` (valid, error, duplicate) and
    ``reason``. ``canonical`` is a chemistry plug-in from an array of SMILES to an array of canonical ones, null where one
    can't be read; identity by default. Of rows that agree in canonical form and property the first of an attempt
    counts. A null response failed. A response's rows stay in one array: no shuffle.
    """
    payload, error = parsed(F.coalesce(F.col(response), F.lit("")))
    df = responses.select(*keys, "attempt", payload.alias("__p"), error.alias("__e"))
    got, errors = molecule_rows(F.col("__p"))
    df = df.select(*keys, "attempt", "__e", F.struct(got.alias("rows"), errors.alias("errors")).alias("got"))
    bad = F.when(F.col("__e").isNotNull(), F.col("__e")).when(F.size("got.errors") > 0, F.array_join("got.errors", "; "))
    df = df.select(*keys, "attempt", bad.alias("bad"), F.col("got.rows").alias("given")).withColumn("given", F.when(F.col("bad").isNull(), F.col("given")).otherwise(F.filter("given", lambda _: F.lit(False))))
    smiles = F.transform("given", lambda r: r["smiles"])
    df = df.withColumn("made", canonical(smiles) if canonical is not None else smiles)
    rows = F.zip_with("given", "made", lambda r, c: F.struct(*[r[k].alias(k) for k in MOLECULE_FIELDS], c.alias("canonical_smiles")))
    return _attempts(df.select(*keys, "attempt", "bad", _checked(F.coalesce(rows, F.array()), _MOLECULE, _molecule).alias("rows")), keys, ["duplicate"])


def nano_items(payload: Column) -> tuple[Column, Column]:
    """(items, error) of a nano payload: a list's items or those of its ``rows``."""

    def whole(p: Column) -> Column:
        items = F.when(_kind(p).startswith("ARRAY"), F.try_variant_get(p, "$", "array<variant>")).otherwise(F.try_variant_get(p, "$.rows", "array<variant>"))
        return let(items, lambda xs: F.struct(xs.alias("items"), F.when(xs.isNull(), F.lit("Nanozyme extractor JSON payload must contain a rows array.")).alias("error")))

    out = let(payload, whole)
    return out["items"], out["error"]


def nano_gate(items: Column, aliases: bool = True) -> Column:
    """An array of VARIANT items as rows with ``index`` from 1 and ``schema_reason``, empty where the row may go on.

    With ``aliases`` (JSON responses) fields are found under their other names before they are checked; without, as for
    rows a plug-in hands over itself, names must be exact and types right.
    """

    def gate(v: Column, i: Column) -> Column:
        is_row = _kind(v).startswith("OBJECT")

        def checked(n: Column) -> Column:
            if aliases:
                empty = [F.when(n[k] == "", F.lit(f"{k}: {EMPTY}")) for k, default in NANO_FIELDS.items() if default is None and k != "value"]
                wrong = F.filter(F.array(*empty), lambda e: e.isNotNull())
            else:
                wrong = let(F.try_variant_get(v, "$", _MAP), lambda m: field_errors(m, NANO_FIELDS, F.lit("")))
            wrong = F.when(~is_row, F.array(F.lit(f"row: {NO_ROW}"))).otherwise(wrong)
            reason = let(wrong, lambda w: F.when(F.size(w) > 0, F.concat(F.lit("row "), (i + 1).cast("string"), F.lit(": "), F.array_join(w, "; "))).otherwise(F.lit("")))
            shown = [F.when(is_row, n[k]).alias(k) for k in NANO_FIELDS]
            return F.struct(*shown, (i + 1).cast("int").alias("index"), reason.alias("schema_reason"))

        return let(F.struct(*nano_row(F.when(is_row, v))), checked)

    return F.transform(items, gate)


def _nano(r: Column, n: Column, seen: Column) -> Column:
    place = F.concat(F.lit("row "), n.cast("string"), F.lit(" material_id="), r["material_id"], F.lit(": "))
    none = F.array().cast(_NONE)

    def judged(f: Column) -> Column:
        # f: formula, canonical property, key, what is wrong with the property, what is wrong with formula and value
        again = F.array_contains(seen, f["key"])
        refused = r["schema_reason"] != ""
        state = F.when(refused, "schema").when(f["no_property"].isNotNull(), "property").when(F.size(f["wrong"]) > 0, "error").when(again, "duplicate").otherwise("valid")

        def out(s: Column) -> Column:
            errors = F.when(s == "error", F.transform(f["wrong"], lambda e: F.concat(place, e))).when(s == "property", F.array(F.concat(place, f["no_property"]))).when(s == "duplicate", F.array(F.concat(place, F.lit("duplicate "), f["canonical"], F.lit(" for "), f["formula"], F.lit(" skipped")))).otherwise(none)
            valid = s == "valid"
            fields = [F.when(valid, f["canonical"]).otherwise(r[k]).alias(k) if k == "property_name" else r[k].alias(k) for k in NANO_FIELDS]
            more = let(errors, lambda es: F.struct(F.when(s == "schema", r["schema_reason"]).otherwise(F.array_join(es, "; ")).alias("reason"), es.alias("errors")))
            row = F.struct(*fields, F.when(valid, f["formula"]).otherwise(F.lit("")).alias("normalized_formula"), F.when(refused, F.lit(0)).otherwise(n).alias("row"), s.alias("state"), more["reason"].alias("reason"), more["errors"].alias("errors"), F.when(s == "schema", "nano_extractor_schema").when(~valid, "nano_critic").otherwise("").alias("validator"), F.when(refused, r["index"]).otherwise(n).cast("int").alias("row_index"))
            return F.struct(F.when(refused, F.lit(0)).otherwise(F.lit(1)).alias("counts"), f["key"].alias("key"), row.alias("out"))

        return let(state, out)

    def facts(formula: Column) -> Column:
        canonical = canonical_property(r["property_name"])
        no_property = let(letters_key(text(r["property_name"])), lambda k: F.when(k == "", F.lit("property_name is empty")).when(~property_allowed(r["property_name"]), F.concat(F.lit("property_name "), quoted(r["property_name"]), F.lit(" is not an allowed nanozyme endpoint"))))
        wrong = F.concat(formula_errors(r["material_formula"]), sanity_errors(r["property_name"], r["value"], r["unit"]))
        same = [F.lower(text(x)) for x in (r["unit"], r["assay"], r["condition"])]
        return let(canonical, lambda c: F.struct(formula.alias("formula"), c.alias("canonical"), F.to_json(F.array(formula, F.lower(text(c)), *same)).alias("key"), no_property.alias("no_property"), wrong.alias("wrong")))

    return let(let(clean_formula(r["material_formula"]), facts), judged)


def critic(rows: Column) -> Column:
    """Nano rows (an array of the fields, index, schema_reason) judged against chemistry and physics, in order.

    Adds state, reason, errors (each as it is logged), validator, row_index, normalized_formula, and the canonical
    property name of valid rows. ``row`` counts those that passed the schema from 1; 0 stands for the others.
    """
    return _checked(rows, _NANO, _nano)


def nano_attempts(responses: DataFrame, keys: list[str], response: str = "response", aliases: bool = True) -> DataFrame:
    """Nano responses (keys, attempt, response) judged, as ``molecule_attempts``.

    ``rows`` have ``state``: valid, schema, property or duplicate (rejected, the latter two with a warning) and error
    (rejected too, and calls for another attempt), ``reason``, ``validator`` and ``row_index``, which counts all items
    for the schema and those that passed it for the rest. Of rows that agree in formula, property, unit, assay and
    condition the first of an attempt counts.
    """
    payload, error = parsed(F.coalesce(F.col(response), F.lit("")))
    df = responses.select(*keys, "attempt", payload.alias("__p"), error.alias("__e"))
    items, no_rows = nano_items(F.col("__p"))
    df = df.select(*keys, "attempt", F.coalesce("__e", no_rows).alias("bad"), items.alias("items"))
    given = F.when(F.col("bad").isNull(), F.col("items")).otherwise(F.array().cast("array<variant>"))
    df = df.select(*keys, "attempt", "bad", nano_gate(F.coalesce(given, F.array().cast("array<variant>")), aliases).alias("gated"))
    return _attempts(df.select(*keys, "attempt", "bad", critic(F.col("gated")).alias("rows")), keys, ["property", "duplicate"])


def outcome(attempts: DataFrame, keys: list[str], max_attempts: int = 3) -> DataFrame:
    """A row per chunk: (keys, attempts, status, valid, n_candidates, error_log, warnings, validated, rejected).

    The attempt that counts is the first good one within the limit, else the last; at least one is always made. The logs
    are the distinct texts of the attempts up to it, in order. ``validated``: its valid rows. ``rejected``: the others
    of all attempts up to it, in order, schema before chemistry within an attempt (small-molecule batches have none).
    Attempts of a chunk are few; they are gathered by the chunk's key, in one shuffle.
    """
    tried = attempts.where(F.col("attempt") <= max(1, max_attempts))
    rest = [c for c in attempts.columns if c not in keys]
    one = tried.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("all"))
    good = F.array_position(F.transform("all", lambda a: ~a["failed"] & (a["n_errors"] == 0)), True).cast("int")
    one = one.withColumn("stop", F.when(good > 0, good).otherwise(F.size("all"))).withColumn("upto", F.slice("all", 1, F.col("stop"))).withColumn("last", F.element_at("all", F.col("stop")))
    log = lambda c: ordered_union(F.flatten(F.transform("upto", lambda a: a[c])))
    status = F.when(F.col("last.failed"), "failed").when(F.col("last.n_errors") > 0, "invalid").otherwise("valid")
    gone = F.lit(None)
    if "validator" in str(attempts.schema["rows"].dataType.simpleString()):
        by = lambda a, schema: F.filter(a["rows"], lambda r: (r["state"] != "valid") & ((r["state"] == "schema") == F.lit(schema)))
        gone = F.flatten(F.transform("upto", lambda a: F.concat(by(a, True), by(a, False))))
    else:
        gone = F.filter("last.rows", lambda r: F.lit(False))
    return one.select(*keys, F.col("last.attempt").alias("attempts"), status.alias("status"), (status == "valid").alias("valid"), F.col("last.n_candidates").alias("n_candidates"), log("errors").alias("error_log"), log("warnings").alias("warnings"), F.filter("last.rows", lambda r: r["state"] == "valid").alias("validated"), gone.alias("rejected"))


def rows_of(states: DataFrame, keys: list[str], which: str) -> DataFrame:
    """The ``validated`` or ``rejected`` rows of chunks as rows, numbered from 0 in ``place``."""
    drop = ["state", "errors", "row", *(["reason", "validator", "row_index"] if which == "validated" else [])]
    out = states.select(*keys, F.posexplode(which).alias("place", "r")).select(*keys, "place", "r.*")
    return out.drop(*drop)


def prompt(chunk: Column, attempt: Column, errors: Column, task: str, fields: list[str], schema: str | None = None) -> Column:
    """What a model is asked: the task and its fields, the attempt, the errors so far, the chunk, and the JSON shape where one is given."""
    so_far = F.when(F.size(errors) > 0, F.concat(F.lit("- "), F.array_join(errors, "\n- "))).otherwise(F.lit("- none"))
    parts = [F.lit(f"{task}\nReturn rows with these fields only: {', '.join(fields)}.\nMend what the validation errors name before you answer.\n\nAttempt: "), attempt.cast("string"), F.lit("\nPrevious validation errors:\n"), so_far, F.lit("\n\nArticle chunk:\n"), chunk]
    if schema is not None:
        parts.append(F.lit(f"\n\nReturn a single valid JSON object with this shape:\n{schema}\n\nNo Markdown fences, comments or explanations."))
    return F.concat(*parts)


def json_schema(fields: dict) -> dict:
    """The JSON schema of a batch of rows of these fields."""
    kinds = {k: {"type": "number"} if k == "value" else {"type": "string", "minLength": 1} if default is None else {"type": "string", "default": default} for k, default in fields.items()}
    row = {"type": "object", "properties": kinds, "required": [k for k, d in fields.items() if d is None], "additionalProperties": False}
    return {"type": "object", "properties": {"rows": {"type": "array", "items": row}}, "additionalProperties": False}


def message_text(body: Column) -> Column:
    """The answer in a chat completion's JSON: the first choice's message, its text, or the generated text; the body itself where it is no object."""
    v = F.try_parse_json(body)
    paths = ["$.choices[0].message.content", "$.choices[0].text", "$.generated_text"]
    found = F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])
    plain = v.isNull() | ~_kind(v).startswith("OBJECT")
    return F.coalesce(found, F.when(plain, body))


def redacted(x: Column, *secrets: str | None) -> Column:
    """A text in which secrets are not shown."""
    for s in secrets:
        if s:
            x = F.replace(x, F.lit(s), F.lit("<redacted>"))
    return x


def empty_responses(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """A response without rows for each chunk: what stands in where there is no model."""
    return chunks.select(*keys, F.lit(1).alias("attempt"), F.lit('{"rows": []}').alias("response"))


def with_retries(chunks: DataFrame, ask: Callable[[DataFrame], DataFrame], keys: list[str], nano: bool, max_attempts: int = 3, canonical: Lifted | None = None, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """Ask a model about each chunk until its rows have no errors, ``max_attempts`` times at most; what counts, as ``outcome``.

    ``ask`` gets the chunks still open with ``attempt`` and ``errors`` (so far) and returns (keys, response). Each round's
    judged answers are kept (``keep``: a table in the shared folder), so that no chunk is asked twice for one attempt.
    """
    made, open_chunks = None, chunks.withColumns({"attempt": F.lit(1), "errors": F.array().cast(_NONE)})
    for n in range(1, max(1, max_attempts) + 1):
        said = ask(open_chunks).select(*keys, F.lit(n).alias("attempt"), "response")
        judged = keep(nano_attempts(said, keys) if nano else molecule_attempts(said, keys, canonical=canonical))
        made = judged if made is None else made.unionByName(judged)
        if n < max_attempts:
            states = outcome(made, keys, n).where("not valid").select(*keys, F.col("error_log").alias("errors"))
            open_chunks = keep(chunks.join(states, keys).withColumn("attempt", F.lit(n + 1)))
            if open_chunks.limit(1).count() == 0:
                break
    return outcome(made, keys, max_attempts)
