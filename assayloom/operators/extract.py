"""Extraction responses: repair and parse, check against the schema, validate, choose the attempt that counts.

A response table has a row per (chunk, attempt) with the text a model gave. Producers of such rows (a
service, a replay) plug in through ``respond``; all that follows is column expressions and windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.chem import checked_formula
from assayloom.functions.exprs import compact_key, let, strip, text

STRINGS = "array<string>"
# The fields of a nano row and the keys that may stand for each.
ALIASES = {
    "material_id": ["material_id", "compound_id", "id"],
    "material_name": ["material_name", "material", "name"],
    "material_formula": ["material_formula", "formula", "composition"],
    "property_name": ["property_name", "property", "endpoint"],
    "unit": ["unit", "units"],
    "assay": ["assay", "method", "measurement"],
    "condition": ["condition", "conditions"],
}
# What reads as a formula inside a name, and the keys under which rows are found.
FORMULA_IN_NAME = r"\b(?:[A-Z][a-z]?\s*\d*(?:\.\d+)?\s*){2,}\b"
ENVELOPES = ["validated_objects", "extracted_objects", "rows", "data"]


def unfenced(x: Column) -> Column:
    """The inside of a text that is one Markdown code block."""
    t = strip(x)
    inside = F.regexp_extract(t, r"(?is)^```(?:json)?\s*(.*?)\s*```\z", 1)
    return F.when(t.rlike(r"(?is)^```(?:json)?\s*.*?\s*```\z"), inside).otherwise(t)


def first_object(x: Column) -> Column:
    """The first balanced ``{...}``, strings and escapes minded; null without one.

    Whole strings, closed or not, and braces are the marks of the text; the fold goes over them, not over characters.
    """
    marks = r'(?s)"(?:[^"\\]++|\\.)*+"?|[{}]'
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, m: Column) -> Column:
        at = s["at"] + F.length(m["gap"]) + F.length(m["mark"])
        depth = s["depth"] + F.when(m["mark"] == "{", 1).when(m["mark"] == "}", -1).otherwise(0)
        closes = (s["end"] == 0) & (m["mark"] == "}") & (depth == 0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(closes, at).otherwise(s["end"]).alias("end"))

    def cut(rest: Column) -> Column:
        pairs = F.filter(F.arrays_zip(F.split(rest, marks, -1).alias("gap"), F.regexp_extract_all(rest, F.lit(marks), F.lit(0)).alias("mark")), lambda m: m["mark"].isNotNull())
        return let(F.aggregate(pairs, zero, step, lambda s: s["end"]), lambda e: F.when(e > 0, F.substring(rest, F.lit(1), e)))

    start = F.position(F.lit("{"), x)
    return F.when(start > 0, let(F.substring(x, start, F.length(x)), cut))


def payload(x: Column) -> Column:
    """A response as VARIANT: its text, or the first object in it; null where neither parses."""
    return let(unfenced(x), lambda t: F.coalesce(F.try_parse_json(t), F.try_parse_json(first_object(t))))


def envelope_rows(v: Column) -> Column:
    """The rows of a payload as an array of VARIANT: a list's items, a known field's, or the object alone."""
    return let(v, lambda p: let(F.schema_of_variant(p), lambda kind: _rows(p, kind)))


def _rows(v: Column, kind: Column) -> Column:
    out = F.when(kind.startswith("OBJECT"), F.array(v))
    for name in reversed(ENVELOPES):
        out = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), out)
    rows = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(out)
    return F.filter(rows, lambda r: F.schema_of_variant(r).startswith("OBJECT"))


def entries(row: Column) -> Column:
    """A VARIANT object's fields as structs (k: the name's lower-case letters and digits, v: the value as text)."""
    named = F.map_entries(F.try_variant_get(row, "$", "map<string,variant>"))
    return F.transform(named, lambda e: F.struct(compact_key(e["key"]).alias("k"), strip(F.try_variant_get(e["value"], "$", "string")).alias("v")))


def field(fields: Column, names: list[str]) -> Column:
    """The first filled of a row's fields, by any of the names, as text; of fields whose names differ in case or marks only, the last."""
    def called(name: str) -> Column:
        key = F.lit("".join(c for c in name if c.isalnum()))
        return F.get(F.reverse(F.filter(fields, lambda e: e["k"] == key)), F.lit(0))["v"]

    return F.coalesce(*[F.nullif(called(n), F.lit("")) for n in names], F.lit(""))


def numeric(x: Column) -> Column:
    """The first number in a text, a decimal comma allowed; NaN without one."""
    t = F.replace(text(x), F.lit(","), F.lit("."))
    found = F.regexp_extract(t, r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", 0)
    return F.coalesce(F.when(found != "", found.try_cast("double")), F.lit(float("nan")))


def first_formula(name: Column) -> Column:
    """The first run in a name that reads as a valid formula."""
    found = F.transform(F.regexp_extract_all(name, F.lit(FORMULA_IN_NAME), F.lit(0)), lambda c: checked_formula(c))
    return F.coalesce(F.get(F.filter(found, lambda c: c != ""), F.lit(0)), F.lit(""))


def nano_row(row: Column) -> list[Column]:
    """Canonical fields of a VARIANT row, found by name whatever its case and marks."""

    def whole(fields: Column) -> Column:
        got = F.struct(*[field(fields, names).alias(k) for k, names in ALIASES.items()])

        def filled(g: Column) -> Column:
            formula = F.when(g["material_formula"] != "", g["material_formula"]).otherwise(first_formula(g["material_name"]))
            return let(formula, lambda f: F.struct(*[F.when(g["material_id"] != "", g["material_id"]).otherwise(F.lit("material")).alias(k) if k == "material_id" else f.alias(k) if k == "material_formula" else F.when(g["material_name"] != "", g["material_name"]).otherwise(f).alias(k) if k == "material_name" else g[k].alias(k) for k in ALIASES]))

        return let(got, filled)

    made = let(entries(row), whole)
    return [*[made[k].alias(k) for k in ALIASES], numeric(F.try_variant_get(row, "$.value", "string")).alias("value")]


def final_attempts(attempts: DataFrame, keys: list[str], max_attempts: int = 3) -> DataFrame:
    """(keys, attempt, status) of the attempt that counts: the first good one within the limit, else the last.

    ``attempts`` has ``attempt`` from 1, ``failed`` (nothing could be read) and ``n_errors``.
    """
    good = ~F.col("failed") & (F.col("n_errors") == 0)
    tried = attempts.where(F.col("attempt") <= max(1, max_attempts))
    first = tried.groupBy(*keys).agg(F.min(F.when(good, F.col("attempt"))).alias("good"), F.max("attempt").alias("last"), F.max_by("failed", "attempt").alias("last_failed"))
    status = F.when(F.col("good").isNotNull(), "valid").when(F.col("last_failed"), "failed").otherwise("invalid")
    return first.select(*keys, F.coalesce("good", "last").alias("attempt"), status.alias("status"))


def ordered_union(*lists: Column) -> Column:
    """Distinct non-empty texts of several lists, first seen first."""
    return F.array_distinct(F.filter(F.concat(*lists), lambda x: x.isNotNull() & (x != "")))


def error_log(attempts: DataFrame, final: DataFrame, keys: list[str], errors: str = "errors") -> DataFrame:
    """(keys, error_log): the distinct errors of all attempts up to the one that counts, in order.

    An attempt's list is gathered per chunk, whose attempts are at most a handful.
    """
    upto = attempts.join(final.select(*keys, F.col("attempt").alias("stop")), keys).where(F.col("attempt") <= F.col("stop"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("attempt", errors))), lambda x: x[errors])
    return upto.groupBy(*keys).agg(ordered_union(F.flatten(lists)).alias("error_log"))


def respond(chunks: DataFrame, model: Callable[[pd.DataFrame], pd.Series], keys: list[str], text_col: str = "text") -> DataFrame:
    """Ask a plug-in for responses, Arrow batch by batch: (keys, response, error).

    Where a batch raises, its rows are asked one by one; a row that raises by itself has a null response and the error's text.
    """
    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = pdf[keys].copy()
            try:
                out["response"], out["error"] = model(pdf).astype("object"), None
            except (TypeError, ValueError, RuntimeError):
                said = [alone(pdf.iloc[i : i + 1]) for i in range(len(pdf))]
                out["response"], out["error"] = [s for s, _ in said], [e for _, e in said]
            yield out

    def alone(row: pd.DataFrame) -> tuple[str | None, str | None]:
        try:
            return model(row).iloc[0], None
        except (TypeError, ValueError, RuntimeError) as e:
            return None, str(e)

    return chunks.select(*keys, text_col, *[c for c in chunks.columns if c not in [*keys, text_col]]).mapInPandas(run, f"{kinds}, response string, error string")


