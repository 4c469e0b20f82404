"""Pick-one aggregation of measurement rows: normalise, score, choose by source priority, report conflicts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.chem import checked_formula
from assayloom.functions.exprs import falsy_default, flag_list, lookup, number, or_default, rounded, text

# How much each kind of source counts.
MOLECULE_PRIORITY = {"docling_table": 30, "camelot_table": 30, "table": 30, "text": 20, "chunk": 20, "llm_text": 20, "unknown": 10}
NANO_PRIORITY = {"docling_table": 30, "camelot_table": 30, "table": 30, "vision": 25, "text": 20, "chunk": 20, "llm_text": 20, "unknown": 10}
TABLES = ["table", "docling_table", "camelot_table"]
TEXTS = ["text", "chunk", "llm_text"]
VISIONS = ["vision", "cv", "computer_vision"]
# The order of the output columns.
CLEAN = ["canonical_smiles", "property_name", "value", "unit", "compound_id", "smiles", "source_type", "article_id", "source_id", "chunk_index", "quality_score", "quality_flags", "evidence"]
CONFLICTS = ["canonical_smiles", "property_name", "chosen_value", "chosen_source_type", "rejected_value", "rejected_source_type", "resolution", "article_id", "source_id"]
NANO_KEYS = ["normalized_formula", "property_name", "unit", "assay", "condition"]
NANO_CLEAN = ["normalized_formula", "material_formula", "material_name", "property_name", "value", "unit", "assay", "condition", "material_id", "source_type", "article_id", "source_id", "chunk_index", "quality_score", "quality_flags", "evidence"]
NANO_CONFLICTS = [*NANO_KEYS, *CONFLICTS[2:]]
REJECTED = ["reason", "validator", "material_formula", "normalized_formula", "material_name", "property_name", "value", "unit", "assay", "condition", "material_id", "source_type", "article_id", "source_id", "chunk_index", "evidence"]


class Aggregated(NamedTuple):
    clean: DataFrame
    conflicts: DataFrame
    rejected: DataFrame | None = None


def with_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with null text columns for the names it lacks."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def source_type(x: Column | str, nano: bool = False) -> Column:
    """A known source kind, or ``unknown``; nano rows also know vision by its other names."""
    t = F.lower(text(x))
    known = list(NANO_PRIORITY if nano else MOLECULE_PRIORITY)
    out = F.when(t.isin(known), t)
    if nano:
        out = out.when(t.isin(VISIONS), F.lit("vision"))
    return out.otherwise(F.lit("unknown"))


def quality(source: Column, identifier: Column, unit: Column, evidence: Column, condition: Column, flag: str) -> tuple[Column, Column]:
    """(score, flags) of a row from its kind of source and which of its fields are filled."""
    kind = F.lower(text(source))
    score = F.when(kind.isin(TABLES), 30).when(kind.isin(VISIONS), 25).when(kind.isin(TEXTS), 20).otherwise(10)
    names = F.when(kind.isin(TABLES), "from_table").when(kind.isin(VISIONS), "from_vision").when(kind.isin(TEXTS), "from_text").otherwise("source_unknown")
    filled = [(text(identifier) != "", 25, flag, "missing_identifier"), (text(unit) != "", 15, "has_unit", "missing_unit"), (text(evidence) != "", 20, "has_evidence", "missing_evidence"), (text(condition) != "", 5, "has_condition", None)]
    flags = [names]
    for has, points, yes, no in filled:
        score = score + F.when(has, points).otherwise(0)
        flags.append(F.when(has, F.lit(yes)).otherwise(F.lit(no)))
    return F.least(score, F.lit(100)).cast("int"), flag_list(*flags)


def _scored(df: DataFrame, identifier: str, flag: str, nano: bool) -> DataFrame:
    score, flags = quality(F.col("source_type"), F.col(identifier), F.col("unit"), F.col("evidence"), F.col("condition") if nano else F.lit(""), flag)
    table = NANO_PRIORITY if nano else MOLECULE_PRIORITY
    return df.withColumns({"quality_score": score, "quality_flags": flags, "source_priority": lookup(F.col("source_type"), table).cast("int")})


def normalize_molecules(rows: DataFrame, decimals: int = 3, order: str = "_row_order", smiles: Column | None = None) -> DataFrame:
    """Usable rows with normalised columns. ``smiles`` canonicalises where no canonical form is given; identity by default.

    A row without identifier, property or finite value is dropped. Columns the input lacks count as empty.
    """
    df = with_columns(rows, "canonical_smiles", "smiles", "property_name", "property", "value", "unit", "compound_id", "source_type", "article_id", "source_id", "chunk_index", "evidence")
    made = smiles if smiles is not None else text("smiles")
    df = df.select(
        or_default(text("canonical_smiles"), made).alias("canonical_smiles"), falsy_default("property_name", "property", F.lit("pMIC")).alias("property_name"), number("value").alias("value"),
        source_type("source_type").alias("source_type"), *[text(c).alias(c) for c in ("unit", "compound_id", "smiles", "article_id", "source_id", "chunk_index", "evidence")], F.col(order).alias("_row_order"),
    )
    df = df.where((F.col("canonical_smiles") != "") & (F.col("property_name") != "") & F.col("value").isNotNull()).withColumn("value", rounded("value", decimals))
    return _scored(df, "canonical_smiles", "valid_smiles", False)


def resolution() -> Column:
    """Why the first row of a group won over another."""
    won = F.when(F.col("first.source_type").isin(TABLES), "table_priority").otherwise("source_priority")
    return F.when(F.col("first.source_priority") > F.col("source_priority"), won).when(F.col("first.source_priority") == F.col("source_priority"), "first_seen_same_priority").otherwise("lower_priority_selected")


def pick_one(rows: DataFrame, keys: list[str], clean: list[str], conflicts: list[str], tolerance: float = 1e-9, order: list[str] | None = None) -> Aggregated:
    """The first row of each key by (priority, row order), and the later rows whose values differ.

    The clean rows come from ``min_by``, which combines before the shuffle, so a key of very many rows
    stays cheap. Conflicts join the first value back, so the rows of a hot key stay spread.
    """
    order = order or ["_row_order"]
    rank = F.struct((-F.col("source_priority")).alias("p"), *order)
    wanted = list(dict.fromkeys([*clean, "value", "source_type", "source_priority"]))
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in wanted if c not in keys]), rank).alias("first"), F.min(rank).alias("first_rank"))
    kept = first.select(*[F.col(c) if c in keys else F.col(f"first.{c}").alias(c) for c in clean])
    others = rows.withColumn("rank", rank).join(first, keys).where((F.col("rank") != F.col("first_rank")) & (F.abs(F.col("first.value") - F.col("value")) > tolerance))
    named = {"chosen_value": F.col("first.value"), "chosen_source_type": F.col("first.source_type"), "rejected_value": F.col("value"), "rejected_source_type": F.col("source_type"), "resolution": resolution()}
    return Aggregated(kept, others.select(*[named[c].alias(c) if c in named else F.col(c) for c in conflicts]))


def aggregate_molecules(rows: DataFrame, decimals: int = 3, tolerance: float = 1e-9, order: str = "_row_order", per_article: bool = False, smiles: Column | None = None) -> Aggregated:
    """Clean and conflicting rows by (identifier, property); with ``per_article`` an article's rows stay apart."""
    keys = ["canonical_smiles", "property_name", *(["article_id"] if per_article else [])]
    return pick_one(normalize_molecules(rows, decimals, order, smiles), keys, CLEAN, CONFLICTS, tolerance)


def normalize_nano(rows: DataFrame, decimals: int = 6, order: str = "_row_order") -> DataFrame:
    """All rows with normalised columns and ``usable``."""
    df = with_columns(rows, "normalized_formula", "material_formula", "formula", "property_name", "property", "value", "unit", "units", "material_name", "material", "assay", "condition", "material_id", "compound_id", "source_type", "article_id", "source_id", "chunk_index", "evidence", "reason", "validator")
    df = df.select(
        falsy_default("material_formula", "formula").alias("raw_formula"), text("normalized_formula").alias("given"), falsy_default("property_name", "property").alias("property_name"), falsy_default("unit", "units").alias("unit"), number("value").alias("value"), text("value").alias("raw_value"),
        falsy_default("material_name", "material").alias("material_name"), falsy_default("material_id", "compound_id").alias("material_id"), source_type("source_type", True).alias("source_type"), text("source_type").alias("raw_source"),
        *[text(c).alias(c) for c in ("assay", "condition", "article_id", "source_id", "chunk_index", "evidence", "reason", "validator")], F.col(order).alias("_row_order"),
    )
    df = df.withColumns({"normalized_formula": or_default(F.col("given"), checked_formula(F.col("raw_formula"))), "value": rounded("value", decimals)})
    return df.withColumn("usable", (F.col("normalized_formula") != "") & (F.col("property_name") != "") & (F.col("unit") != "") & F.col("value").isNotNull())


def aggregate_nano(rows: DataFrame, decimals: int = 6, tolerance: float = 1e-9, order: str = "_row_order", per_article: bool = False) -> Aggregated:
    """Clean and conflicting rows by (formula, property, unit, assay, condition), and the rows that can't be used."""
    every = normalize_nano(rows, decimals, order)
    good = every.where("usable").withColumn("material_formula", or_default(F.col("raw_formula"), F.col("normalized_formula")))
    keys = [*NANO_KEYS, *(["article_id"] if per_article else [])]
    picked = pick_one(_scored(good, "normalized_formula", "valid_formula", True), keys, NANO_CLEAN, NANO_CONFLICTS, tolerance)
    bad = every.where("not usable").withColumns({"reason": or_default(F.col("reason"), "missing_or_invalid_required_field"), "validator": or_default(F.col("validator"), "nano_aggregation"), "material_formula": F.col("raw_formula"), "value": F.col("raw_value"), "source_type": F.col("raw_source")})
    return Aggregated(picked.clean, picked.conflicts, bad.select(*REJECTED))
