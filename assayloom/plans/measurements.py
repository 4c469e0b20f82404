"""Aggregation, quality and evaluation over the order lines read as measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators import aggregate as A
from assayloom.operators import evaluate as E
from assayloom.plans.registry import query, table

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
_ORDER = ", ".join(ORDER)


def molecule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as small-molecule measurements with mixed sources and gaps."""
    df = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 1, "docling_table").when(F.col("l_linenumber") == 2, " Text ").when(F.col("l_linenumber") == 3, "chunk").when(F.col("l_linenumber") == 4, "table").otherwise("blog")
    return df.select(
        F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("canonical_smiles"), F.when(F.col("l_returnflag") == "N", None).otherwise(F.col("l_returnflag")).alias("property_name"), F.when(F.col("l_linenumber") == 6, "n/a").otherwise(F.replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))).alias("value"),
        F.when(F.col("l_linestatus") == "O", "uM").otherwise("").alias("unit"), kind.alias("source_type"), F.col("l_suppkey").cast("string").alias("compound_id"), F.concat(F.lit("a"), (F.col("l_orderkey") % 50).cast("string")).alias("article_id"), F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("source_id"),
        F.when(F.col("l_quantity") > 25, F.concat(F.lit(" row "), F.col("l_quantity").cast("int").cast("string"))).alias("evidence"), F.struct(*ORDER).alias("_row_order"),
    )


_MOLECULES = f"""
SELECT *, CASE WHEN source_type IN ('docling_table', 'table') THEN 30 WHEN source_type IN ('text', 'chunk') THEN 20 ELSE 10 END AS prio FROM (
  SELECT 'C' || l_partkey AS canonical_smiles, CASE WHEN l_returnflag = 'N' THEN 'pMIC' ELSE l_returnflag END AS property_name, round(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE), 3) AS value,
    CASE WHEN l_linestatus = 'O' THEN 'uM' ELSE '' END AS unit, CAST(l_suppkey AS VARCHAR) AS compound_id, '' AS smiles,
    CASE l_linenumber WHEN 1 THEN 'docling_table' WHEN 2 THEN 'text' WHEN 3 THEN 'chunk' WHEN 4 THEN 'table' ELSE 'unknown' END AS source_type,
    'a' || (l_orderkey % 50) AS article_id, 's' || l_orderkey AS source_id, '' AS chunk_index, CASE WHEN l_quantity > 25 THEN 'row ' || CAST(l_quantity AS INTEGER) ELSE '' END AS evidence, {_ORDER}
  FROM lineitem WHERE l_linenumber <> 6)"""
_MOLECULE_FLAGS = """CASE WHEN source_type IN ('docling_table', 'table') THEN 'from_table' WHEN source_type IN ('text', 'chunk') THEN 'from_text' ELSE 'source_unknown' END
  || ';valid_smiles;' || CASE WHEN unit <> '' THEN 'has_unit' ELSE 'missing_unit' END || ';' || CASE WHEN evidence <> '' THEN 'has_evidence' ELSE 'missing_evidence' END"""
_MOLECULE_RANKED = f"m AS ({_MOLECULES}), r AS (SELECT *, row_number() OVER w AS rn, first_value(value) OVER w AS v1, first_value(source_type) OVER w AS s1, first_value(prio) OVER w AS p1 FROM m WINDOW w AS (PARTITION BY canonical_smiles, property_name ORDER BY prio DESC, {_ORDER}))"
_RESOLUTION = "CASE WHEN p1 > prio THEN CASE WHEN s1 IN ('docling_table', 'camelot_table', 'table') THEN 'table_priority' ELSE 'source_priority' END WHEN p1 = prio THEN 'first_seen_same_priority' ELSE 'lower_priority_selected' END"


@query(f"""WITH {_MOLECULE_RANKED}
SELECT canonical_smiles, property_name, value, unit, compound_id, smiles, source_type, article_id, source_id, chunk_index,
  CAST(prio + 25 + CASE WHEN unit <> '' THEN 15 ELSE 0 END + CASE WHEN evidence <> '' THEN 20 ELSE 0 END AS INTEGER) AS quality_score, {_MOLECULE_FLAGS} AS quality_flags, evidence
FROM r WHERE rn = 1""")
def agg_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.aggregate_molecules(molecule_rows(spark, sf_dir)).clean


@query(f"""WITH {_MOLECULE_RANKED}
SELECT canonical_smiles, property_name, v1 AS chosen_value, s1 AS chosen_source_type, value AS rejected_value, source_type AS rejected_source_type, {_RESOLUTION} AS resolution, article_id, source_id
FROM r WHERE rn > 1 AND abs(v1 - value) > 1e-9""")
def agg_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.aggregate_molecules(molecule_rows(spark, sf_dir)).conflicts


FORMULAS = ["Fe3O4", "Mn₃O₄", "CeO2", "Xx2O", "Pt-Au", "Fe3+", "Zn(OH)2", "", "Fe0O", "Cu?O", "AB2", "M-W/SBA-15"]
_FORMULA_OF = "CASE l_partkey % 12 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FORMULAS)) + " END"
#: What the formulas are once cleaned and checked; empty where they are not valid.
CHECKED = ["Fe3O4", "Mn3O4", "CeO2", "", "Pt-Au", "Fe", "Zn(OH)2", "", "", "", "", "M-W/SBA-15"]
_CHECKED_OF = "CASE l_partkey % 12 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(CHECKED)) + " END"


def nano_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as nanomaterial measurements: valid and invalid formulas, missing units, several sources."""
    df = table(spark, sf_dir, "lineitem")
    formula = F.element_at(F.array(*[F.lit(f) for f in FORMULAS]), (F.col("l_partkey") % 12 + 1).cast("int"))
    kind = F.when(F.col("l_linenumber") == 1, "CV").when(F.col("l_linenumber") == 2, "text").when(F.col("l_linenumber") == 3, "camelot_table").otherwise("other")
    return df.select(
        formula.alias("material_formula"), F.concat(F.lit("m"), (F.col("l_partkey") % 300).cast("string")).alias("material_name"), F.concat(F.lit("size "), F.col("l_returnflag")).alias("property"), F.col("l_quantity").cast("int").cast("string").alias("value"), F.when(F.col("l_linenumber") == 5, " ").otherwise("nm").alias("units"), F.col("l_linestatus").alias("assay"),
        F.when(F.col("l_suppkey") % 3 == 0, "dry").alias("condition"), F.col("l_partkey").cast("string").alias("material_id"), kind.alias("source_type"), F.concat(F.lit("a"), (F.col("l_orderkey") % 50).cast("string")).alias("article_id"), F.col("l_orderkey").cast("string").alias("source_id"), F.lit("seen").alias("evidence"), F.struct(*ORDER).alias("_row_order"),
    )


_NANO = f"""
SELECT *, CASE source_type WHEN 'camelot_table' THEN 30 WHEN 'vision' THEN 25 WHEN 'text' THEN 20 ELSE 10 END AS prio FROM (
  SELECT {_CHECKED_OF} AS normalized_formula, {_FORMULA_OF} AS material_formula, 'm' || (l_partkey % 300) AS material_name, 'size ' || l_returnflag AS property_name, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS value,
    CASE WHEN l_linenumber = 5 THEN '' ELSE 'nm' END AS unit, l_linestatus AS assay, CASE WHEN l_suppkey % 3 = 0 THEN 'dry' ELSE '' END AS condition, CAST(l_partkey AS VARCHAR) AS material_id,
    CASE l_linenumber WHEN 1 THEN 'vision' WHEN 2 THEN 'text' WHEN 3 THEN 'camelot_table' ELSE 'unknown' END AS source_type, CASE l_linenumber WHEN 1 THEN 'CV' WHEN 2 THEN 'text' WHEN 3 THEN 'camelot_table' ELSE 'other' END AS raw_source,
    'a' || (l_orderkey % 50) AS article_id, CAST(l_orderkey AS VARCHAR) AS source_id, '' AS chunk_index, 'seen' AS evidence, {_ORDER} FROM lineitem)"""
_NANO_KEYS = "normalized_formula, property_name, unit, assay, condition"
_NANO_RANKED = f"m AS ({_NANO}), r AS (SELECT *, row_number() OVER w AS rn, first_value(value) OVER w AS v1, first_value(source_type) OVER w AS s1, first_value(prio) OVER w AS p1 FROM m WHERE normalized_formula <> '' AND unit <> '' WINDOW w AS (PARTITION BY {_NANO_KEYS} ORDER BY prio DESC, {_ORDER}))"


@query(f"""WITH {_NANO_RANKED}
SELECT normalized_formula, material_formula, material_name, property_name, value, unit, assay, condition, material_id, source_type, article_id, source_id, chunk_index,
  CAST(prio + 60 + CASE WHEN condition <> '' THEN 5 ELSE 0 END AS INTEGER) AS quality_score,
  CASE source_type WHEN 'camelot_table' THEN 'from_table' WHEN 'vision' THEN 'from_vision' WHEN 'text' THEN 'from_text' ELSE 'source_unknown' END || ';valid_formula;has_unit;has_evidence' || CASE WHEN condition <> '' THEN ';has_condition' ELSE '' END AS quality_flags, evidence
FROM r WHERE rn = 1""")
def nano_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.aggregate_nano(nano_rows(spark, sf_dir)).clean


@query(f"""WITH {_NANO_RANKED}
SELECT {_NANO_KEYS}, v1 AS chosen_value, s1 AS chosen_source_type, value AS rejected_value, source_type AS rejected_source_type, {_RESOLUTION} AS resolution, article_id, source_id
FROM r WHERE rn > 1 AND abs(v1 - value) > 1e-9""")
def nano_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.aggregate_nano(nano_rows(spark, sf_dir)).conflicts


@query(f"""WITH m AS ({_NANO})
SELECT 'missing_or_invalid_required_field' AS reason, 'nano_aggregation' AS validator, material_formula, normalized_formula, material_name, property_name, CAST(CAST(value AS INTEGER) AS VARCHAR) AS value, unit, assay, condition, material_id, raw_source AS source_type, article_id, source_id, chunk_index, evidence
FROM m WHERE normalized_formula = '' OR unit = ''""")
def nano_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.aggregate_nano(nano_rows(spark, sf_dir)).rejected


@query("""SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 30 WHEN 'F' THEN 25 ELSE 10 END + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 25 END + CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 15 END + CASE WHEN o_orderkey % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 0 END AS INTEGER) AS quality_score,
  CASE o_orderstatus WHEN 'O' THEN 'from_table' WHEN 'F' THEN 'from_vision' ELSE 'source_unknown' END || CASE WHEN o_orderkey % 5 = 0 THEN ';missing_identifier' ELSE ';valid_smiles' END || CASE WHEN o_orderpriority LIKE '1%' THEN ';missing_unit' ELSE ';has_unit' END || CASE WHEN o_orderkey % 3 = 0 THEN ';has_evidence' ELSE ';missing_evidence' END || CASE WHEN o_orderkey % 7 = 0 THEN ';has_condition' ELSE '' END AS quality_flags FROM orders""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    score, flags = A.quality(F.when(F.col("o_orderstatus") == "O", "Docling_Table").when(F.col("o_orderstatus") == "F", "computer_vision").otherwise("web"), F.when(k % 5 == 0, "  ").otherwise("x"), F.when(F.col("o_orderpriority").startswith("1"), None).otherwise(F.lit("nm")), F.when(k % 3 == 0, "e"), F.when(k % 7 == 0, "pH 7"), "valid_smiles")
    return table(spark, sf_dir, "orders").select("o_orderkey", score.alias("quality_score"), flags.alias("quality_flags"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    return E.records(d.select(F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("s"), F.col("l_returnflag").alias("p"), (F.col("l_suppkey") % 7).cast("string").alias("v"), F.struct(*ORDER).alias("o")), "s", "p", "v", "o")


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lines over 4 are of molecules that gold doesn't have
    d = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey") + F.when(F.col("l_linenumber") > 4, 10_000_000).otherwise(0)
    return E.records(d.select(F.concat(F.lit("C"), part.cast("string")).alias("s"), F.col("l_returnflag").alias("p"), F.when(F.col("l_suppkey") % 11 == 0, "n.d.").otherwise((F.col("l_suppkey") % 7).cast("string")).alias("v"), F.struct(*ORDER).alias("o")), "s", "p", "v", "o")


_VALUE = "printf('%.3f', CAST(l_suppkey % 7 AS DOUBLE))"
_SIDES = f"""WITH g AS (SELECT 'C' || l_partkey AS s, l_returnflag AS p, arg_max({_VALUE}, row({_ORDER})) AS v FROM lineitem GROUP BY ALL),
x AS (SELECT 'C' || (l_partkey + CASE WHEN l_linenumber > 4 THEN 10000000 ELSE 0 END) AS s, l_returnflag AS p, arg_max(CASE WHEN l_suppkey % 11 = 0 THEN 'n.d.' ELSE {_VALUE} END, row({_ORDER})) AS v FROM lineitem GROUP BY ALL),
b AS (SELECT coalesce(g.s, x.s) AS s, coalesce(g.p, x.p) AS p, g.v AS gv, x.v AS xv FROM g FULL OUTER JOIN x ON g.s = x.s AND g.p = x.p),
l AS (SELECT label, sum(t) AS t, sum(q) AS q, sum(tp) AS tp FROM (SELECT coalesce(gv, '<missing>') AS label, 1 AS t, 0 AS q, CASE WHEN coalesce(gv, '<missing>') = coalesce(xv, '<missing>') THEN 1 ELSE 0 END AS tp FROM b UNION ALL SELECT coalesce(xv, '<missing>'), 0, 1, 0 FROM b) GROUP BY label),
f AS (SELECT count(*) AS labels, round(avg(2.0 * tp / (t + q)), 9) AS macro_f1 FROM l)
"""


@query(_SIDES + """, c AS (SELECT CAST(count(gv) AS BIGINT) AS gold_records, CAST(count(xv) AS BIGINT) AS generated_records, CAST(sum(CASE WHEN gv IS NOT NULL AND xv IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS shared_keys, CAST(sum(CASE WHEN gv IS NOT NULL AND xv IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_keys, CAST(sum(CASE WHEN gv IS NULL AND xv IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra_keys, CAST(sum(CASE WHEN gv = xv THEN 1 ELSE 0 END) AS BIGINT) AS exact_matches FROM b)
SELECT c.*, round(exact_matches / shared_keys, 9) AS value_accuracy, round(shared_keys / generated_records, 9) AS key_precision, round(shared_keys / gold_records, 9) AS key_recall, round(2.0 * shared_keys / (generated_records + gold_records), 9) AS key_f1, f.labels, f.macro_f1 FROM c, f""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.metrics(_gold(spark, sf_dir), _made(spark, sf_dir))
    return m.withColumns({c: F.round(c, 9) for c in ("value_accuracy", "key_precision", "key_recall", "key_f1", "macro_f1")})


@query(_SIDES + "SELECT labels, macro_f1 FROM f")
def eval_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro_f1(_gold(spark, sf_dir), _made(spark, sf_dir)).withColumn("macro_f1", F.round("macro_f1", 9))


@query(_SIDES + "SELECT s AS canonical_smiles, p AS property_name, coalesce(gv, '') AS gold_value, coalesce(xv, '') AS generated_value, CASE WHEN xv IS NULL THEN 'missing' WHEN gv IS NULL THEN 'extra' WHEN gv = xv THEN 'match' ELSE 'mismatch' END AS status FROM b")
def eval_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mismatches(_gold(spark, sf_dir), _made(spark, sf_dir))
