"""Envelopes, aliases, formulas, property names, physical limits and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions import chem
from assayloom.operators import extract as X
from assayloom.operators import validate as V
from assayloom.plans.registry import query, table


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model responses: bare objects, fenced lists, envelopes with words around, broken ones."""
    k = F.get_json_object("props", "$.k")
    row = F.concat(F.lit('{"material": "M'), F.col("user_id").cast("string"), F.lit('", "formula": "Fe3O4", "property": "particle size", "value": "'), k, F.lit(',5 nm", "units": "nm"}'))
    e = F.col("event_id") % 5
    said = F.when(e == 0, row).when(e == 1, F.concat(F.lit("```json\n["), row, F.lit(", "), row, F.lit("]\n```"))).when(e == 2, F.concat(F.lit('Here you are: {"note": "a } brace", "rows": ['), row, F.lit("]} - done {}"))).when(e == 3, F.concat(F.lit('{"data": ['), row, F.lit(', 5], "rows": 3}'))).otherwise(F.concat(F.lit("no json, "), row.substr(F.lit(2), F.lit(9))))
    return table(spark, sf_dir, "events").select("event_id", "user_id", k.alias("k"), said.alias("response"))


_EVENTS = "SELECT event_id, user_id, json_extract_string(props, '$.k') AS k, event_id % 5 AS e FROM events"


@query(f"SELECT event_id, CAST(CASE e WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS n_rows FROM ({_EVENTS})")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir).withColumn("v", X.payload(F.col("response")))
    return r.select("event_id", F.coalesce(F.size(X.envelope_rows(F.col("v"))), F.lit(0)).alias("n_rows")).withColumn("n_rows", F.greatest("n_rows", F.lit(0)))


@query(f"SELECT event_id, i AS item, 'material' AS material_id, 'M' || user_id AS material_name, 'Fe3O4' AS material_formula, CAST(k || '.5' AS DOUBLE) AS value FROM ({_EVENTS}), range(0, 2) AS t(i) WHERE e < 4 AND (i = 0 OR e = 1)")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir).select("event_id", F.posexplode(X.envelope_rows(X.payload(F.col("response")))).alias("item", "r"))
    fields = [c for c in X.nano_row(F.col("r"))]
    return r.select("event_id", F.col("item").cast("long").alias("item"), *fields).select("event_id", "item", "material_id", "material_name", "material_formula", "value")


#: Spellings of (material_id, material_formula or name, property_name, unit) that rows come with.
ALIASED = [("Material ID", "FORMULA", "Property", "Units"), ("id", "composition", "endpoint", "units"), ("Compound-Id", "Formula", "property_name", "unit"), ("material_id", "Name", "End Point", "UNIT")]


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'material' ELSE p_brand END AS material_id, CASE p_partkey % 4 WHEN 3 THEN 'sheet Fe2O3 x' ELSE 'CeO2' END AS material_name, CASE p_partkey % 4 WHEN 3 THEN 'Fe2O3' ELSE 'CeO2' END AS material_formula, 'size' AS property_name, 'nm' AS unit, CAST(p_size AS DOUBLE) AS value FROM part""")
def alias_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit(" about "), F.col("p_size").cast("string"), F.lit(" nm"))
    ids = F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_brand"))
    said = [F.to_json(F.struct(ids.alias(i), F.lit("sheet Fe2O3 x" if name == "Name" else " CeO2 ").alias(name), F.lit("size").alias(p), F.lit("nm").alias(u), shown.alias("value"))) for i, name, p, u in ALIASED]
    v = F.parse_json(F.element_at(F.array(*said), (F.col("p_partkey") % 4 + 1).cast("int")))
    rows = table(spark, sf_dir, "part").select("p_partkey", v.alias("r"))
    return rows.select("p_partkey", *X.nano_row(F.col("r"))).select("p_partkey", "material_id", "material_name", "material_formula", "property_name", "unit", "value")


#: Formulas and what is wrong with them.
TRIED = {"Fe3O4": "", "Mn₃O₄": "", "Xx2O": "unknown element 'Xx' in formula 'Xx2O'", "Fe0O": "non-positive element count '0' in formula 'Fe0O'", "Cu?O": "unparsed formula fragment '?' in formula 'Cu?O'", "": "material_formula is empty", "Pt-Au": "", "M-W/SBA-15 (M = Ni)": "", "Qq-1": "unknown element 'Qq' in formula 'Qq-1'", "123": "formula '123' has no elements", "Fe3+": "", "Zn(OH)2": ""}


@query("SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{e.replace(chr(39), chr(39) * 2)}'" for i, e in enumerate(TRIED.values())) + " END AS errors FROM part")
def formula_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.element_at(F.array(*[F.lit(x) for x in TRIED]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(chem.formula_errors(f), "; ").alias("errors"))


NAMED = {"Vmax (upper)": "Vmax_upper", "kcat/Km": "kcat", "apparent Km": "Km", "Zeta potential": "zeta potential", "IC50 lower": "IC50_lower", "hydrodynamic diameter": "particle diameter", "particle_size": "particle size", "BET area": "BET surface area", "LOD": "limit of detection", "phosphatase activity": "optimum pH", "working temp": "optimum temperature", "sorbitol yield": "sorbitol yield", "peroxidase activity": "activity", " random score ": "random score"}


@query("SELECT s_suppkey, CASE s_suppkey % 14 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(NAMED.values())) + " END AS canonical, s_suppkey % 14 NOT IN (10, 13) AS allowed FROM supplier")
def property_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.element_at(F.array(*[F.lit(x) for x in NAMED]), (F.col("s_suppkey") % 14 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", chem.canonical_property(n).alias("canonical"), chem.property_allowed(n).alias("allowed"))


@query("""WITH d AS (SELECT DISTINCT l_partkey, l_linenumber, l_quantity - 10 AS v, CAST(CAST(l_quantity - 10 AS INTEGER) AS VARCHAR) AS g FROM lineitem)
SELECT l_partkey, l_linenumber, v, CASE l_linenumber WHEN 1 THEN CASE WHEN v NOT BETWEEN 0 AND 14 THEN 'pH value ' || g || ' is outside 0-14' ELSE '' END WHEN 2 THEN CASE WHEN v < 1 THEN 'pore size value ' || g || ' Å is below 0.1 nm' ELSE '' END WHEN 3 THEN CASE WHEN v <= 0 THEN 'film width value must be positive' ELSE '' END
WHEN 4 THEN CASE WHEN v < 0 THEN 'temperature value ' || g || ' K is physically impossible' ELSE '' END WHEN 5 THEN CASE WHEN v < 0 THEN 'recovery value ' || g || ' is outside 0-200%; recovery value must not be negative' ELSE '' END WHEN 6 THEN CASE WHEN v <= 0 THEN 'Km value must be positive' ELSE '' END ELSE CASE WHEN v < 0 THEN 'yield value must not be negative' ELSE '' END END AS errors FROM d""")
def sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", (F.col("l_quantity") - 10).alias("v")).distinct()
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.least("l_linenumber", F.lit(7)))
    errors = chem.sanity_errors(at(["optimum pH", "pore size", "film width", "temperature", "recovery", "Km", "yield"]), F.col("v"), at(["", " Å ", "inch", "K", "%", "mM", "%"]))
    return d.select("l_partkey", "l_linenumber", "v", F.array_join(errors, "; ").alias("errors"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size * 1e3 WHEN 2 THEN p_size * 1e9 WHEN 3 THEN round(p_size * 0.1, 9) ELSE NULL END AS nm FROM part")
def size_nm(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.element_at(F.array(*[F.lit(x) for x in ("nm", "µ m", "Meters", "Å", "mm")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(chem.size_in_nm(F.col("p_size").cast("double"), u), 9).alias("nm"))


@query("""WITH d AS (SELECT p_partkey, p_size, CAST(floor(p_partkey / 100) AS INTEGER) AS chunk, CASE WHEN p_size % 2 = 0 THEN 'nm' ELSE 'NM' END AS unit, CASE p_size % 5 WHEN 0 THEN 'odd name' ELSE 'particle size' END AS name, CASE p_size % 3 WHEN 0 THEN 'Xx9' ELSE 'CeO2' END AS formula FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY p_partkey) AS row, row_number() OVER (PARTITION BY chunk, name, formula, lower(unit) ORDER BY p_partkey) AS nth FROM d),
s AS (SELECT *, 'row ' || row || ' material_id=m1: ' AS place, CASE WHEN name = 'odd name' THEN 'property' WHEN formula <> 'CeO2' THEN 'error' WHEN nth > 1 THEN 'duplicate' ELSE 'valid' END AS state FROM r)
SELECT p_partkey, state, CASE state WHEN 'property' THEN place || 'property_name ''odd name'' is not an allowed nanozyme endpoint' WHEN 'error' THEN place || 'unknown element ''Xx'' in formula ''Xx9''' WHEN 'duplicate' THEN place || 'duplicate particle size for CeO2 skipped' ELSE '' END AS reason, CASE state WHEN 'valid' THEN '' ELSE 'nano_critic' END AS validator FROM s""")
def nano_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd, bad = F.when(F.col("p_size") % 5 == 0, "odd name").otherwise("particle size"), F.when(F.col("p_size") % 3 == 0, "Xx9").otherwise("CeO2")
    fields = {"material_id": F.lit("m1"), "material_name": F.lit("ceria"), "material_formula": bad, "property_name": odd, "value": F.col("p_size").cast("double"), "unit": F.when(F.col("p_size") % 2 == 0, "nm").otherwise("NM"), "assay": F.lit(""), "condition": F.lit("")}
    row = F.struct("p_partkey", *[c.alias(k) for k, c in fields.items()], F.lit(0).alias("index"), F.lit("").alias("schema_reason"))
    # a chunk holds a hundred neighbours, as a response holds few rows
    chunks = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") / 100).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    judged = chunks.select("rows", V.critic(F.col("rows")).alias("j")).select(F.explode(F.arrays_zip("rows", "j")).alias("x"))
    return judged.select("x.rows.p_partkey", "x.j.state", "x.j.reason", "x.j.validator")


#: Small-molecule responses by event, and what comes of each: (response, error, warning, valid rows); @ is the event's number.
_ROW = '{"compound_id": "c@", "smiles": "CC@", "property_name": "pMIC", "value": 5.25, "unit": "pMIC"}'
MOLECULES = [
    (f'{{"rows": [{_ROW}]}}', "", "", 1),
    (f"```json\n[{_ROW}, {_ROW.replace('c@', 'd@')}]\n```", "", "row 2 compound_id=d@: duplicate pMIC for CC@ skipped", 1),
    ('{"rows": [' + _ROW.replace('"unit": "pMIC"', '"unit": " "').replace('"pMIC"', '" PMIC "') + "]}", "", "", 1),
    ('Here: {"rows": [' + _ROW + ", " + _ROW.replace('"pMIC"}', '""}').replace('"property_name": "pMIC"', '"property_name": "MIC"') + "]} as asked", "extractor output validation failed: rows.1.unit: String should have at least 1 character", "", 0),
    ('{"rows": [' + _ROW.replace("5.25", '"5.25"').replace('"compound_id": "c@", ', "") + "]}", "extractor output validation failed: rows.0.compound_id: Field required; rows.0.value: Input should be a valid number", "", 0),
    ('{"rows": [' + _ROW.replace("}", ', "note": 1}') + '], "more": 2}', "extractor output validation failed: rows.0.note: Extra inputs are not permitted; more: Extra inputs are not permitted", "", 0),
    ('{"rows": [5, ' + _ROW.replace('"CC@"', "7") + "]}", "extractor output validation failed: rows.0: Input should be a valid dictionary; rows.1.smiles: Input should be a valid string", "", 0),
    ('{"rows": [' + _ROW.replace("CC@", "CC?@") + ", " + _ROW + "]}", "row 1 compound_id=c@: RDKit could not parse SMILES 'CC?@'", "", 1),
    ("nothing found", "extractor output validation failed: No JSON object found in extractor response.", "", 0),
    ('so {"rows": [', "extractor output validation failed: Unterminated JSON object in extractor response.", "", 0),
    ("{}", "", "", 0),
    ('{"rows": 3}', "extractor output validation failed: rows: Input should be a valid list", "", 0),
    ("17", "extractor output validation failed: Extractor JSON payload must be an object or list.", "", 0),
]


def _cases(texts: list[str], key: str) -> str:
    return f"replace(CASE {key} % {len(texts)} " + " ".join(f"WHEN {i} THEN '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(texts)) + f" END, '@', CAST({key} AS VARCHAR))"


def _pick(texts: list[str], key: str):
    return F.replace(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col(key) % len(texts) + 1).cast("int")), F.lit("@"), F.col(key).cast("string"))


@query(f"""SELECT event_id, CASE WHEN error = '' THEN 'valid' WHEN starts_with(error, 'extractor') THEN 'failed' ELSE 'invalid' END AS status, error AS error_log, warning AS warnings, CAST(valid AS BIGINT) AS n_validated FROM
(SELECT event_id, {_cases([m[1] for m in MOLECULES], "event_id")} AS error, {_cases([m[2] for m in MOLECULES], "event_id")} AS warning, CASE event_id % {len(MOLECULES)} {" ".join(f"WHEN {i} THEN {m[3]}" for i, m in enumerate(MOLECULES))} END AS valid FROM events)""")
def molecule_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("attempt"), _pick([m[0] for m in MOLECULES], "event_id").alias("response"))
    states = V.outcome(V.molecule_attempts(said, ["event_id"], canonical=V.each(lambda s: F.when(~F.contains(s, F.lit("?")), s))), ["event_id"], 1)
    return states.select("event_id", "status", F.array_join("error_log", "|").alias("error_log"), F.array_join("warnings", "|").alias("warnings"), F.size("validated").cast("long").alias("n_validated"))


#: Nano responses of two attempts by part, the rows rejected over both (validator, number, reason), the error log and the valid rows.
_NANO = '{"Material ID": "m@", "formula": "CeO2", "endpoint": "particle size", "value": "about 5,5 nm", "units": "nm"}'
_BAD = _NANO.replace("CeO2", "Xx2O")
NANO = [
    ([f'{{"rows": [{_NANO}, {_NANO}, 4]}}', f'{{"rows": [{_BAD}]}}'], [("nano_critic", 2, "row 2 material_id=m@: duplicate particle size for CeO2 skipped"), ("nano_extractor_schema", 3, "row 3: row: Input should be a valid dictionary")], "", 1),
    ([f"[{_BAD}, {_NANO.replace('CeO2', '')}]", f"[{_NANO.replace('particle size', 'colour')}, {_NANO}]"], [("nano_critic", 1, "row 1 material_id=m@: unknown element 'Xx' in formula 'Xx2O'"), ("nano_extractor_schema", 2, "row 2: material_name: String should have at least 1 character; material_formula: String should have at least 1 character"), ("nano_critic", 1, "row 1 material_id=m@: property_name 'colour' is not an allowed nanozyme endpoint")], "row 1 material_id=m@: unknown element 'Xx' in formula 'Xx2O'", 1),
    (["none", '{"rows": 1}'], [], "extractor output validation failed: No JSON object found in extractor response.|extractor output validation failed: Nanozyme extractor JSON payload must contain a rows array.", 0),
    ([f'{{"rows": [{_NANO.replace("about 5,5 nm", "n.d.")}]}}', f'{{"rows": [{_NANO.replace("about 5,5 nm", "1e9 nm")}]}}'], [("nano_critic", 1, "row 1 material_id=m@: particle size value must be finite"), ("nano_critic", 1, "row 1 material_id=m@: particle size value 1e+09 nm is unrealistically large")], "row 1 material_id=m@: particle size value must be finite|row 1 material_id=m@: particle size value 1e+09 nm is unrealistically large", 0),
]


def _nano(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    said = F.when(F.col("attempt") == 1, _pick([n[0][0] for n in NANO], "p_partkey")).otherwise(_pick([n[0][1] for n in NANO], "p_partkey"))
    return V.outcome(V.nano_attempts(d.withColumn("response", said), ["p_partkey"]), ["p_partkey"], 2)


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'valid' WHEN 2 THEN 'failed' ELSE 'invalid' END AS status, CASE p_partkey % 4 WHEN 0 THEN 1 ELSE 2 END AS attempts, {_cases([n[2] for n in NANO], "p_partkey")} AS error_log, CAST(CASE p_partkey % 4 {" ".join(f"WHEN {i} THEN {n[3]}" for i, n in enumerate(NANO))} END AS BIGINT) AS n_validated FROM part""")
def nano_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nano(spark, sf_dir).select("p_partkey", "status", "attempts", F.array_join("error_log", "|").alias("error_log"), F.size("validated").cast("long").alias("n_validated"))


@query(" UNION ALL ".join(f"SELECT p_partkey, '{v}' AS validator, {i} AS row_index, replace('{r.replace(chr(39), chr(39) * 2)}', '@', CAST(p_partkey AS VARCHAR)) AS reason FROM part WHERE p_partkey % {len(NANO)} = {k}" for k, n in enumerate(NANO) for v, i, r in n[1]))
def nano_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rows_of(_nano(spark, sf_dir), ["p_partkey"], "rejected").select("p_partkey", "validator", "row_index", "reason")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("attempt"), F.length("text").alias("n")).groupBy("conv_id", "attempt").agg(F.min("n").alias("n"))
    return d.select("conv_id", "attempt", (F.col("n") % 4 == 0).alias("failed"), (F.col("n") % 3).alias("n_errors"), F.when(F.col("n") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("error "), (F.col("n") % 5).cast("string")))).alias("errors"))


_ATTEMPTS = "SELECT conv_id, attempt, n % 4 = 0 AS failed, n % 3 AS n_errors, 'error ' || (n % 5) AS err FROM (SELECT conv_id, CAST(turn + 1 AS INTEGER) AS attempt, min(length(text)) AS n FROM conversations GROUP BY ALL)"
_FINAL = f"a AS ({_ATTEMPTS}), f AS (SELECT conv_id, min(CASE WHEN NOT failed AND n_errors = 0 THEN attempt END) AS good, max(attempt) AS last, arg_max(failed, attempt) AS last_failed FROM a WHERE attempt <= 3 GROUP BY conv_id)"


@query(f"WITH {_FINAL} SELECT conv_id, coalesce(good, last) AS attempt, CASE WHEN good IS NOT NULL THEN 'valid' WHEN last_failed THEN 'failed' ELSE 'invalid' END AS status FROM f")
def retry_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.final_attempts(attempts(spark, sf_dir), ["conv_id"], 3)


@query(f"""WITH {_FINAL}, e AS (SELECT a.conv_id, a.err, min(a.attempt) AS first FROM a JOIN f ON a.conv_id = f.conv_id AND a.attempt <= coalesce(f.good, f.last) WHERE a.n_errors <> 0 GROUP BY ALL)
SELECT f.conv_id, coalesce(string_agg(e.err, '|' ORDER BY e.first), '') AS error_log FROM f LEFT JOIN e ON f.conv_id = e.conv_id GROUP BY f.conv_id""")
def retry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir)
    return X.error_log(a, X.final_attempts(a, ["conv_id"], 3), ["conv_id"]).select("conv_id", F.array_join("error_log", "|").alias("error_log"))
