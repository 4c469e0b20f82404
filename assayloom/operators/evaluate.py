"""Scoring of extracted measurements against gold, and preparation of gold and article references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.exprs import falsy_default, fixed, let, number, or_default, safe_divide, text

MISSING = "<missing>"
# What one unit of concentration is in mol/l; mass units also need a molar weight.
MOLAR = {1.0: ["mol/l", "m", "m/l"], 1e-3: ["mmol/l", "mm", "mm/l", "mm/liter", "mm/litre"], 1e-6: ["umol/l", "um", "um/l", "um/liter", "um/litre"]}
MASS = ["ug/ml", "mcg/ml"]


def value_text(x: Column | str, decimals: int = 3) -> Column:
    """A number with fixed decimals; other text as it is."""
    return let(number(x), lambda n: F.coalesce(fixed(n, decimals), text(x)))


def records(df: DataFrame, smiles: str, prop: str, value: str, order: str, decimals: int = 3) -> DataFrame:
    """(smiles, property_name, value, order) of the rows that have an identifier and a value."""
    out = df.select(text(smiles).alias("smiles"), falsy_default(prop, F.lit("pMIC")).alias("property_name"), value_text(value, decimals).alias("value"), F.col(order).alias("order"))
    return out.where((F.col("smiles") != "") & (F.col("value") != ""))


# The columns an evaluation file may have.
SMILES_COLUMNS = ["canonical_smiles", "smiles", "SMILES"]
PROPERTY_COLUMNS = ["property_name", "property", "endpoint"]
VALUE_COLUMNS = ["value", "pMIC", "pmic", "property_value", "activity_value", "label"]


def load_records(rows: DataFrame, order: str, path: str = "", smiles: str | None = None, prop: str | None = None, value: str | None = None, decimals: int = 3, canonical: Callable[[Column], Column] | None = None) -> DataFrame:
    """``records`` of a file's rows, its columns found by name; a SMILES that ``canonical`` can't read ends the job.

    ``order`` numbers the file's rows from 0; the header is its line 1.
    """
    s, p, v = (given or pick_column(rows.columns, names) for given, names in ((smiles, SMILES_COLUMNS), (prop, PROPERTY_COLUMNS), (value, VALUE_COLUMNS)))
    df = records(rows, s, p, v, order, decimals)
    if canonical is None:
        return df
    bad = F.raise_error(F.concat(F.lit(f"Invalid SMILES in {path} at row "), (F.col("order") + 2).cast("string"), F.lit(": "), "smiles"))
    return df.withColumn("smiles", F.coalesce(F.nullif(canonical(F.col("smiles")), F.lit("")), bad.cast("string")))


def metrics_text(m: DataFrame) -> DataFrame:
    """(line): the metrics as name=value, shares with six decimals."""
    counts = ["gold_records", "generated_records", "gold_keys", "generated_keys", "shared_keys", "missing_keys", "extra_keys", "exact_value_matches"]
    shares = ["value_accuracy_on_shared_keys", "key_precision", "key_recall", "key_f1", "macro_f1"]
    lines = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in counts] + [F.concat(F.lit(f"{c}="), let(F.col(c), lambda x: fixed(x, 6))) for c in shares]
    return m.select(F.posexplode(F.array(*lines)).alias("place", "line"))


def evaluation(gold: DataFrame, made: DataFrame) -> DataFrame:
    """One row of all counts and shares: records, distinct keys, and ``metrics`` under the names of the report."""
    n = gold.agg(F.count("*").alias("gold_records")).crossJoin(made.agg(F.count("*").alias("generated_records")))  # one row each
    m = metrics(gold, made).withColumnsRenamed({"gold_records": "gold_keys", "generated_records": "generated_keys", "exact_matches": "exact_value_matches", "value_accuracy": "value_accuracy_on_shared_keys"})
    return n.crossJoin(m.drop("labels"))


def last_wins(df: DataFrame) -> DataFrame:
    """One value for each key: that of the last record."""
    return df.groupBy("smiles", "property_name").agg(F.max_by("value", "order").alias("value"))


def _both(gold: DataFrame, made: DataFrame) -> DataFrame:
    g, p = last_wins(gold).withColumnRenamed("value", "gold"), last_wins(made).withColumnRenamed("value", "made")
    return g.join(p, ["smiles", "property_name"], "full_outer")


def macro_f1(gold: DataFrame, made: DataFrame) -> DataFrame:
    """(labels, macro_f1): the mean F1 over all value labels, absent keys being a label of their own."""
    v = _both(gold, made).select(F.coalesce("gold", F.lit(MISSING)).alias("t"), F.coalesce("made", F.lit(MISSING)).alias("p"))
    sides = v.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("t") == F.col("p")).cast("int").alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("x")).select("x.*")
    per = sides.groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    return per.agg(F.count("*").alias("labels"), F.coalesce(F.avg(safe_divide(2.0 * F.col("tp"), F.col("t") + F.col("p"))), F.lit(0.0)).alias("macro_f1"))


def metrics(gold: DataFrame, made: DataFrame) -> DataFrame:
    """One row of counts, key precision, recall and F1, value accuracy and macro-F1; 0 where there is nothing to divide by."""
    b = _both(gold, made)
    has_g, has_p = F.col("gold").isNotNull(), F.col("made").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = b.agg(count(has_g).alias("gold_records"), count(has_p).alias("generated_records"), count(has_g & has_p).alias("shared_keys"), count(has_g & ~has_p).alias("missing_keys"), count(has_p & ~has_g).alias("extra_keys"), count(has_g & has_p & (F.col("gold") == F.col("made"))).alias("exact_matches"))
    out = out.withColumns({"value_accuracy": safe_divide(F.col("exact_matches"), F.col("shared_keys")), "key_precision": safe_divide(F.col("shared_keys"), F.col("generated_records")), "key_recall": safe_divide(F.col("shared_keys"), F.col("gold_records"))})
    out = out.withColumn("key_f1", safe_divide(2.0 * F.col("key_precision") * F.col("key_recall"), F.col("key_precision") + F.col("key_recall")))
    return out.crossJoin(macro_f1(gold, made))  # one row each


def mismatches(gold: DataFrame, made: DataFrame) -> DataFrame:
    """Every key with both values and how they stand to each other."""
    g, p = F.coalesce("gold", F.lit("")), F.coalesce("made", F.lit(""))
    status = F.when(p == "", "missing").when(g == "", "extra").when(g == p, "match").otherwise("mismatch")
    return _both(gold, made).select(F.col("smiles").alias("canonical_smiles"), "property_name", g.alias("gold_value"), p.alias("generated_value"), status.alias("status"))


def pick_column(columns: list[str], candidates: list[str]) -> str:
    """The column that the first matching candidate names, case and punctuation aside."""
    key = lambda name: "".join(c.lower() for c in name if c.isalnum())
    by_key = {key(c): c for c in columns}
    for c in candidates:
        if key(c) in by_key:
            return by_key[key(c)]
    raise ValueError(f"none of {candidates} among {columns}")


def access_flag(x: Column | str) -> Column:
    t = text(x)
    return F.when(t.isin("1", "1.0", "true", "True", "yes", "open"), "1").when(t.isin("0", "0.0", "false", "False", "no", "closed"), "0").otherwise(t)


def article_references(df: DataFrame, pdf: str, doi: str, title: str, access: str, order: str, only_access: str | None = None) -> DataFrame:
    """(key, pdf, doi, title, access, row_count) by DOI, or by file where there is none; first filled values win."""
    rows = df.select(text(pdf).alias("pdf"), text(doi).alias("doi"), text(title).alias("title"), access_flag(access).alias("access"), F.col(order).alias("o"))
    if only_access is not None:
        rows = rows.where(F.col("access") == only_access)
    rows = rows.withColumn("key", F.lower(or_default(F.col("doi"), F.col("pdf")))).where(F.col("key") != "")
    filled = lambda c: F.coalesce(F.min_by(F.col(c), F.when(F.col(c) != "", F.col("o"))), F.lit(""))
    return rows.groupBy("key").agg(filled("pdf").alias("pdf"), F.min_by("doi", "o").alias("doi"), filled("title").alias("title"), F.min_by("access", "o").alias("access"), F.count("*").alias("row_count"))


def distinct_references(df: DataFrame, pdf: str, doi: str, title: str, order: str) -> DataFrame:
    """The first row of each (pdf, doi, title), as text, that names an article at all."""
    rows = df.withColumns({pdf: text(pdf), doi: text(doi), title: text(title)})
    return first_distinct(rows.where((F.col(pdf) != "") | (F.col(doi) != "") | (F.col(title) != "")), [pdf, doi, title], [order])


def domain_of(paths: list[str]) -> str:
    """The name of a single reference file without its ending, else ``articles``."""
    return paths[0].rsplit("/", 1)[-1].rsplit(".", 1)[0] if len(paths) == 1 else "articles"


def first_distinct(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")) if rest else df.select(*keys).distinct()
    return one.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]) if rest else one


def mic_to_molar(value: Column, unit: Column | str, weight: Column | None = None) -> Column:
    u = F.lower(F.translate(text(unit), "\u03bc\u00b5", "uu"))
    out = F.lit(None).cast("double")
    for factor, names in MOLAR.items():
        out = F.when(u.isin(names), value * F.lit(factor)).otherwise(out)
    if weight is not None:
        out = F.when(u.isin(MASS) & (weight > 0), value * 1e-3 / weight).otherwise(out)
    return out


def gold_value(value: Column | str, unit: Column | str, prop: Column | str, weight: Column | None = None) -> tuple[Column, Column, Column]:
    """(property, value text, unit) of a gold row: MIC becomes pMIC where the unit can be converted."""
    p = or_default(text(prop), "pMIC")

    def whole(n: Column) -> Column:
        molar = mic_to_molar(n, unit, weight)
        turn, kept = n.isNotNull() & (F.lower(p) == "mic") & (molar > 0), n.isNotNull() & (F.lower(p) == "pmic")
        shown = F.coalesce(F.when(turn, let(-F.log10(molar), lambda m: fixed(m, 3))), fixed(n, 3), text(value))
        return F.struct(F.when(turn | kept, "pMIC").otherwise(p).alias("property"), shown.alias("value"), F.when(turn | kept, "pMIC").otherwise(text(unit)).alias("unit"))

    out = let(number(value), whole)
    return out["property"], out["value"], out["unit"]


def nested_gold(df: DataFrame, id_col: str, rows_col: str) -> DataFrame:
    """The records inside a list column, with a path to each."""
    return df.select(F.col(id_col), F.posexplode(rows_col).alias("i", "r")).select(F.col(id_col), F.concat_ws(":", F.col(id_col).cast("string"), F.lit(rows_col), F.col("i").cast("string")).alias("source_id"), "r.*")
