"""Benchmark sets: which configuration, split and rows count, gold records inside rows, and article payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.exprs import compact_key, let, short, strip
from assayloom.operators.evaluate import gold_value
from assayloom.sources.readers import column_key

# The columns that may hold each part of a gold record, what names a column of nested records, of articles and of domains.
SMILES = ["canonical_smiles", "can_smiles", "smiles", "compound_smiles", "molecule_smiles"]
PROPERTY = ["property_name", "property", "target_type", "endpoint", "target", "assay"]
VALUE = ["pmic", "pMIC", "target_value", "value", "property_value", "activity_value", "label", "y"]
UNIT = ["unit", "units", "target_units", "property_unit", "activity_unit"]
ID = ["id", "example_id", "compound_id", "molecule_id", "article_id", "paper_id"]
DOMAIN = ["domain", "subset", "benchmark", "task", "collection", "family"]
ARTICLE_HINTS = ["pdf", "article", "paper", "document", "full_text", "text"]
RECORD_HINTS = ["gold", "target", "label", "table", "record"]


def pick_config(names: list[str], domain: str) -> str | None:
    """The configuration named as the domain, else the first whose name holds it; case and marks aside."""
    key = column_key(domain)
    return next((n for n in names if column_key(n) == key), None) or next((n for n in names if key in column_key(n)), None)


def pick_splits(names: list[str], split: str) -> list[str]:
    """The split asked for; the validation split where there is no test split; else all."""
    if split in names:
        return [split]
    return ["validation"] if split == "test" and "validation" in names else list(names)


def read_benchmark(spark: SparkSession, folder: str, configs: dict[str, list[str]], domain: str, split: str = "test") -> tuple[DataFrame, dict]:
    """(rows, manifest) of a set stored as ``folder/config/split`` Parquet folders; ``configs`` maps configurations to splits.

    Without a configuration of the domain all are read and rows are kept by their domain columns, or all where none matches.
    """
    config = pick_config(list(configs), domain)
    chosen = [config] if config else list(configs)
    loaded = [(c, s) for c in chosen for s in pick_splits(configs[c], split)]
    rows = None
    for c, s in loaded:
        part = spark.read.parquet(f"{folder}/{c}/{s}").withColumn("_benchmark_split", F.lit(s))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        raise ValueError(f"{folder} has no splits")
    filtered = False
    if not config:
        hits = rows.where(matches_domain(rows, domain))
        filtered = hits.limit(1).count() > 0
        rows = hits if filtered else rows
    manifest = {"domain": domain, "requested_split": split, "config": config, "available_configs": list(configs), "loaded_splits": [s for _, s in loaded], "domain_filter_applied": filtered, "columns": sorted(rows.columns)}
    if not config and not filtered:
        manifest["domain_filter_warning"] = "No domain column matched; kept all loaded rows."
    return rows, manifest


def matches_domain(df: DataFrame, domain: str) -> Column:
    """Whether any domain-like column of a row, or any item of a list there, holds the domain as letters and digits."""
    key, names = column_key(domain), {column_key(d) for d in DOMAIN}
    hit = F.lit(False)
    for f in df.schema.fields:
        if column_key(f.name) not in names:
            continue
        holds = lambda x: F.contains(compact_key(x.cast("string")), F.lit(key))
        one = F.exists(F.col(f.name), holds) if isinstance(f.dataType, T.ArrayType) else holds(F.col(f.name))
        hit = hit | F.coalesce(one, F.lit(False))
    return hit


def shown(x: Column, kind: T.DataType) -> Column:
    """Any value as text: floating numbers with 6 significant digits, null as empty text, all else stripped."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(short(x.cast("double")), F.lit(""))
    return F.coalesce(strip(x.cast("string")), F.lit(""))


def _found(fields: dict[str, T.DataType], candidates: list[str]) -> str | None:
    by_key = {column_key(n): n for n in fields}
    return next((by_key[column_key(c)] for c in candidates if column_key(c) in by_key), None)


def gold_record(fields: dict[str, T.DataType], get, canonical=None, weight: Column | None = None) -> Column | None:
    """A row's gold record as a struct (its smiles or value may be empty), or None where it has no such columns.

    ``fields``: names and types, ``get(name)`` a field's Column. ``canonical`` is a chemistry plug-in on the SMILES;
    what it can't read stays as it is.
    """
    s, v = _found(fields, SMILES), _found(fields, VALUE)
    if s is None or v is None:
        return None
    text = lambda n: shown(get(n), fields[n]) if n else F.lit("")
    p, u, i = (_found(fields, c) for c in (PROPERTY, UNIT, ID))
    prop = text(p) if p else F.lit("pMIC")

    def whole(x: Column) -> Column:
        name, value, unit = gold_value(x["value"], x["unit"], x["property"], weight)
        made = F.coalesce(canonical(x["smiles"]), x["smiles"]) if canonical is not None else x["smiles"]
        usable = (x["smiles"] != "") & (x["value"] != "")
        return F.when(usable, F.struct(x["id"].alias("compound_id"), x["smiles"].alias("smiles"), made.alias("canonical_smiles"), name.alias("property_name"), value.alias("value"), unit.alias("unit")))

    return let(F.struct(text(s).alias("smiles"), text(v).alias("value"), prop.alias("property"), text(u).alias("unit"), text(i).alias("id")), whole)


def gold_records(df: DataFrame, id_col: str, canonical=None, weight: Column | None = None) -> DataFrame:
    """(source_id, compound_id, smiles, canonical_smiles, property_name, value, unit): the row itself, and the records in its lists.

    Lists are searched whose column's name hints at records; ``source_id`` is the row's, with column and place of a record.
    """
    own = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    base = F.col(id_col).cast("string")
    if (one := gold_record(own, lambda n: F.col(f"`{n}`"), canonical, weight)) is not None:
        parts.append(F.array(F.struct(base.alias("source_id"), one.alias("r"))))
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.ArrayType) or not isinstance(f.dataType.elementType, T.StructType) or not any(h in f.name.lower() for h in RECORD_HINTS):
            continue
        inner = {g.name: g.dataType for g in f.dataType.elementType.fields}
        if gold_record(inner, lambda n: F.lit(None)) is None:
            continue
        parts.append(F.coalesce(_items(f, inner, base, canonical, weight), F.array()))
    if not parts:
        return df.select(base.alias("source_id"), *[F.lit("").alias(c) for c in ("compound_id", "smiles", "canonical_smiles", "property_name", "value", "unit")]).limit(0)
    rows = df.select(F.explode(F.concat(*parts)).alias("x")).where("x.r is not null")
    return rows.select("x.source_id", "x.r.*")


def _items(f: T.StructField, inner: dict[str, T.DataType], base: Column, canonical, weight: Column | None) -> Column:
    def one(item: Column, i: Column) -> Column:
        return F.struct(F.concat_ws(":", base, F.lit(f.name), i.cast("string")).alias("source_id"), gold_record(inner, lambda n: item[n], canonical, weight).alias("r"))

    return F.transform(F.col(f"`{f.name}`"), one)


def artifact_kind(df: DataFrame, name: str) -> Column:
    """What a row's article column holds: (kind, suffix, size, sha256); kind is bytes, url, text, path or null where nothing is saved."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    nothing = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("sha256"))
    said = lambda k, suffix, size=None, sha=None: F.struct(F.lit(k).alias("kind"), suffix.alias("suffix"), (size if size is not None else F.lit(None).cast("int")).alias("size"), (sha if sha is not None else F.lit(None).cast("string")).alias("sha256"))
    as_bytes = lambda b: said("bytes", F.when(F.substring(b, 1, 4) == F.lit(b"%PDF"), ".pdf").otherwise(".bin"), F.octet_length(b), F.sha2(b, 256))
    if isinstance(kind, T.BinaryType):
        return F.when(c.isNotNull(), as_bytes(c)).otherwise(nothing)
    if isinstance(kind, T.StructType):
        names = set(kind.fieldNames())
        out = nothing
        if "path" in names:
            out = F.when(F.coalesce(c["path"], F.lit("")) != "", said("path", F.coalesce(F.nullif(F.regexp_extract(c["path"], r"(\.[^./]+)$", 1), F.lit("")), F.lit(".bin")))).otherwise(out)
        return F.when(c["bytes"].isNotNull(), as_bytes(c["bytes"])).otherwise(out) if "bytes" in names else out
    if isinstance(kind, T.StringType):
        t = strip(c)
        link = t.startswith("http://") | t.startswith("https://")
        return F.when(link, said("url", F.when(F.contains(F.lower(t), F.lit(".pdf")), ".pdf").otherwise(".download"))).when(F.length(t) > 500, said("text", F.lit(".txt"))).when((t != "") & ~t.rlike(r"\s"), said("path", F.coalesce(F.nullif(F.regexp_extract(t, r"(\.[^./]+)$", 1), F.lit("")), F.lit(".bin")))).otherwise(nothing)
    return nothing


def article_artifacts(df: DataFrame, id_col: str) -> DataFrame:
    """(source_id, field, kind, suffix, size, sha256) of every article payload in columns whose names hint at one."""
    names = [f.name for f in df.schema.fields if any(h in f.name.lower() for h in ARTICLE_HINTS)]
    if not names:
        return df.select(F.col(id_col).cast("string").alias("source_id"), F.lit("").alias("field"), F.lit("").alias("kind"), F.lit("").alias("suffix"), F.lit(0).alias("size"), F.lit("").alias("sha256")).limit(0)
    every = F.array(*[F.struct(F.lit(n).alias("field"), artifact_kind(df, n).alias("a")) for n in names])
    return df.select(F.col(id_col).cast("string").alias("source_id"), F.explode(every).alias("x")).where("x.a.kind is not null").select("source_id", "x.field", "x.a.*")
