"""Provenance, routing, traces, manifests and the tables people look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.exprs import or_default, text

# What in a text hints at nanozymes.
NANO_HINTS = ["nanozyme", "nanoparticle", "nanoparticles", "nanomaterial", "microsphere", "microspheres", "oxidase-like", "catalase-like", "km", "vmax"]


def with_provenance(df: DataFrame, article: str, chunk: str, evidence: Column) -> DataFrame:
    """Source type, article, source id, chunk and evidence where a row has none of its own."""
    made = {"source_type": F.lit("text"), "article_id": F.col(article).cast("string"), "source_id": F.concat(F.col(article).cast("string"), F.lit(":chunk-"), F.col(chunk).cast("string")), "chunk_index": F.col(chunk).cast("string"), "evidence": F.substring(evidence, 1, 1000)}
    return df.withColumns({k: F.coalesce(F.col(k).cast("string"), v) if k in df.columns and k not in (article, chunk) else v for k, v in made.items()})


def nano_hits(x: Column) -> Column:
    t = F.lower(x)
    hits = F.lit(0)
    for h in NANO_HINTS:
        hits = hits + F.contains(t, F.lit(h)).cast("int")
    return hits


def looks_nano(x: Column) -> Column:
    t = F.lower(x)
    return (nano_hits(x) >= 2) | ((nano_hits(x) >= 1) & (F.contains(t, F.lit(" nm")) | F.contains(t, F.lit("nm "))))


def effective_domain(domain: Column, x: Column, can_switch: bool = True) -> Column:
    """The domain, or Nanozymes where the text says so and switching is possible."""
    nano = F.contains(F.lower(domain), F.lit("nano"))
    return F.when(F.lit(can_switch) & ~nano & looks_nano(x), "Nanozymes").otherwise(domain)


def material_hint(rows: DataFrame, article: str, order: str) -> DataFrame:
    """Each article's first row with a formula: (article, material_id, material_name, material_formula)."""
    have = rows.where(text("material_formula") != "")
    one = have.groupBy(article).agg(F.min_by(F.struct("material_id", "material_name", "material_formula"), order).alias("h"))
    return one.select(article, "h.*")


def trace(counts: DataFrame, article: str, steps: list[tuple[str, str, str]]) -> DataFrame:
    """A row per article and step, (step, metric column, role); a step that made nothing is a warning."""
    parts = [F.struct(F.lit(i).alias("step"), F.lit(name).alias("agent"), F.lit(role).alias("role"), F.when(F.coalesce(F.col(c), F.lit(0)) > 0, "completed").otherwise("warning").alias("status"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("metric")) for i, (name, c, role) in enumerate(steps)]
    return counts.select(article, F.explode(F.array(*parts)).alias("x")).select(article, "x.*")


def manifest(articles: DataFrame, article: str, **parts: DataFrame) -> DataFrame:
    """Each article with the number of rows each part has of it, 0 where none; parts are counted before they are joined."""
    out = articles
    for name, df in parts.items():
        out = out.join(df.groupBy(article).agg(F.count("*").alias(name)), article, "left").fillna(0, [name])
    return out


def chunk_view(chunks: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with their retrieval result, if any; ``for_display`` sorts what is shown."""
    r = ranked.select(*keys, F.col("rank").alias("retrieval_rank"), F.col("score").alias("retrieval_score"), "retrieval_method")
    return chunks.join(r, keys, "left").withColumns({"selected": F.col("retrieval_rank").isNotNull(), "retrieval_method": F.coalesce("retrieval_method", F.lit("")), "chars": F.length("text"), "preview": F.replace(F.substring("text", 1, 300), F.lit("\n"), F.lit(" "))})


def for_display(view: DataFrame, keys: list[str]) -> DataFrame:
    """A chunk view in the order people read it."""
    return view.orderBy(F.desc("selected"), F.asc_nulls_last("retrieval_rank"), *keys)


def evidence_preview(x: Column, most: int = 180) -> Column:
    return F.substring(F.replace(x, F.lit("\n"), F.lit(" ")), 1, most)


def evidence_label(position: Column, identity: Column, prop: Column, value: Column, unit: Column) -> Column:
    n = (position + 1).cast("string")
    return F.rtrim(F.concat(n, F.lit(": "), or_default(text(identity), F.concat(F.lit("row "), n)), F.lit(" | "), or_default(text(prop), "property"), F.lit(" = "), text(value), F.lit(" "), text(unit)))


def preferred_first(df: DataFrame, preferred: list[str]) -> DataFrame:
    names = [c for c in preferred if c in df.columns]
    return df.select(*names, *[c for c in df.columns if c not in names])


def recent(x: Column, most: int = 3) -> Column:
    return F.slice(x, F.greatest(F.size(x) - most + 1, F.lit(1)), most)


def safe_filename(x: Column, variant: str = "runs") -> Column:
    """A file name made of plain characters.

    ``runs``: runs of others become one underscore, ends stripped of ``._-``, 80 characters, default ``article``.
    ``chars``: letters, digits and ``-_.`` stay, each other becomes an underscore, 80 characters, ends stripped of ``._``.
    ``long``: the same with 120 characters. ``plain``: letters, digits and ``-_`` stay, 80 characters, ends stripped of
    ``_``, default ``artifact``.
    """
    t = text(x)
    if variant == "runs":
        made = F.substring(F.regexp_replace(F.regexp_replace(t, "[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+\z", ""), 1, 80)
    elif variant in ("chars", "long"):
        made = F.regexp_replace(F.substring(F.regexp_replace(t, r"[^\p{L}\p{N}\-_.]", "_"), 1, 80 if variant == "chars" else 120), r"^[._]+|[._]+\z", "")
    elif variant == "plain":
        made = F.regexp_replace(F.substring(F.regexp_replace(t, r"[^\p{L}\p{N}\-_]", "_"), 1, 80), r"^_+|_+\z", "")
        return or_default(made, "artifact")
    else:
        raise ValueError(f"no variant {variant!r}")
    return or_default(made, "article")
