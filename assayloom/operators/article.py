"""Articles from parsed text to clean tables, as one chain of DataFrames keyed by article.

``prepare`` cleans, cuts and scans; ``run_articles`` ranks chunks, asks the extractor, judges, aggregates and reports.
Nothing is done article by article: every step is one plan over all articles.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.operators import aggregate as A
from assayloom.operators import lineage as L
from assayloom.operators import retrieval as R
from assayloom.operators import validate as V
from assayloom.operators.chunk import chunk_articles
from assayloom.operators.text import clean_markdown, mentions
from assayloom.tables import stored

KEYS = ["article_id", "index"]
#: Asks a model: gets open chunks (article_id, index, text, attempt, errors, ...) and returns (article_id, index, response).
Ask = Callable[[DataFrame], DataFrame]


class Prepared(NamedTuple):
    documents: DataFrame
    chunks: DataFrame
    mentions: DataFrame


class Articles(NamedTuple):
    """Tables by article: what each step made, the trace of the steps, and a manifest of counts."""

    documents: DataFrame
    chunks: DataFrame
    mentions: DataFrame
    ranked: DataFrame
    states: DataFrame
    molecules: A.Aggregated
    nano: A.Aggregated
    rejected: DataFrame
    trace: DataFrame
    manifest: DataFrame


def prepare(articles: DataFrame, targets: list[str] | None = None, max_chars: int = 6000, overlap: int = 400, weight: Column | None = None) -> Prepared:
    """Clean ``markdown``, cut it and scan it for concentrations; other columns of ``articles`` are kept."""
    clean = clean_markdown(articles, "markdown")
    return Prepared(clean, chunk_articles(clean, "article_id", "markdown", targets, max_chars, overlap), mentions(clean, "article_id", "markdown", weight))


def _counted(base: DataFrame, **parts: Column | DataFrame) -> DataFrame:
    """``base`` with the number of rows each table has of an article, 0 where none."""
    return L.manifest(base, "article_id", **parts)


def run_articles(
    articles: DataFrame, ask_molecules: Ask | None = None, ask_nano: Ask | None = None, top_k: int = 3, max_attempts: int = 3, can_switch: bool = True, canonical: V.Lifted | None = None,
    vision: DataFrame | None = None, mode: str = "tfidf", vectors: Callable[[DataFrame], DataFrame] | None = None, keep: Callable[[DataFrame], DataFrame] = stored, **cut,
) -> Articles:
    """The whole pipeline over ``articles`` (article_id, markdown, domain, and if they have them parser, table_count, warnings).

    A domain that is not nano becomes Nanozymes where the text says so and ``can_switch``. The ``top_k`` best chunks of an
    article go to the extractor of its kind; without one every chunk has no rows. ``vectors`` adds chunk_vector and
    query_vector to chunks for hybrid ranking. ``vision`` has particle summaries (article_id, index, source, count,
    mean_diameter_nm, mean_diameter_px, panel, warnings). What a model said is kept (``keep``), so later steps don't ask again.
    """
    articles = articles.withColumns({c: F.lit(v).cast(t) for c, v, t in (("parser", "markdown", "string"), ("table_count", 0, "int")) if c not in articles.columns})
    if "warnings" not in articles.columns:
        articles = articles.withColumn("warnings", F.array().cast("array<string>"))
    p = prepare(articles, **cut)
    docs = p.documents.withColumn("selected_domain", F.col("domain")).withColumn("domain", L.effective_domain(F.col("domain"), F.col("markdown"), can_switch))
    docs = docs.withColumn("nano", F.contains(F.lower("domain"), F.lit("nano")))
    docs = keep(docs)
    p = Prepared(docs, keep(p.chunks), keep(p.mentions))
    chunks = p.chunks.join(docs.select("article_id", "nano", R.query_of(F.col("domain")).alias("query")), "article_id")
    hybrid = mode == "hybrid" and vectors is not None
    picked = R.rank_chunks(vectors(chunks) if hybrid else chunks, F.col("query"), top_k, chunk_vector="chunk_vector" if hybrid else None, query_vector="query_vector" if hybrid else None)
    ranked = keep(picked)
    chosen = chunks.join(ranked.select("article_id", "index", "rank"), KEYS)
    nothing = lambda df: V.empty_responses(df, KEYS)
    states, validated, refused = {}, {}, {}
    for kind, ask in (("nano", ask_nano), ("molecule", ask_molecules)):
        own = chosen.where("nano" if kind == "nano" else "not nano")
        states[kind] = keep(V.with_retries(own, ask or nothing, KEYS, kind == "nano", max_attempts, canonical, keep))
        text = own.select(*KEYS, "text", "rank")
        validated[kind], refused[kind] = (L.with_provenance(V.rows_of(states[kind], KEYS, which).join(text, KEYS), "article_id", "index", F.col("text")).drop("text") for which in ("validated", "rejected"))
    order = F.struct(F.lit(0).alias("kind"), "rank", "place")
    validated, refused = {k: keep(v) for k, v in validated.items()}, {k: keep(v) for k, v in refused.items()}
    found_nano = validated["nano"].withColumn("_row_order", order)
    seen = vision if vision is not None else None
    if seen is not None:
        hint = L.material_hint(found_nano, "article_id", "_row_order")
        from_images, image_rejects = vision_rows(seen.join(docs.where("nano").select("article_id"), "article_id", "left_semi"), hint)
        found_nano = found_nano.unionByName(from_images, allowMissingColumns=True)
    molecules = A.aggregate_molecules(validated["molecule"].withColumn("_row_order", order), per_article=True)
    nano = A.aggregate_nano(found_nano, per_article=True)
    rejected = combined_rejects(refused["nano"], nano.rejected)
    if seen is not None:
        rejected = rejected.unionByName(image_rejects.select(*[F.col(c).cast("string").alias(c) if c in image_rejects.columns else F.lit(None).cast("string").alias(c) for c in A.REJECTED]))
    every = states["nano"].select(*KEYS, "attempts", "status", "n_candidates", "error_log", F.size("validated").alias("n_validated"), F.size("rejected").alias("n_rejected")).unionByName(states["molecule"].select(*KEYS, "attempts", "status", "n_candidates", "error_log", F.size("validated").alias("n_validated"), F.lit(0).alias("n_rejected")))
    molecules, nano = (A.Aggregated(*[None if t is None else keep(t) for t in made]) for made in (molecules, nano))
    rejected = keep(rejected)
    facts = keep(_facts(docs, p, ranked, every, molecules, nano, rejected, seen))
    return Articles(docs, p.chunks, p.mentions, ranked, every, molecules, nano, rejected, trace_of(facts, top_k, mode, seen is not None), manifest_of(facts, seen is not None))


def combined_rejects(extraction: DataFrame, aggregation: DataFrame) -> DataFrame:
    """Rows rejected while extracting, then those the aggregation could not use, in the same columns."""
    have = lambda df: df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit("").alias(c) for c in A.REJECTED])
    return have(extraction).unionByName(have(aggregation))


def vision_rows(summaries: DataFrame, hint: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of particle summaries: measurements of the article's first material, in nanometres.

    Without particles there is no row; without a scale, or without a material in the article, the row is rejected.
    """
    nm, has = F.col("mean_diameter_nm"), F.col("material_formula").isNotNull()
    df = summaries.where(F.col("count") > 0).join(hint, "article_id", "left")
    base = {"property_name": F.lit("particle diameter"), "assay": F.lit("CV particle segmentation"), "source_type": F.lit("vision"), "source_id": F.concat("article_id", F.lit(":vision-"), F.col("index").cast("string")), "chunk_index": F.lit(""), "evidence": F.array_join("warnings", " | ")}
    usable = nm.isNotNull() & has
    name = F.substring_index("source", "/", -1)
    condition = F.when(usable, F.concat(F.lit("mean; count="), F.col("count").cast("string"), F.lit("; panel="), F.coalesce(F.col("panel").cast("string"), F.lit("")))).otherwise(F.concat(F.lit("mean; "), name))
    reason = F.when(nm.isNull(), "vision particle measurements have no nm scale").when(~has, "missing material formula hint for vision measurement")
    made = df.withColumns({**base, "condition": condition, "reason": reason, "value": F.coalesce(nm, F.col("mean_diameter_px")).cast("string"), "unit": F.when(nm.isNull(), "px").otherwise("nm"), "_row_order": F.struct(F.lit(1).alias("kind"), F.col("index").cast("int").alias("rank"), F.lit(0).alias("place"))})
    columns = ["article_id", *base, "condition", "value", "unit"]
    return made.where(usable).select(*columns, "material_id", "material_name", "material_formula", "_row_order"), made.where(~usable).select(*columns, "reason", F.lit("vision_reconciler").alias("validator"))


def _facts(docs: DataFrame, p: Prepared, ranked: DataFrame, states: DataFrame, molecules: A.Aggregated, nano: A.Aggregated, rejected: DataFrame, vision: DataFrame | None) -> DataFrame:
    """A row per article with what the trace and the manifest count. Lists are of an article's few ranked chunks and errors."""
    base = docs.select("article_id", "domain", "selected_domain", "nano", "parser", "table_count", "warnings", F.length("markdown").alias("markdown_chars"))
    lists = ranked.groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "index"))), lambda x: x["index"]).alias("retrieved_chunks"))
    per = states.groupBy("article_id").agg(F.count("*").alias("processed_chunk_count"), F.sum("n_candidates").alias("candidate_count"), F.sum("n_validated").cast("long").alias("validated_count"), F.sum("n_rejected").cast("long").alias("extraction_rejected"), F.sum("attempts").cast("long").alias("attempts"), F.sum((F.col("status") == "failed").cast("long")).alias("failed_chunks"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("index", "error_log"))), lambda x: x["error_log"])).alias("errors"))
    clean = molecules.clean.select("article_id").union(nano.clean.select("article_id"))
    conflicts = molecules.conflicts.select("article_id").union(nano.conflicts.select("article_id"))
    out = _counted(base, chunk_count=p.chunks, concentration_mentions=p.mentions, clean_rows=clean, conflict_rows=conflicts, rejected_rows=rejected).join(lists, "article_id", "left").join(per, "article_id", "left")
    numbers = ["processed_chunk_count", "candidate_count", "validated_count", "extraction_rejected", "attempts", "failed_chunks"]
    if vision is not None:
        of = vision.groupBy("article_id").agg(F.count("*").alias("vision_result_count"), F.sum("count").cast("long").alias("vision_particle_count"), F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("index", "warnings"))), lambda x: x["warnings"]))), 1, 5).alias("vision_warnings"))
        out = out.join(of, "article_id", "left")
    else:
        out = out.withColumns({"vision_result_count": F.lit(0).cast("long"), "vision_particle_count": F.lit(0).cast("long"), "vision_warnings": F.array().cast("array<string>")})
    out = out.fillna(0, [*numbers, "vision_result_count", "vision_particle_count"])
    return out.withColumns({"retrieved_chunks": F.coalesce("retrieved_chunks", F.array().cast("array<int>")), "errors": F.coalesce("errors", F.array().cast("array<string>")), "vision_warnings": F.coalesce("vision_warnings", F.array().cast("array<string>"))})


def trace_of(facts: DataFrame, top_k: int, mode: str, with_vision: bool) -> DataFrame:
    """(article_id, step, agent, role, status, summary, metrics, warnings): a row for each step an article went through."""
    none = F.array().cast("array<string>")
    words = lambda *parts: F.concat(*[F.col(x[1:]).cast("string") if x.startswith("$") else F.lit(x) for x in parts])
    kind = F.when(F.col("nano"), "nanozyme").otherwise("small-molecule")
    # The agents of the steps, in order.
    steps = [
        ("ParserAgent", "Turn parsed text into clean text, tables and section chunks.", F.lit(False), words("Prepared ", "$chunk_count", " chunks from ", "$markdown_chars", " markdown characters."), {"markdown_chars": "markdown_chars", "tables": "table_count", "chunks": "chunk_count", "concentration_mentions": "concentration_mentions"}, F.col("warnings")),
        ("RouterAgent", "Choose the extractor and the validator of the domain.", F.lit(False), words("Using ", "$domain", " as the effective domain."), {"selected_domain": "selected_domain", "effective_domain": "domain", "extractor_kind": kind}, none),
        ("RetrievalAgent", "Rank chunks before any goes to the extractor.", F.lit(False), F.concat(F.lit("Selected "), F.size("retrieved_chunks").cast("string"), F.lit(f" chunks with {mode} retrieval.")), {"retrieval_mode": F.lit(mode), "requested_chunks": F.lit(top_k), "selected_chunks": F.to_json("retrieved_chunks"), "selected_count": F.size("retrieved_chunks")}, none),
        ("ExtractorValidatorAgent", "Extract and validate each chosen chunk, asking again on errors.", F.size("errors") > 0, words("Processed ", "$processed_chunk_count", " chunks; validated ", "$validated_count", " rows."), {"processed_chunks": "processed_chunk_count", "candidate_rows": "candidate_count", "validated_rows": "validated_count", "rejected_rows": "extraction_rejected", "attempts": "attempts"}, F.slice("errors", 1, 5)),
        ("VisionAgent", "Measure particles in figures.", F.size("vision_warnings") > 0, words("Analyzed ", "$vision_result_count", " figure crops/pages."), {"vision_results": "vision_result_count", "particle_count": "vision_particle_count"}, F.col("vision_warnings")),
        ("AggregatorAgent", "Drop repeats, settle conflicts, make the final tables.", (F.col("conflict_rows") > 0) | (F.col("rejected_rows") > 0), words("Produced ", "$clean_rows", " clean rows, ", "$conflict_rows", " conflicts, ", "$rejected_rows", " rejected rows."), {"clean_rows": "clean_rows", "conflicts": "conflict_rows", "rejected": "rejected_rows"}, none),
    ]
    steps = [s for s in steps if with_vision or s[0] != "VisionAgent"]
    metric = lambda m: F.map_from_arrays(F.array(*[F.lit(k) for k in m]), F.array(*[(F.col(v) if isinstance(v, str) else v).cast("string") for v in m.values()]))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(agent).alias("agent"), F.lit(role).alias("role"), F.when(bad, "warning").otherwise("completed").alias("status"), summary.alias("summary"), metric(m).alias("metrics"), warnings.alias("warnings")) for i, (agent, role, bad, summary, m, warnings) in enumerate(steps)]
    return facts.select("article_id", F.explode(F.array(*rows)).alias("s")).select("article_id", "s.*")


#: What a bundle holds of an article, by the name of its part.
ARTIFACTS = ["clean_csv", "conflicts_csv", "rejected_csv", "logs", "prepared_markdown", "chunks_json", "retrieval_json", "agent_trace_json", "states_json"]


def manifest_of(facts: DataFrame, with_vision: bool, folder: str = "") -> DataFrame:
    """A row per article: its counts and lists, when it was made, and where its artefacts stand under ``folder``."""
    agents = ["ParserAgent", "RouterAgent", "RetrievalAgent", "ExtractorValidatorAgent", *(["VisionAgent"] if with_vision else []), "AggregatorAgent"]
    names = [*ARTIFACTS, *(["vision_json", "vision_summary_csv"] if with_vision else [])]
    paths = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.concat(F.lit(f"{folder}/{n}/article_id="), "article_id") for n in names]))
    out = facts.withColumns({"created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "retrieved_chunk_count": F.size("retrieved_chunks").cast("long"), "agent_steps": F.array(*[F.lit(a) for a in agents]), "artifacts": paths})
    return out.select("article_id", "created_at", "domain", "parser", "table_count", "chunk_count", "retrieved_chunk_count", "retrieved_chunks", "agent_steps", "processed_chunk_count", "candidate_count", "validated_count", "clean_rows", "conflict_rows", "rejected_rows", "vision_result_count", "vision_particle_count", "concentration_mentions", "warnings", "artifacts")


def why_empty(facts: DataFrame, columns: list[str]) -> DataFrame:
    """(article_id, reasons): why an article has no clean row, with its last three errors; none where it has.

    ``facts``: (article_id, domain, nano_text, chunks, failed_chunks, candidates, validated, clean, errors). ``columns``:
    those of the result table.
    """
    first = F.when(F.col("failed_chunks") > 0, "Extractor failed on at least one chunk; open Log for the exact provider or validation error.").when(F.col("chunks") == 0, "No chunks were sent to the extractor.").when(F.col("candidates") == 0, "Extractor returned zero candidate rows for the processed chunks.").when(F.col("validated") == 0, "Extractor found candidates, but the validator rejected all of them.").otherwise("Validated rows exist, but aggregation removed them as incomplete or non-numeric.")
    nano = F.contains(F.lower("domain"), F.lit("nano"))
    small = bool({"canonical_smiles", "smiles"} & set(columns))
    recent = L.recent(F.col("errors"), 3)
    blocked = F.exists(recent, lambda e: F.lower(e).rlike("winerror 10013|access to a socket|доступа к сокету"))
    every = F.array(
        first,
        F.when(~nano & F.col("nano_text"), "This document looks like a nano/nanoparticle article; choose the Nanozymes domain and run again."),
        F.when(nano & F.lit(small), "The result table has small-molecule columns; rerun after selecting the Nanozymes domain."),
        F.when(blocked, "Network access is blocked for the process; restart it with network access before using a remote model."),
        F.when(F.size("errors") > 0, F.concat(F.lit("Recent errors: "), F.array_join(recent, " | "))),
    )
    reasons = F.when(F.col("clean") > 0, F.array().cast("array<string>")).otherwise(F.filter(every, lambda r: r.isNotNull()))
    return facts.select("article_id", reasons.alias("reasons"))


def agent_task(articles: DataFrame, task: str, id_col: str = "article_id", text_col: str = "text", **cut) -> DataFrame:
    """(id, task, steps, chunks, selected_sections, context, trace): plan, chunk and collect, an article a row.

    An article's chunks are gathered in its own row, in order.
    """
    chunks = chunk_articles(articles, id_col, text_col, **cut)
    per = chunks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("index", "section_title", "text", "start_char", "end_char"))).alias("chunks"))
    out = articles.select(id_col).join(per, id_col, "left")
    out = out.withColumn("chunks", F.coalesce("chunks", F.array().cast(per.schema["chunks"].dataType)))
    # The three agents of a task.
    steps = ["identify requested evidence", "segment relevant article sections", "summarize selected context for downstream reasoning"]
    summaries = [("planner", F.lit("Created a deterministic execution plan.")), ("chunker", F.concat(F.lit("Selected "), F.size("chunks").cast("string"), F.lit(" context chunks."))), ("synthesizer", F.lit("Prepared response context for the next LLM step."))]
    return out.select(id_col, F.lit(task).alias("task"), F.array(*[F.lit(s) for s in steps]).alias("steps"), "chunks", F.array_sort(F.array_distinct(F.transform("chunks", lambda c: c["section_title"]))).alias("selected_sections"), F.array_join(F.transform("chunks", lambda c: c["text"]), "\n\n").alias("context"), F.array(*[F.struct(F.lit(a).alias("agent"), s.alias("summary")) for a, s in summaries]).alias("trace"))


def run_steps(df: DataFrame, agents: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Agents one after the other over a table; each sees what those before it added."""
    if not agents:
        raise ValueError("At least one agent is required.")
    for _, agent in agents:
        df = agent(df)
    return df
