"""Whole articles, gold records, references, links and image figures, with every text and count compared."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators import article as R
from assayloom.operators import evaluate as E
from assayloom.operators import images as I
from assayloom.operators import retrieval
from assayloom.operators.lineage import looks_nano
from assayloom.plans.measurements import _gold, _made
from assayloom.plans.registry import query, table
from assayloom.sources import benchmark, downloads
from assayloom.sources.writers import particle_table

#: Five articles in turn: their domain, text and what a model says of a Results chunk ("" elsewhere); @ is the article's number.
_MOLECULE = '{"compound_id": "c", "smiles": "CC@", "property_name": "pMIC", "value": %s, "unit": ""}'
_NANO = '{"material": "ceria", "formula": "%s", "endpoint": "%s", "value": "%s", "units": "nm"}'
_TEXT = "Abstract\nNothing of note.\n## Methods\nMixed.\n## Results\nThe MIC was 5 ug/mL, later ca. 7,5 ug/mL.\n## References\n[1] none"
ARTICLES = [
    ("Oxazolidinones", "Nanoparticles of ceria were 5 nm wide. The LOD was 3 ug/mL.", f'{{"rows": [{_NANO % ("CeO2", "size", "5")}, {_NANO % ("CeO2", "colour", "1")}]}}'),
    ("Nanozymes", _TEXT, f'{{"rows": [{_NANO % ("Xx2", "size", "5")}, {_NANO % ("Fe3O4", "Km", "2")}, 7]}}'),
    ("Benzimidazoles", _TEXT, f'{{"rows": [{_MOLECULE % "5.5"}, {_MOLECULE % "6.5"}]}}'),
    ("Oxazolidinones", _TEXT, f'[{_MOLECULE % "4.0625"}]'),
    ("Benzimidazoles", _TEXT, "no answer"),
]


def _of(values: list[str], key: str = "s_suppkey"):
    return F.replace(F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int")), F.lit("@"), F.col(key).cast("string"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("article_id"), _of([a[0] for a in ARTICLES]).alias("domain"), _of([a[1] for a in ARTICLES]).alias("markdown"))
    return d.select("article_id", "domain", "markdown", F.lit("docling").alias("parser"), F.lit(2).alias("table_count"), F.array(F.lit("w")).alias("warnings"))


def answers(chunks: DataFrame) -> DataFrame:
    """A model that always says the same: rows for Results and whole texts, none for other sections."""
    said = _of([a[2] for a in ARTICLES], "k")
    return chunks.withColumn("k", F.col("article_id").cast("long")).select("article_id", "index", F.when(F.col("section_title").isin("Results", "Document"), said).otherwise(F.lit('{"rows": []}')).alias("response"))


@cache
def _run(spark: SparkSession, sf_dir: str) -> R.Articles:
    return R.run_articles(articles(spark, sf_dir), answers, answers, max_attempts=2)


_K = "s_suppkey % 5"
_ERRORS = ["", "row 1 material_id=material: unknown element 'Xx' in formula 'Xx2'", "", "", "extractor output validation failed: No JSON object found in extractor response."]


def _case(*values, kind: str = "BIGINT") -> str:
    return f"CAST(CASE {_K} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" END AS {kind})"


@query(f"""SELECT CAST(s_suppkey AS VARCHAR) AS article_id, CASE {_K} WHEN 0 THEN 'Nanozymes' WHEN 1 THEN 'Nanozymes' WHEN 3 THEN 'Oxazolidinones' ELSE 'Benzimidazoles' END AS domain, 'docling' AS parser, 2 AS table_count, {_case(1, 2, 2, 2, 2)} AS chunk_count, {_case(1, 2, 2, 2, 2)} AS retrieved_chunk_count, CASE {_K} WHEN 0 THEN '0' ELSE '0,1' END AS retrieved_chunks,
'ParserAgent,RouterAgent,RetrievalAgent,ExtractorValidatorAgent,AggregatorAgent' AS agent_steps, {_case(1, 2, 2, 2, 2)} AS processed_chunk_count, {_case(2, 2, 2, 1, 0)} AS candidate_count, {_case(1, 1, 1, 1, 0)} AS validated_count, {_case(1, 1, 1, 1, 0)} AS clean_rows, {_case(0, 0, 0, 0, 0)} AS conflict_rows, {_case(1, 4, 0, 0, 0)} AS rejected_rows, {_case(0, 0, 0, 0, 0)} AS vision_result_count, {_case(0, 0, 0, 0, 0)} AS vision_particle_count, {_case(1, 2, 2, 2, 2)} AS concentration_mentions, 'w' AS warnings, 9 AS n_artifacts FROM supplier""")
def article_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _run(spark, sf_dir).manifest
    join = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",").alias(c)
    return m.select("article_id", "domain", "parser", "table_count", "chunk_count", "retrieved_chunk_count", join("retrieved_chunks"), F.array_join("agent_steps", ",").alias("agent_steps"), "processed_chunk_count", "candidate_count", "validated_count", "clean_rows", "conflict_rows", "rejected_rows", "vision_result_count", "vision_particle_count", "concentration_mentions", join("warnings"), F.size("artifacts").alias("n_artifacts"))


@query(f"""SELECT CAST(s_suppkey AS VARCHAR) AS article_id, step, agent, status, summary FROM (
SELECT s_suppkey, 0 AS step, 'ParserAgent' AS agent, 'completed' AS status, 'Prepared ' || {_case(1, 2, 2, 2, 2)} || ' chunks from ' || {_case(len(ARTICLES[0][1]), *[len(_TEXT.split("## References")[0].rstrip())] * 4)} || ' markdown characters.' AS summary FROM supplier
UNION ALL SELECT s_suppkey, 1, 'RouterAgent', 'completed', 'Using ' || CASE {_K} WHEN 0 THEN 'Nanozymes' WHEN 1 THEN 'Nanozymes' WHEN 3 THEN 'Oxazolidinones' ELSE 'Benzimidazoles' END || ' as the effective domain.' FROM supplier
UNION ALL SELECT s_suppkey, 2, 'RetrievalAgent', 'completed', 'Selected ' || {_case(1, 2, 2, 2, 2)} || ' chunks with tfidf retrieval.' FROM supplier
UNION ALL SELECT s_suppkey, 3, 'ExtractorValidatorAgent', CASE WHEN {_K} IN (1, 4) THEN 'warning' ELSE 'completed' END, 'Processed ' || {_case(1, 2, 2, 2, 2)} || ' chunks; validated ' || {_case(1, 1, 1, 1, 0)} || ' rows.' FROM supplier
UNION ALL SELECT s_suppkey, 4, 'AggregatorAgent', CASE WHEN {_K} IN (0, 1) THEN 'warning' ELSE 'completed' END, 'Produced ' || {_case(1, 1, 1, 1, 0)} || ' clean rows, 0 conflicts, ' || {_case(1, 4, 0, 0, 0)} || ' rejected rows.' FROM supplier)""")
def article_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).trace.select("article_id", "step", "agent", "status", "summary")


@query(f"""SELECT CAST(s_suppkey AS VARCHAR) AS article_id, validator, reason, source_id FROM (
SELECT s_suppkey, 'nano_critic' AS validator, 'row 2 material_id=material: property_name ''colour'' is not an allowed nanozyme endpoint' AS reason, s_suppkey || ':chunk-0' AS source_id FROM supplier WHERE {_K} = 0
UNION ALL SELECT s_suppkey, v, r, s_suppkey || ':chunk-1' FROM supplier, (VALUES ('nano_extractor_schema', 'row 3: row: Input should be a valid dictionary'), ('nano_critic', '{_ERRORS[1].replace("'", "''")}'), ('nano_extractor_schema', 'row 3: row: Input should be a valid dictionary'), ('nano_critic', '{_ERRORS[1].replace("'", "''")}')) AS t(v, r) WHERE {_K} = 1)""")
def article_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).rejected.select("article_id", "validator", "reason", "source_id")


_WHY = ["", "Extractor found candidates, but the validator rejected all of them.", "Validated rows exist, but aggregation removed them as incomplete or non-numeric.|This document looks like a nano/nanoparticle article; choose the Nanozymes domain and run again.", "No chunks were sent to the extractor.", "Extractor failed on at least one chunk; open Log for the exact provider or validation error.|The result table has small-molecule columns; rerun after selecting the Nanozymes domain.|Network access is blocked for the process; restart it with network access before using a remote model.|Recent errors: e2 | WinError 10013 | e4"]


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS article_id, CASE {_K} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WHY)) + " END AS reasons FROM supplier")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    at = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    errors = F.when(k == 4, F.array(*[F.lit(e) for e in ("e1", "e2", "WinError 10013", "e4")])).otherwise(F.array().cast("array<string>"))
    said = at("", "", "nanoparticles and Vmax", "", "")
    facts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("article_id"), at("x", "x", "x", "x", "Nanozymes").alias("domain"), looks_nano(said).alias("nano_text"), at(1, 1, 1, 0, 1).alias("chunks"), at(0, 0, 0, 0, 1).alias("failed_chunks"), at(3, 3, 3, 0, 0).alias("candidates"), at(3, 0, 3, 0, 0).alias("validated"), at(1, 0, 0, 0, 0).alias("clean"), errors.alias("errors"))
    return R.why_empty(facts, ["canonical_smiles", "value"]).select("article_id", F.array_join("reasons", "|").alias("reasons"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS article_id, CASE s_suppkey % 5 WHEN 0 THEN 'Document' ELSE 'Methods,Results' END AS sections, CASE s_suppkey % 5 WHEN 0 THEN '## Document' || chr(10) || chr(10) || 'Nanoparticles of ceria were 5 nm wide. The LOD was 3 ug/mL.' ELSE '## Methods' || chr(10) || chr(10) || 'Mixed.' || chr(10) || chr(10) || '## Results' || chr(10) || chr(10) || 'The MIC was 5 ug/mL, later ca. 7,5 ug/mL.' END AS context, CASE s_suppkey % 5 WHEN 0 THEN 'Selected 1 context chunks.' ELSE 'Selected 2 context chunks.' END AS summary FROM supplier""")
def agent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.agent_task(articles(spark, sf_dir), "find values", text_col="markdown")
    return t.select("article_id", F.array_join("selected_sections", ",").alias("sections"), "context", F.get(F.filter("trace", lambda s: s["agent"] == "chunker"), F.lit(0))["summary"].alias("summary"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS source_id, p_brand AS compound_id, 'C' || p_size AS smiles, 'MIC' AS property_name, printf('%.3f', CAST(p_size AS DOUBLE)) AS value, 'mg' AS unit FROM part
UNION ALL SELECT p_partkey || ':Gold_Rows:0', '', 'N', 'pMIC', printf('%.3f', CAST(printf('%g', p_retailprice) AS DOUBLE)), 'pMIC' FROM part
UNION ALL SELECT p_partkey || ':Gold_Rows:1', '', 'O', 'pMIC', 'n.d.', '' FROM part""")
def gold_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda s, v: F.struct(F.lit(s).alias("Molecule-Smiles"), v.cast("string").alias("pMIC"), F.lit(1).alias("other"))
    price = F.call_function("printf", F.lit("%s"), benchmark.shown(F.col("p_retailprice"), table(spark, sf_dir, "part").schema["p_retailprice"].dataType))
    d = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("Compound ID"), F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("SMILES"), F.lit("MIC").alias("endpoint"), F.col("p_size").cast("double").alias("value"), F.lit(" mg ").alias("units"), F.array(item("N", price), item("O", F.lit("n.d.")), item("", F.lit("1")), item("S", F.lit(""))).alias("Gold_Rows"), F.array(item("X", F.lit("1"))).alias("Notes"))
    return benchmark.gold_records(d, "p_partkey").select("source_id", "compound_id", "smiles", "property_name", "value", "unit")


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 IN (0, 2)")
def domain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    d = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, "Nano-Zymes v2").otherwise("other").alias("Task"), F.when(k == 2, F.array(F.lit("x"), F.lit("the NANO zymes"))).otherwise(F.array(F.lit("nano"))).alias("collection"), F.lit("nanozymes").alias("note"))
    return d.where(benchmark.matches_domain(d, "nanozymes")).select("p_partkey")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'openalex:https://a.org/' || page_id || '.pdf|ncbi-oa:https://ftp.ncbi.nlm.nih.gov/pub/' || page_id || '.tar.gz|crossref:https://c.org/x.PDF' WHEN 1 THEN 'crossref:https://c.org/x.PDF' ELSE '' END AS links, 'https://h.org:8080/' AS referer, page_id % 3 = 0 AS archive FROM pages""")
def oa_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    a = F.concat(F.lit("https://a.org/"), n, F.lit(".pdf"))
    alex = F.when(k == 0, F.parse_json(F.concat(F.lit('{"best_oa_location": {"pdf_url": "'), a, F.lit('"}, "primary_location": null, "locations": [{"pdf_url": null}, {"pdf_url": "'), a, F.lit('"}]}'))))
    xml = F.when(k == 0, F.concat(F.lit('<OA><records><record><link href="ftp://ftp.ncbi.nlm.nih.gov/pub/'), n, F.lit('.tar.gz"/><link href=""/></record></records></OA>')))
    cross = F.when(k != 2, F.parse_json(F.lit('{"message": {"link": [{"URL": "https://c.org/x.PDF"}, {"URL": "https://c.org/x.html", "content-type": "text/html"}, {"URL": "https://c.org/x.PDF", "content-type": "application/pdf"}]}}')))
    found = F.transform(downloads.candidates(alex, xml, cross), lambda x: F.concat(x["resolver"], F.lit(":"), x["url"]))
    archive = downloads.looks_like_archive(F.when(k == 0, F.lit(b"\x1f\x8b\x08")).otherwise(F.lit(b"%PDF-")), F.lit(""), F.lit("https://x.org/a.pdf"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, "|").alias("links"), downloads.referer(F.concat(F.lit("https://h.org:8080/p?x="), n)).alias("referer"), archive.alias("archive"))


_REPORT = """WITH g0 AS (SELECT count(*) AS n FROM lineitem), x0 AS (SELECT count(*) AS n FROM lineitem), """


def _report_sql() -> str:
    from assayloom.plans.registry import SQL

    inner = SQL["eval_metrics"].removeprefix("WITH ")
    lines = ["'gold_records=' || g0.n", "'generated_records=' || x0.n", "'gold_keys=' || m.gold_records", "'generated_keys=' || m.generated_records", "'shared_keys=' || m.shared_keys", "'missing_keys=' || m.missing_keys", "'extra_keys=' || m.extra_keys", "'exact_value_matches=' || m.exact_matches"]
    lines += [f"'{name}=' || printf('%.6f', m.{c})" for name, c in (("value_accuracy_on_shared_keys", "value_accuracy"), ("key_precision", "key_precision"), ("key_recall", "key_recall"), ("key_f1", "key_f1"), ("macro_f1", "macro_f1"))]
    head, _, tail = inner.rpartition("\nSELECT c.*")
    return _REPORT + head + ", m AS (SELECT c.*" + tail + ") SELECT unnest([" + ", ".join(lines) + "]) AS line FROM m, g0, x0"


@query(_report_sql())
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics_text(E.evaluation(_gold(spark, sf_dir), _made(spark, sf_dir))).select("line")


@query("""WITH c AS (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber, l_quantity FROM lineitem), p AS (SELECT l_suppkey, sqrt(4.0 * (l_quantity * 10) / pi()) AS px FROM c WHERE l_quantity * 10 BETWEEN 60 AND 400)
SELECT l_suppkey, CAST(count(*) AS INTEGER) AS count, printf('%.4f', avg(px) * 0.5) AS mean_nm, printf('%.4f', quantile_cont(px, 0.5) * 0.5) AS median_nm, printf('%.4f', stddev_samp(px) * 0.5) AS std_nm, printf('%.4f', avg(px)) AS mean_px FROM p GROUP BY l_suppkey""")
def image_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_quantity").distinct()
    one = F.struct((F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("int").alias("contour_id"), F.array(F.lit(0), F.lit(0), F.lit(3), F.lit(3)).alias("bbox"), (F.col("l_quantity") * 10).cast("double").alias("area_px"), F.lit(20.0).alias("perimeter_px"))
    bar = F.struct(F.lit(200.0).alias("length_px"), F.lit(100.0).alias("label_nm"), F.lit(0.5).alias("nm_per_px"))
    results = c.groupBy("l_suppkey").agg(F.collect_list(one).alias("contours")).select("l_suppkey", F.lit(1).alias("index"), F.lit(80).alias("image_width"), F.lit(50).alias("image_height"), "contours", bar.alias("scale_bar"), F.array().cast("array<struct<index:int,bbox:array<int>,kind:string,confidence:double>>").alias("panels"), F.array().cast("array<string>").alias("warnings"))
    s = I.summaries(results, ["l_suppkey"], least_area=60.0).where("count > 0")
    four = lambda c, n: F.format_string("%.4f", F.col(c)).alias(n)
    return s.select("l_suppkey", "count", four("mean_diameter_nm", "mean_nm"), four("median_diameter_nm", "median_nm"), F.when(F.col("count") > 1, F.format_string("%.4f", "std_diameter_nm")).alias("std_nm"), four("mean_diameter_px", "mean_px"))


@query("SELECT s_suppkey, 3 AS count, printf('%g', s_acctbal) AS mean_diameter_nm, '' AS std_diameter_nm, '0.333333' AS nm_per_px FROM supplier")
def particle_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(3).alias("count"), F.col("s_acctbal").alias("mean_diameter_nm"), F.lit(None).cast("double").alias("std_diameter_nm"), F.lit(1 / 3).alias("nm_per_px"))
    return particle_table(s, ["s_suppkey"]).select("s_suppkey", "count", "mean_diameter_nm", "std_diameter_nm", "nm_per_px")


@query("SELECT DISTINCT coalesce(lang, '') AS pdf, coalesce(source, '') AS doi, CASE WHEN coalesce(lang, '') = 'de' THEN 'T' ELSE '' END AS title FROM documents WHERE coalesce(lang, '') <> '' OR coalesce(source, '') <> ''")
def refs_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit(" "), F.coalesce("lang", F.lit(""))).alias("pdf"), F.col("source").alias("doi"), F.when(F.col("lang") == "de", "T").alias("title"), "doc_id")
    return E.distinct_references(d, "pdf", "doi", "title", "doc_id").select("pdf", "doi", "title")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS with_vectors FROM supplier")
def embedding_plug_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("article_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("index"))
    d = d.select("article_id", "index", F.concat(F.lit("t"), (F.col("article_id") % 3).cast("string")).alias("text"), F.lit("q").alias("query"))

    def embed(texts: list[str]) -> object:
        if "t2" in texts:
            return [[1.0, 2.0]]  # another number of vectors than texts
        return [[float(len(t)), 1] for t in texts]

    v = retrieval.with_vectors(d, embed)
    return v.groupBy(F.col("article_id").alias("s_suppkey")).agg(F.count("chunk_vector").cast("int").alias("with_vectors"))
