"""References, gold, vision arithmetic, manifests and display tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.exprs import fixed, let, number, rounded, short
from assayloom.operators import evaluate as E
from assayloom.operators import lineage as L
from assayloom.operators import vision as V
from assayloom.plans.registry import query, table
from assayloom.sources.readers import merge_tables, pipe_table


@query("""WITH d AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN '' ELSE (CASE WHEN page_id % 2 = 0 THEN 'DOI/' ELSE 'doi/' END) || (page_id % 40) END AS doi, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'p' || (page_id % 30) END AS pdf, CASE WHEN page_id % 5 = 0 THEN ' T' || page_id ELSE '' END AS title, CASE page_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE 'maybe' END AS access FROM pages),
k AS (SELECT *, lower(CASE WHEN doi <> '' THEN doi ELSE pdf END) AS key FROM d)
SELECT key, coalesce(arg_min(pdf, page_id) FILTER (pdf <> ''), '') AS pdf, arg_min(doi, page_id) AS doi, coalesce(arg_min(trim(title), page_id) FILTER (title <> ''), '') AS title, arg_min(access, page_id) AS access, count(*) AS row_count FROM k WHERE key <> '' GROUP BY key""")
def article_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    d = table(spark, sf_dir, "pages").select("page_id", F.when(k % 6 == 0, "").otherwise(F.concat(F.when(k % 2 == 0, "DOI/").otherwise("doi/"), (k % 40).cast("string"))).alias("doi"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("p"), (k % 30).cast("string"))).alias("pdf"), F.when(k % 5 == 0, F.concat(F.lit(" T"), k.cast("string"))).alias("title"), F.when(k % 3 == 0, "open").when(k % 3 == 1, "False").otherwise("maybe").alias("access"))
    return E.article_references(d, "pdf", "doi", "title", "access", "page_id")


@query("""WITH g AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, l_partkey, l_quantity FROM lineitem)
SELECT l_orderkey || ':records:' || i AS source_id, 'C' || l_partkey AS smiles, printf('%.3f', l_quantity) AS value FROM g""")
def gold_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("smiles"), F.col("l_quantity").cast("string").alias("value"))
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("records"))
    return E.nested_gold(nested, "l_orderkey", "records").select("source_id", "smiles", E.value_text("value").alias("value"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 2, 3) THEN 'pMIC' ELSE 'MIC' END AS property_name,
printf('%.3f', CASE p_partkey % 5 WHEN 0 THEN -log10(p_size * 1e-3) WHEN 1 THEN -log10(p_size * 1e-6) WHEN 2 THEN -log10(p_size * 1e-3 / 250.0) ELSE p_size END) AS value, CASE WHEN p_partkey % 5 = 4 THEN 'mg' ELSE 'pMIC' END AS unit FROM part""")
def mic_to_molar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    unit = F.element_at(F.array(*[F.lit(u) for u in ("mmol/L", "μM", "ug/mL", "", "mg")]), (k + 1).cast("int"))
    prop, value, out = E.gold_value(F.col("p_size").cast("string"), unit, F.when(k == 3, "PMIC").otherwise("MIC"), F.lit(250.0))
    return table(spark, sf_dir, "part").select("p_partkey", prop.alias("property_name"), value.alias("value"), out.alias("unit"))


#: Numbers that land on a half, or beside one, once rounded to three places.
TIES = ["2.6755", "8.3455", "1.2345", "0.5075", "4.0125", "-2.6755", "0.0625", "1234567.0625", "99999.9995", "3"]


@query("SELECT p_partkey, CAST(printf('%.3f', x) AS DOUBLE) AS rounded, printf('%.3f', x) AS fixed, printf('%g', x * 1000) AS short FROM (SELECT p_partkey, CAST(CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TIES)) + " END AS DOUBLE) + p_size AS x FROM part)")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(t) for t in TIES]), (F.col("p_partkey") % 10 + 1).cast("int"))
    d = table(spark, sf_dir, "part").select("p_partkey", (number(said) + F.col("p_size")).alias("x"))
    return d.select("p_partkey", rounded("x", 3).alias("rounded"), fixed("x", 3).alias("fixed"), let(F.col("x") * 1000, short).alias("short"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE CAST(p_size AS DOUBLE) + 0.5 END AS value FROM part")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_size") % 4, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(F.lit(" "), s, F.lit(",5"))).when(k == 1, F.concat(s, F.lit(".5e0"))).when(k == 2, F.concat(F.lit("+"), s, F.lit(".5_0"))).otherwise(F.concat(s, F.lit(".5d")))
    return table(spark, sf_dir, "part").select("p_partkey", number(said).alias("value"))


@query("""WITH c AS (SELECT l_suppkey, l_extendedprice AS area, l_quantity * 4 AS perimeter, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 0.5 END AS s FROM lineitem),
p AS (SELECT l_suppkey, sqrt(4.0 * area / pi()) AS px, sqrt(4.0 * area / pi()) * s AS nm FROM c WHERE area BETWEEN 20 AND 40000 AND perimeter > 0)
SELECT l_suppkey, count(*) AS count, round(avg(nm), 5) AS mean_nm, round(quantile_cont(nm, 0.5), 5) AS median_nm, round(stddev_samp(nm), 5) AS std_nm, round(min(nm), 5) AS min_nm, round(max(nm), 5) AS max_nm, round(avg(px), 5) AS mean_px FROM p GROUP BY l_suppkey""")
def particle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("area"), (F.col("l_quantity") * 4).alias("perimeter"), F.lit(400000.0).alias("image"), F.when(F.col("l_suppkey") % 4 != 0, 0.5).alias("scale"))
    s = V.summarize(V.particles(c, "area", "perimeter", "image", "scale"), ["l_suppkey"])
    r = lambda c, n: F.round(c, 5).alias(n)
    return s.select("l_suppkey", "count", r("mean_diameter_nm", "mean_nm"), r("median_diameter_nm", "median_nm"), r("std_diameter_nm", "std_nm"), r("min_diameter_nm", "min_nm"), r("max_diameter_nm", "max_nm"), r("mean_diameter_px", "mean_px"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size * 1e3 WHEN 2 THEN p_size * 1e6 WHEN 3 THEN p_size * 1e7 WHEN 4 THEN NULL ELSE (p_size + 0.5) * 1e3 END AS nm FROM part")
def scale_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    label = F.when(k == 0, F.concat(s, F.lit(" nm"))).when(k == 1, F.concat(F.lit("bar "), s, F.lit("µm"))).when(k == 2, F.concat(s, F.lit(" Mm"))).when(k == 3, F.concat(s, F.lit("cm"))).when(k == 4, F.lit("scale bar")).otherwise(F.concat(s, F.lit(",5 micrometers")))
    return table(spark, sf_dir, "part").select("p_partkey", V.label_nm(label).alias("nm"))


@query("""WITH b AS (SELECT DISTINCT l_partkey, l_suppkey, l_quantity * 4 AS w, l_linenumber * 2 AS h, l_partkey % 240 AS y FROM lineitem)
SELECT l_partkey, l_suppkey, w, h, y, w >= 20 AND h >= 2 AND h <= 12 AND w / h >= 6 AND y >= 108 AS is_bar, CAST(printf('%.3f', CAST(0.45 AS DOUBLE) * least(1.0, CAST(w AS DOUBLE) / h / 20.0) + CAST(0.35 AS DOUBLE) * least(1.0, greatest(0.0, (CAST(y AS DOUBLE) / 240.0 - 0.45) / 0.45)) + CAST(0.20 AS DOUBLE) * least(1.0, CAST(w AS DOUBLE) / 80.0)) AS DOUBLE) AS confidence FROM b""")
def scalebar_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_quantity") * 4).alias("w"), (F.col("l_linenumber") * 2).alias("h"), (F.col("l_partkey") % 240).alias("y")).distinct()
    box = [F.col("w"), F.col("h"), F.col("y"), F.lit(320), F.lit(240)]
    return b.select("l_partkey", "l_suppkey", "w", "h", "y", V.scale_bar_like(*box).alias("is_bar"), V.scale_bar_confidence(*box).alias("confidence"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'no_scale' WHEN 2 THEN 'no_material' ELSE 'usable' END AS state, CASE s_suppkey % 4 WHEN 1 THEN 'px' ELSE 'nm' END AS unit, CASE s_suppkey % 4 WHEN 1 THEN 7.0 ELSE s_acctbal END AS value FROM supplier WHERE s_suppkey % 4 > 0")
def vision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    s = table(spark, sf_dir, "supplier").select("s_suppkey", k.alias("count"), F.when(k != 1, F.col("s_acctbal")).alias("mean_diameter_nm"), F.lit(7.0).alias("mean_diameter_px"), F.when(k != 2, "Mn3O4").alias("material_formula"))
    return V.nano_rows(s).select("s_suppkey", "state", "unit", "value")


@query("""SELECT c_custkey, CASE WHEN a > greatest(120.0, 0.8 * t) THEN 'plot_or_histogram' WHEN t > 768.0 THEN 'microscopy' ELSE 'unknown' END AS kind FROM (SELECT c_custkey, c_custkey % 997 AS a, (c_custkey * 7) % 1500 AS t FROM customer)""")
def panel_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", V.panel_kind(k % 997, (k * 7) % 1500, F.lit(76800)).alias("kind"))


@query("""WITH s AS (SELECT DISTINCT source AS article_id FROM documents), c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY source)
SELECT s.article_id, coalesce(c.n, 0) AS chunk_count, coalesce(r.n, 0) AS rejected_rows FROM s LEFT JOIN c ON c.source = s.article_id LEFT JOIN r ON r.source = s.article_id""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "article_id")
    return L.manifest(d.select("article_id").distinct(), "article_id", chunk_count=d, rejected_rows=d.where("lang = 'de'"))


@query("""WITH m AS (SELECT source AS article_id, count(*) AS chunks, sum(CASE WHEN lang = 'de' AND doc_id % 7 = 0 THEN 1 ELSE 0 END) AS clean FROM documents GROUP BY source)
SELECT article_id, 0 AS step, 'ParserAgent' AS agent, CASE WHEN chunks > 0 THEN 'completed' ELSE 'warning' END AS status, CAST(chunks AS BIGINT) AS metric FROM m UNION ALL SELECT article_id, 1, 'AggregationAgent', CASE WHEN clean > 0 THEN 'completed' ELSE 'warning' END, CAST(clean AS BIGINT) FROM m""")
def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("article_id")).agg(F.count("*").alias("chunks"), F.sum(((F.col("lang") == "de") & (F.col("doc_id") % 7 == 0)).cast("int")).alias("clean"))
    return L.trace(m, "article_id", [("ParserAgent", "chunks", "parser"), ("AggregationAgent", "clean", "aggregator")]).select("article_id", "step", "agent", "status", "metric")


@query("""SELECT source AS article_id, doc_id AS index, doc_id % 9 = 0 AS selected, CASE WHEN doc_id % 9 = 0 THEN CAST(doc_id / 9 AS INTEGER) END AS retrieval_rank, CASE WHEN doc_id % 9 = 0 THEN 'tfidf' ELSE '' END AS retrieval_method, CAST(length(text) AS INTEGER) AS chars, md5(replace(substr(text, 1, 300), chr(10), ' ')) AS preview_md5 FROM documents""")
def chunk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("article_id"), F.col("doc_id").alias("index"), "text")
    ranked = d.where("index % 9 = 0").select("article_id", "index", (F.col("index") / 9).cast("int").alias("rank"), F.lit(0.5).alias("score"), F.lit("tfidf").alias("retrieval_method"))
    v = L.chunk_view(d, ranked, ["article_id", "index"])
    return v.select("article_id", "index", "selected", "retrieval_rank", "retrieval_method", "chars", F.md5(F.col("preview").cast("binary")).alias("preview_md5"))


@query("SELECT doc_id, substr(replace(text, chr(10), ' '), 1, 180) AS preview, 'k' || doc_id AS source_id FROM documents")
def evidence_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.evidence_preview(F.col("text")).alias("preview"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("source_id"))


@query("SELECT page_id, CASE WHEN f = '' THEN 'article' ELSE f END AS file FROM (SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+', ''), '[._-]+$', ''), 1, 80) AS f FROM pages)")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", L.safe_filename(F.col("url")).alias("file"))


@query("""SELECT doc_id, source AS article_id, source || ':chunk-' || doc_id AS source_id, 'text' AS source_type, md5(substr(text, 1, 1000)) AS evidence_md5 FROM documents""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.with_provenance(table(spark, sf_dir, "documents").withColumn("chunk", F.col("doc_id")), "source", "chunk", F.col("text"))
    return d.select("doc_id", "article_id", "source_id", "source_type", F.md5(F.col("evidence").cast("binary")).alias("evidence_md5"))


@query("SELECT source AS article_id, arg_min(CAST(doc_id AS VARCHAR), doc_id) AS material_id, 'CeO2' AS material_formula FROM documents WHERE doc_id % 3 = 0 GROUP BY source")
def material_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("article_id"), "doc_id", F.col("doc_id").cast("string").alias("material_id"), F.lit("ceria").alias("material_name"), F.when(F.col("doc_id") % 3 == 0, "CeO2").otherwise(" ").alias("material_formula"))
    return L.material_hint(d, "article_id", "doc_id").select("article_id", "material_id", "material_formula")


@query("""SELECT s_suppkey, '## Table 1 (page 2)' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || s_suppkey || ' | x\\|y |' || chr(10) || '| z |  |' AS markdown FROM supplier""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.array(F.lit("a "), F.lit("b")), F.array(F.lit(" "), F.lit("")), F.array(F.col("s_suppkey").cast("string"), F.lit("x|y")), F.array(F.lit("z")))
    tables = F.array(F.struct(F.lit(1).alias("index"), F.lit(2).alias("page"), pipe_table(cells).alias("markdown")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", merge_tables(F.lit(" \n"), tables).alias("markdown"))
