"""Tokens, TF-IDF, embeddings, ranking and routing over documents grouped by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators import lineage as L
from assayloom.operators import retrieval as R
from assayloom.plans.registry import query, table

ASKED = "the of and der que les con table size nm activity"
_MATCH = "regexp_extract_all(lower(text), '[a-z0-9][a-z0-9./%-]*')"


@query(f"SELECT doc_id, CAST(len({_MATCH}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({_MATCH})) AS INTEGER) AS n_distinct FROM documents")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


_ASKED = "[" + ", ".join(f"'{t}'" for t in ASKED.split()) + "]"


@query(f"SELECT doc_id, array_to_string(list_slice(list_filter({_ASKED}, lambda q: list_contains({_MATCH}, q)), 1, 8), ' ') AS matched FROM documents")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(R.matched_terms(F.lit(ASKED), F.col("text")), " ").alias("matched"))


@query(f"SELECT doc_id, round(len(list_filter({_ASKED}, lambda q: list_contains({_MATCH}, q))) / {len(ASKED.split())}.0, 6) AS overlap FROM documents")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(R.keyword_overlap(F.lit(ASKED), F.col("text")), 6).alias("overlap"))


def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the chunks of their source, whatever their language; null sources are one, ""."""
    d = table(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 5 == 0, "Results").when(F.col("doc_id") % 5 == 1, "Materials and Methods").otherwise("Conclusion")
    return d.select(F.coalesce("source", F.lit("")).alias("article_id"), F.col("doc_id").alias("index"), title.alias("section_title"), "text")


_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


def _gram_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{_WORD}][{_WORD}./%-]*[{_WORD}]')"


_TFIDF = f"""WITH d AS (SELECT coalesce(source, '') AS a, doc_id AS i, text, {_gram_tokens("text")} AS t FROM documents),
qt AS (SELECT {_gram_tokens(f"'{ASKED}'")} AS t),
g AS (SELECT a, i, unnest(list_concat(t, list_transform(range(1, len(t)), lambda j: t[j] || ' ' || t[j + 1]))) AS term FROM d),
tf AS (SELECT a, i, term, count(*) AS tf FROM g GROUP BY ALL),
q AS (SELECT term, count(*) AS qf FROM (SELECT unnest(list_concat(t, list_transform(range(1, len(t)), lambda j: t[j] || ' ' || t[j + 1]))) AS term FROM qt) GROUP BY term),
n AS (SELECT a, count(*) AS n FROM d GROUP BY a),
df AS (SELECT a, term, count(*) AS df FROM tf GROUP BY ALL),
qa AS (SELECT n.a, q.term, q.qf FROM n, q),
w AS (SELECT coalesce(df.a, qa.a) AS a, coalesce(df.term, qa.term) AS term, qf, coalesce(df, 0) + CASE WHEN qf IS NULL THEN 0 ELSE 1 END AS df FROM df FULL OUTER JOIN qa ON df.a = qa.a AND df.term = qa.term),
wi AS (SELECT w.*, ln((2.0 + n.n) / (1.0 + df)) + 1 AS idf FROM w JOIN n USING (a)),
qn AS (SELECT a, sqrt(sum(pow(qf * idf, 2))) AS qn FROM wi WHERE qf IS NOT NULL GROUP BY a),
c AS (SELECT tf.a, tf.i, sqrt(sum(pow(tf * idf, 2))) AS cn, sum(coalesce(qf, 0) * tf * idf * idf) AS dot FROM tf JOIN wi ON tf.a = wi.a AND tf.term = wi.term GROUP BY tf.a, tf.i),
s AS (SELECT d.a, d.i, d.text, coalesce(dot / (cn * qn), 0) AS tfidf FROM d LEFT JOIN c ON d.a = c.a AND d.i = c.i LEFT JOIN qn ON d.a = qn.a)
"""


@query(_TFIDF + "SELECT a AS article_id, i AS index, round(tfidf, 6) AS tfidf FROM s")
def tfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.tfidf_scores(source_chunks(spark, sf_dir), F.lit(ASKED))
    return s.select("article_id", "index", F.round("tfidf", 6).alias("tfidf"))


@query(_TFIDF + f""", m AS (SELECT a, i, tfidf, len(list_slice(list_filter({_ASKED}, lambda q: list_contains({_MATCH}, q)), 1, 8)) AS k, CASE i % 5 WHEN 0 THEN 0.08 WHEN 1 THEN 0.02 ELSE 0 END AS bonus FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(tfidf, 9) + bonus + least(0.10, 0.01 * k) DESC, i) AS rn FROM m)
SELECT a AS article_id, i AS index, CAST(rn AS INTEGER) AS rank, round(tfidf + bonus + least(0.10, 0.01 * k), 6) AS score FROM r WHERE rn <= 3""")
def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_chunks(source_chunks(spark, sf_dir), F.lit(ASKED), 3).select("article_id", "index", "rank", "score")


_ZERO = "(SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_ZERO}), 5) AS cosine FROM embeddings")
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    zero = e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(zero)).select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))


@query(f"""WITH c AS (SELECT vec_id, label, (vec_id % 100) / 100.0 AS t, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_ZERO}) AS e FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(0.35 * t + 0.65 * e, 9) DESC, vec_id) AS rn FROM c)
SELECT label, vec_id, CAST(rn AS INTEGER) AS rank, round(0.35 * t + 0.65 * e, 5) AS score FROM r WHERE rn <= 5""")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    zero = e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))
    s = e.join(F.broadcast(zero)).select("label", "vec_id", R.blended((F.col("vec_id") % 100) / 100.0, R.cosine(F.col("embedding"), F.col("q"))).alias("s"))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("s", 9)), "vec_id"))).where("rank <= 5")
    return s.select("label", "vec_id", "rank", F.round("s", 5).alias("score"))


_HITS = " + ".join(f"CAST(contains(lower(x), '{h}') AS INTEGER)" for h in L.NANO_HINTS)


@query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Nanozymes' WHEN 1 THEN 'Oxazolidinones' ELSE 'Benzimidazoles' END AS domain, CASE doc_id % 3 WHEN 0 THEN text || ' Mn3O4 nanoparticles with Vmax' WHEN 1 THEN text || ' km of 5 nm wide' ELSE text END AS x FROM documents),
h AS (SELECT *, {_HITS} AS hits FROM d)
SELECT doc_id, CAST(hits AS INTEGER) AS hits, CASE WHEN domain <> 'Nanozymes' AND (hits >= 2 OR (hits >= 1 AND (contains(lower(x), ' nm') OR contains(lower(x), 'nm ')))) THEN 'Nanozymes' ELSE domain END AS effective FROM h""")
def domain_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    domain = F.when(k % 4 == 0, "Nanozymes").when(k % 4 == 1, "Oxazolidinones").otherwise("Benzimidazoles")
    x = F.when(k % 3 == 0, F.concat("text", F.lit(" Mn3O4 nanoparticles with Vmax"))).when(k % 3 == 1, F.concat("text", F.lit(" km of 5 nm wide"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", L.nano_hits(x).alias("hits"), L.effective_domain(domain, x).alias("effective"))


@query("""SELECT doc_id, CAST(CASE doc_id %% 3 WHEN 0 THEN 0.08 WHEN 1 THEN 0.03 ELSE 0.0 END AS DOUBLE) AS bonus, len(CASE doc_id %% 3 WHEN 0 THEN '%s' WHEN 1 THEN '%s' ELSE '%s' END) AS query_chars FROM documents""" % (R.DOMAIN_TERMS["nanozymes"], R.DOMAIN_TERMS["oxazolidinones"], R.DEFAULT_TERMS))
def domain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    domain = F.when(k == 0, " Nano-Zymes").when(k == 1, "OXAZOLIDINONES").otherwise("other")
    title = F.when(k == 0, "3. Results and Discussion").when(k == 1, "Experimental Section").otherwise("Summary")
    return table(spark, sf_dir, "documents").select("doc_id", R.section_bonus(title).alias("bonus"), F.length(R.query_of(domain)).cast("long").alias("query_chars"))
