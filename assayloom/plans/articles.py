"""Cleaning, sectioning and chunking over documents dressed as articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.exprs import letters_key, strip
from assayloom.operators import chunk as C
from assayloom.operators import text as T
from assayloom.plans.registry import query, table

#: A document's text as an article with headings, page lines and closing matter.
_ARTICLE = ["# Introduction\n", "{t}", "\n12\nDownloaded from example.org\n3 of 14\n\n\n\nResults and Discussion  \n", "{t}", "\nJournal of Looms\nJournal of Looms\n journal of  looms\nDOI: 10.1/x\n2. Conclusion\nDone.\n", "References\n[1] none\n"]


def article(t):
    return F.concat(*[t if p == "{t}" else F.lit(p) for p in _ARTICLE])


_SQL_ARTICLE = " || ".join("text" if p == "{t}" else "'" + p.replace("\n", "' || chr(10) || '") + "'" for p in _ARTICLE)
_NL = "chr(10)"


@query(f"""WITH a AS (SELECT doc_id, {_SQL_ARTICLE} AS x FROM documents),
c AS (SELECT doc_id, substr(x, 1, instr(x, {_NL} || 'References') - 1) AS x FROM a)
SELECT doc_id, CAST(length(rtrim(x, ' ' || chr(9) || chr(10))) AS INTEGER) AS n_chars, md5(rtrim(x, ' ' || chr(9) || chr(10))) AS digest FROM c""")
def trailing_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.cut_trailing(article(F.col("text"))).alias("x"))
    return d.select("doc_id", F.length("x").alias("n_chars"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query(f"""WITH a AS (SELECT doc_id, string_split({_SQL_ARTICLE}, {_NL}) AS lines FROM documents),
k AS (SELECT doc_id, l AS line, lower(regexp_replace(trim(l, ' ' || chr(9)), '[ \\t]+', ' ', 'g')) AS key FROM a, unnest(lines) AS u(l))
SELECT doc_id, key, count(*) AS n FROM k WHERE key <> '' AND length(trim(line)) <= 120 AND NOT starts_with(key, '|') AND regexp_matches(key, 'downloaded|copyright|all rights reserved|doi:|journal|volume|vol\\.|issue|www\\.|http://|https://') GROUP BY doc_id, key HAVING count(*) >= 3""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(article(F.col("text")), "\n", -1)).alias("line"))
    keyed = lines.where(T.header_like(F.col("line"))).select("doc_id", T.line_key(F.col("line")).alias("key"))
    return keyed.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n >= 3")


@query(rf"""WITH a AS (SELECT doc_id, {_SQL_ARTICLE} AS x FROM documents),
c AS (SELECT doc_id, substr(x, 1, instr(x, {_NL} || 'References') - 1) AS x FROM a),
l AS (SELECT doc_id, list_filter(string_split(x, {_NL}), lambda y: NOT regexp_matches(lower(trim(y)), '^(downloaded from .+|(https?://|www\.).+|doi:\s*10\.\S+|(copyright|©).+|all rights reserved\.?)$') AND lower(regexp_replace(trim(y), ' +', ' ', 'g')) <> 'journal of looms' AND NOT regexp_matches(y, '^[ \\t]*(?:[Pp]age ?)?[0-9]{{1,4}}[ \\t]*(?:of [0-9]{{1,4}})?[ \\t]*$')) AS lines FROM c)
SELECT doc_id, CAST(len(list_filter(lines, lambda y: trim(y) <> '')) AS INTEGER) AS n_lines, md5(array_to_string(list_transform(list_filter(lines, lambda y: trim(y) <> ''), lambda y: rtrim(y, ' ' || chr(9))), '|')) AS digest FROM l""")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", article(F.col("text")).alias("markdown"))
    full = F.filter(F.split("markdown", "\n"), lambda y: F.trim(y) != "")
    return T.clean_markdown(d).select("doc_id", F.size(full).alias("n_lines"), F.md5(F.array_join(full, "|").cast("binary")).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS value_ug_ml, CASE WHEN l_linenumber = 1 THEN l_quantity + 5 END AS upper_value_ug_ml,
CASE l_linenumber WHEN 2 THEN '<=' WHEN 3 THEN '~' ELSE NULL END AS relation, round(-log10(l_quantity * 1e-3 / 250.0), 6) AS pmic, CASE WHEN l_linenumber IN (2, 3) THEN 8 ELSE 7 END AS start_char FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)""")
def conc_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    q = F.col("l_quantity").cast("int").cast("string")
    upper = F.concat(q, F.lit("–"), (F.col("l_quantity") + 5).cast("int").cast("string"))
    said = F.when(F.col("l_linenumber") == 1, upper).when(F.col("l_linenumber") == 2, F.concat(F.lit("<="), q)).when(F.col("l_linenumber") == 3, F.concat(F.lit("ca. "), q)).otherwise(q)
    d = d.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"), F.concat(F.lit("MIC was "), said, F.lit(" µg/mL against it")).alias("t"))
    m = T.mentions(d, "k", "t", F.lit(250.0))
    return m.select("k.*", "value_ug_ml", "upper_value_ug_ml", "relation", F.round("pmic", 6).alias("pmic"), "start_char")


@query("SELECT p_partkey, round(-log10(p_retailprice * 1e-3 / (100.0 + p_size)), 6) AS pmic FROM part")
def pmic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.pmic(F.col("p_retailprice"), F.lit(100.0) + F.col("p_size")), 6).alias("pmic"))


_SECTIONS = f"""WITH a AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest([struct_pack(n := 0, title := 'Abstract', body := t), struct_pack(n := 1, title := 'Materials and Methods', body := 'Mixed.' || {_NL} || t), struct_pack(n := 2, title := 'Results', body := t), struct_pack(n := 3, title := 'Appendix', body := 'None.')]) AS x FROM a)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY x.n) - 1 AS INTEGER) AS section, x.title AS title, CAST(length(trim(x.body, ' ' || chr(9) || chr(10))) AS INTEGER) AS n_chars, md5(trim(x.body, ' ' || chr(9) || chr(10))) AS digest FROM s WHERE trim(x.body, ' ' || chr(9) || chr(10)) <> ''"""


def sectioned(t):
    return F.concat(F.lit("Abstract\n"), t, F.lit("\n## Materials and Methods\nMixed.\n"), t, F.lit("\n3.1. Results\n"), t, F.lit("\nAppendix\nNone.\n"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(C.sections_of(sectioned(F.col("text")))).alias("section", "s"))


@query(_SECTIONS)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("doc_id", "section", F.col("s.title").alias("title"), F.length("s.body").alias("n_chars"), F.md5(F.col("s.body").cast("binary")).alias("digest"))


@query(f"SELECT title, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM ({_SECTIONS}) WHERE title IN ('Materials and Methods', 'Results') GROUP BY title")
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir).where(C.selected(F.col("s.title"), C.TARGETS))
    return s.groupBy(F.col("s.title").alias("title")).agg(F.count("*").alias("n"), F.sum(F.length("s.body")).alias("chars"))


_RFIND = "CASE WHEN instr(reverse(w), reverse('{s}')) = 0 THEN -1 ELSE length(w) - instr(reverse(w), reverse('{s}')) + 1 - length('{s}') END"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, '## Document' || {_NL} || {_NL} || trim(text, ' ' || chr(9) || chr(10)) AS t FROM documents WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''),
c AS (SELECT doc_id, 0 AS start, CAST(0 AS BIGINT) AS stop, 0 AS step FROM d
  UNION ALL
  SELECT doc_id, CAST(nxt AS INTEGER), stop2, step + 1 FROM (
    SELECT doc_id, step, nxt, CASE WHEN hard >= length(t) THEN length(t) WHEN bl >= half THEN nxt + bl + 2 WHEN se >= half THEN nxt + se + 2 WHEN sc >= half THEN nxt + sc + 2 WHEN li >= half THEN nxt + li + 1 ELSE hard END AS stop2 FROM (
      SELECT doc_id, step, nxt, t, hard, floor((hard - nxt) * 0.5) AS half,
        CASE WHEN instr(reverse(w), {_NL} || {_NL}) = 0 THEN -1 ELSE length(w) - instr(reverse(w), {_NL} || {_NL}) - 1 END AS bl, {_RFIND.format(s=". ")} AS se, {_RFIND.format(s="; ")} AS sc, CASE WHEN instr(reverse(w), {_NL}) = 0 THEN -1 ELSE length(w) - instr(reverse(w), {_NL}) END AS li FROM (
        SELECT doc_id, step, nxt, t, least(nxt + 1500, length(t)) AS hard, substr(t, CAST(nxt AS BIGINT) + 1, CAST(least(nxt + 1500, length(t)) - nxt AS BIGINT)) AS w FROM (
          SELECT c.doc_id, c.step, d.t, CASE WHEN c.step = 0 THEN 0 WHEN c.stop - 200 > c.start THEN c.stop - 200 ELSE c.stop END AS nxt FROM c JOIN d USING (doc_id) WHERE c.step = 0 OR c.stop < length(d.t))))))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS index, start AS start_char, CAST(stop AS INTEGER) AS end_char, md5(trim(substr(t, start + 1, CAST(stop - start AS BIGINT)), ' ' || chr(9) || chr(10))) AS digest
FROM c JOIN d USING (doc_id) WHERE step > 0 AND trim(substr(t, start + 1, CAST(stop - start AS BIGINT)), ' ' || chr(9) || chr(10)) <> ''""")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.chunk_articles(table(spark, sf_dir, "documents"), "doc_id", "text", max_chars=1500, overlap=200)
    return c.select("doc_id", "index", "start_char", "end_char", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT url, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS title_key, CAST(length(trim(html)) AS INTEGER) AS n_chars FROM pages")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", letters_key("url").alias("title_key"), F.length(strip("html")).alias("n_chars"))
