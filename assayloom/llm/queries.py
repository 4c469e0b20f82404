"""The training-data queries by name, each over its whole table, and DuckDB SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm.common import table
from assayloom.llm.decontam import leaks
from assayloom.llm.mixing import mix, token_count
from assayloom.llm.near_dup import near_duplicates
from assayloom.llm.pii import span_digests
from assayloom.llm.quality_classifier import quality_scores
from assayloom.llm.quality_rules import fit_forest, quality_rules
from assayloom.llm.sharding import shard_places
from assayloom.llm.tokens import token_files
from assayloom.llm.toxicity import toxicity_scores
from assayloom.llm.warc import warc_round_trip


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the machine's public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_places(table(spark, sf_dir, "documents"), n_shards=16)


def op2_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_patched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=0)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, num=80, den=100)


def op5_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_forest(docs, table(spark, sf_dir, "labels")))


def op6_bootstrapped_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(table(spark, sf_dir, "documents"))


#: Shares of the mixture by level; sources share by their tokens.
MIX_WEIGHTS = {"domain": {"web": 0.6, "curated": 0.4}, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}}


def mix_domain() -> Column:
    """Sources of one digit are web crawls here, the others curated."""
    return F.when(F.col("source").rlike("^src[0-9]$"), "web").otherwise("curated")


def op7_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, domain=mix_domain())
    return mixed.select("doc_id", mix_domain().alias("domain"), "lang", "source", token_count().alias("n_tokens"), "mix_epoch")


def op9_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=3, kept_back=1)


def op10_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=5, kept_back=0)


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_virtual_slots": op1_virtual_slots,
    "op2_simhash_windows": op2_simhash_windows,
    "op3_patched_frames": op3_patched_frames,
    "op4_minhash": op4_minhash,
    "op5_isolation_forest": op5_isolation_forest,
    "op6_bootstrapped_context": op6_bootstrapped_context,
    "op7_hierarchical_mix": op7_hierarchical_mix,
    "op8_warc_index": op8_warc_index,
    "op9_quadratic_discriminant": op9_quadratic_discriminant,
    "op10_counterfactual": op10_counterfactual,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs by shared shingles, then the transitive closure of the links.
_OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k) UNION ALL SELECT b, a FROM p WHERE 100 * k >= 80 * (na + nb - k)),
c AS (SELECT DISTINCT a AS node, a AS seen FROM l UNION SELECT c.node, l.b FROM c JOIN l ON c.seen = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, coalesce(m.root, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN (SELECT node, min(seen) AS root FROM c GROUP BY node) m ON m.node = s.doc_id"""

#: Base 32 is 5 bits a letter: 5 hex digits of the SHA-1 are 4 letters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))
_OP8 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f"""


def _op7() -> str:
    """The budget tree level by level, then the epochs and the prefix of the last.

    With a parent's children in the order of capacity over weight, what is left after those before a child, over
    the weights from it on, is largest where the budget is used up: that is the level that all others get by weight.
    """
    parts = ["d AS (SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'curated' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0, CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT) AS n FROM documents)"]
    parts.append("leaves AS (SELECT domain, lang, source, sum(n) AS tokens FROM d GROUP BY ALL)")
    levels = ["domain", "lang", "source"]
    for depth in range(1, 4):
        own, parent = ", ".join(levels[:depth]), ", ".join(levels[: depth - 1])
        named = MIX_WEIGHTS.get(levels[depth - 1])
        weight = "CASE " + " ".join(f"WHEN {levels[depth - 1]} = '{k}' THEN {float(v)}" for k, v in named.items()) + " ELSE 1.0 END" if named else "CAST(sum(tokens) AS DOUBLE)"
        budget = "sum(CAST(tokens AS DOUBLE)) OVER ()" if depth == 1 else "b.budget"
        join = "" if depth == 1 else f" JOIN (SELECT {parent}, budget FROM b{depth - 1}) b USING ({parent})"
        parts.append(f"n{depth} AS (SELECT {own}, CAST(sum(tokens) AS DOUBLE) * 2.0 AS capacity, sum(tokens) AS tokens, CAST({weight} AS DOUBLE) AS weight FROM leaves GROUP BY {own})")
        parts.append(f"s{depth} AS (SELECT {own}, capacity, tokens, weight, {budget} AS budget FROM n{depth}{join})")
        within = f"PARTITION BY {parent} " if parent else ""
        order = f"{within}ORDER BY capacity / nullif(weight, 0) NULLS LAST, {own}"
        parts.append(f"t{depth} AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS reach FROM s{depth})")
        parts.append(f"l{depth} AS (SELECT *, weight * coalesce(max(reach) OVER ({within}), 0) AS want FROM t{depth})")
        parts.append(f"b{depth} AS (SELECT {own}, tokens, CASE WHEN weight > 0 AND want >= capacity * (1 - 1e-12) THEN capacity ELSE want END AS budget FROM l{depth})")
    parts.append("w AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(budget / tokens * (1 + 1e-12)) AS BIGINT) ELSE 1 END AS whole FROM b3)")
    parts.append("k AS (SELECT d.*, whole, greatest(budget - whole * tokens, 0) AS rest, CAST('0x' || substr(md5('7:' || whole || ':' || doc_id), 1, 15) AS BIGINT) AS key FROM d JOIN w USING (domain, lang, source))")
    parts.append("r AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS run FROM k)")
    return "WITH " + ", ".join(parts) + " SELECT doc_id, domain, lang0 AS lang, source0 AS source, n AS n_tokens, CAST(e AS INTEGER) AS mix_epoch FROM r, range(0, 5) AS t(e) WHERE e < whole + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END"


SQL: dict[str, str] = {"op4_minhash": _OP4, "op7_hierarchical_mix": _op7(), "op8_warc_index": _OP8}
