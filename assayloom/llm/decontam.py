"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

DataFrame and SQL functions only. The steps:

1. A window can only pass the last step if it shares a five-word shingle with an item. Shingles of all
   documents are looked up among the items' shingles; a hit places a window of the item's size where the
   item would start. Nothing that could pass is left out, and most text makes no window.
2. Every window and every item gets a 64-bit SimHash of its words.
3. Fingerprints are cut into four blocks of 16 bits. Two within ``radius`` differ in at most
   ``radius // 4`` bits of some block, so items are entered under every block value that near, windows
   look up their own four, and no pair within the radius is missed. A window meets items of its own size.
4. Pairs within the radius are kept if the weighted Jaccard similarity of their shingle multisets
   (shared occurrences over all occurrences) is at least ``least``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import stored

BLOCKS, BLOCK_BITS = 4, 16
#: Item shingles that are broadcast at most; more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles_of(words: Column, k: int) -> Column:
    """64-bit hashes of the runs of ``k`` words, in order; none where there are fewer."""
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), at)).otherwise(F.array().cast("array<bigint>"))


def simhash(words: Column) -> Column:
    """64-bit SimHash, every occurrence of a word counting once."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    bit = lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int")) * 2 > F.size(words)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda s, b: F.when(bit(b), s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))).otherwise(s))


def block_value(fingerprint: Column, block: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, (block * BLOCK_BITS).cast("int")).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def near_masks(bits: int) -> list[int]:
    """All 16-bit masks of at most ``bits`` ones."""
    return [sum(1 << i for i in c) for n in range(bits + 1) for c in combinations(range(BLOCK_BITS), n)]


def shared_weight(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets given as arrays."""
    n = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(n(a, x), n(b, x)))


def leaks(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, least: float = 0.8, radius: int = 15, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id, start, n_words, hamming, similarity): documents' best windows on each item they leak.

    ``start`` counts words from 0. Items of fewer than ``shingle_words`` words are one shingle. Items and
    documents without words match nothing; rows with null ids are carried with null ids. Rows that
    share an id and a text are reported once.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text)).alias("iw")).where(F.size("iw") > 0)
    items = items.withColumn("k", F.least(F.lit(shingle_words), F.size("iw")))
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # at most shingle_words numbers
    if not sizes:
        return docs.limit(0).select(id_col, F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0).alias("hamming"), F.lit(0.0).alias("similarity"))
    by_size = F.lit(None).cast("array<bigint>")
    for k in sizes:
        by_size = F.when(F.col("k") == k, shingles_of(F.col("iw"), k)).otherwise(by_size)
    items = stored(items.withColumn("ish", by_size).withColumn("ifp", simhash(F.col("iw"))).withColumn("size", F.size("iw")), "items")

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    spots = stored(items.select("k", F.posexplode("ish").alias("at", "sh"), "size").distinct(), "item-shingles")
    placed = F.broadcast(spots) if spots.count() <= BROADCAST_SHINGLES else spots
    worded = rows.select("id", "h", words_of(F.col("t")).alias("w"))
    found = None
    for k in sizes:
        hits = worded.select("id", "h", F.posexplode(shingles_of(F.col("w"), k)).alias("pos", "sh")).join(placed.where(F.col("k") == k).drop("k"), "sh")
        hits = hits.select("id", "h", F.greatest(F.col("pos") - F.col("at"), F.lit(0)).alias("start"), "size", F.lit(k).alias("k"))
        found = hits if found is None else found.union(hits)
    windows = stored(found.distinct(), "windows")

    # the windows' words, read again from the few documents that have any
    same = F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.h") == F.col("y.h"))
    cut = rows.alias("x").join(windows.groupBy("id", "h").agg(F.collect_set(F.struct("start", "size", "k")).alias("at")).alias("y"), same)
    cut = cut.select("x.id", "x.h", words_of(F.col("x.t")).alias("w"), "at")
    cut = cut.select("id", "h", F.explode(F.transform("at", lambda a: F.struct(a["start"].alias("start"), a["k"].alias("k"), a["size"].alias("size"), F.slice("w", a["start"] + 1, a["size"]).alias("ww")))).alias("a"))
    cut = cut.select("id", "h", "a.start", "a.k", "a.size", "a.ww")
    own = F.lit(None).cast("array<bigint>")
    for k in sizes:
        own = F.when(F.col("k") == k, shingles_of(F.col("ww"), k)).otherwise(own)
    cut = stored(cut.withColumn("wsh", own).withColumn("n_words", F.size("ww")).withColumn("wfp", simhash(F.col("ww"))).drop("ww"), "fingerprints")

    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    masks = F.array(*[F.lit(m) for m in near_masks(radius // BLOCKS)])
    entered = items.select("item_id", "k", "size", "ifp", blocks.alias("block")).select("item_id", "k", "size", "ifp", "block", F.explode(masks).alias("mask"))
    entered = entered.select("item_id", "k", "size", "ifp", "block", block_value(F.col("ifp"), F.col("block")).bitwiseXOR(F.col("mask")).alias("value"))
    looked = cut.select("id", "h", "start", "k", "size", "n_words", "wfp", blocks.alias("block")).withColumn("value", block_value(F.col("wfp"), F.col("block")))
    near = looked.join(entered, ["block", "value", "k", "size"]).withColumn("hamming", F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp")))).where(F.col("hamming") <= radius)
    near = near.select("id", "h", "start", "k", "size", "n_words", "item_id", "hamming").distinct()
    both = near.alias("p").join(cut.select("id", "h", "start", "k", "size", "wsh").alias("q"), F.col("p.id").eqNullSafe(F.col("q.id")) & (F.col("p.h") == F.col("q.h")) & (F.col("p.start") == F.col("q.start")) & (F.col("p.k") == F.col("q.k")) & (F.col("p.size") == F.col("q.size")))
    both = both.select("p.*", "q.wsh").alias("p").join(items.select("item_id", "ish").alias("i"), F.col("p.item_id").eqNullSafe(F.col("i.item_id"))).select("p.*", "i.ish").where(F.arrays_overlap("wsh", "ish"))
    both = both.withColumn("shared", shared_weight(F.col("wsh"), F.col("ish"))).withColumn("similarity", F.col("shared") / (F.size("wsh") + F.size("ish") - F.col("shared")))
    passed = both.where(F.col("similarity") >= least)
    best = passed.groupBy("id", "h", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "hamming", "start", "n_words")).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", "b.start", "b.n_words", "b.hamming", (-F.col("b.s")).alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that leak no item; rows with a null id stay unless one of them leaks."""
    bad = stored(leaks(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias("__leak_id")).distinct(), "leaks")
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__leak_id")), "left_anti")
