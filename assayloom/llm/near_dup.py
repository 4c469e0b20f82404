"""MinHash near-duplicate detection: banding, signature check, exact check, star-contraction components.

The plan, for N documents:

1. One Arrow pass makes a sketch per document: set size, 128-bit digest of its shingle set and the
   MinHash signature (universal hashes ``a * x + b`` modulo 2**64, 16 bits kept of each minimum).
2. Equal sets are one class (partial aggregation, so a huge group of copies is summed up before the
   shuffle); only one representative of each goes on.
3. Every band of the signature is a bucket. Within buckets, signatures that agree well enough link
   roughly; the components of rough links are clusters that no true link leaves.
4. Only for documents of clusters of two or more, shingle sets are made again from the texts. Within
   clusters, sets are compared exactly; these links give the components.

Steps 3 and 4 are one routine (``linked``). Its groups are dealt in chunks of bounded size. A task joins
what it links, compares only what is not joined yet, and sends a spanning forest, so a group of n near
copies makes under n links, not n * n. Members outside a group's largest component then meet the chunks
they have not met: no pair that could change a component is left out. Components come from
alternating large-star and small-star rounds, each written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import batches, groups, hash_words, lean_batches, rolling, stored, utf8, workspace

BANDS, ROWS = 40, 5
#: Ids of clustered or of left-out documents that are broadcast at most, 16 bytes each.
BROADCAST_IDS = 2_000_000
Keep = Callable[[DataFrame, str], DataFrame]


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of an ASCII-lower-cased text; empty without words."""
    h = hash_words(text.lower()) if text else np.empty(0, np.uint64)
    return np.unique(rolling(h, k))


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**64, n, dtype=np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of each universal hash's minimum over the set."""
    low = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(s), 1024):
        t = a[:, None] * s[None, at : at + 1024]
        t += b[:, None]
        np.minimum(low, t.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u2")


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(id, n, digest, sig); digest and sig are null where the set is empty."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(bands * rows, seed)
        for batch in batches(it, 200):
            n, digest, sig = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "digest", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).mapInArrow(run, "id long, n long, digest binary, sig binary")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, p): the shingle set of each document in ``ids``, made from its whole text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 100):
            out = [shingle_set(t, k).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "p"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).join(ids, "id", "left_semi")
    return texts.mapInArrow(run, "node long, p binary")


class _Joined:
    """Union-find over positions 0 to n - 1 that start in given components."""

    def __init__(self, comps: list[int]):
        self.comps = np.array(comps, np.int64)
        self.start, self.label = np.unique(self.comps, return_inverse=True)
        self.least = self.start.copy()

    def join(self, i: int, others: np.ndarray) -> None:
        """Join the components of ``others`` with that of ``i``."""
        labels = np.unique(self.label[others])
        into = self.label[i]
        self.least[into] = min(self.least[into], self.least[labels].min(initial=self.least[into]))
        self.label[np.isin(self.label, labels)] = into

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(component, smallest component it has been joined with), for those that have changed."""
        least = self.least[self.label]
        moved = np.unique(np.column_stack([self.comps, least])[self.comps != least], axis=0)
        return moved[:, 0], moved[:, 1]


def _agree(payload: list[bytes], least: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Among positions, those whose signature agrees with position i's in ``least`` of the places."""
    sig = np.frombuffer(b"".join(payload), "<u2").reshape(len(payload), -1)
    return lambda i, others: others[(sig[others] == sig[i]).mean(axis=1) >= least]


def _alike(payload: list[bytes], num: int, den: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Among positions, those whose set has ``den * intersection >= num * union`` with position i's."""
    sets = [np.frombuffer(p, np.uint64) for p in payload]
    size = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner, every = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order], every[order]
    del order

    def near(i: int, others: np.ndarray) -> np.ndarray:
        fit = others[den * np.minimum(size[others], size[i]) >= num * np.maximum(size[others], size[i])]
        if not len(fit):
            return fit
        if len(fit) <= 3:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in fit])
        else:
            lo, hi = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(sets))[fit]
        return fit[den * common >= num * (size[fit] + size[i] - common)]

    return near


def _link_task(compare: str, limits: tuple, keys: int, across: bool) -> Callable:
    """Joined components within each group of rows (keys..., side, node, comp, payload); ``across``: between sides only."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, node, comp, payload in (g[keys:] for g in groups(it, keys)):
            order = sorted(range(len(node)), key=lambda k: (side[k], node[k]))
            side, comp, payload = ([c[k] for k in order] for c in (side, comp, payload))
            joined, n = _Joined(comp), len(order)
            n_left = side.count(0) if across else n
            if n_left == 0 or len(joined.start) < 2:
                continue
            near = _agree(payload, *limits) if compare == "sig" else _alike(payload, *limits)
            for i in range(n_left):
                others = np.arange(n_left if across else i + 1, n)
                others = others[joined.label[others] != joined.label[i]]
                if len(others) and len(hits := near(i, others)):
                    joined.join(i, hits)
            a, b = joined.stars()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def linked(members: DataFrame, payload: DataFrame, compare: str, limits: tuple, chunk: int, name: str, keep: Keep = stored) -> DataFrame:
    """(node, root): how components merge by what ``compare`` finds alike within groups; those that don't are absent.

    ``members``: (g, node, comp, size), comp being a component's smallest node and size the group's, in units
    of which a task takes some ``chunk``. ``payload``: (node, p).
    """
    cut = F.ceil(F.col("size") / chunk).cast("int")
    rows = members.withColumn("chunks", cut).withColumn("own", F.pmod(F.xxhash64("node", "g"), F.col("chunks")).cast("int"))
    whole = rows.join(payload, "node").select("g", "own", F.lit(0).alias("side"), "node", "comp", "p")
    whole = whole.repartition("g", "own").sortWithinPartitions("g", "own")
    merged = connected_components(whole.mapInArrow(_link_task(compare, limits, 2, False), "a long, b long"), name, keep)
    large = rows.where("chunks > 1")
    if large.limit(1).count() == 0:
        return merged
    large = large.join(merged.select(F.col("node").alias("comp"), "root"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
    large = keep(large, f"{name}-large")
    parts = large.groupBy("g", "comp").agg(F.count("*").alias("n"))
    main = parts.groupBy("g").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("k"), F.sum("n").alias("all")).where("k > 1")
    main = main.select("g", F.col("m.comp").alias("main"), F.col("m.n").alias("n_main"), F.col("all"))
    # the chunks are as wide as the group's were, by its mean size of a member
    lefts = F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("n_main")) * F.col("size") / F.col("all") / chunk)).cast("int")
    large = large.join(main, "g").withColumn("lefts", lefts)
    left = large.where("comp <> main").select("g", F.pmod(F.xxhash64("node"), "lefts").cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("r"), F.lit(0).alias("side"), "node", "comp")
    right = large.select("g", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"), F.col("own").alias("r"), F.lit(1).alias("side"), "node", "comp")
    pairs = left.union(right).join(payload, "node").select("g", "l", "r", "side", "node", "comp", "p").repartition("g", "l", "r").sortWithinPartitions("g", "l", "r")
    return composed(merged, connected_components(pairs.mapInArrow(_link_task(compare, limits, 3, True), "a long, b long"), f"{name}-across", keep))


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """(node, root) of two mergers, the second over the roots of the first.

    A left join, in which a root of very many nodes can be split, and the second's nodes that the first has not.
    """
    later = then.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
    moved = first.join(later, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root"))
    return moved.union(then.join(first.select("node"), "node", "left_anti").select("node", "root"))


def rough_clusters(members: DataFrame, sigs: DataFrame, least: float, chunk: int, first_bands: int, keep: Keep = stored) -> DataFrame:
    """(node, root): the components of what signatures link within buckets.

    The first bands join most of a group of near copies; of the others only buckets that still hold
    several components are looked at, so a group of n gives some n links, not n for every band.
    """
    one = members.where(F.col("band") < first_bands).withColumn("comp", F.col("node"))
    comps = keep(linked(one.select("g", "node", "comp", "size"), sigs, "sig", (least,), chunk, "rough-first", keep), "rough-components")
    rest = members.where(F.col("band") >= first_bands).join(comps.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rest = keep(rest.select("g", "node", "comp", "size"), "rest")
    mixed = rest.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g")
    return composed(comps, linked(keep(rest.join(mixed, "g"), "mixed"), sigs, "sig", (least,), chunk, "rough-rest", keep))


def connected_components(edges: DataFrame, name: str = "edges", keep: Keep = stored, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b), root being the component's smallest node.

    Alternating large-star and small-star (Kiveris et al., 2014) until every node points at a root. A
    node's smallest neighbour is found by partial aggregation and joined back, so a hub's edges stay
    spread; nothing is collected but whether any node is left over.
    """
    e = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    for _ in range(max_rounds):
        places = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("p")).select("p.*")
        unsettled = places.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if unsettled.limit(1).count() == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        e = keep(small, name)
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS, seed: int = 20, chunk: int = 1000) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), a row per row of ``docs``.

    Documents link where ``den * |A & B| >= num * |A | B|`` on their word-shingle sets; a component's
    id is its smallest document id. With the default 40 bands of 5 a pair at 0.8 shares no bucket with
    probability 1.2e-7, and its signature falls below the pre-check (0.15 under the threshold, 5 standard
    deviations) as rarely; larger corpora want more rows a band and more bands.
    Null or wordless texts: size 0, a component of their own. Null ids: row kept, component null.
    Rows with one id count as one node. Other columns of ``docs`` are ignored. What is stored on the way goes in the end.
    """
    lean_batches(docs.sparkSession)
    with workspace(docs.sparkSession, "near-duplicates") as keep:
        return stored(_near_duplicates(docs, id_col, text_col, shingle_words, num, den, bands, rows, seed, chunk, keep), "components")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, num: int, den: int, bands: int, rows: int, seed: int, chunk: int, keep: Keep) -> DataFrame:
    least = num / den - 0.15
    sketch = keep(sketches(docs, id_col, text_col, shingle_words, bands, rows, seed), "sketch")
    reps = keep(sketch.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n")), "reps")
    width = 2 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))
    banded = reps.select("rep", F.posexplode(keys).alias("band", "g"))
    buckets = banded.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    members = keep(banded.join(buckets, "g").select("g", "band", F.col("rep").alias("node"), "size"), "members")
    sigs = reps.select(F.col("rep").alias("node"), F.col("sig").alias("p"))
    clusters = keep(rough_clusters(members, sigs, least, chunk, max(1, bands // 10), keep).select("node", F.col("root").alias("g")), "clusters")
    # a chunk of sets is bounded in shingles too: each thousand counts as one more document
    weights = clusters.join(reps.select(F.col("rep").alias("node"), (F.col("n") / 1000 + 1).cast("long").alias("w")), "node")
    # up to a counted bound the ids go to the texts, beyond it both are shuffled
    ids = clusters.select(F.col("node").alias("id"))
    sets = keep(shingle_sets(docs, F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_col, text_col, shingle_words), "sets")
    clusters = clusters.withColumn("comp", F.col("node")).join(weights.groupBy("g").agg(F.sum("w").alias("size")), "g")
    comps = linked(clusters, sets, "set", (num, den), chunk // 2, "links", keep).withColumnRenamed("node", "rep")
    classes = reps.select("digest", "rep").join(comps, "rep", "left").select("digest", F.coalesce("root", "rep").alias("component"))
    out = sketch.select("id", "n", "digest").join(classes, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, one of each component: that of the smallest id.

    Rows that share an id are one document, of which one row stays. Rows with a null id stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = stored(found.where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__gone")).distinct(), "near-duplicates")
    # up to a counted bound the ids go to the texts, beyond it both are shuffled
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    out = docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    again = stored(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).count().where("count > 1").select("__again"), "repeated-ids")
    if again.limit(1).count():
        same = F.col(id_col) == F.col("__again")
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([id_col]))
    return out
