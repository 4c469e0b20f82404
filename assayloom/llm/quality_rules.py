"""Quality rules: an isolation forest over rule statistics, its threshold calibrated on labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import batches, lean_batches, utf8, workspace
from assayloom.llm.doc_stats import FEATURES, NAMES, measure, ratios

_EULER = 0.5772156649
#: Labelled ids that are broadcast at most; beyond, all texts are measured and their ratios meet the labels in a shuffle.
BROADCAST_IDS = 2_000_000
_SLOTS = 4096


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points (Liu, Ting and Zhou, 2008)."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays (tree, node): split feature (-1 in a leaf), split value, left child, path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    size: int
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores, 0 to 1; near 1 where random splits part a row from the rest early."""
        path = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left, depth in zip(self.feature, self.value, self.left, self.depth, strict=True):
            at = np.zeros(len(x), np.int32)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] >= value[at]
                at = np.where(inner, left[at] + go, at)
            path += depth[at]
        return 2.0 ** (-path / len(self.feature) / max(float(_expected(self.size)), 1e-9))


def grow(drawn: list[np.ndarray], size: int, seed: int = 5) -> Forest:
    """A forest of one tree for each ``drawn`` set of ``size`` rows."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(size, 2))))
    made = []
    for x in drawn:
        nodes: list[list[float]] = [[-1, 0, 0, 0]]
        todo = [(0, x, 0)]
        while todo:
            at, part, deep = todo.pop()
            lo, hi = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(hi > lo)
            if deep >= limit or len(part) <= 1 or not len(wide):
                nodes[at][3] = deep + float(_expected(len(part)))
                continue
            f = int(rng.choice(wide))
            v = rng.uniform(lo[f], hi[f])
            v = v if v > lo[f] else hi[f]
            nodes[at][:3] = [f, v, len(nodes)]
            side = part[:, f] >= v
            todo += [(len(nodes), part[~side], deep + 1), (len(nodes) + 1, part[side], deep + 1)]
            nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
        made.append(np.array(nodes))
    width = max(map(len, made))
    full = np.stack([np.vstack([m, np.tile([-1.0, 0, 0, 0], (width - len(m), 1))]) for m in made])
    return Forest(full[..., 0].astype(np.int32), full[..., 1], full[..., 2].astype(np.int32), full[..., 3], size)


def calibrate(scores: np.ndarray, y: np.ndarray, keep_good: float = 0.99) -> float:
    """The score from which rows go: the best Youden index among thresholds that keep ``keep_good`` of the good rows.

    ``threshold`` is the same over a table.
    """
    good, bad = scores[y == 1], scores[y == 0]
    if not len(good) or not len(bad):
        return float(np.nextafter(scores.max(), 2)) if len(scores) else 1.0
    at = np.unique(scores)
    kept = np.searchsorted(np.sort(good), at) / len(good)
    gone = 1 - np.searchsorted(np.sort(bad), at) / len(bad)
    ok = kept >= keep_good
    return float(at[ok][np.argmax((kept + gone)[ok])]) if ok.any() else float(np.nextafter(at[-1], 2))


def threshold(scored: DataFrame, keep_good: float = 0.99) -> float:
    """``calibrate`` over all rows of (y, n, s): label, number of rows, score. Only counts by slot of scores come to the driver."""
    at = scored.groupBy("s").agg(F.sum(F.col("n") * F.col("y")).alias("good"), F.sum(F.col("n") * (1 - F.col("y"))).alias("bad")).withColumn("slot", F.floor(F.col("s") * _SLOTS).cast("int"))
    slots = at.groupBy("slot").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("s").alias("top")).toPandas().sort_values("slot")
    if slots.empty:
        return 1.0
    good, bad = int(slots["good"].sum()), int(slots["bad"].sum())
    over = float(np.nextafter(slots["top"].max(), 2))
    if not good or not bad:
        return over
    before = pd.DataFrame({"slot": slots["slot"].astype("int32"), "good_before": slots["good"].cumsum() - slots["good"], "bad_before": slots["bad"].cumsum() - slots["bad"]})
    lower = Window.partitionBy("slot").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    under = lambda c: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(lower), F.lit(0))
    kept, gone = under("good") / float(good), 1 - under("bad") / float(bad)
    choices = at.join(F.broadcast(at.sparkSession.createDataFrame(before)), "slot").select("s", kept.alias("kept"), gone.alias("gone")).where(F.col("kept") >= keep_good)
    best = choices.agg(F.max_by("s", F.struct(F.col("kept") + F.col("gone"), -F.col("s")))).first()[0]
    return over if best is None else float(best)


def draw(kinds: DataFrame, trees: int, size: int, seed: int = 5) -> list[np.ndarray]:
    """For each tree ``size`` different rows of all that (y, x, n) stands for, n rows each; whatever the partitions.

    Rows are numbered in 4096 slots of their hashes; the driver draws numbers and gets only the rows that were drawn.
    """
    h = F.xxhash64("y", "x")
    slotted = kinds.select("y", "x", "n", h.alias("h"), F.pmod(h, F.lit(_SLOTS)).cast("int").alias("slot"))
    counts = np.zeros(_SLOTS + 1, np.int64)
    for r in slotted.groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"] + 1] = r["n"]
    edge = np.cumsum(counts)
    if not edge[-1]:
        return []
    rng = np.random.default_rng(seed)
    drawn = [rng.choice(edge[-1], min(size, int(edge[-1])), replace=False) for _ in range(trees)]
    asked = np.unique(np.concatenate(drawn))
    slot = np.searchsorted(edge, asked, side="right") - 1
    places = kinds.sparkSession.createDataFrame(pd.DataFrame({"slot": slot.astype(np.int32), "at": asked - edge[slot], "number": asked}))
    ends = slotted.withColumn("end", F.sum("n").over(Window.partitionBy("slot").orderBy("h", "y", "x").rowsBetween(Window.unboundedPreceding, 0)))
    hit = ends.join(F.broadcast(places), "slot").where((F.col("at") < F.col("end")) & (F.col("at") >= F.col("end") - F.col("n")))
    got = hit.select("number", "x").toPandas().sort_values("number")
    x = np.stack(got["x"].to_numpy())
    return [x[np.searchsorted(asked, d)] for d in drawn]


def fit_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", trees: int = 200, size: int = 256, keep_good: float = 0.99, seed: int = 5) -> Forest:
    """Trees over rows drawn from all labelled rows, ``size`` a tree; the threshold over the scores of all labelled rows."""
    lean_batches(docs.sparkSession)
    with workspace(docs.sparkSession, "forest") as keep:
        return _fit(docs, labels, id_col, trees, size, keep_good, seed, keep)


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, trees: int, size: int, keep_good: float, seed: int, keep: Callable[[DataFrame, str], DataFrame]) -> Forest:
    def ratios_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            x = ratios(np.array([measure(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])

    picked = labels.where(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1)).select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("y")).distinct()
    few = picked.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).alias("id"), utf8("text").alias("t"))
    if few:
        texts = texts.join(F.broadcast(picked.select("id")), "id", "left_semi")
    rows = texts.mapInArrow(ratios_of, f"id {docs.schema[id_col].dataType.simpleString()}, x array<double>").join(F.broadcast(picked) if few else picked, "id")
    # copies have equal ratios: they are counted before they meet
    kinds = keep(rows.groupBy("y", "x").agg(F.count("*").alias("n")), "kinds")
    drawn = draw(kinds, trees, size, seed)
    if not drawn:
        return grow([np.zeros((1, len(FEATURES)))], 1)
    forest = grow(drawn, len(drawn[0]), seed)

    def scores_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forest.score(x))], names=["y", "n", "s"])

    scored = kinds.select("y", "n", "x").mapInArrow(scores_of, "y int, n long, s double")
    forest.threshold = threshold(keep(scored, "scored"), keep_good)
    return forest


def quality_rules(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept), a row per row.

    ``base_failed``: fewer than ``min_words`` words, or over ``repeat_percent`` % of them in repeated
    8-word windows. ``kept``: not failed and anomaly below the forest's threshold. Null and empty
    texts have no words and fail. Null ids are carried.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1000):
            m = np.array([measure(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(NAMES))
            anomaly = forest.score(ratios(m)) if len(m) else np.zeros(0)
            failed = (m[:, 0] < min_words) | (100 * m[:, 4] > repeat_percent * m[:, 0])
            columns = [batch.column(0), *(pa.array(m[:, i]) for i in range(5)), pa.array(failed), pa.array(anomaly), pa.array(~failed & (anomaly < forest.threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *NAMES[:5], "base_failed", "anomaly", "kept"])

    lean_batches(docs.sparkSession)
    kinds = ", ".join(f"{n} long" for n in NAMES[:5])
    out = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, {kinds}, base_failed boolean, anomaly double, kept boolean")
    return out.withColumnRenamed("id", id_col)
