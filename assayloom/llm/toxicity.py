"""Toxicity: logistic regression on words and word beginnings, regularised by counterfactual pairs.

A labelled text that names a group is paired with the same text naming each other group of the same kind;
training penalises the squared differences of the scores, so that naming a group neutrally is no evidence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import batches, lean_batches, utf8, workspace
from assayloom.llm.labelled import held_out, labelled_texts, sample

#: Group words that are exchanged for each other within a line.
IDENTITIES = (
    ("women", "men", "girls", "boys", "nonbinary", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("black", "white", "asian", "latino", "indigenous", "arab"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_LINE = {w.encode(): [x.encode() for x in line] for line in IDENTITIES for w in line}
_GROUP_FEATURES = {f for w in _LINE for f in (w, b"^" + w[:5])}
_BREAKS = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def words_of(text: bytes | None) -> set[bytes]:
    """Distinct words: runs of ASCII letters and digits and of all bytes beyond ASCII; ASCII in lower case."""
    return set((text or b"").lower().translate(_BREAKS).split())


def features(words: set[bytes]) -> set[bytes]:
    """The words, and the first five bytes of longer ones."""
    return words | {b"^" + w[:5] for w in words if len(w) > 5}


def swapped(words: set[bytes]) -> list[set[bytes]]:
    """The words with each group word changed for another of its line, for every other word of the longest line."""
    held = [w for w in words if w in _LINE]
    rest = words.difference(held)
    turns = range(1, max((len(_LINE[w]) for w in held), default=1))
    made = [rest.union(_LINE[w][(_LINE[w].index(w) + k) % len(_LINE[w])] for w in held) for k in turns]
    return [m for m in made if m != words]


@dataclass
class ToxicityModel:
    weight: dict[bytes, float]
    bias: float

    def __post_init__(self) -> None:
        self.known = frozenset(self.weight)

    def logit(self, text: bytes | None) -> float:
        return self.bias + sum(map(self.weight.__getitem__, sorted(self.known & features(words_of(text)))))

    def score(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -35, 35))))


class _Rows:
    """Sparse 0/1 rows with values, multiplied both ways."""

    def __init__(self, rows: list[list[tuple[int, float]]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c, _ in r], np.int64)
        self.val = np.array([v for r in rows for _, v in r], float)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.width)


def train(x: _Rows, y: np.ndarray, pairs: _Rows, ridge: float, fairness: float, texts: int = 0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Minimise mean log loss + ridge |w|^2 / 2 + fairness / 2 * sum (w . (x - x'))^2 / texts, by Adam over all rows.

    ``texts``: the number of texts that ``pairs`` come from.
    """
    w, b = np.zeros(x.width), 0.0
    m, v = np.zeros(x.width + 1), np.zeros(x.width + 1)
    for t in range(1, steps + 1):
        r = (1 / (1 + np.exp(-np.clip(x.dot(w) + b, -35, 35))) - y) / max(len(y), 1)
        g = x.back(r) + ridge * w
        if pairs.n:
            g = g + fairness * pairs.back(pairs.dot(w)) / max(texts, 1)
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 6000, least_chi2: float = 12.0, ridge: float = 2e-4, fairness: float = 10.0) -> ToxicityModel:
    """Fit on at most ``per_class`` training rows of each label, on all features of those rows that have a
    chi-squared of ``least_chi2`` or more, whatever the number of rows.

    The intercept is moved from the sample's to the labels' proportion. No positive or no negative
    row: a constant score, the classes' share (0.5 without any label). Null texts have no words. A labelled id
    that several rows share counts each of them.
    """
    lean_batches(docs.sparkSession)
    with workspace(docs.sparkSession, "toxicity") as keep:
        return _fit(docs, labels, train_rows, label, id_col, text_col, per_class, least_chi2, ridge, fairness, keep)


def _fit(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str, id_col: str, text_col: str, per_class: int, least_chi2: float, ridge: float, fairness: float, keep: Callable[[DataFrame, str], DataFrame]) -> ToxicityModel:
    picked, totals = sample(labels, label, train_rows, per_class, id_col)
    lists = pa.list_(pa.list_(pa.binary()))

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a counterfactual only what it adds to the text's features (0) and what it takes from them (1)
        for batch in batches(it, 200):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            own = [features(w) for w in words]
            other = [[features(o) for o in swapped(w)] for w in words]
            plus = [[sorted(o - f) for o in os] for f, os in zip(own, other, strict=True)]
            less = [[sorted(f - o) for o in os] for f, os in zip(own, other, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(f) for f in own], pa.list_(pa.binary())), pa.array(plus, lists), pa.array(less, lists)], names=["y", "f", "plus", "less"])

    rows = keep(labelled_texts(docs, picked, utf8(text_col), id_col).mapInArrow(extract, "y int, f array<binary>, plus array<array<binary>>, less array<array<binary>>"), "rows")
    seen = {int(r["y"]): int(r["count"]) for r in rows.groupBy("y").count().collect()}
    pos, neg = seen.get(1, 0), seen.get(0, 0)
    share = totals.get(1, 0) / max(sum(totals.values()), 1) if totals else 0.5
    if not pos or not neg:
        return ToxicityModel({}, float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))))
    df = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    total = float(pos + neg)
    chi2 = F.lit(total) * F.pow(F.col("a") * (neg - F.col("b")) - F.col("b") * (pos - F.col("a")), F.lit(2)) / (F.lit(float(pos) * neg) * (F.col("a") + F.col("b")) * F.greatest(F.lit(total) - F.col("a") - F.col("b"), F.lit(1.0)))
    # group words are features whatever their chi-squared: the penalty is about their weights
    top = df.where("a + b >= 3").where((chi2 >= least_chi2) | F.col("f").isin([F.lit(w) for w in sorted(_GROUP_FEATURES)])).select("f").collect()
    vocabulary = {f: i for i, f in enumerate(sorted(bytes(r["f"]) for r in top))}

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = lambda fs: [vocabulary[f] for f in fs if f in vocabulary]
        kind = pa.list_(pa.list_(pa.int32()))
        for batch in batches(it, 500):
            own = [ids(r) for r in batch.column(1).to_pylist()]
            plus, less = ([[ids(v) for v in r] for r in batch.column(i).to_pylist()] for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(plus, kind), pa.array(less, kind)], names=["y", "x", "plus", "less"])

    got = sorted(tuple(r) for r in rows.mapInArrow(encode, "y int, x array<int>, plus array<array<int>>, less array<array<int>>").collect())
    x = _Rows([[(i, 1.0) for i in own] for _, own, _, _ in got], len(vocabulary))
    # a text's counterfactuals weigh one together
    share = lambda vs: 1 / np.sqrt(len(vs))
    pairs = _Rows([[(i, share(plus)) for i in p] + [(i, -share(plus)) for i in m] for _, _, plus, less in got for p, m in zip(plus, less, strict=True)], len(vocabulary))
    w, b = train(x, np.array([y for y, _, _, _ in got], float), pairs, ridge, fairness, texts=sum(1 for r in got if r[2]))
    b += float(np.log(max(totals[1], 1) / max(totals[0], 1)) - np.log(pos / neg))
    return ToxicityModel({f: float(w[i]) for f, i in vocabulary.items()}, b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score), a row per row; null and empty texts score as a text without words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    lean_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def score_column(model: ToxicityModel, text: Column) -> Column:
    """The score of a text column. Only the texts go to Python and only scores come back."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            parts = [[model.score(t) for t in texts.slice(at, 500).to_pylist()] for at in range(0, len(texts), 500)]
            yield pa.array([s for part in parts for s in part], pa.float64())

    return F.arrow_udf(run, "double")(text.cast("binary"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is under ``least``; null and empty texts score as no words."""
    lean_batches(docs.sparkSession)
    return docs.where(score_column(model, F.col(text_col)) < least)


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, kept_back: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted): fitted on the rows not held out, scored on all. Null ids are held out."""
    out = held_out(id_col, modulus, kept_back)
    model = fit_toxicity(docs, labels, ~out, id_col=id_col, text_col=text_col)
    return score_toxicity(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
