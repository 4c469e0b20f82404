"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import batches, lean_batches, utf8
from assayloom.llm.doc_stats import FEATURES, NAMES, measure, ratios
from assayloom.llm.labelled import held_out, labelled_texts, sample


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """Transformed statistics of whole texts: the shared ratios and how far from long a text is."""
    m = np.array([measure(t) for t in texts], float).reshape(-1, len(NAMES))
    return np.column_stack([ratios(m), 10 / (10 + m[:, 0])])


@dataclass
class Discriminant:
    """Class means and cached inverse Cholesky factors of the shrunken covariances."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the logistic of the difference of the classes' log densities."""
        if not len(x):
            return np.zeros(0)
        log = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            log.append(self.log_prior[c] - 0.5 * self.log_det[c] - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -35, 35)))


def discriminant(n: np.ndarray, total: np.ndarray, outer: np.ndarray, prior: np.ndarray, ridge: float = 1e-4) -> Discriminant:
    """From each class's count, sum and sum of outer products.

    A covariance is drawn towards the diagonal of the pooled one, by p / (p + n) of the way and 2 % at
    least, so that a class of few rows, or of a statistic that never varies, still has an inverse.
    """
    p = total.shape[1]
    if (n < 2).any():
        prior = n / n.sum() if n.sum() else np.array([0.5, 0.5])
        return Discriminant(np.zeros((2, p)), np.zeros((2, p, p)), np.zeros(2), np.log(np.clip(prior, 1e-6, 1)))
    mean = total / n[:, None]
    cov = [outer[c] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = np.diag(np.diag((n[0] * cov[0] + n[1] * cov[1]) / n.sum())) + ridge * np.eye(p)
    factors, dets = [], []
    for c in (0, 1):
        a = max(0.02, p / (p + n[c]))
        low = np.linalg.cholesky((1 - a) * cov[c] + a * pooled)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(mean, np.stack(factors), np.array(dets), np.log(np.clip(prior / prior.sum(), 1e-6, 1)))


def fit_discriminant(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 15000) -> Discriminant:
    """Fit on at most ``per_class`` training rows of each label; tasks send moments only."""
    picked, totals = sample(labels, label, train, per_class, id_col)
    p = len(FEATURES) + 1

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
        for batch in batches(it):
            y, x = np.array(batch.column(0)), statistics(batch.column(1).to_pylist())
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                total[c] += own.sum(axis=0)
                outer[c] += own.T @ own
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([n[c]]), pa.array([total[c].tolist()]), pa.array([outer[c].ravel().tolist()])], names=["y", "n", "s", "o"])

    got = labelled_texts(docs, picked, utf8(text_col), id_col).mapInArrow(moments, "y int, n double, s array<double>, o array<double>").where("n > 0").collect()
    n, total, outer = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for r in sorted(got, key=lambda r: (r["y"], r["n"], r["s"])):
        n[r["y"]] += r["n"]
        total[r["y"]] += np.array(r["s"])
        outer[r["y"]] += np.array(r["o"]).reshape(p, p)
    return discriminant(n, total, outer, np.array([totals.get(0, 0), totals.get(1, 0)], float))


def score_quality(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score), a row per row; null and empty texts score as a text of nothing."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(statistics(batch.column(1).to_pylist())))], names=["id", "score"])

    lean_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, kept_back: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted): fitted on the rows not held out, scored on all.

    No labels, or labels of one class only: every score is the classes' share. Null ids are held out.
    """
    out = held_out(id_col, modulus, kept_back)
    model = fit_discriminant(docs, labels, ~out, id_col=id_col, text_col=text_col)
    return score_quality(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
