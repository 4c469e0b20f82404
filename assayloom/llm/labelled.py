"""Training rows of the classifiers: bounded, hashed samples of the labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, modulus: int, kept_back: int) -> Column:
    """Whether a row is kept back from training: its id's CRC-32 says so. A null id never trains."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == kept_back, F.lit(True))


def sample(labels: DataFrame, label: str, train: Column, per_class: int, id_col: str = "doc_id", seed: int = 11) -> tuple[DataFrame, dict[int, int]]:
    """((id, y) of at most ``per_class`` rows of label 1 and of label 0, all training rows by label).

    The rows with the smallest hashes are taken: a bounded top-k, so broadcasting the sample is safe.
    """
    rows = labels.where(train & F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).distinct()
    totals = {int(r["y"]): int(r["count"]) for r in rows.groupBy("y").count().collect()}
    order = F.xxhash64("id", F.lit(seed))
    parts = [rows.where(F.col("y") == y).orderBy(order, "id").limit(per_class) for y in (0, 1)]
    return parts[0].union(parts[1]), totals


def labelled_texts(docs: DataFrame, picked: DataFrame, text: Column, id_col: str = "doc_id") -> DataFrame:
    """(y, t) of the documents in a bounded sample."""
    return docs.select(F.col(id_col).alias("id"), text.alias("t")).join(F.broadcast(picked), "id").select("y", "t")
