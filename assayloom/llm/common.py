"""Shared plumbing of the training-data operators: tables, the shared folder, batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.hashing import hash_words, mix64, rolling  # noqa: F401
from assayloom.tables import fresh_path, remove_path, shared_base, stored, workspace, written  # noqa: F401

#: What separates words everywhere in this package: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let whole texts go to Python ``rows`` at a time, unless the session has set a number of its own.

    Arrow buffers of some thousand texts are returned to the system at once; those of tens of megabytes linger on both sides.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def utf8(col: str | Column) -> Column:
    """The text's bytes; null stays null. Python then gets bytes and never decodes."""
    return (F.col(col) if isinstance(col, str) else col).cast("binary")


def batches(it: Iterator, size: int = 2000) -> Iterator:
    """Arrow batches cut to at most ``size`` rows, so that what is made from one stays small."""
    for b in it:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def groups(it: Iterator, keys: int) -> Iterator[list[list]]:
    """The columns, as lists, of each run of rows that agree in the first ``keys`` columns."""
    held, name = None, None
    for batch in it:
        columns = [c.to_pylist() for c in batch.columns]
        names = list(zip(*columns[:keys], strict=True))
        at = 0
        while at < len(names):
            end = at + 1
            while end < len(names) and names[end] == names[at]:
                end += 1
            part = [c[at:end] for c in columns]
            if held is not None and names[at] == name:
                for h, c in zip(held, part, strict=True):
                    h.extend(c)
            else:
                if held is not None:
                    yield held
                held, name = part, names[at]
            at = end
    if held is not None:
        yield held
