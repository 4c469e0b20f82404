"""Tables on the way: written in the folder that driver and executors share, read again, and taken away."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_base: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder stands in on a local master only; on a cluster each machine would have its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_base:
            _own_base[app] = "file://" + tempfile.mkdtemp(prefix="assayloom-")
        base = _own_base[app]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/assayloom/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: cuts the lineage, survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder, which stays."""
    return written(df, fresh_path(df.sparkSession, name))


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A folder of tables that goes when the block ends: ``keep(df, part)`` stores one of them.

    What leaves the block must have been stored outside it.
    """
    folder = fresh_path(spark, name)
    try:
        yield lambda df, part: written(df, f"{folder}/{part}-{uuid.uuid4().hex[:8]}")
    finally:
        remove_path(spark, folder)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
