"""Sinks: tables as CSV, JSON lines and Parquet, and an article's bundle of artefacts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.functions.exprs import let, short
from assayloom.operators.aggregate import Aggregated
from assayloom.operators.article import Articles


def write_csv(df: DataFrame, path: str, one_file: bool = False, mark: bool = False) -> None:
    """CSV with a header; ``one_file`` for small results only; ``mark`` puts a byte-order mark before the first name."""
    out = df.toDF("﻿" + df.columns[0], *df.columns[1:]) if mark else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_aggregated(result: Aggregated, folder: str, one_file: bool = False) -> None:
    for name, df in result._asdict().items():
        if df is not None:
            write_csv(df, f"{folder}/{name}", one_file)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line, fields by name; binary values become their kind, size and SHA-256."""
    columns = []
    for name, kind in sorted(df.dtypes):
        c = F.col(name)
        columns.append(F.struct(F.lit("bytes").alias("type"), F.octet_length(c).alias("size"), F.sha2(c, 256).alias("sha256")).alias(name) if kind == "binary" else c)
    df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """A JSON object a line; with ``by`` a folder for each of its values."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def write_mismatches(df: DataFrame, path: str) -> None:
    """A mismatch report in the order of its keys, in one file: a report for people."""
    write_csv(df.orderBy("canonical_smiles", "property_name"), path, one_file=True)


def write_bundle(result: Articles, folder: str, vision: DataFrame | None = None) -> None:
    """What each step made of every article, each part under its own name and an article a folder within it.

    Tables are CSV, text and logs plain lines, lists and states JSON; vision parts only where there are results.
    """
    by = lambda df: df.write.mode("overwrite").partitionBy("article_id")
    both = lambda field: getattr(result.molecules, field).unionByName(getattr(result.nano, field), allowMissingColumns=True)
    for name, df in (("clean_csv", both("clean")), ("conflicts_csv", both("conflicts")), ("rejected_csv", result.rejected)):
        by(df).option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    by(result.documents.select("article_id", F.col("markdown").alias("value"))).text(f"{folder}/prepared_markdown")
    logs = result.trace.select("article_id", F.concat("agent", F.lit(": "), "summary").alias("value"), "step").repartition("article_id").sortWithinPartitions("article_id", "step").drop("step")
    by(logs).text(f"{folder}/logs")
    for name, df in (("chunks_json", result.chunks), ("retrieval_json", result.ranked), ("agent_trace_json", result.trace), ("states_json", result.states), ("manifest", result.manifest)):
        write_json(df, f"{folder}/{name}", "article_id")
    if vision is not None:
        write_json(vision, f"{folder}/vision_json", "article_id")
        by(particle_table(vision, ["article_id", "source"])).option("header", True).csv(f"{folder}/vision_summary_csv")


def particle_table(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Particle summaries as text for a CSV: numbers with 6 significant digits, nulls empty."""
    names = ["mean_diameter_nm", "median_diameter_nm", "std_diameter_nm", "min_diameter_nm", "max_diameter_nm", "mean_diameter_px", "scale_length_px", "scale_label_nm", "nm_per_px"]
    shown = lambda c: F.coalesce(let(F.col(c).cast("double"), short), F.lit("")) if c in summaries.columns else F.lit("")
    return summaries.select(*keys, "count", *[shown(c).alias(c) for c in names])


def export_path(folder: str, source: str, suffix: str) -> str:
    """Where a table that came from ``source`` is exported: its name without ending, and the table's."""
    plain = lambda x: ("".join(c if c.isalnum() or c in "-_." else "_" for c in x)[:80].strip("._") or "article")
    return f"{folder}/{plain(source.rsplit('/', 1)[-1].rsplit('.', 1)[0])}_{plain(suffix)}.csv"


def output_folder(root: str, source: str) -> str:
    """The folder of a source's bundle: its name without ending, plain characters only."""
    stem = source.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"{root}/{re.sub('[^A-Za-z0-9._-]+', '_', stem.strip()).strip('._-')[:80] or 'article'}"
