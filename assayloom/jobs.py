"""Jobs for the command line: ``python -m assayloom.jobs NAME ...`` over files, results to a folder."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayloom.operators import aggregate as A
from assayloom.operators import article as R
from assayloom.operators import evaluate as E
from assayloom.operators import images as I
from assayloom.sources import benchmark, downloads, readers, writers


def aggregate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Clean and conflicting rows of extraction files; both kinds round to the same number of decimals."""
    rows = readers.read_rows(spark, a.inputs)
    made = (A.aggregate_nano if a.kind == "nanozyme" else A.aggregate_molecules)(rows, decimals=a.value_decimals)
    writers.write_csv(made.clean, f"{a.output}/clean")
    writers.write_csv(made.conflicts, f"{a.output}/conflicts")
    return {"input_rows": rows.count(), "clean_rows": made.clean.count(), "conflicts": made.conflicts.count(), "output": a.output}


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Counts and shares of generated against gold measurements; with ``--mismatches`` a report of every key."""

    def load(path: str):
        rows = readers.read_rows(spark, [path])
        return E.load_records(rows.withColumn("_line", F.col("_row_order.line")), "_line", path, a.smiles, a.property, a.value, a.value_decimals)

    gold, made = load(a.gold), load(a.generated)
    if a.mismatches:
        writers.write_mismatches(E.mismatches(gold, made), a.mismatches)
    result = E.evaluation(gold, made)
    if a.json:
        return result.first().asDict()
    return {"text": "\n".join(r.line for r in E.metrics_text(result).orderBy("place").collect())}


def gold(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A benchmark's rows as JSON lines, its gold records, article payloads and references."""
    rows, manifest = benchmark.read_benchmark(spark, a.folder, json.loads(a.configs), a.domain, a.split)
    rows = rows.withColumn("_source_id", F.monotonically_increasing_id().cast("string"))
    records, artifacts = benchmark.gold_records(rows, "_source_id"), benchmark.article_artifacts(rows, "_source_id")
    writers.write_jsonl(rows, f"{a.output}/rows")
    writers.write_csv(records, f"{a.output}/gold")
    writers.write_csv(artifacts, f"{a.output}/artifacts")
    if {"pdf", "doi", "title"} <= set(rows.columns):
        writers.write_csv(E.distinct_references(rows.select("pdf", "doi", "title", F.col("_source_id").cast("long").alias("o")), "pdf", "doi", "title", "o").drop("o"), f"{a.output}/article_references")
    return {**manifest, "gold_records": records.count(), "artifacts": artifacts.count()}


def articles(spark: SparkSession, a: argparse.Namespace, ask_molecules: R.Ask | None = None, ask_nano: R.Ask | None = None) -> dict:
    """Markdown files to a bundle of clean tables; extractors are plug-ins, without them nothing is extracted."""
    files = spark.read.text(a.folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("article_id"), F.col("value").alias("markdown"))
    made = R.run_articles(files.withColumn("domain", F.lit(a.domain)), ask_molecules, ask_nano, a.max_chunks, a.max_attempts, can_switch=a.switch)
    writers.write_bundle(made, a.output)
    return {"articles": made.manifest.count(), "output": a.output}


def images(spark: SparkSession, a: argparse.Namespace) -> dict:
    """PNG files to particle summaries."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(a.folder)
    found = I.summaries(I.analyze_images(files.select(F.col("path").alias("source"), F.col("content").alias("image"), F.lit(a.scale_label).alias("label")), ["source"], label="label" if a.scale_label else None, crop_panels=a.panels), ["source"])
    writers.write_json(found, f"{a.output}/vision_results")
    writers.write_csv(writers.particle_table(found, ["source"]), f"{a.output}/vision_summary")
    return {"results": found.count(), "output": a.output}


def download(spark: SparkSession, a: argparse.Namespace, fetch: downloads.Fetch | None = None) -> dict:
    """References to PDF files by a fetching plug-in (plain HTTP by default); ``--dry-run`` lists the links only."""
    refs = None
    for i, path in enumerate(a.inputs):
        df = readers.read_csv(spark, path).withColumn("_o", F.struct(F.lit(i).alias("file"), F.monotonically_increasing_id().alias("line")))
        refs = df if refs is None else refs.unionByName(df, allowMissingColumns=True)
    some = E.article_references(refs, "pdf", "doi", "title", "access", "_o", a.access)
    some = some.withColumn("candidates", F.array(F.struct(F.lit("given").alias("resolver"), F.concat(F.lit("https://doi.org/"), "doi").alias("url"))))
    got = downloads.download(some, fetch or downloads.http_fetch(a.timeout), ["key"], limit=a.limit, dry_run=a.dry_run)
    got.write.mode("overwrite").parquet(f"{a.output}/{E.domain_of(a.inputs)}")
    done = spark.read.parquet(f"{a.output}/{E.domain_of(a.inputs)}")
    return {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assayloom", description="Jobs over extraction files, articles, images and benchmarks.")
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name: str, run: Callable, *arguments: tuple) -> None:
        one = jobs.add_parser(name, help=run.__doc__.split("\n")[0])
        for names, options in arguments:
            one.add_argument(*names.split(), **options)
        one.set_defaults(run=run)

    decimals = ("--value-decimals", {"type": int, "default": 3})
    job("aggregate", aggregate, ("inputs", {"nargs": "+"}), ("--output", {"required": True}), ("--kind", {"choices": ["small-molecule", "nanozyme"], "default": "small-molecule"}), decimals)
    job("evaluate", evaluate, ("gold", {}), ("generated", {}), ("--smiles", {}), ("--property", {}), ("--value", {}), ("--mismatches", {}), ("--json", {"action": "store_true"}), decimals)
    job("gold", gold, ("folder", {}), ("--configs", {"required": True}), ("--domain", {"required": True}), ("--split", {"default": "test"}), ("--output", {"required": True}))
    job("articles", articles, ("folder", {}), ("--domain", {"required": True}), ("--output", {"required": True}), ("--max-chunks", {"type": int, "default": 3}), ("--max-attempts", {"type": int, "default": 3}), ("--switch", {"action": "store_true"}))
    job("images", images, ("folder", {}), ("--output", {"required": True}), ("--scale-label", {}), ("--panels", {"action": "store_true"}))
    job("download", download, ("inputs", {"nargs": "+"}), ("--output", {"required": True}), ("--access", {}), ("--limit", {"type": int}), ("--timeout", {"type": float, "default": 30.0}), ("--dry-run", {"action": "store_true"}))
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(arguments)
    said = a.run(spark or SparkSession.builder.getOrCreate(), a)
    print(said.get("text") or json.dumps(said, indent=2, default=str))
    return said


if __name__ == "__main__":
    main(sys.argv[1:])
