"""Sources: extraction rows from CSV, JSON lines and JSON; documents from files; tables inside documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.exprs import strip
from assayloom.operators.evaluate import pick_column  # noqa: F401
from assayloom.operators.extract import envelope_rows

#: The fields an extraction row may have; all are read as text.
ROW_FIELDS = ["canonical_smiles", "smiles", "compound_id", "property_name", "property", "value", "unit", "units", "source_type", "article_id", "source_id", "chunk_index", "evidence", "material_id", "material_name", "material", "material_formula", "formula", "normalized_formula", "assay", "condition", "reason", "validator"]


def column_key(name: str) -> str:
    return "".join(c.lower() for c in name if c.isalnum())


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as text; a byte-order mark before the header is dropped.

    Cells may hold line breaks, which makes a file one task; without ``multi_line`` large files are split.
    """
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def _from_variants(df: DataFrame, v: Column) -> DataFrame:
    rows = df.select(F.posexplode(envelope_rows(v)).alias("_item", "r"), "_line")
    return rows.select("_line", "_item", *[F.try_variant_get("r", f"$.{f}", "string").alias(f) for f in ROW_FIELDS])


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A row per record; each line may be a record or an envelope of records; blank lines are skipped."""
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id()).where(strip("value") != "")
    return _from_variants(lines, F.parse_json("value"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of whole-file JSON."""
    whole = spark.read.text(path, wholetext=True).withColumn("_line", F.monotonically_increasing_id())
    return _from_variants(whole, F.parse_json("value"))


def read_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several files in the order of the arguments, with ``_row_order`` that follows it.

    The order is (argument, line, item): a sort key made at the scan, not a global sort.
    """
    out = None
    for i, path in enumerate(paths):
        kind = path.rsplit(".", 1)[-1].lower()
        if kind == "csv":
            df = read_csv(spark, path).withColumns({"_line": F.monotonically_increasing_id(), "_item": F.lit(0)})
        elif kind in ("jsonl", "json"):
            df = (read_jsonl if kind == "jsonl" else read_json)(spark, path)
        else:
            raise ValueError(f"{path}: rows are read from .csv, .jsonl and .json")
        df = df.withColumn("_row_order", F.struct(F.lit(i).alias("file"), F.col("_line").cast("long").alias("line"), F.col("_item").cast("int").alias("item"))).drop("_line", "_item")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no path given")
    return out


def clean_cell(x: Column) -> Column:
    return strip(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))


def pipe_table(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table: blank rows dropped, short ones filled, the first the header."""
    cells = F.filter(F.transform(rows, lambda r: F.transform(r, clean_cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), line)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.array(line(F.get(cells, F.lit(0))), rule), body), "\n")).otherwise(F.lit(""))


def merge_tables(markdown: Column, tables: Column) -> Column:
    """A document followed by its tables (index, page, markdown) under numbered headings."""
    page = lambda t: F.when(F.coalesce(t["page"], F.lit(0)) != 0, F.concat(F.lit(" (page "), t["page"].cast("string"), F.lit(")"))).otherwise(F.lit(""))
    parts = F.transform(tables, lambda t: F.concat(F.lit("## Table "), t["index"].cast("string"), page(t), F.lit("\n\n"), t["markdown"]))
    return strip(F.array_join(F.filter(F.concat(F.array(strip(markdown)), parts), lambda p: p != ""), "\n\n"))


Cells = list[list[str | None]]
#: Parsers of a file's bytes: its text, and the tables (page, rows of cells) that one way of looking finds.
TextParser = Callable[[bytes], str]
TableParser = Callable[[bytes], list[tuple[object, Cells]]]


def safe_int(x: object) -> int | None:
    """An integer, or None for what is none."""
    try:
        return int(x)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return None


def _tables(content: bytes, ways: dict[str, TableParser], warnings: list[str]) -> list[dict]:
    """The tables of the first way that finds any that isn't blank; a table keeps its place among all that way found."""
    for flavor, look in ways.items():
        try:
            found = look(content)
        except Exception as e:  # one way that fails leaves the others
            warnings.append(f"{flavor} mode failed: {e}")
            continue
        made = [{"index": i, "page": safe_int(page), "flavor": flavor, "rows": [["" if c is None else str(c) for c in row] for row in rows]} for i, (page, rows) in enumerate(found, 1)]
        if kept := [t for t in made if any(c.strip() for row in t["rows"] for c in row)]:
            return kept
    return []


def read_documents(spark: SparkSession, path: str, parse: TextParser | None, tables: dict[str, TableParser] | None = None, name: str = "docling", table_name: str = "camelot") -> DataFrame:
    """(source, parser, markdown, tables, table_count, warnings) of the PDF files under ``path``, parsed where they are.

    ``parse`` gives the text and ``tables`` the ways to look for tables, tried in order. Neither ends the job: what is
    missing or raises is a warning. The tables follow the text; the parser's name says whether there are any.
    """
    ways = dict(tables or {})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for source, content in zip(pdf["path"], pdf["content"], strict=True):
                warnings: list[str] = []
                markdown = ""
                if parse is None:
                    warnings.append(f"{name} is not installed; document text extraction was skipped.")
                else:
                    try:
                        markdown = parse(content) or ""
                    except Exception as e:  # a file that can't be parsed must not end the job
                        warnings.append(f"{name} failed to parse PDF: {e}")
                if not ways:
                    warnings.append(f"{table_name} is not installed; table extraction was skipped.")
                out.append((source.rsplit("/", 1)[-1], markdown, _tables(content, ways, warnings), warnings))
            yield pd.DataFrame(out, columns=["source", "markdown", "cells", "warnings"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content")
    made = files.mapInPandas(run, "source string, markdown string, cells array<struct<index:int,page:int,flavor:string,rows:array<array<string>>>>, warnings array<string>")
    made = made.withColumn("tables", F.transform("cells", lambda t: F.struct(t["index"].alias("index"), t["page"].alias("page"), t["flavor"].alias("flavor"), pipe_table(t["rows"]).alias("markdown"))))
    parser = F.when(F.size("tables") > 0, f"{name}+{table_name}").otherwise(name)
    return made.select("source", parser.alias("parser"), merge_tables(F.col("markdown"), F.col("tables")).alias("markdown"), "tables", F.size("tables").alias("table_count"), "warnings")


def read_pages(spark: SparkSession, path: str, render: Callable[[bytes, float, int | None], list[bytes]], dpi: int = 200, max_pages: int | None = None) -> DataFrame:
    """(source, page, image) of the PDF files under ``path``, drawn by a plug-in at ``dpi`` / 72 times their size."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for source, content in zip(pdf["path"], pdf["content"], strict=True):
                for i, image in enumerate(render(content, dpi / 72, max_pages)[:max_pages], 1):
                    yield pd.DataFrame({"source": [source], "page": [i], "image": [image]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content")
    return files.mapInPandas(run, "source string, page int, image binary")


def token_from(env: dict[str, str], names: list[str], given: str | None = None) -> str | None:
    """A secret: the one given, else the first of the named settings that is filled."""
    return next((v.strip() for v in [given, *(env.get(n) for n in names)] if v and v.strip()), None)


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def open_access_urls(v: Column) -> Column:
    """Distinct PDF links of a work record: of its best, primary and other locations, in that order."""
    one = lambda p: F.array(F.try_variant_get(v, p, "string"))
    many = F.transform(F.coalesce(F.try_variant_get(v, "$.locations", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$.pdf_url", "string"))
    return F.array_distinct(F.filter(F.concat(one("$.best_oa_location.pdf_url"), one("$.primary_location.pdf_url"), many), lambda u: u.isNotNull() & (u != "")))


def link_urls(v: Column) -> Column:
    """Links of a work record that are PDFs by content type or ending."""
    links = F.coalesce(F.try_variant_get(v, "$.message.link", "array<variant>"), F.array().cast("array<variant>"))
    url = lambda x: F.coalesce(F.try_variant_get(x, "$.URL", "string"), F.lit(""))
    pdf = lambda x: F.contains(F.lower(F.coalesce(F.try_variant_get(x, "$.content-type", "string"), F.lit(""))), F.lit("pdf")) | F.lower(url(x)).endswith(".pdf")
    return F.filter(F.transform(F.filter(links, pdf), url), lambda u: u != "")
