"""Articles as a stream: the same operators, file by file as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayloom.operators.aggregate import CLEAN, normalize_molecules
from assayloom.operators.chunk import parts_of
from assayloom.operators.text import clean_markdown


def read_articles(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(article_id, markdown) of Markdown files as they appear."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(folder)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("article_id"), F.col("value").alias("markdown"))

def chunk_stream(articles: DataFrame, targets: list[str] | None = None, max_chars: int = 6000, overlap: int = 400) -> DataFrame:
    """Chunks of a stream of articles: stateless, numbered by (section, part) instead of one running number.

    An article without a selected section is cut whole, as in the batch form.
    """
    return parts_of(clean_markdown(articles), "article_id", "markdown", targets, max_chars, overlap).select("article_id", "section", "part", "section_title", "text")

def upsert_measurements(rows: DataFrame, table: str, checkpoint: str, decimals: int = 3) -> StreamingQuery:
    """Keep the best row of each key in a Parquet table, batch by batch: its next version is the better of old and new."""
    usable = normalize_molecules(rows, decimals)

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        keys = ["canonical_smiles", "property_name"]
        keep = [*CLEAN, "source_priority", "_row_order"]
        new = batch.select(*keep)
        every = spark.read.parquet(f"{table}/v{n - 1}").unionByName(new) if n else new
        rest = [c for c in keep if c not in keys]
        best = every.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col("source_priority")).alias("p"), "_row_order")).alias("r"))
        best.select(*keys, *[f"r.{c}" for c in rest]).write.mode("overwrite").parquet(f"{table}/v{n}")

    return usable.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
