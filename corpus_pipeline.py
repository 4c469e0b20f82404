"""From raw documents to a sharded training corpus: five stages, each kept as a table before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm.common import fresh_path, stored, table
from assayloom.llm.decontam import without_leaks
from assayloom.llm.mixing import mix
from assayloom.llm.near_dup import without_near_duplicates
from assayloom.llm.sharding import assign_shards, build_map, load_map, save_map, slot_sizes
from assayloom.llm.toxicity import fit_toxicity, without_toxic

#: Target shares of the mixture, and its tokens as a share of what there is. They steer only repeats: each leaf keeps
#: LEAST_EPOCHS of its measured tokens on any mix of languages, and the budget grows if that takes more.
WEIGHTS = {"lang": {"en": 0.58, "de": 0.16, "fr": 0.16, "es": 0.10}}
BUDGET_SHARE = 1.25
LEAST_EPOCHS = 1.0
N_SHARDS = 16


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the counterfactually regularised classifier scores under 0.5."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return without_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles at 0.8."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and again for each further epoch that the budgets of its language and source take it."""
    return mix(docs, WEIGHTS, total_share=BUDGET_SHARE, least_epochs=LEAST_EPOCHS, epoch_col="__epoch").drop("__epoch")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its virtual slot and its shard, of near equal bytes."""
    folder = fresh_path(spark, "slot-map")
    save_map(build_map(stored(slot_sizes(docs), "slot-sizes"), N_SHARDS), folder)
    return assign_shards(docs, load_map(spark, folder))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL has no MinHash search, classifier or SimHash; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
