"""Sharding by fixed virtual slots and a versioned slot-to-shard map. DataFrame and SQL functions only.

A record's slot is a hash of its id and never changes. What changes is the map from slots to shards, a
table of ``n_slots`` rows: built from the bytes each slot holds, stored with a version, and edited, not
rebuilt, when shards are added. All that is ever gathered in one place is that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayloom.llm.common import fresh_path, stored, utf8

N_SLOTS = 4096
MAP_SCHEMA = "slot int, bytes long, rows long, shard int, version int"


def slot_of(id_col: str, n_slots: int = N_SLOTS) -> Column:
    """A record's slot, from the MD5 of its id as text; a null id has the slot of the empty text."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def text_bytes(text_col: str) -> Column:
    """A text's UTF-8 bytes, none for null, plus 1."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1


def slot_sizes(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, bytes, rows) of every slot, empty ones too."""
    got = docs.select(slot_of(id_col, n_slots).alias("slot"), text_bytes(text_col).alias("b")).groupBy("slot").agg(F.sum("b").alias("bytes"), F.count("*").alias("rows"))
    every = docs.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(got, "slot", "left").select("slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def build_map(sizes: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of a map with shards near equal in bytes: each slot, largest first, to the lightest shard.

    The greedy fold is one ``aggregate`` over the array of slots, whose length is fixed.
    """
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("load"), F.array().cast("array<int>").alias("picks"))

    def put(state: Column, x: Column) -> Column:
        at = F.array_position(state["load"], F.array_min(state["load"])).cast("int")
        load = F.transform(state["load"], lambda v, i: F.when(i == at - 1, v + x["bytes"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(state["picks"], F.array(at - 1)).alias("picks"))

    slots = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "slot", "bytes", "rows")))
    one = sizes.agg(slots.alias("slots")).withColumn("picks", F.aggregate("slots", start, put, lambda s: s["picks"]))
    rows = one.select(F.explode(F.arrays_zip("slots", "picks")).alias("x"))
    return rows.select("x.slots.slot", "x.slots.bytes", "x.slots.rows", F.col("x.picks").cast("int").alias("shard"), F.lit(1).alias("version"))


def grow_map(old: DataFrame, n_shards: int) -> DataFrame:
    """The next version with shards up to ``n_shards`` - 1: slots move to new shards only, and no more than needed.

    Every old shard gives slots, in the order of their hashes, while what it has given stays within its
    surplus over the new mean; what is given is dealt to the new shards, the largest slots first.
    """
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / n_shards
    within = Window.partitionBy("shard")
    given = F.sum("bytes").over(within.orderBy(F.md5(F.col("slot").cast("string").cast("binary")), "slot").rowsBetween(Window.unboundedPreceding, 0))
    m = old.withColumn("mean", mean).withColumn("spare", F.sum("bytes").over(within) - F.col("mean")).withColumn("moves", given <= F.col("spare"))
    n_old = F.max("shard").over(Window.partitionBy(F.lit(1))) + 1
    m = m.withColumn("n_old", n_old).withColumn("order", F.row_number().over(Window.partitionBy("moves").orderBy(F.desc("bytes"), "slot")) - 1)
    fresh = (F.col("n_old") + F.col("order") % F.greatest(F.lit(n_shards) - F.col("n_old"), F.lit(1))).cast("int")
    shard = F.when(F.col("moves") & (F.col("n_old") < n_shards), fresh).otherwise(F.col("shard"))
    return m.select("slot", "bytes", "rows", shard.alias("shard"), (F.col("version") + 1).cast("int").alias("version"))


def save_map(m: DataFrame, folder: str) -> None:
    """Add a version to the map's folder; earlier versions stay."""
    m.write.mode("append").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest by default."""
    every = spark.read.schema(MAP_SCHEMA).parquet(folder)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version)


def assign_shards(docs: DataFrame, m: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``virtual_slot`` and ``shard``, which take the place of columns of these names.

    The map has a fixed number of rows, so it is broadcast. Rows of one id, and all without one, share a slot.
    """
    n_slots = m.count()
    if n_slots > 1 << 20:
        raise ValueError("a map of over a million slots is not broadcast")
    pairs = F.broadcast(m.select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard")))
    placed = docs.withColumn("__vs", slot_of(id_col, n_slots)).join(pairs, F.col("__vs") == F.col("__slot"))
    others = [F.col(c) for c in docs.columns if c.lower() not in ("virtual_slot", "shard")]
    return placed.select(*others, F.col("__vs").alias("virtual_slot"), F.col("__shard").alias("shard"))


def shard_places(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard, virtual_slot), a row per row.

    The law is ``bytes``: shards near equal in size. ``slot`` counts a shard's rows from 0 without
    gaps: by virtual slot, then id, then text checksum. The count before a virtual slot comes from
    the map, so rows are ordered within virtual slots only. Null texts have size 1 and checksum 0.
    Rows that share an id stay together, null ids among themselves. Columns of ``docs`` other than id and
    text are ignored.
    """
    spark, folder = docs.sparkSession, fresh_path(docs.sparkSession, "slot-map")
    save_map(build_map(stored(slot_sizes(docs, n_slots, id_col, text_col), "slot-sizes"), n_shards), folder)
    m = load_map(spark, folder, version=1)
    first = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = stored(m.withColumn("first", first), "slot-firsts")
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("size"), F.crc32(F.coalesce(utf8(text_col), F.lit(b""))).alias("crc"), slot_of(id_col, n_slots).alias("vs"))
    nth = F.row_number().over(Window.partitionBy("vs").orderBy("id", "crc", "size")) - 1
    out = rows.withColumn("nth", nth).join(F.broadcast(m.select(F.col("slot").alias("vs"), "shard", "first")), "vs")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vs").alias("virtual_slot"))
