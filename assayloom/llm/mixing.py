"""Mixing sources to target weights by hierarchical budgets. DataFrame and SQL functions only.

Leaves are (domain, language, source). The token budget goes down the tree by weight. A leaf can give
``max_epochs`` times its tokens; what it can't give its siblings share, by weight, and only what they
can't give either goes up to the parent's siblings. Each leaf then takes a prefix of its documents in
the order of a seeded hash, a fresh order in each epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.common import stored

LEVELS = ["domain", "lang", "source"]


def token_count(text_col: str = "text") -> Column:
    """A text's tokens for budgets: its bytes over 4, rounded up; 0 for null and empty."""
    return F.ceil(F.coalesce(F.octet_length(text_col), F.lit(0)) / 4).cast("long")


def _share(df: DataFrame, parent: list[str | Column]) -> DataFrame:
    """Deal each parent's ``budget`` to its children by ``weight``, each between its ``floor`` and ``capacity``; adds ``give``.

    A child gets its weight times a level, but no less than its floor and no more than its capacity. What the
    children get together grows with the level and bends only where one leaves its floor or fills up: running
    sums over these points, two for a child, say between which two the budget lies. Nothing is left undealt
    unless every child with a weight is full. A budget under the floors gives the floors.
    """
    w = Window.partitionBy(*parent)
    upto = w.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def point(at: str, sign: int) -> Column:
        of = lambda x: F.when(F.col("weight") > 0, x).otherwise(F.lit(0.0))
        return F.struct(F.lit(sign > 0).alias("leaves"), of(F.col(at) / F.nullif("weight", F.lit(0.0))).alias("level"), of(F.col("weight") * sign).alias("turn"), of(F.col(at) * sign).alias("jump"))

    df = df.withColumn("weight", F.col("weight").cast("double")).withColumn("point", F.explode(F.array(point("floor", 1), point("capacity", -1)))).select("*", "point.*").drop("point")
    df = df.withColumn("slope", F.sum("turn").over(upto)).withColumn("base", F.sum(F.when(F.col("leaves"), F.col("floor"))).over(w) - F.sum("jump").over(upto))
    df = df.withColumn("dealt", F.col("base") + F.col("level") * F.col("slope"))
    df = df.withColumn("last", F.max(F.when(F.col("dealt") <= F.col("budget"), F.struct("level", "dealt", "slope"))).over(w))
    df = df.withColumn("next", F.min(F.when(F.col("level") > F.col("last.level"), F.col("level"))).over(w))
    rise = F.when(F.col("last.slope") > 0, (F.col("budget") - F.col("last.dealt")) / F.nullif(F.col("last.slope"), F.lit(0.0))).otherwise(F.lit(0.0))
    level = F.coalesce(F.least(F.col("last.level") + rise, F.col("next")), F.lit(0.0))
    full = (F.col("weight") > 0) & (level * F.col("weight") >= F.col("capacity") * (1 - 1e-12))
    df = df.withColumn("give", F.when(full, F.col("capacity")).otherwise(F.greatest(F.col("floor"), level * F.col("weight"))))
    return df.where("leaves").drop("leaves", "level", "turn", "jump", "slope", "base", "dealt", "last", "next")


def _asked(weights: dict[str, dict[str, float]], levels: list[str]) -> Column:
    """Whether no level of a leaf has a named weight of 0."""
    asked = F.lit(True)
    for lv in levels:
        for value in (v for v, x in weights.get(lv, {}).items() if x <= 0):
            asked = asked & (F.col(lv) != value)
    return asked


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: float | None = None, total_share: float = 1.0, max_epochs: float = 2.0, levels: list[str] = LEVELS, least_epochs: float = 0.0) -> DataFrame:
    """(levels, tokens, budget) of every leaf.

    ``leaves`` has the level columns and ``tokens``. ``weights`` gives a level's nodes theirs by value
    (nodes it doesn't name: 1); nodes of a level without weights weigh what tokens they have. The total
    is ``total``, or ``total_share`` of all tokens. Every leaf keeps ``least_epochs`` times its tokens whatever the
    weights (the total is raised to what that takes), so they steer only what is beyond; a leaf under a named
    weight of 0 keeps and gives nothing. Each level is settled from the top down against the capacities of
    whole subtrees, which hands a shortage to siblings before it leaves the parent.
    """
    most = F.when(_asked(weights, levels), F.col("tokens")).otherwise(F.lit(0))
    leaves = leaves.withColumn("capacity", most * F.lit(float(max_epochs))).withColumn("floor", most * F.lit(float(min(least_epochs, max_epochs))))
    top = F.lit(float(total)) if total is not None else F.sum(F.col("tokens").cast("double")).over(Window.partitionBy(F.lit(1))) * total_share
    given = None
    for depth in range(1, len(levels) + 1):
        own, parent = levels[:depth], levels[: depth - 1]
        nodes = leaves.groupBy(*own).agg(F.sum("capacity").alias("capacity"), F.sum("floor").alias("floor"), F.sum("tokens").alias("tokens"))
        weight = F.col("tokens").cast("double")
        if named := weights.get(own[-1]):
            weight = F.lit(1.0)
            for value, x in sorted(named.items()):
                weight = F.when(F.col(own[-1]) == value, F.lit(float(x))).otherwise(weight)
        nodes = nodes.withColumn("weight", weight)
        nodes = nodes.withColumn("budget", top) if given is None else nodes.join(given, parent)
        dealt = _share(nodes, parent or [F.lit(1)])
        given = stored(dealt.select(*own, F.col("give").alias("budget"), "tokens"), "budgets")
        if depth < len(levels):
            given = given.drop("tokens")
    return given


def order_key(id_col: Column, epoch: Column, seed: int) -> Column:
    """Where a document stands in its leaf's order of an epoch: 60 bits of a seeded MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: dict[str, dict[str, float]], domain: Column | None = None, total: float | None = None, total_share: float = 1.0, max_epochs: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", bucket_bits: int = 12, least_epochs: float = 0.0, epoch_col: str = "mix_epoch") -> DataFrame:
    """``docs``, each row once for every epoch that takes it, with the epoch (from 0) in ``epoch_col``, which
    takes the place of a column of that name.

    A leaf's budget of b tokens out of t takes floor(b / t) whole epochs and, of the next, the longest
    prefix within what is left; documents whose keys tie go together. Null level values are the level
    "". Documents without tokens go where the cut falls; a leaf of nothing else is taken once. Weights of 0 give a node nothing. With ``least_epochs`` of
    1 each document of the others is taken at least once.

    No leaf is ordered in one place: tokens are summed by leaf and the key's first ``bucket_bits`` bits,
    running sums over these find the bucket in which a leaf's cut falls, and only rows of such
    buckets are ordered. The cut keys are a row per leaf, joined back; Spark broadcasts them if they are small.
    Rows that share an id share their key, so null ids of a leaf go in or out together.
    """
    tagged = docs
    names = {lv: f"__mix_{lv}" for lv in LEVELS}
    tagged = tagged.withColumn(names["domain"], F.coalesce(domain if domain is not None else F.lit("all"), F.lit("")))
    for lv in LEVELS[1:]:
        tagged = tagged.withColumn(names[lv], F.coalesce(F.col(lv).cast("string"), F.lit("")))
    keys = list(names.values())
    narrow = tagged.select(*[F.col(k).alias(lv) for lv, k in names.items()], F.col(id_col).alias("id"), token_count(text_col).alias("n"))
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    b = budgets(stored(leaves, "leaves"), weights, total, total_share, max_epochs, least_epochs=least_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") * (1 + 1e-12))).otherwise(_asked(weights, LEVELS).cast("int")).cast("int")
    b = stored(b.withColumn("whole", whole).withColumn("rest", F.greatest(F.col("budget") - F.col("whole") * F.col("tokens"), F.lit(0.0))).select(*LEVELS, "whole", "rest"), "leaf-budgets")
    # the cut of the last, partial epoch
    last = narrow.join(b, LEVELS).withColumn("key", order_key(F.col("id"), F.col("whole"), seed))
    last = last.withColumn("bucket", F.shiftright("key", 60 - bucket_bits))
    sums = last.groupBy(*LEVELS, "bucket").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    edge = sums.where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", "before")).alias("e")).select(*LEVELS, F.col("e.bucket").alias("bucket"), F.col("e.before").alias("before"))
    edge = stored(edge, "edges")
    # rows of one key, of a repeated id say, are summed up before any are ordered
    inside = last.join(edge, [*LEVELS, "bucket"]).groupBy(*LEVELS, "key", "before", "rest").agg(F.sum("n").alias("n"))
    run = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    taken = inside.withColumn("run", run).where("run <= rest").groupBy(*LEVELS).agg(F.max("key").alias("in_edge"))
    floor_key = F.shiftleft(F.col("bucket").cast("long"), 60 - bucket_bits) - 1
    cuts = b.join(edge.select(*LEVELS, "bucket"), LEVELS, "left").join(taken, LEVELS, "left")
    cuts = cuts.withColumn("cut", F.when(F.col("bucket").isNull(), F.lit(2**60)).otherwise(F.coalesce("in_edge", floor_key)))
    # a leaf whose prefix is everything, with nothing left to give, has no partial epoch
    cuts = stored(cuts.select(*[F.col(lv).alias(names[lv]) for lv in LEVELS], F.col("whole").alias("__mix_whole"), F.when((F.col("rest") <= 0), F.lit(-1)).otherwise(F.col("cut")).alias("__mix_cut")), "cuts")
    out = tagged.join(cuts, keys)
    partial = order_key(F.col(id_col), F.col("__mix_whole"), seed) <= F.col("__mix_cut")
    epochs = F.col("__mix_whole") + partial.cast("int")
    out = out.withColumn("__mix_epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(0), epochs - 1)).otherwise(F.array().cast("array<int>"))))
    return out.select(*[F.col(c) for c in docs.columns if c.lower() != epoch_col.lower()], F.col("__mix_epoch").alias(epoch_col))
