"""Personal data: four base kinds by rule, and a bootstrap that finds more by context.

DataFrame and SQL functions only. Seeds are the base spans and, for secrets, strings of well-known key
formats. The one or two words before or after a seed are lexical patterns; what stands by the same words
elsewhere is a candidate. Patterns and instances form a graph that is scored in rounds: a pattern is as
good as the share of its instances that are known, an instance as good as the patterns that bring it, and
what a round has found is known in the next, where it supports patterns of its own. In the end candidates
by good patterns are added as spans of the pattern's kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.exprs import let
from assayloom.llm.common import stored, workspace

KINDS = ["email", "ip", "card", "phone"]
#: Kinds of added spans: those of the base, and one that has no base rule.
FOUND = [*KINDS, "secret"]
SECRET = FOUND.index("secret")
# Matching starts where a run of the first class starts, or where the last match ended: the leftmost
# matches are the same, and a long run is read once. Possessive repeats never back up.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Seeds of secrets: access keys with their published prefixes, and bare hexadecimal keys of 160 or 256 bits.
SECRET_SEED = r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9_])"
#: What a candidate looks like: a run with a digit or an @ in it, after a space or other delimiter.
CANDIDATE = r"(?<![^\x20\x09-\x0D,;<>\"'=:\[])[A-Za-z0-9._%+()-]*[0-9@][A-Za-z0-9._%+@()-]*"
#: A number written in spaced or bracketed groups, of as many digits as the kind has at most, then the rest of its last
#: token. A full stop before a space ends it.
_GROUPS = r"(?<![^\x20\x09-\x0D,;<>\"'=:\[])[+(]*+[0-9](?:(?:(?!\.\x20)[\x20().-]){0,4}+[0-9]){0,%d}(?![0-9])[A-Za-z0-9._%%+@()-]*+"
#: Kinds whose candidates are such groups too.
GROUPED = {KINDS.index("card"): _GROUPS % 18, KINDS.index("phone"): _GROUPS % 14}
SPAN = "array<struct<start:int,stop:int,value:string,ctx:array<string>>>"
#: Words of contexts stand between these delimiters, without the marks at their ends.
_BETWEEN = r"[\x20\x09-\x0D,;<>\"'=:\[\]()][^\p{L}\p{M}\p{N}@]*+"
_MARKS = r"^[^\p{L}\p{M}\p{N}@]+|[^\p{L}\p{M}\p{N}@]+$"


def _beside(line: Column, broken: Column, edge: str, sign: str, turned: bool) -> Column:
    """The patterns on one side of a place: its nearest word, and its two nearest; none where no word is next.

    ``line`` is what stands there up to the end of the line or to the next candidate (``broken``: to the end of the
    line). A word with a digit or an @, and another candidate, is "#" and ends the context; so does the line's end.
    """
    parts = F.split(F.lower(F.reverse(line) if turned else line), _BETWEEN, 4)
    near = F.filter(F.transform(F.slice(parts, 1, 3), lambda w: F.regexp_replace(w, _MARKS, "")), lambda w: w != "")
    word = lambda w: F.when(w.rlike("[0-9@]"), F.lit("#")).otherwise(F.reverse(w) if turned else w)
    ends = F.when(broken, F.lit(edge)).otherwise(F.lit("#"))
    none = F.array().cast("array<string>")

    def patterns(ws: Column) -> Column:
        one = F.concat(F.lit(sign), F.get(ws, F.lit(0)))
        return F.when((F.get(ws, F.lit(0)) == "#") | (F.get(ws, F.lit(0)) == edge), none).otherwise(F.array(one, F.concat(one, F.lit(" "), F.get(ws, F.lit(1)))))

    found = let(F.concat(F.transform(F.slice(near, 1, 2), word), F.array(ends, F.lit("#"))), patterns)
    # a key of bounded length stands for a very long context
    return F.transform(found, lambda c: F.when(F.length(c) > 120, F.concat(F.lit(sign), F.md5(c.cast("binary")))).otherwise(c))


def matches(text: Column, pattern: str, needs: Column, contexts: bool = True) -> Column:
    """The pattern's leftmost non-overlapping matches as structs (start, stop, value, ctx), in code points.

    No pattern here matches a line break, so one at either end of the text makes its ends line ends.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")

    def ctx(x: Column) -> Column:
        before = _beside(F.substring_index(x["gap"], "\n", -1), F.contains(x["gap"], F.lit("\n")), "^", "<", True)
        after = _beside(F.substring_index(x["next"], "\n", 1), F.contains(x["next"], F.lit("\n")), "$", ">", False)
        return F.concat(before, after)

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("value"), (ctx(x) if contexts else none).alias("ctx"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def all_of(gaps: Column) -> Column:
        pairs = F.filter(F.arrays_zip(gaps.alias("gap"), F.slice(gaps, 2, F.size(gaps)).alias("next"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
        zero = F.struct(F.lit(-1).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(pairs, zero, place, lambda s: s["out"])

    framed = F.concat(F.lit("\n"), text, F.lit("\n"))
    return F.when(needs, let(F.split(framed, pattern, -1), all_of)).otherwise(F.array().cast(SPAN))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")

    def add(s: Column, i: Column) -> Column:
        d = F.get(back, i).cast("int") * (i % 2 + 1)
        return s + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.cast("double") <= 255)
    n = F.length(digits_of(x))
    if kind == "card":
        return F.when(n.between(12, 19), passes_luhn(digits_of(x))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _passing(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["value"])


def _tagged(i: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind_no"), x["stop"].alias("stop"), x["value"].alias("value"), x["ctx"].alias("ctx"))


def _is(i: int) -> Callable[[Column], Column]:
    return lambda x: x["kind_no"] == i


def base_spans(text: Column) -> Column:
    """All base spans as structs (start, kind_no, stop, value, ctx), sorted."""
    found = []
    for i, kind in enumerate(KINDS):
        needs = F.contains(text, F.lit("@" if kind == "email" else "+")) if kind in ("email", "phone") else text.rlike("[0-9]")
        found.append(F.transform(F.filter(matches(text, PATTERNS[kind], needs), _passing(kind)), _tagged(i)))
    return F.array_sort(F.concat(*found))


def secret_seeds(text: Column) -> Column:
    """Strings of known key formats, with a letter and a digit, as structs like base spans."""
    found = matches(text, SECRET_SEED, text.rlike("[0-9a-f]{40}|AKIA|gh[pousr]_"))
    return F.transform(F.filter(found, lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")), _tagged(SECRET))


def clear_of(candidates: Column, spans: Column) -> Column:
    """The candidates that overlap no span: two passes, from the left past the spans' ends, from the right past their starts."""
    kinds = "array<struct<start:int,stop:int,value:string,ctx:array<string>>>"

    def sweep(xs: Column, from_left: bool) -> Column:
        key = lambda x: x["start"] if from_left else -x["stop"]
        mine = F.transform(xs, lambda x: F.struct(key(x).alias("key"), F.lit(1).alias("own"), x.alias("x")))
        others = F.transform(spans, lambda b: F.struct(key(b).alias("key"), F.lit(0).alias("own"), F.struct(b["start"].alias("start"), b["stop"].alias("stop"), b["value"].alias("value"), b["ctx"].alias("ctx")).alias("x")))
        edge = lambda x: x["x"]["stop"] if from_left else -x["x"]["start"]

        def step(s: Column, x: Column) -> Column:
            far = F.when(x["own"] == 0, F.greatest(s["edge"], edge(x))).otherwise(s["edge"])
            out = F.when((x["own"] == 1) & (x["key"] >= s["edge"]), F.concat(s["out"], F.array(x["x"]))).otherwise(s["out"])
            return F.struct(far.alias("edge"), out.alias("out"))

        zero = F.struct(F.lit(-(2**31)).alias("edge"), F.array().cast(kinds).alias("out"))
        return F.aggregate(F.array_sort(F.concat(others, mine)), zero, step, lambda s: s["out"])

    none = (F.size(candidates) == 0) | (F.size(spans) == 0)
    return F.when(none, candidates).otherwise(sweep(sweep(candidates, True), False))


def grouped(text: Column, kind_no: int, base: Column) -> Column:
    """Candidates of several groups for a kind; one that runs into a base span ends before it."""

    def cut(x: Column) -> Column:
        at = F.array_min(F.transform(F.filter(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])), lambda b: b["start"]))
        value = F.when(at.isNull(), x["value"]).otherwise(F.regexp_replace(F.substring(x["value"], F.lit(1), F.greatest(at - x["start"], F.lit(0))), r"[^0-9A-Za-z)]+$", ""))
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(value)).cast("int").alias("stop"), value.alias("value"), x["ctx"].alias("ctx"))

    several = lambda x: F.contains(x["value"], F.lit(" "))
    found = F.filter(matches(text, GROUPED[kind_no], text.rlike(r"[0-9][().-]*\x20[\x20().-]*[0-9]")), several)
    return F.filter(F.transform(found, cut), several)


def kinds_of(x: Column) -> Column:
    """A bit for each kind that a candidate's value can be of."""
    n = F.length(digits_of(x))
    bit = lambda k, can: F.when(can, F.lit(1 << k)).otherwise(F.lit(0))
    secret = (F.length(x) >= 16) & x.rlike("[0-9]") & x.rlike("[A-Za-z]") & ~F.contains(x, F.lit("@"))
    return bit(0, F.contains(x, F.lit("@"))) + bit(1, (n >= 4) & F.contains(x, F.lit("."))) + bit(2, n.between(12, 19)) + bit(3, n.between(7, 15)) + bit(SECRET, secret)


def likely_share(known: Column, n: Column, z: float = 1.645) -> Column:
    """The lower end of Wilson's interval for a share of ``known`` in ``n``: few instances make no good pattern."""
    p = known / n
    return (p + z * z / (2 * n) - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _apart(spans: Column) -> Column:
    """Of spans sorted by start, those that no earlier one of them reaches into."""
    kind = "array<struct<start:int,kind_no:int,stop:int>>"

    def step(s: Column, x: Column) -> Column:
        one = F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["stop"].alias("stop"))
        free = x["start"] >= s["at"]
        return F.struct(F.when(free, x["stop"]).otherwise(s["at"]).alias("at"), F.when(free, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_support: int = 3, least_pattern: float = 0.5, least_score: float = 0.5) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base, extra), a row per row; spans as arrays of structs.

    ``n_*`` count base spans. ``extra`` are the bootstrap's: none overlaps a base span or another of them.
    Candidates are tokens and, for cards and phones, the spaced groups of a number as one; where two
    overlap, the one that starts first counts, then the better score, then the longer. A pattern counts with
    ``least_support`` distinct known instances and a likely share of known ones of ``least_pattern``
    (``likely_share``); instances of ``least_score`` are known in the next round. Seeds of secrets are spans
    only where a good pattern brings them.

    Null texts are empty, null ids are kept. Rows that share an id and a text share their spans. Other
    columns are ignored. Values stand in the tables in between as digests only, and these tables go in the end.
    """
    with workspace(docs.sparkSession, "pii") as keep:
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
        rows = rows.withColumn("h", F.xxhash64("t")).withColumns({"base": base_spans(F.col("t")), "keys": secret_seeds(F.col("t"))})
        rows = rows.withColumn("keys", F.filter("keys", lambda k: ~F.exists("base", lambda b: (b["start"] < k["stop"]) & (k["start"] < b["stop"]))))
        taken = F.concat("base", "keys")
        rows = rows.withColumns({"other": clear_of(matches(F.col("t"), CANDIDATE, F.col("t").rlike("[0-9@]")), taken), **{f"many{k}": grouped(F.col("t"), k, taken) for k in GROUPED}})
        node = lambda x, kind, fits: F.struct(kind.cast("int").alias("kind_no"), fits.cast("int").alias("fits"), x["start"].alias("start"), x["stop"].alias("stop"), F.unhex(F.md5(x["value"].cast("binary"))).alias("key"), x["ctx"].alias("ctx"))
        every, unknown = F.lit((1 << len(FOUND)) - 1), F.lit(None)
        several = lambda k: F.transform(f"many{k}", lambda x: node(x, unknown, kinds_of(x["value"]).bitwiseAND(F.lit(1 << k))))
        seen = F.concat(F.transform(taken, lambda x: node(x, x["kind_no"], every)), F.transform("other", lambda x: node(x, unknown, kinds_of(x["value"]))), *[several(k) for k in GROUPED])
        base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind_no"].alias("kind_no"), b["stop"].alias("stop")))
        table = keep(rows.select("id", "h", base.alias("base"), F.filter(seen, lambda x: (F.size(x["ctx"]) > 0) & (x["fits"] > 0)).alias("seen")), "spans")

        bit = lambda c, k: F.col(c).bitwiseAND(F.call_function("shiftleft", F.lit(1), k if isinstance(k, Column) else F.lit(k))) > 0
        uses = table.select(F.explode("seen").alias("x")).select(F.explode("x.ctx").alias("ctx"), "x.key", "x.kind_no", "x.fits")
        pairs = keep(uses.groupBy("ctx", "key").agg(F.bit_or("fits").alias("fits"), F.coalesce(F.bit_or(F.when(F.col("kind_no").isNull(), F.col("fits"))), F.lit(0)).alias("free"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("kind_no"))).alias("own")), "pairs")
        # a context of fewer distinct values than a pattern needs known ones never makes a pattern
        sizes = pairs.groupBy("ctx").agg(*[F.sum(bit("fits", k).cast("long")).alias(f"n{k}") for k in range(len(FOUND))])
        sizes = sizes.where(F.greatest(*[f"n{k}" for k in range(len(FOUND))]) >= least_support)
        sizes = keep(sizes.select("ctx", F.explode(F.array(*[F.struct(F.lit(k).alias("kind_no"), F.col(f"n{k}").alias("n")) for k in range(len(FOUND))])).alias("s")).select("ctx", "s.*").where(F.col("n") >= least_support), "sizes")
        pairs = keep(pairs.join(sizes.select("ctx").distinct(), "ctx", "left_semi"), "graph")
        seeds = keep(pairs.where("own is not null").select("key", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(FOUND) - 1)), lambda k: F.col("own").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) > 0)).alias("kind_no")).distinct().withColumn("score", F.lit(1.0)), "seeds")
        known, good = seeds, None
        for _ in range(rounds):
            held = pairs.select("ctx", "key", "fits").join(known, "key").where(bit("fits", F.col("kind_no"))).groupBy("ctx", "kind_no").agg(F.sum("score").alias("known"), F.count("*").alias("support"))
            scored = held.where(F.col("support") >= least_support).join(sizes, ["ctx", "kind_no"]).withColumn("p", likely_share(F.col("known"), F.col("n")))
            good = keep(scored.where(F.col("p") >= least_pattern).select("ctx", "kind_no", "p"), "patterns")
            brought = pairs.where("free > 0").select("ctx", "key", "free").join(good, "ctx").where(bit("free", F.col("kind_no")))
            score = F.lit(1.0) - F.exp(F.sum(F.log(F.greatest(F.lit(1.0) - F.col("p"), F.lit(1e-9)))))
            fresh = brought.groupBy("key", "kind_no").agg(score.alias("score")).where(F.col("score") >= least_score).join(seeds.select("key", "kind_no"), ["key", "kind_no"], "left_anti")
            known = keep(seeds.unionByName(fresh), "instances")
        hits = table.select("id", "h", F.explode("seen").alias("x")).where(f"x.kind_no is null or x.kind_no = {SECRET}").select("id", "h", "x.start", "x.stop", "x.key", "x.fits", F.col("x.kind_no").alias("own"), F.explode("x.ctx").alias("ctx"))
        hits = hits.join(good, "ctx").where(bit("fits", F.col("kind_no")) & (F.col("own").isNull() | (F.col("own") == F.col("kind_no")))).join(known, ["key", "kind_no"])
        best = hits.groupBy("id", "h", "start").agg(F.max(F.struct("score", "stop", (-F.col("kind_no")).alias("k"))).alias("b"))
        extra = best.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("b.k")).alias("kind_no"), F.col("b.stop").alias("stop")))).alias("extra"))
        extra = extra.select(F.col("id").alias("eid"), F.col("h").alias("eh"), _apart(F.col("extra")).alias("extra"))
        out = table.join(extra, F.col("id").eqNullSafe(F.col("eid")) & (F.col("h") == F.col("eh")), "left")
        empty = F.array().cast("array<struct<start:int,kind_no:int,stop:int>>")
        found = stored(out.select("id", "base", F.coalesce("extra", empty).alias("extra")), "pii-spans")
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("id").alias(id_col), *counts, "base", "extra")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in FOUND])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra, n_spans); edge cases as in ``find_spans``."""
    found = find_spans(docs, id_col, text_col, **options)
    every = F.array_sort(F.concat("base", "extra"))
    sizes = [F.size("extra").cast("long").alias("n_extra"), (F.size("base") + F.size("extra")).cast("long").alias("n_spans")]
    return found.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(every).alias("spans"), *sizes)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, text) with every span replaced by its kind in brackets; where spans overlap, the first counts.

    Null texts come back empty. Rows that share an id must share their text.
    """
    found = find_spans(docs, id_col, text_col, **options).select(F.col(id_col).alias("rid"), F.array_sort(F.concat("base", "extra")).alias("spans")).dropDuplicates(["rid"])
    both = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(found, F.col("id").eqNullSafe(F.col("rid")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in FOUND])

    def put(s: Column, x: Column) -> Column:
        piece = F.concat(s["out"], F.substring(F.col("t"), s["at"] + 1, x["start"] - s["at"]), F.get(names, x["kind_no"]))
        use = x["start"] >= s["at"]
        return F.struct(F.when(use, x["stop"]).otherwise(s["at"]).alias("at"), F.when(use, piece).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate("spans", start, put, lambda s: F.concat(s["out"], F.substring(F.col("t"), s["at"] + 1, F.length("t"))))
    return both.select(F.col("id").alias(id_col), text.alias(text_col))
