"""Cleaning of article text and the scan for concentrations, on one text column per article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.exprs import MULTI, SPACE, contains_any, let, number, rstrip, strip

_S, _NS = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"
# Headings after which an article's text ends.
TRAILING = rf"{MULTI}^{_S}*(?:#{{1,6}}{_S}*)?(?:\d+(?:\.\d+)*\.?{_S}*)?(?:references?|bibliography|literature cited|references and notes|acknowledg(?:e)?ments?|funding){_S}*$"
# Lines that pages leave in a text.
PAGE_NUMBER = rf"{MULTI}^{_S}*(?:page{_S}*)?\d{{1,4}}{_S}*(?:of{_S}+\d{{1,4}})?{_S}*$"
PAGE_LINE = rf"{MULTI}^{_S}*(?:downloaded from .+|(?:https?://|www\.).+|doi:{_S}*10\.{_NS}+|(?:copyright|©).+|all rights reserved\.?){_S}*$"
TABLE_HEADING = rf"{MULTI}^## Table \d+(?:{_S}*\([^)]*\))?{_S}*$"
HEADER_TOKENS = ["downloaded", "copyright", "all rights reserved", "doi:", "journal", "volume", "vol.", "issue", "www.", "http://", "https://"]
# Micrograms per millilitre, with relation and range.
UNIT = rf"(?:ug|mcg|µg|μg|microgram(?:s)?){_S}*(?:/|per){_S}*m(?:l|L)"
MENTION = rf"(?iU)(<=|>=|<|>|=|~|ca\.?|about|approximately)?{_S}*(\d+(?:[.,]\d+)?)(?:{_S}*(?:-|–|—|to){_S}*(\d+(?:[.,]\d+)?))?{_S}*({UNIT})"


def line_ends(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def cut_trailing(x: Column) -> Column:
    """The text before its first line that is only a closing heading."""
    return let(x, lambda t: let(F.regexp_instr(t, F.lit(TRAILING)), lambda at: F.when(at > 0, rstrip(F.substring(t, F.lit(1), at - 1))).otherwise(t)))


def line_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(strip(x)), rf"[{SPACE}]+", " ")


def header_like(x: Column) -> Column:
    """Whether a line looks like a page header or footer."""
    return let(F.lower(strip(x)), lambda t: (t != "") & (F.length(t) <= 120) & ~t.startswith("|") & contains_any(t, HEADER_TOKENS))


def drop_repeated_headers(x: Column, least: int = 3) -> Column:
    """Without the lines seen ``least`` times or more, of which any looks like a header."""

    # the keys of all lines are made only where some line looks like a header
    def drop(lines: Column) -> Column:
        suspects = F.array_distinct(F.transform(F.filter(lines, header_like), line_key))
        return let(suspects, lambda some: F.when(F.size(some) > 0, let(F.transform(lines, lambda y: F.struct(y.alias("line"), line_key(y).alias("key"))), lambda keyed: without(keyed, some))).otherwise(x))

    def without(keyed: Column, suspects: Column) -> Column:
        gone = F.filter(suspects, lambda k: F.size(F.filter(keyed, lambda y: y["key"] == k)) >= least)
        return let(gone, lambda g: F.when(F.size(g) > 0, F.array_join(F.transform(F.filter(keyed, lambda y: ~F.array_contains(g, y["key"])), lambda y: y["line"]), "\n")).otherwise(x))

    return let(F.split(x, "\n", -1), drop)


def drop_page_lines(x: Column) -> Column:
    return let(F.regexp_replace(F.regexp_replace(x, PAGE_NUMBER, ""), PAGE_LINE, ""), drop_repeated_headers)


def clean_body(x: Column) -> Column:
    t = drop_page_lines(cut_trailing(line_ends(x)))
    return strip(F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t]++$", ""), "\n{3,}", "\n\n"))


def clean_markdown(df: DataFrame, text_col: str = "markdown") -> DataFrame:
    """Clean a document's body and put its appended tables, untouched, after it."""

    def cleaned(t: Column) -> Column:
        # one search finds where tables begin; what each step makes is bound, not written out at every use
        def parts(at: Column) -> Column:
            body = F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t)
            tables = F.when(at > 0, strip(F.substring(t, at, F.length(t))))
            return F.concat_ws("\n\n", let(clean_body(body), lambda b: F.when(b != "", b)), let(tables, lambda x: F.when(x != "", x)))

        return let(F.regexp_instr(t, F.lit(TABLE_HEADING)), parts)

    return df.withColumn(text_col, let(F.coalesce(F.col(text_col), F.lit("")), cleaned))


def relation_of(x: Column) -> Column:
    r = F.lower(F.nullif(strip(x), F.lit("")))
    return F.when(r.isin("ca", "ca.", "about", "approximately"), "~").otherwise(r)


def pmic(value: Column, weight: Column) -> Column:
    """Minus the decimal logarithm of a concentration in micrograms per millilitre as molarity."""
    return F.when((value > 0) & (weight > 0), -F.log10(value * 1e-3 / weight))


def mentions(df: DataFrame, id_col: str, text_col: str, weight: Column | None = None) -> DataFrame:
    """A row per concentration mention: raw text, relation, values, pMIC where ``weight`` is known, code-point offsets."""
    w = weight if weight is not None else F.lit(None).cast("double")
    df = df.select(F.col(id_col), w.alias("w"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # one search for the mentions and one for what stands between them; their parts are read from the mentions alone
    pairs = F.filter(F.arrays_zip(F.split("t", MENTION, -1).alias("gap"), F.regexp_extract_all("t", F.lit(MENTION), F.lit(0)).alias("raw")), lambda p: p["raw"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<raw:string,start:int,stop:int>>").alias("out"))

    def place(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["gap"])
        stop = start + F.length(p["raw"])
        return F.struct(stop.alias("at"), F.concat(s["out"], F.array(F.struct(p["raw"].alias("raw"), start.alias("start"), stop.alias("stop")))).alias("out"))

    df = df.select(id_col, "w", F.posexplode(F.aggregate(pairs, zero, place, lambda s: s["out"])).alias("mention", "m"))
    part = lambda g: F.nullif(F.regexp_extract("m.raw", MENTION, g), F.lit(""))
    df = df.select(id_col, "w", "mention", "m.*", relation_of(F.regexp_extract("m.raw", MENTION, 1)).alias("relation"), number(part(2)).alias("value_ug_ml"), number(part(3)).alias("upper_value_ug_ml"))
    return df.select(id_col, "mention", strip("raw").alias("raw_text"), "relation", "value_ug_ml", "upper_value_ug_ml", pmic(F.col("value_ug_ml"), F.col("w")).alias("pmic"), pmic(F.col("upper_value_ug_ml"), F.col("w")).alias("upper_pmic"), F.col("start").alias("start_char"), F.col("stop").alias("end_char"))
