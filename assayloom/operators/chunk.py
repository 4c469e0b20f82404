"""Sections of an article and overlapping chunks that end at soft boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.exprs import MULTI, SPACE, last_index, let, letters_key, strip
from assayloom.operators.text import line_ends

# The headings that start a section, and the sections taken by default.
HEADINGS = ["abstract", "introduction", "background", "related work", "methods", "materials and methods", "experimental", "experimental section", "results", "results and discussion", "discussion", "conclusion", "conclusions", "references", "acknowledgements", "appendix"]
TARGETS = ["experimental", "experimental section", "methods", "materials and methods", "results", "results and discussion", "discussion"]
_S = r"[\s\x1c-\x1f]"
HEADING = rf"{MULTI}^(?:#{{1,6}}{_S}+|\d+(?:\.\d+)*\.?{_S}+)?({'|'.join(HEADINGS)}){_S}*$"


def sections_of(x: Column) -> Column:
    """An array of (title, body); text before the first heading is ``Preamble``, text without headings ``Document``."""
    return let(strip(line_ends(x)), _sections)


def _sections(t: Column) -> Column:
    titles = F.transform(F.regexp_extract_all(t, F.lit(HEADING), F.lit(1)), lambda y: strip(F.regexp_replace(F.replace(y, F.lit("#"), F.lit("")), rf"[{SPACE}]+", " ")))
    bodies = F.transform(F.split(t, HEADING, -1), strip)
    named = F.zip_with(F.concat(F.array(F.lit("Preamble")), titles), bodies, lambda a, b: F.struct(a.alias("title"), b.alias("body")))
    whole = F.array(F.struct(F.lit("Document").alias("title"), t.alias("body")))
    return F.filter(F.when(t.rlike(HEADING), named).otherwise(whole), lambda s: s["body"] != "")


def selected(title: Column, targets: list[str]) -> Column:
    """Whether a title holds a target or a target holds it, both as plain words."""
    key = letters_key(title)
    hit = F.lit(False)
    for t in dict.fromkeys(" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()).split()) for x in targets):
        hit = hit | F.contains(key, F.lit(t)) | F.contains(F.lit(t), key)
    return hit


def soft_end(t: Column, start: Column, hard: Column) -> Column:
    """Where a chunk ends: after the last blank line, sentence, semicolon or line in the window's second half."""
    half = F.floor((hard - start) * 0.5)

    def end(window: Column) -> Column:
        out = hard
        for separator in ["\n", "; ", ". ", "\n\n"]:
            at = last_index(window, separator)
            out = F.when(at >= half, start + at + len(separator)).otherwise(out)
        return out.cast("int")

    return let(F.substring(t, start + 1, hard - start), end)


_CHUNK = "struct<start:int,stop:int,text:string>"


def bounds(t: Column, n: Column, max_chars: int, overlap: int) -> Column:
    """The (start, stop, text) of each chunk of a text of ``n`` characters, in order.

    The fold has as many steps as chunks can be needed; a step moves on by more than half a window
    less the overlap, or at least by one place where the overlap is larger than that.
    """
    least = max(1, max_chars // 2 - overlap)
    steps = F.sequence(F.lit(0), F.ceil(n / least).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_CHUNK}>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        stop = F.when(s["at"] + max_chars >= n, n).otherwise(soft_end(t, s["at"], s["at"] + max_chars))
        moved = let(stop, lambda e: F.struct(F.when(e >= n, F.lit(-1)).when(e - overlap > s["at"], e - overlap).otherwise(e).cast("int").alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), e.alias("stop"), F.substring(t, s["at"] + 1, e - s["at"]).alias("text")))).alias("out")))
        return F.when((s["at"] < 0) | (s["at"] >= n), s).otherwise(moved)

    return F.aggregate(steps, start, step, lambda s: s["out"])


def parts_of(df: DataFrame, id_col: str, text_col: str, targets: list[str] | None, max_chars: int, overlap: int) -> DataFrame:
    """(id_col, section, section_title, part, start_char, end_char, text) of the chunks of the selected sections, row by row.

    Where no section is selected the whole text is the section ``Document``.
    """
    if max_chars < 500 or overlap < 0 or overlap >= max_chars:
        raise ValueError("max_chars must be 500 or more, overlap from 0 to less than max_chars")
    t = F.coalesce(F.col(text_col), F.lit(""))
    chosen = F.filter(sections_of(t), lambda s: selected(s["title"], targets or TARGETS))
    whole = F.filter(F.array(F.struct(F.lit("Document").alias("title"), strip(t).alias("body"))), lambda s: s["body"] != "")
    parts = df.select(F.col(id_col), let(chosen, lambda c: F.when(F.size(c) > 0, c).otherwise(whole)).alias("parts"))
    parts = parts.select(id_col, F.posexplode("parts").alias("section", "s"))
    parts = parts.select(id_col, "section", F.col("s.title").alias("section_title"), strip(F.concat(F.lit("## "), "s.title", F.lit("\n\n"), "s.body")).alias("t"))
    # the section's text and length are columns of their own, so that the fold's lambdas only name them
    cut = parts.withColumn("n", F.length("t")).select(id_col, "section", "section_title", F.posexplode(bounds(F.col("t"), F.col("n"), max_chars, overlap)).alias("part", "b"))
    cut = cut.select(id_col, "section", "section_title", "part", F.col("b.start").alias("start_char"), F.col("b.stop").alias("end_char"), strip("b.text").alias("text"))
    return cut.where(F.col("text") != "")


def chunk_articles(df: DataFrame, id_col: str, text_col: str, targets: list[str] | None = None, max_chars: int = 6000, overlap: int = 400) -> DataFrame:
    """(id_col, index, section_title, text, start_char, end_char) of the chunks of the selected sections.

    Offsets count from the start of a section with its title line. Where no section is selected the whole
    text is the section ``Document``. ``index`` runs through an article from 0; blank chunks take none.
    """
    cut = parts_of(df, id_col, text_col, targets, max_chars, overlap)
    index = F.row_number().over(Window.partitionBy(id_col).orderBy("section", "part")) - 1
    return cut.select(id_col, index.cast("int").alias("index"), "section_title", "text", "start_char", "end_char")
