"""Arithmetic of image measurements: scale labels, scale-bar tests, particle summaries, rows for tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.exprs import let, number, rounded, text

# How a scale label reads.
LABEL = r"(?iU)(\d+(?:[.,]\d+)?)\s*(nm|nanometers?|(?:u|micro)m|micrometers?|mm|cm|m)\b"


def label_nm(x: Column) -> Column:
    """A scale label's length in nanometres; null without a number and a unit."""
    x = F.translate(x, "\u00b5\u03bc", "uu")
    unit = F.lower(F.regexp_extract(x, LABEL, 2))
    n = number(F.regexp_extract(x, LABEL, 1))
    factor = F.when(unit.startswith("n"), 1.0).when(unit.startswith("micro") | (unit == "um"), 1e3).when(unit == "mm", 1e6).when(unit == "cm", 1e7).when(unit == "m", 1e9)
    return n * factor


def scale_bar_like(w: Column, h: Column, y: Column, image_w: Column, image_h: Column) -> Column:
    """Whether a box can be a scale bar: wide, flat and in the lower part of its image."""
    wide = w >= F.greatest(F.lit(20), F.floor(image_w * 0.04))
    flat = (h >= 2) & (h <= F.greatest(F.lit(12), F.floor(image_h * 0.04))) & (w / F.greatest(h, F.lit(1)) >= 6)
    return wide & flat & (y >= F.floor(image_h * 0.45))


def scale_bar_confidence(w: Column, h: Column, y: Column, image_w: Column, image_h: Column) -> Column:
    aspect = F.least(F.lit(1.0), w / F.greatest(h, F.lit(1)) / 20.0)
    low = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (y / image_h - 0.45) / 0.45))
    wide = F.least(F.lit(1.0), w / F.greatest(F.lit(1.0), image_w * 0.25))
    return let(0.45 * aspect + 0.35 * low + 0.20 * wide, lambda c: rounded(c, 3))


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter))


def equivalent_diameter(area: Column) -> Column:
    return F.sqrt(4.0 * area / F.pi())


def particles(df: DataFrame, area: str, perimeter: str, image_area: str, nm_per_px: str, least_area: float = 20.0, most_share: float = 0.1) -> DataFrame:
    """Contours that can be particles, with circularity and diameters in pixels and nanometres."""
    ok = F.col(area).between(F.lit(least_area), most_share * F.col(image_area)) & (F.col(perimeter) > 0)
    d = equivalent_diameter(F.col(area))
    return df.where(ok).withColumns({"circularity": circularity(F.col(area), F.col(perimeter)), "diameter_px": d, "diameter_nm": d * F.col(nm_per_px)})


def summarize(df: DataFrame, keys: list[str], nm: str = "diameter_nm", px: str = "diameter_px") -> DataFrame:
    """Count, mean, median, sample deviation and range in nanometres, mean in pixels."""
    return df.groupBy(*keys).agg(F.count("*").alias("count"), F.avg(nm).alias("mean_diameter_nm"), F.percentile(nm, 0.5).alias("median_diameter_nm"), F.stddev_samp(nm).alias("std_diameter_nm"), F.min(nm).alias("min_diameter_nm"), F.max(nm).alias("max_diameter_nm"), F.avg(px).alias("mean_diameter_px"))


def nano_rows(summaries: DataFrame, hint: str = "material_formula") -> DataFrame:
    """Measurement rows from particle summaries with ``state``: usable, no_scale or no_material. Empty summaries give none."""
    nm = F.col("mean_diameter_nm")
    state = F.when(nm.isNull(), "no_scale").when(text(hint) == "", "no_material").otherwise("usable")
    reason = F.when(nm.isNull(), "vision particle measurements have no nm scale").when(text(hint) == "", "missing material formula hint for vision measurement").otherwise("")
    return summaries.where(F.col("count") > 0).withColumns({"state": state, "reason": reason, "property_name": F.lit("particle diameter"), "value": F.coalesce(nm, F.col("mean_diameter_px")), "unit": F.when(nm.isNull(), "px").otherwise("nm"), "source_type": F.lit("vision")})


def panel_kind(axis_pixels: Column, texture: Column, pixels: Column) -> Column:
    plot = axis_pixels > F.greatest(F.lit(120.0), 0.8 * texture)
    return F.when(plot, "plot_or_histogram").when(texture > F.greatest(F.lit(200.0), 0.01 * pixels), "microscopy").otherwise("unknown")


def distinct_warnings(x: Column, most: int = 5) -> Column:
    return F.slice(F.array_distinct(F.flatten(x)), 1, most)
