"""Formulas, property names and physical limits of nanomaterial measurements, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayloom.functions.exprs import contains_any, let, letters_key, short, text

# The chemical elements by atomic number.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
# Property names that count, by what they contain.
PROPERTY_TOKENS = ["size", "diameter", "radius", "length", "width", "hydrodynamic", "zeta", "km", "vmax", "kcat", "activity", "lod", "limit", "range", "ic50", "viability", "cytotoxicity", "ph", "temperature", "recovery", "rsd", "surface area", "bet", "pore", "rate", "velocity", "yield", "conversion", "selectivity"]
# Canonical names by the first of these that a name contains.
PROPERTY_NAMES = [("vmax", "Vmax"), ("kcat", "kcat"), (r"\bkm\b", "Km"), ("zeta", "zeta potential"), ("ic50", "IC50"), ("viability", "cell viability"), ("cytotoxic", "cytotoxicity"), ("diameter", "particle diameter"), ("hydrodynamic", "hydrodynamic size"), ("size", "particle size"), ("surface area|bet", "BET surface area"), ("limit|lod", "limit of detection"), ("range", "linear range"), ("ph", "optimum pH"), ("temp", "optimum temperature"), ("rsd", "RSD"), ("activity", "activity")]
# What one unit of length is in nanometres.
NANOMETRES = {1.0: ["nm", "nanometer", "nanometers"], 1e3: ["um", "µm", "μm", "micrometer", "micrometers"], 1e9: ["m", "meter", "meters"], 0.1: ["angstrom", "angstroms", "a", "å"]}
# An element with its count, and what names a supported catalyst; the texts of errors below are fixed too.
TOKEN = r"([A-Z][a-z]?)(\d+(?:\.\d+)?)?"
CATALYST = r"(?i)[-/@]|SBA|CNT|CNF|MOF|ZIF|SiO2|Al2O3|TiO2"


def clean_formula(x: Column | str) -> Column:
    """Plain digits and dashes, no white space, no charge at the end."""
    t = F.translate(text(x), "₀₁₂₃₄₅₆₇₈₉−–—", "0123456789---")
    return F.regexp_replace(F.regexp_replace(t, r"[\s\x0B\x1C-\x1F\x85\xA0]+", ""), r"(?<=[A-Za-z0-9)])\d*[+-]+$", "")


def formula_errors(x: Column | str) -> Column:
    """What is wrong with a formula, as texts; none for labels of supported catalysts with a known element."""
    given = text(x)
    return let(clean_formula(x), lambda f: let(F.regexp_extract_all(f, F.lit(TOKEN), F.lit(1)), lambda found: _errors(f, found, given)))


def checked_formula(x: Column | str) -> Column:
    """The cleaned formula, or empty text where it is not valid."""
    given = text(x)
    return let(clean_formula(x), lambda f: let(F.regexp_extract_all(f, F.lit(TOKEN), F.lit(1)), lambda found: F.when(F.size(_errors(f, found, given)) == 0, f).otherwise(F.lit(""))))


def _errors(f: Column, found: Column, given: Column) -> Column:
    known = F.array(*[F.lit(e) for e in ELEMENTS])
    unknown = F.transform(F.filter(found, lambda e: ~F.array_contains(known, e)), lambda e: F.concat(F.lit("unknown element '"), e, F.lit("' in formula '"), given, F.lit("'")))
    counts = F.regexp_extract_all(f, F.lit(TOKEN), F.lit(2))
    zero = F.transform(F.filter(counts, lambda c: (c != "") & (c.try_cast("double") <= 0)), lambda c: F.concat(F.lit("non-positive element count '"), c, F.lit("' in formula '"), given, F.lit("'")))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(f, TOKEN, ""), r"\d+(?:\.\d+)?", ""), r"[()\[\]{}.,;:+\-_/@·*]", "")
    left = let(rest, lambda r: F.when(r != "", F.array(F.concat(F.lit("unparsed formula fragment '"), r, F.lit("' in formula '"), given, F.lit("'")))).otherwise(F.array().cast("array<string>")))
    label = f.rlike(CATALYST) & F.exists(found, lambda e: F.array_contains(known, e))
    none = F.array().cast("array<string>")
    return F.when(f == "", F.array(F.lit("material_formula is empty"))).when(F.size(found) == 0, F.array(F.concat(F.lit("formula '"), given, F.lit("' has no elements")))).when(label, none).otherwise(F.concat(unknown, zero, left))


def property_allowed(x: Column | str) -> Column:
    return let(letters_key(text(x)), lambda key: contains_any(key, PROPERTY_TOKENS))


def canonical_property(x: Column | str) -> Column:
    """The canonical name of a property, with ``_lower`` or ``_upper`` kept; unknown ones as they are."""

    def named(stem: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, name in reversed(PROPERTY_NAMES):
            out = F.when(stem.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    def whole(key: Column) -> Column:
        end = F.when(key.endswith(" lower"), "_lower").when(key.endswith(" upper"), "_upper").otherwise("")
        return F.concat(let(F.trim(F.regexp_replace(key, " (lower|upper)$", "")), named), end)

    return F.coalesce(let(letters_key(text(x)), whole), text(x))


def size_in_nm(value: Column, unit: Column | str) -> Column:
    u = F.regexp_replace(F.lower(text(unit)), r"\s+", "")
    out = F.lit(None).cast("double")
    for factor, names in NANOMETRES.items():
        out = F.when(u.isin(names), value * F.lit(factor)).otherwise(out)
    return out


def sanity_errors(name: Column | str, value: Column, unit: Column | str) -> Column:
    """What is physically wrong with a value, as texts; the first kind of property a name contains decides."""
    bound = F.struct(F.lower(text(name)).alias("p"), F.lower(text(unit)).alias("u"), value.alias("v"), size_in_nm(value, unit).alias("nm"), short(value).alias("shown"))
    return let(bound, lambda b: _insane(b["p"], b["u"], b["v"], b["nm"], b["shown"], text(name), text(unit)))


def _insane(p: Column, u: Column, value: Column, nm: Column, shown: Column, name: Column, unit: Column) -> Column:
    said = lambda ok, *parts: F.when(ok, F.array().cast("array<string>")).otherwise(F.array(F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])))
    celsius = F.when(u.isin("k", "kelvin"), value - 273.15).otherwise(value)
    size = F.when(nm.isNull(), said(value > 0, name, " value must be positive")).when(nm < 0.1, said(F.lit(False), name, " value ", shown, " ", unit, " is below 0.1 nm")).otherwise(said(nm <= 1_000_000, name, " value ", shown, " ", unit, " is unrealistically large"))
    rest = F.concat(said(~F.contains(p, F.lit("recovery")) | value.between(0, 200), "recovery value ", shown, " is outside 0-200%"), said(~F.contains(p, F.lit("rsd")) | value.between(0, 100), "RSD value ", shown, " is outside 0-100%"), said(value >= 0, name, " value must not be negative"))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) <= 1.7976931348623157e308)
    return (
        F.when(~finite, said(F.lit(False), name, " value must be finite"))
        .when(F.contains(p, F.lit("ph")), said(value.between(0, 14), "pH value ", shown, " is outside 0-14"))
        .when(F.contains(p, F.lit("temp")), said(celsius >= -273.15, "temperature value ", shown, " ", unit, " is physically impossible"))
        .when(contains_any(p, ["size", "diameter", "radius", "length", "width"]), size)
        .when(contains_any(p, ["km", "vmax", "kcat", "lod", "limit", "range", "rate", "velocity"]), said(value > 0, name, " value must be positive"))
        .otherwise(rest)
    )
