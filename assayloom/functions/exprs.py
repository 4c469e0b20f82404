"""Column expressions every operator shares: Python-like strip, falsy defaults, guarded numbers, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space.
SPACE = r"\s\x0B\x1C-\x1F\x85\xA0  -     　"
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Flags under which Java regular expressions read lines, case and classes as Unicode text wants.
MULTI = "(?imdU)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at both ends, all that Unicode counts as such."""
    return F.btrim(col(x), F.lit(SPACES))


def rstrip(x: Column | str) -> Column:
    return F.rtrim(col(x), F.lit(SPACES))


def text(x: Column | str) -> Column:
    """Any value as stripped text; null as empty text."""
    return F.coalesce(strip(col(x).cast("string")), F.lit(""))


def falsy_default(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty text, before any stripping; then stripped."""
    return text(F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in columns]))


def or_default(x: Column, default: Column | str) -> Column:
    """``x`` unless it is empty text."""
    return F.when(x != "", x).otherwise(F.lit(default) if isinstance(default, str) else default)


_NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def number(x: Column | str) -> Column:
    """A finite double from text with a decimal point or comma; null for all else."""
    # text that is no number is extracted as "", which casts to null, and what is too large as an infinity
    t = F.regexp_extract(F.replace(text(x), F.lit(","), F.lit(".")), _NUMBER, 0)
    n = F.replace(t, F.lit("_"), F.lit("")).try_cast("double")
    return F.nullif(F.nullif(n, F.lit(float("inf"))), F.lit(float("-inf")))


def rounded(x: Column | str, decimals: int) -> Column:
    """A double rounded by its exact binary value, halves to even, as C's ``printf`` does.

    Whole part and fraction are taken apart, which is exact. The fraction times 10**decimals is a rounded product and
    its error (Dekker's two-product), which decides where the product lands on a half. Name a column, or bind the
    value with ``let``: it is used many times.
    """
    if not 0 <= decimals <= 8:
        raise ValueError("0 to 8 decimals")
    return _rounded(col(x), F.lit(float(10**decimals)))


def _rounded(x: Column, scale: Column) -> Column:
    whole = F.floor(F.abs(x)).cast("double")
    f = F.abs(x) - whole
    high = f * 134217729.0 - (f * 134217729.0 - f)
    p = f * scale
    error = (high * scale - p) + (f - high) * scale
    n = F.floor(p).cast("double")
    odd = n % 2 == 1
    up = (p - n > 0.5) | ((p - n == 0.5) & ((error > 0) | ((error == 0) & odd)))
    steps = n + up.cast("double")
    r = F.when(whole < 2.0**52 / scale, (whole * scale + steps) / scale).otherwise(whole + steps / scale)
    return F.when(F.abs(x) < 2.0**52, F.signum(x) * r).otherwise(x)


def fixed(x: Column | str, decimals: int) -> Column:
    """A double as text with so many decimals, rounded as ``rounded`` does."""
    return F.when(col(x).isNotNull(), F.format_string(f"%.{decimals}f", rounded(x, decimals)))


def short(x: Column | str) -> Column:
    """A double as text with up to 6 significant digits, as C's ``%g``: trailing zeros go, very large and small ones have exponents."""
    plain = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)

    def shown(v: Column, said: Column) -> Column:
        exponent = F.substring_index(said, "e", -1).try_cast("int")

        def digits(e: Column) -> Column:
            with_exponent = F.concat(plain(F.substring_index(said, "e", 1)), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
            # after the point stand 5 less the exponent; beyond 8 places the text's own rounding must do
            near = F.when(e >= -3, _rounded(v, F.pow(F.lit(10.0), 5 - e))).otherwise(v)
            in_place = F.call_function("printf", F.concat(F.lit("%."), (5 - e).cast("string"), F.lit("f")), near)
            return F.when(e.between(-4, 5), plain(in_place)).otherwise(with_exponent)

        return F.when(v == 0, F.lit("0")).when(F.isnan(v), F.lit("nan")).when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).otherwise(let(exponent, digits))

    return let(col(x), lambda v: let(F.format_string("%.5e", v), lambda said: shown(v, said)))


def letters_key(x: Column | str) -> Column:
    """Lower case with every run of other than a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", " "))


def compact_key(x: Column | str) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(col(x)), r"[^\p{L}\p{N}]+", "")


def contains_any(x: Column, needles: tuple[str, ...] | list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(x, F.lit(n))
    return hit


def lookup(x: Column, table: dict) -> Column:
    """A small fixed table as an expression; null where there is no entry."""
    out = F.lit(None)
    for k, v in reversed(list(table.items())):
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def flag_list(*flags: Column) -> Column:
    """Flags joined by semicolons, nulls left out."""
    return F.concat_ws(";", *flags)


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def last_index(x: Column, needle: str) -> Column:
    """Position from 0 of the last occurrence of ``needle``, below 0 without one."""
    return F.length(x) - F.length(F.substring_index(x, needle, -1)) - len(needle)
