"""Values out of names and texts, tolerant and strict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_number(name: Column, fallback: Column | None = None) -> Column:
    """The first run of digits as a long, or ``fallback``."""
    found = F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint")
    return found if fallback is None else F.coalesce(found, fallback.cast("bigint"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def participant(path: Column, pattern: str = r"(P\d+)") -> Column:
    """By pattern, else the parent folder's name, else "unknown"."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(F.regexp_extract(path, pattern, 1)), some(parent(path)), F.lit("unknown"))


def token(text: Column) -> Column:
    """Letters, digits, - and _ stay; runs of others become one _; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "_"), F.lit("_"))


def padded(number: Column, width: int = 6, extension: str = ".png") -> Column:
    return F.concat(F.lpad(number.cast("string"), width, "0"), F.lit(extension))


def tolerant_bool(value: Column) -> Column:
    """true/1/yes/y/t and false/0/no/n/f in any case; empty or null is false; anything else is null."""
    v = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(v.isin("true", "1", "1.0", "yes", "y", "t"), True).when(v.isin("false", "0", "0.0", "no", "n", "f", "", "nan", "none"), False)


def safe_int(value: Column) -> Column:
    return F.coalesce(F.floor(value.cast("string").try_cast("double")).cast("bigint"), F.lit(0).cast("bigint"))


def safe_float(value: Column) -> Column:
    v = value.cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def joined(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order, joined by |."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named])), "|")


def strict_int(name: str) -> Column:
    """The column as a long; a value that is none is an error."""
    c = F.col(name).cast("string").try_cast("double")
    bad = c.isNull() | (c != F.floor(c))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{name} holds no integer: "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))).otherwise(c.cast("bigint"))


def fps(value: Column, order: Column, default: float) -> Column:
    """Aggregate: the first positive number in file order, else ``default``."""
    v = safe_float(value)
    return F.coalesce(F.min_by(F.when(v > 0, v), F.when(v > 0, order)), F.lit(default))
