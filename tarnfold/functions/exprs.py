"""Column expressions whose null and order rules differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def trim_u(c: Column) -> Column:
    """Trim white space of any script, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    """Null where nothing but white space is left; other text stays as it is."""
    return F.when(trim_u(c) != "", c)


def count_filled(*cols: Column) -> Column:
    """How many of the columns hold something: neither null nor blank."""
    return sum((F.when(trim_u(c.cast("string")) != "", 1).otherwise(0) for c in cols), F.lit(0))


def days_between(later: Column, earlier: Column) -> Column:
    """Exact days as a float, rounded half to even at six places."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.bround((micros(later) - micros(earlier)) / F.lit(float(DAY_MICROS)), 6)


def count_map(pairs: Column) -> Column:
    """A stable JSON text of (key, count) structs, sorted by key."""
    return F.to_json(F.map_from_entries(F.array_sort(pairs)))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def canonical(c: Column, kind: str) -> Column:
    """V1, G1: a business value as text in one form: trimmed, blank is null, 1.0 is 1, lists are sets in order, times ISO."""
    if kind == "string":
        return F.nullif(trim_u(c), F.lit(""))
    if kind in ("float", "double") or kind.startswith("decimal"):
        whole = c.cast("double") == F.floor(c.cast("double"))
        short = c.cast("string") if kind in ("float", "double") else F.regexp_replace(c.cast("string"), r"\.?0+$", "")
        text = F.when(F.isnan(c.cast("double")), None).when(whole & (F.abs(c.cast("double")) < 1e15), c.cast("long").cast("string"))
        return text.otherwise(short)
    if kind.startswith("array<"):
        inner = kind[6:-1]
        items = F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: canonical(x, inner)), lambda x: x.isNotNull())))
        return F.to_json(items)
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind == "date" else F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    if kind.startswith("map<"):
        return F.to_json(F.array_sort(F.map_entries(c)))
    return c.cast("string")


def signature(*cols: Column) -> Column:
    """A content hash in which null differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in cols]
    return F.sha2(F.to_json(F.array(*parts)), 256)
