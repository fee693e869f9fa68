"""Feature bags: map<string,string> columns, their predicates and their algebra.

A value may hold several alternatives joined by bars. Comparison ignores case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(bag: Column, key: Column | str) -> Column:
    """The bag's value, null where it has none."""
    return F.try_element_at(bag, F.lit(key) if isinstance(key, str) else key)


def same(actual: Column, wanted: Column) -> Column:
    """Whether any alternative of `actual` equals `wanted` but for case."""
    return F.array_contains(F.split(F.lower(actual), "[|]"), F.lower(wanted))


def strong(bag: Column, key: Column | str, wanted: Column) -> Column:
    """The bag has the key with that value; both missing also counts."""
    got = value(bag, key)
    return F.coalesce(same(got, wanted), got.isNull() & wanted.isNull())


def weak(bag: Column, key: Column | str, wanted: Column) -> Column:
    """As strong(), but a missing key counts."""
    got = value(bag, key)
    return F.coalesce(got.isNull() | same(got, wanted), F.lit(False))


def weak_all(bag: Column, other: Column) -> Column:
    """Every entry of `other` matches the bag weakly."""
    return F.forall(F.map_entries(other), lambda e: F.coalesce(value(bag, e["key"]).isNull() | same(value(bag, e["key"]), e["value"]), F.lit(False)))


def strong_one_side(bag: Column, other: Column) -> Column:
    """Every entry of `other` matches the bag strongly."""
    return F.forall(F.map_entries(other), lambda e: F.coalesce(same(value(bag, e["key"]), e["value"]), F.lit(False)))


def strong_both(bag: Column, other: Column) -> Column:
    """strong_one_side() in both directions."""
    return strong_one_side(bag, other) & strong_one_side(other, bag)


def add(bag: Column, key: str, v: Column | str) -> Column:
    """The bag with the key set; needs spark.sql.mapKeyDedupPolicy=LAST_WIN."""
    return F.map_concat(bag, F.create_map(F.lit(key), F.lit(v) if isinstance(v, str) else v))


def remove(bag: Column, key: str) -> Column:
    return F.map_filter(bag, lambda k, _: k != key)


def keep(bag: Column, keys: list[str]) -> Column:
    return F.map_filter(bag, lambda k, _: k.isin(keys))


def reading(variant: Column, paradigm: Column, lexeme: Column, ending: Column) -> Column:
    """The bag of a reading. The paradigm enters twice, so its values win over the lexeme's; the ending's win over all."""
    none = F.create_map().cast("map<string,string>")
    parts = [F.coalesce(b, none) for b in (variant, paradigm, lexeme, paradigm, ending)]
    return F.map_concat(*parts)


def to_json(bag: Column) -> Column:
    """JSON with keys in order, so that equal bags give equal strings."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(bag))))
