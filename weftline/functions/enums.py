"""Value maps and enumerations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _typed(values: list[str]) -> str:
    """The type of a map whose values are all booleans, all numbers, or names."""
    if all(v in ("true", "false") for v in values):
        return "boolean"
    return "decimal(38,10)" if all(v.lstrip("+-").replace(".", "", 1).isdigit() for v in values) else "string"


def enum_map(x: Column, mapping: dict[str, str]) -> Column:
    """The value mapped to, typed by all values of the map; null for a miss."""
    kind = _typed(list(mapping.values()))
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.try_element_at(pairs, x.cast("string")).cast(kind)


def enum_map_default(x: Column, mapping: dict[str, str], fallback: Column) -> Column:
    found = enum_map(x, mapping)
    return F.coalesce(found.cast("string"), fallback.cast("string")) if _typed(list(mapping.values())) != "boolean" else F.coalesce(found, fallback)


def enum_map_strict(x: Column, mapping: dict[str, str]) -> tuple[Column, Column]:
    """The value, and whether the row misses the map (to be reported as an error)."""
    found = enum_map(x, mapping)
    return found, x.isNotNull() & found.isNull()


def enum_default(x: Column, fallback: Column) -> Column:
    return F.coalesce(x, fallback)


def enum_resolve(x: Column, names: list[str]) -> Column:
    """The full name in a hierarchy of names: itself, or the first that ends in '.' and it; else as it is."""
    exact = {n: n for n in names}
    by_suffix: dict[str, str] = {}
    for n in names:
        parts = n.split(".")
        for k in range(1, len(parts)):
            by_suffix.setdefault(".".join(parts[k:]), n)
    known = by_suffix | exact
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in known.items()))
    return F.coalesce(F.try_element_at(pairs, x), x)
