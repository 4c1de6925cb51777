"""Conditions with defined results for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(x: Column, kind: str) -> Column:
    """Whether a value of `kind` (boolean, text, number, other) counts as true; null doesn't, the text 'false' does."""
    test = {"boolean": lambda: x, "text": lambda: x != "", "number": lambda: x != 0}.get(kind, x.isNotNull)
    return F.coalesce(test(), F.lit(False))


def and_value(a: Column, b: Column) -> Column:
    """`b` where `a` is true, else false."""
    return F.when(F.coalesce(a, F.lit(False)), b).otherwise(False)


def or_value(a: Column, b: Column) -> Column:
    """True where `a` is, else `b`."""
    return F.when(F.coalesce(a, F.lit(False)), True).otherwise(b)


def not_value(x: Column, kind: str = "boolean") -> Column:
    """True for null, the opposite of a boolean, false for any other value."""
    return F.when(x.isNull(), True).otherwise(~x if kind == "boolean" else F.lit(False))


def if_value(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), yes).otherwise(no)


def eq_value(a: Column, b: Column) -> Column:
    """Null equals null and nothing else."""
    return a.eqNullSafe(b)


def neq_value(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def lt_value(a: Column, b: Column) -> Column:
    """False where either is null."""
    return F.coalesce(a < b, F.lit(False))


def lte_value(a: Column, b: Column) -> Column:
    """True where either is null."""
    return F.coalesce(a <= b, F.lit(True))


def gt_value(a: Column, b: Column) -> Column:
    """False where either is null."""
    return F.coalesce(a > b, F.lit(False))


def gte_value(a: Column, b: Column) -> Column:
    """True where either is null."""
    return F.coalesce(a >= b, F.lit(True))
