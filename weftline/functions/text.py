"""Text functions. Positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_text(*parts: Column) -> Column:
    """The parts joined; nulls are skipped, and nulls only give ''."""
    return F.concat_ws("", *parts)


def substring_at(s: Column, start: Column | int, size: Column | int) -> Column:
    """`size` characters from `start` on, cut at the end; '' where start lies outside."""
    start, size = _lit(start), _lit(size)
    inside = (start >= 0) & (start < F.length(s)) & (size > 0)
    return F.when(s.isNull() | start.isNull() | size.isNull(), None).when(inside, F.substring(s, start + 1, size)).otherwise("")


def trim_controls(s: Column) -> Column:
    """Without blanks and control characters (up to U+0020) at both ends."""
    return F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def replace_all(s: Column, what: Column | str, by: Column | str) -> Column:
    """Every literal occurrence replaced; an empty `what` changes nothing."""
    return F.replace(s, F.lit(what) if isinstance(what, str) else what, F.lit(by) if isinstance(by, str) else by)


def truncate_text(s: Column, size: Column | int) -> Column:
    """At most `size` characters; '' from 0 down."""
    size = _lit(size)
    return F.when(s.isNull() | size.isNull(), None).when(size <= 0, "").otherwise(F.left(s, size))


def _lit(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
