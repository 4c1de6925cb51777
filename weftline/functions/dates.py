"""Dates and date-times from text. An offset is dropped, never converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPACT = r"^\d{8}$"
_ISO = r"^\d{4}-\d{2}-\d{2}$"
_ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"
_OFFSET = r"(Z|[+-]\d{2}:\d{2})$"


def _sliced(v: Column) -> Column:
    return F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 5, 2), F.substring(v, 7, 2))


def to_date_value(v: Column) -> Column:
    """The date of yyyy-MM-dd, of yyyyMMdd, or of an ISO date-time; else null."""
    v = v.cast("string")
    return (
        F.when(v.rlike(_COMPACT), _sliced(v).try_cast("date"))
        .when(v.rlike(_ISO), v.try_cast("date"))
        .when(v.rlike(_ISO_TIME), F.left(v, F.lit(10)).try_cast("date"))
    )


def to_datetime_value(v: Column) -> Column:
    """The local date-time of an ISO date-time; noon of a date; else null."""
    v = v.cast("string")
    noon = F.expr("interval 12 hours")
    return (
        F.when(v.rlike(_ISO_TIME), F.regexp_replace(v, _OFFSET, "").try_cast("timestamp_ntz"))
        .when(v.rlike(_COMPACT), _sliced(v).try_cast("date").cast("timestamp_ntz") + noon)
        .when(v.rlike(_ISO), v.try_cast("date").cast("timestamp_ntz") + noon)
    )


def to_compact_date(v: Column) -> Column:
    """yyyyMMdd of what `to_date_value` reads."""
    return F.date_format(to_date_value(v), "yyyyMMdd")
