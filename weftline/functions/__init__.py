"""Scalar functions for assignments and conditions, all built from Spark's own expressions."""

from weftline.functions.dates import to_compact_date, to_date_value, to_datetime_value
from weftline.functions.enums import enum_default, enum_map, enum_map_default, enum_map_strict, enum_resolve
from weftline.functions.geometry import coord_equals, point_on_surface
from weftline.functions.identity import name_uuid
from weftline.functions.logic import and_value, eq_value, gt_value, gte_value, if_value, lt_value, lte_value, neq_value, not_value, or_value, truthy
from weftline.functions.numbers import abs_of, add, div, max_of, min_of, mul, number_text, round_to, sub, to_number
from weftline.functions.text import concat_text, replace_all, substring_at, trim_controls, truncate_text

__all__ = [
    "abs_of", "add", "and_value", "concat_text", "coord_equals", "div", "enum_default", "enum_map", "enum_map_default",
    "enum_map_strict", "enum_resolve", "eq_value", "gt_value", "gte_value", "if_value", "lt_value", "lte_value", "max_of", "min_of",
    "mul", "name_uuid", "neq_value", "not_value", "number_text", "or_value", "point_on_surface", "replace_all", "round_to", "sub",
    "substring_at", "to_compact_date", "to_date_value", "to_datetime_value", "to_number", "trim_controls", "truncate_text", "truthy",
]
