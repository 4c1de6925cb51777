import datetime
import uuid
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import functions as W
from weftline.functions.geometry import coord_of_text, interior_point, rings_of_wkt, wkt_point


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def null():
    return F.lit(None).cast("string")


@pytest.mark.parametrize(
    ("make", "expected"),
    [
        (lambda: W.concat_text(F.lit("a"), null(), F.lit("b")), "ab"),
        (lambda: W.concat_text(null(), null()), ""),
        (lambda: W.substring_at(F.lit("hello"), 0, 3), "hel"),
        (lambda: W.substring_at(F.lit("hello"), 3, 9), "lo"),
        (lambda: W.substring_at(F.lit("hello"), 5, 1), ""),
        (lambda: W.substring_at(F.lit("hello"), -1, 2), ""),
        (lambda: W.trim_controls(F.lit("\t x y\u0001 ")), "x y"),
        (lambda: W.replace_all(F.lit("a.b.c"), ".", "-"), "a-b-c"),
        (lambda: W.replace_all(F.lit("abc"), "", "-"), "abc"),
        (lambda: W.truncate_text(F.lit("hello"), 2), "he"),
        (lambda: W.truncate_text(F.lit("hello"), 0), ""),
        (lambda: W.truncate_text(null(), 2), None),
        (lambda: W.to_number(F.lit("12.50")), Decimal("12.5")),
        (lambda: W.to_number(F.lit(" 12")), None),
        (lambda: W.to_number(F.lit("1e2")), Decimal(100)),
        (lambda: W.to_number(F.lit("x")), None),
        (lambda: W.div(F.lit(2), F.lit(3)), Decimal("0.6666666667")),
        (lambda: W.div(F.lit(1), F.lit(0)), None),
        (lambda: W.round_to(F.lit("2.5").cast("decimal(10,5)"), 0), Decimal(3)),
        (lambda: W.round_to(F.lit("-2.5").cast("decimal(10,5)"), 0), Decimal(-3)),
        (lambda: W.min_of(F.lit(1), F.lit(None)), None),
        (lambda: W.max_of(F.lit(1), F.lit(2)), Decimal(2)),
        (lambda: W.mul(F.lit("1.5").cast("decimal(5,2)"), F.lit(4)), Decimal(6)),
        (lambda: W.number_text(F.lit("1234.5").cast("decimal(10,2)")), "1234.5"),
        (lambda: W.number_text(F.lit(7)), "7"),
        (lambda: W.lt_value(F.lit(None).cast("int"), F.lit(1)), False),
        (lambda: W.lte_value(F.lit(None).cast("int"), F.lit(1)), True),
        (lambda: W.gt_value(F.lit(2), F.lit(1)), True),
        (lambda: W.gte_value(F.lit(1), F.lit(None).cast("int")), True),
        (lambda: W.eq_value(F.lit(None).cast("int"), F.lit(None).cast("int")), True),
        (lambda: W.neq_value(F.lit(None).cast("int"), F.lit(1)), True),
        (lambda: W.not_value(F.lit(None).cast("boolean")), True),
        (lambda: W.not_value(F.lit("x"), "text"), False),
        (lambda: W.truthy(F.lit("false"), "text"), True),
        (lambda: W.truthy(F.lit(""), "text"), False),
        (lambda: W.truthy(null(), "text"), False),
        (lambda: W.truthy(F.lit(0), "number"), False),
        (lambda: W.to_date_value(F.lit("20240131")), datetime.date(2024, 1, 31)),
        (lambda: W.to_date_value(F.lit("2024-02-31")), None),
        (lambda: W.to_date_value(F.lit("2024-01-31T23:59:59+02:00")), datetime.date(2024, 1, 31)),
        (lambda: W.to_compact_date(F.lit("2024-01-31")), "20240131"),
        (lambda: W.to_datetime_value(F.lit("2024-01-31T10:11:12+02:00")), datetime.datetime(2024, 1, 31, 10, 11, 12)),
        (lambda: W.to_datetime_value(F.lit("2024-01-31")), datetime.datetime(2024, 1, 31, 12)),
        (lambda: W.to_datetime_value(F.lit("soon")), None),
        (lambda: W.enum_map(F.lit("a"), {"a": "true", "b": "false"}), True),
        (lambda: W.enum_map(F.lit("a"), {"a": "1", "b": "2.5"}), Decimal(1)),
        (lambda: W.enum_map(F.lit("z"), {"a": "x"}), None),
        (lambda: W.enum_map_default(F.lit(None).cast("string"), {"a": "x"}, F.lit("d")), "d"),
        (lambda: W.enum_resolve(F.lit("c"), ["a.b.c", "d"]), "a.b.c"),
        (lambda: W.enum_resolve(F.lit("b.c"), ["a.b.c"]), "a.b.c"),
        (lambda: W.enum_resolve(F.lit("z"), ["a.b.c"]), "z"),
        (lambda: coord_of_text(F.lit(" 1.5  2 "))["y"], 2.0),
        (lambda: coord_of_text(F.lit("1 b")), None),
        (lambda: wkt_point(F.lit("POINT (3 4)"))["x"], 3.0),
        (lambda: W.point_on_surface(F.lit("POINT (3 4)"))["y"], 4.0),
        (lambda: W.point_on_surface(F.lit("LINESTRING (3 4, 5 6)")), None),
    ],
)
def test_scalar(spark, make, expected):
    assert value(spark, make()) == expected


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=20), min_size=1, max_size=8))
def test_name_uuid_is_version_3(spark, names):
    class Bare:
        bytes = b""

    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["u"] for r in df.select(W.name_uuid(F.col("n")).alias("u")).collect()]
    assert sorted(got) == sorted(str(uuid.uuid3(Bare, n)) for n in names)


def test_interior_point_lies_inside():
    rings = rings_of_wkt("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2))")
    x, y = interior_point(rings)
    assert 0 < x < 10 and 0 < y < 10 and not (2 < x < 8 and 2 < y < 8)
    assert interior_point([]) is None
