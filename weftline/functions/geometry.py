"""Geometry as struct<x,y> coordinates and as WKT polygons."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

COORD = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])


def coord_equals(a: Column, b: Column, tolerance: Column) -> Column:
    """Whether two coordinates lie within `tolerance`; false for null and for a negative tolerance."""
    distance = F.sqrt(F.pow(a["x"] - b["x"], F.lit(2.0)) + F.pow(a["y"] - b["y"], F.lit(2.0)))
    return F.coalesce((tolerance >= 0) & (distance <= tolerance), F.lit(False))


def coord_of_text(text: Column) -> Column:
    """The coordinate of 'x y'; null for anything else."""
    parts = F.split(F.trim(text), r"\s+")
    x, y = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    return F.when((F.size(parts) == 2) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def wkt_point(text: Column) -> Column:
    """The coordinate of a WKT point, in SQL expressions."""
    found = F.regexp_extract(text, r"(?i)^\s*POINT\s*Z?\s*\(([^)]*)\)\s*$", 1)
    return F.when(found != "", coord_of_text(F.regexp_extract(found, r"^\s*(\S+\s+\S+)", 1)))


def rings_of_wkt(text: str) -> list[list[tuple[float, float]]]:
    """Rings of a WKT polygon, the shell first, or of all polygons of a multi-polygon."""
    if not text.lstrip().upper().startswith(("POLYGON", "MULTIPOLYGON")):
        return []
    return [[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", text)]


def interior_point(rings: list[list[tuple[float, float]]]) -> tuple[float, float] | None:
    """The middle of the widest part of the polygon on a horizontal line halfway between two vertex heights.

    Inside is what an odd number of boundaries lies left of, so rings that cross themselves or touch each other, and
    the parts of a multi-polygon, need no repair first. Of the heights that nearest to the middle is taken whose line
    meets the inside; None where there is no inside.
    """
    ys = sorted({y for ring in rings for _, y in ring})
    best = None
    middle = (ys[0] + ys[-1]) / 2 if ys else 0
    for low, high in sorted(zip(ys, ys[1:]), key=lambda p: abs((p[0] + p[1]) / 2 - middle)):
        y, xs = (low + high) / 2, []
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > y) != (y2 > y):
                    xs.append(x1 + (y - y1) * (x2 - x1) / (y2 - y1))
        xs.sort()
        for a, b in zip(xs[::2], xs[1::2]):
            if b > a and (best is None or b - a > best[0]):
                best = (b - a, ((a + b) / 2, y))
        if best:
            return best[1]
    return None


@pandas_udf(COORD)
def _interior(texts: pd.Series) -> pd.DataFrame:
    points = [interior_point(rings_of_wkt(t)) if t else None for t in texts]
    return pd.DataFrame({"x": [p[0] if p else None for p in points], "y": [p[1] if p else None for p in points]}, dtype="float64")


def point_on_surface(wkt: Column, explicit: Column | None = None) -> Column:
    """A coordinate inside a WKT polygon or multi-polygon; an explicit one, or a WKT point, is taken as it is."""
    found = _interior(wkt)
    inside = F.when(found["x"].isNotNull(), found)
    return F.coalesce(*([explicit] if explicit is not None else []), wkt_point(wkt), inside)


#: Codes of WKB geometries. Fixed values.
WKB_NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


def wkt_of_wkb(blob: bytes | None) -> str | None:
    """WKT, in two dimensions, of WKB in either byte order, also with a reference system or further dimensions."""
    if not blob:
        return None
    text, at = _wkt_at(bytes(blob), 0)
    if at != len(blob):
        raise ValueError(f"{len(blob) - at} bytes behind a geometry")
    return text


def _wkt_at(b: bytes, at: int, bare: bool = False) -> tuple[str, int]:
    order = "<" if b[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", b, at + 1)
    at += 9 if code & 0x20000000 else 5  # a reference system stands before the coordinates
    more = bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0xFFFF
    dimensions, code = 2 + more + {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000], code % 1000

    def number() -> int:
        nonlocal at
        (n,) = struct.unpack_from(f"{order}I", b, at)
        at += 4
        return n

    def points(n: int) -> str:
        nonlocal at
        out = []
        for _ in range(n):
            x, y, *_ = struct.unpack_from(f"{order}{dimensions}d", b, at)
            out.append(f"{x:.15g} {y:.15g}")
            at += 8 * dimensions
        return ", ".join(out)

    name = WKB_NAMES[code]
    if code == 1:
        inner = f"({points(1)})"
    elif code == 2:
        inner = f"({points(number())})"
    elif code == 3:
        inner = "(" + ", ".join(f"({points(number())})" for _ in range(number())) + ")"
    else:
        parts = []
        for _ in range(number()):
            part, at = _wkt_at(b, at, code != 7)
            parts.append(part)
        inner = "(" + ", ".join(parts) + ")"
    return (inner if bare else f"{name} {inner}"), at


@pandas_udf(StringType())
def wkb_text(blobs: pd.Series) -> pd.Series:
    """WKT of a column of WKB or extended WKB."""
    return blobs.map(lambda b: wkt_of_wkb(b) if b is not None else None)
