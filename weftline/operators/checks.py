"""Checks of a transfer across its objects: uniqueness, existence, cardinality, and areas that overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import areas
from weftline.operators.areas import Ring, side_of
from weftline.storage import stored


def _found(code: str, key: Column, rows: DataFrame, n: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), key.cast("string").alias("key"), n.cast("long").alias("n"))


def not_unique(objects: DataFrame, attributes: list[str]) -> DataFrame:
    """(code, key, n) of values that several objects have in all of `attributes`; a null makes no value."""
    groups = objects.dropna(subset=attributes).groupBy(*attributes).agg(F.count("*").alias("n")).where("n > 1")
    return _found("NOT_UNIQUE", F.concat_ws("|", *(F.col(a).cast("string") for a in attributes)), groups, F.col("n"))


def without_target(objects: DataFrame, role: str, targets: DataFrame) -> DataFrame:
    """(code, key, n) of objects whose role (an identifier, or an array) names n objects that aren't there."""
    to = F.col(role) if objects.schema[role].dataType.typeName() == "array" else F.array(role)
    named = objects.select("_oid", F.explode(to.cast("array<string>")).alias("_to")).where("_to is not null")
    missing = named.join(targets.select(F.col("_oid").alias("_there")).distinct(), F.col("_to") == F.col("_there"), "left_anti")
    return _found("NO_TARGET", F.col("_oid"), missing.groupBy("_oid").agg(F.count("*").alias("n")), F.col("n"))


def beyond_cardinality(targets: DataFrame, objects: DataFrame, role: str, low: int = 0, high: int | None = None) -> DataFrame:
    """(code, key, n) of `targets` that n of `objects` refer to by a role, fewer than `low` or more than `high`."""
    to = F.col(role) if objects.schema[role].dataType.typeName() == "array" else F.array(role)
    counts = objects.select(F.explode(to.cast("array<string>")).alias("_to")).groupBy("_to").agg(F.count("*").alias("n"))
    held = targets.select("_oid").join(counts, F.col("_oid") == F.col("_to"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = F.col("n") < low if high is None else (F.col("n") < low) | (F.col("n") > high)
    return _found("CARDINALITY", F.col("_oid"), held.where(out), F.col("n"))


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _within(rings: list[Ring], x: float, y: float) -> int:
    """1 strictly inside a polygon, 0 on its boundary, -1 outside."""
    shell, *holes = (side_of(r, x, y) for r in rings)
    return min([shell, *(-h for h in holes)])


def _inner_points(rings: list[Ring]) -> Iterator[tuple[float, float]]:
    from weftline.functions.geometry import interior_point

    if point := interior_point(rings):
        yield point


def overlap(p: list[Ring], q: list[Ring]) -> bool:
    """Whether the interiors of two polygons meet: edges that cross, a part of an edge within the other, or one inside the other.

    Shared edges and vertices don't count.
    """
    edges = [[(a, b) for r in rings for a, b in zip(r, r[1:])] for rings in (p, q)]
    for a, b in edges[0]:
        for c, d in edges[1]:
            if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
                continue
            if _turn(a, b, c) * _turn(a, b, d) < 0 and _turn(c, d, a) * _turn(c, d, b) < 0:
                return True
    for one, other, own in ((p, q, edges[0]), (q, p, edges[1])):
        points = [*(((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in own), *(a for a, _ in own), *_inner_points(one)]
        if any(_within(other, x, y) == 1 for x, y in points):
            return True
    return False


def _overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (a, b, rings of both): the pairs that overlap."""
    plain = lambda rings: [[(p["x"], p["y"]) for p in r] for r in rings]
    for b in batches:
        hit = [overlap(plain(p), plain(q)) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield b.select([0, 1]).filter(pa.array(hit, pa.bool_()))


def overlaps(objects: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(a, b): pairs of objects (_oid, WKT polygon) whose areas overlap, the smaller identifier first.

    A shape stands in the grid cells of its own size, four at most, and asks in the cells of every larger size that its box
    touches: so each pair meets in cells of the larger one. Pairs whose boxes don't meet are dropped before shapes are read.

    Joins are merges: stored shapes are so much smaller than in memory that a file below the threshold of broadcasts can fill the driver.
    """
    shapes = objects.where(F.col(geometry).isNotNull()).select(F.lit("").alias("map"), F.col("_oid").cast("string").alias("shape"), areas.rings_of_wkt(F.col(geometry)).alias("rings"))
    shapes = stored(shapes.where("rings is not null"), "overlap-shapes")
    shell = F.col("rings")[0]
    x, y = F.transform(shell, lambda p: p["x"]), F.transform(shell, lambda p: p["y"])
    box = shapes.select("shape", F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1"))
    own = stored(areas.cells_of(shapes, "shape", shell).drop("map").join(box.hint("merge"), "shape"), "overlap-cells")
    levels = sorted(r["level"] for r in own.select("level").distinct().collect())
    if not levels:
        return objects.sparkSession.createDataFrame([], "a string, b string")
    least = own.groupBy("shape").agg(F.min("level").alias("own"))
    asked = box.join(least.hint("merge"), "shape").withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where("level >= own")
    cell = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    asked = asked.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    asked = asked.select("level", "cx", "cy", "own", F.col("shape").alias("other"), *(F.col(c).alias(f"o_{c}") for c in ("x0", "x1", "y0", "y1")))
    met = own.join(asked.hint("merge"), ["level", "cx", "cy"]).where("(own < level or other < shape) and x0 < o_x1 and o_x0 < x1 and y0 < o_y1 and o_y0 < y1 and shape <> other")
    pairs = met.select(F.least("shape", "other").alias("a"), F.greatest("shape", "other").alias("b")).distinct()
    rings = lambda n: shapes.select(F.col("shape").alias(n), F.col("rings").alias(f"{n}_rings"))
    both = pairs.join(rings("a").hint("merge"), "a").join(rings("b").hint("merge"), "b").select("a", "b", "a_rings", "b_rings")
    return both.mapInArrow(_overlapping, "a string, b string")
