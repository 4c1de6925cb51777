"""Areas from the lines that bound them, and the lines from areas: planar maps as Spark joins.

Lines meet at their ends. Each line is two directed edges; around each end the edges stand by angle, which gives every
edge the next one of the face at its left. Following these pointers, twice as far in every round, labels the rings;
a ring is gathered once it is labelled, as its polygon is a row anyway. Counter-clockwise rings are shells, others the
outlines of islands, which lie as holes in the smallest shell around them. Shells are found by a grid of cells as large
as they are, so that a shell lies in four cells at most and a point looks up one cell a size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.storage import stored

POINTS = "array<struct<x:double,y:double>>"
Ring = list[tuple[float, float]]


class MapError(ValueError):
    """Lines or areas that make no planar map."""


def points_of_wkt(wkt: Column) -> Column:
    """The points of a WKT line string as an array of x and y."""
    inner = F.regexp_extract(wkt, r"^\s*LINESTRING\s*\((.*)\)\s*$", 1)
    point = lambda p: F.struct(*(F.element_at(F.split(F.trim(p), r"\s+"), i).cast("double").alias(n) for i, n in ((1, "x"), (2, "y"))))
    return F.when(inner != "", F.transform(F.split(inner, ","), point))


def _number(v: Column) -> Column:
    return F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(v.cast("string"))


def wkt_of_rings(rings: Column) -> Column:
    """The WKT polygon of rings, the shell first."""
    text = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"]))), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, text), ", "), F.lit(")"))


def signed_area(ring: Ring) -> float:
    """Of a closed ring; positive where it goes counter-clockwise. Taken from the first point on, so far-off maps lose nothing."""
    (x0, y0), *_ = ring
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(ring, ring[1:])) / 2


def side_of(ring: Ring, x: float, y: float) -> int:
    """1 inside, 0 on the ring, -1 outside."""
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return 0
        if (ay > y) != (by > y) and (cross > 0) == (by > ay):
            inside = not inside
    return 1 if inside else -1


def _edges(lines: DataFrame) -> DataFrame:
    """(map, edge, twin, a, angle, points): both directions of each line (map, line, points)."""
    way = lambda code, points: F.struct((F.col("line") * 2 + code).alias("edge"), (F.col("line") * 2 + 1 - code).alias("twin"), points.alias("points"))
    both = lines.select("map", F.explode(F.array(way(0, F.col("points")), way(1, F.reverse("points")))).alias("e")).select("map", "e.*")
    at = lambda i: F.element_at("points", i)
    angle = F.atan2(at(2)["y"] - at(1)["y"], at(2)["x"] - at(1)["x"])
    return both.select("map", "edge", "twin", at(1).alias("a"), angle.alias("angle"), "points")


def _next(edges: DataFrame) -> DataFrame:
    """(edge, twin, next): behind an edge follows, of those that leave its end, the one clockwise of its twin."""
    around = Window.partitionBy("map", "a").orderBy("angle", "edge")
    last = F.last("edge").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # Clockwise of an outgoing edge is the one before it by angle. The twin of an outgoing edge comes in.
    return edges.select(F.col("twin").alias("edge"), F.col("edge").alias("twin"), F.coalesce(F.lag("edge").over(around), last).alias("next"))


def labelled(pointers: DataFrame) -> DataFrame:
    """(edge, label): the smallest edge of each cycle of `pointers` (edge, next); as many joins as the length of the longest has binary digits."""
    state = stored(pointers.select("edge", "next", F.least("edge", "next").alias("label")), "areas-labels")
    while True:
        ahead = state.select(F.col("edge").alias("n_edge"), F.col("next").alias("n_next"), F.col("label").alias("n_label"))
        step = state.join(ahead, F.col("next") == F.col("n_edge"))
        new = stored(step.select("edge", F.col("n_next").alias("next"), F.least("label", "n_label").alias("label"), (F.col("n_label") < F.col("label")).alias("fell")), "areas-labels")
        if new.where("fell").isEmpty():
            return new.select("edge", "label")
        state = new.drop("fell")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (map, ring, edges: [(edge, next, points)]): (map, ring, points, area), points following the pointers, the last like the first."""
    for b in batches:
        rings, areas = [], []
        for label, edges in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            by_edge = {e["edge"]: e for e in edges}
            ring, at = [], label
            for _ in edges:
                ring += [(p["x"], p["y"]) for p in by_edge[at]["points"][:-1]]
                at = by_edge[at]["next"]
            ring.append(ring[0])
            rings.append([{"x": x, "y": y} for x, y in ring])
            areas.append(signed_area(ring))
        points = pa.array(rings, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), points, pa.array(areas, pa.float64())], names=["map", "ring", "points", "area"])


def rings_of(lines: DataFrame) -> DataFrame:
    """(map, ring, points, area) of the maps that `lines` (map, points) bound.

    Lines cross nowhere and meet at their ends only; a line of fewer than two points, or a null one, is left out. A
    line with the same face on both sides bounds nothing: dead ends and bridges are left out as well.
    """
    kept = lines.where(F.size("points") > 1).select(F.coalesce("map", F.lit("")).alias("map"), F.monotonically_increasing_id().alias("line"), "points")
    kept = stored(kept, "areas-lines")
    while True:
        edges = stored(_edges(kept), "areas-edges")
        pointers = stored(_next(edges), "areas-pointers")
        labels = labelled(pointers)
        sides = pointers.join(labels, "edge").select("edge", "twin", "next", "label")
        other = labels.select(F.col("edge").alias("o_edge"), F.col("label").alias("o_label"))
        sides = stored(sides.join(other, F.col("twin") == F.col("o_edge")), "areas-sides")
        bare = sides.where("label = o_label").select(F.expr("edge div 2").alias("b_line")).distinct()
        if bare.isEmpty():
            break
        kept = stored(kept.join(bare, F.col("line") == F.col("b_line"), "left_anti"), "areas-lines")
    of_ring = sides.select("edge", "next", "label").join(edges.select("map", "edge", "points"), "edge")
    rings = of_ring.groupBy("map", F.col("label").alias("ring")).agg(F.collect_list(F.struct("edge", "next", "points")).alias("edges"))
    return stored(rings.mapInArrow(_gathered, f"map string, ring bigint, points {POINTS}, area double"), "areas-rings")


def cells_of(shapes: DataFrame, key: str, shell: Column) -> DataFrame:
    """A row for each grid cell of a shape's box (four at most), within its map: level (a cell is 2 ** level wide), cx, cy."""
    x, y = (F.transform(shell, _axis(a)) for a in ("x", "y"))
    box = {"x0": F.array_min(x), "x1": F.array_max(x), "y0": F.array_min(y), "y1": F.array_max(y)}
    boxed = shapes.select("map", key, *(c.alias(n) for n, c in box.items()))
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-300))
    boxed = boxed.withColumn("level", F.ceil(F.log2(wide)).cast("int"))
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    boxed = boxed.withColumn("cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1")))))
    return boxed.withColumn("cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1"))))).select("map", key, "level", "cx", "cy")


def _axis(name: str):
    return lambda p: p[name]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (point, x, y, shape, size, rings): the pairs whose point lies within the first ring and outside all others."""
    for b in batches:
        hit = []
        for x, y, rings in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(5).to_pylist()):
            shell, *holes = [[(p["x"], p["y"]) for p in r] for r in rings]
            hit.append(side_of(shell, x, y) == 1 and all(side_of(h, x, y) == -1 for h in holes))
        yield b.select([0, 3, 4]).filter(pa.array(hit, pa.bool_()))


def located(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(point, shape, size) for `points` (map, point, x, y) that lie strictly within `shapes` (map, shape, size, rings) of their map."""
    cells = stored(cells_of(shapes, "shape", F.col("rings")[0]), "areas-cells")
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # sizes that occur, by powers of two
    if not levels:
        return points.sparkSession.createDataFrame([], f"point {dict(points.dtypes)['point']}, shape {dict(shapes.dtypes)['shape']}, size double")
    asked = points.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    cell = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    asked = asked.select("map", "point", "x", "y", "level", cell("x").alias("cx"), cell("y").alias("cy"))
    met = asked.join(cells, ["map", "level", "cx", "cy"]).select("point", "x", "y", "shape").join(shapes.select("shape", "size", "rings").hint("merge"), "shape")  # stored shapes are far larger in memory
    schema = f"point {dict(points.dtypes)['point']}, shape {dict(shapes.dtypes)['shape']}, size double"
    return met.select("point", "x", "y", "shape", "size", "rings").mapInArrow(_within, schema)


def polygons(lines: DataFrame) -> DataFrame:
    """(map, shape, size, rings): the faces of each map of `lines` (map, points), a shell and its holes, and the shell's area."""
    rings = rings_of(lines)
    shells = rings.where("area > 0").select("map", F.col("ring").alias("shape"), F.col("area").alias("size"), F.array("points").alias("rings"))
    outlines = rings.where("area < 0")
    first = outlines.select("map", F.col("ring").alias("point"), F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))
    homes = located(first, shells).groupBy("point").agg(F.min(F.struct("size", "shape")).alias("home"))
    holes = homes.join(outlines, F.col("point") == F.col("ring")).groupBy(F.col("home.shape").alias("h_shape")).agg(F.sort_array(F.collect_list("points")).alias("holes"))
    whole = shells.join(holes, F.col("shape") == F.col("h_shape"), "left")
    return whole.select("map", "shape", "size", F.concat("rings", F.coalesce("holes", F.array().cast(f"array<{POINTS}>"))).alias("rings"))


def assembled(objects: DataFrame, lines: DataFrame, geometry: str = "geometry") -> tuple[DataFrame, DataFrame]:
    """`objects` with the areas that their points lie in, and the findings (code, key).

    objects: `_oid` and `geometry`, a WKT point within the area, which the area's WKT polygon replaces; lines: WKT line
    strings in column `geometry`. An object whose point lies in no area keeps a null geometry (AREA_WITHOUT_BOUNDARY);
    of an area with several points each object gets it (AREA_WITH_SEVERAL_POINTS); an area without one belongs to no
    object (AREA_WITHOUT_OBJECT).
    """
    shapes = stored(polygons(lines.select(F.lit("").alias("map"), points_of_wkt(F.col("geometry")).alias("points"))), "areas-polygons")
    inner = F.split(F.trim(F.regexp_extract(geometry, r"^\s*POINT\s*\((.*)\)\s*$", 1)), r"\s+")
    asked = objects.select(F.lit("").alias("map"), F.col("_oid").alias("point"), *(F.try_element_at(inner, F.lit(i)).try_cast("double").alias(n) for i, n in ((1, "x"), (2, "y"))))
    found = stored(located(asked.where("x is not null and y is not null").distinct(), shapes), "areas-found")
    wkt = found.join(shapes.select("shape", "rings").hint("merge"), "shape").select(F.col("point").alias("_of"), wkt_of_rings(F.col("rings")).alias(geometry))
    named = objects.drop(geometry).join(wkt.hint("merge"), F.col("_oid") == F.col("_of"), "left").drop("_of")
    text = lambda c: F.col(c).cast("string").alias("key")
    missing = objects.join(found, F.col("_oid") == F.col("point"), "left_anti").select(F.lit("AREA_WITHOUT_BOUNDARY").alias("code"), text("_oid"))
    several = found.groupBy("shape").agg(F.count("*").alias("n")).where("n > 1").join(found, "shape").select(F.lit("AREA_WITH_SEVERAL_POINTS").alias("code"), text("point"))
    empty = shapes.join(found.select(F.col("shape").alias("f_shape")), F.col("shape") == F.col("f_shape"), "left_anti").select(F.lit("AREA_WITHOUT_OBJECT").alias("code"), text("shape"))
    return named, missing.unionByName(several).unionByName(empty)


def surfaces(objects: DataFrame, lines: DataFrame, geometry: str = "geometry") -> DataFrame:
    """`objects` (_oid) with the surface that their own `lines` (owner, WKT line strings in `geometry`) bound: the largest
    face of each, with its holes; null where they bound none. Surfaces of different objects may overlap."""
    shapes = stored(polygons(lines.where("owner is not null").select(F.col("owner").alias("map"), points_of_wkt(F.col("geometry")).alias("points"))), "areas-surfaces")
    whole = shapes.groupBy("map").agg(F.max("size").alias("w_size"), F.max_by("rings", "size").alias("rings"))
    return objects.drop(geometry).join(whole.select(F.col("map").alias("_of"), wkt_of_rings(F.col("rings")).alias(geometry)), F.col("_oid") == F.col("_of"), "left").drop("_of")


def rings_of_wkt(wkt: Column) -> Column:
    """The rings of a WKT polygon, each an array of x and y; null for another geometry."""
    inner = F.regexp_extract(wkt, r"^\s*POLYGON\s*\(\s*\((.*)\)\s*\)\s*$", 1)
    point = lambda p: F.struct(*(F.element_at(F.split(F.trim(p), r"\s+"), i).cast("double").alias(n) for i, n in ((1, "x"), (2, "y"))))
    return F.when(inner != "", F.transform(F.split(inner, r"\)\s*,\s*\("), lambda r: F.transform(F.split(r, ","), point)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (owner, ring, segments: sorted [(place, a, b, other, cut)]): (owner, other, wkt) of the runs that have one neighbour and no node within."""
    number = lambda v: f"{v:.0f}" if v == math.floor(v) and abs(v) < 1e15 else repr(v)
    for b in batches:
        out: list[tuple] = []
        for owner, segments in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            run: list[tuple[float, float]] = []
            last = None
            for s in segments:
                if last is None or s["place"] != last["place"] + 1 or s["other"] != last["other"] or s["cut"]:
                    if run:
                        out.append((owner, last["other"], run))
                    run = [(s["a"]["x"], s["a"]["y"])]
                run.append((s["b"]["x"], s["b"]["y"]))
                last = s
            if run:
                out.append((owner, last["other"], run))
        wkt = [f"LINESTRING ({', '.join(f'{number(x)} {number(y)}' for x, y in run)})" for *_, run in out]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array(wkt, pa.string())], names=["owner", "other", "geometry"])


def boundaries(areas: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(owner, other, geometry): the lines of the map of `areas` (_oid, WKT polygon), each boundary of two areas once.

    Neighbours share the vertices of their common boundary: it is found by its segments, whatever their direction. A
    line ends where the neighbour changes or another line meets it. `other` is null at the outside. A segment of more
    than two areas, or twice of one, is an error: the areas overlap.
    """
    segment = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.struct(i.alias("place"), F.element_at(r, i).alias("a"), F.element_at(r, i + 1).alias("b")))
    rings = areas.where(F.col(geometry).isNotNull()).select(F.col("_oid").cast("string").alias("area"), F.posexplode(rings_of_wkt(F.col(geometry))).alias("ring", "points"))
    each = rings.select("area", "ring", F.inline(segment(F.col("points")))).where("a <> b")
    key = each.groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    once = key.agg(F.count("*").alias("n"), F.min(F.struct("area", "ring", "place", "a", "b")).alias("first"), F.max("area").alias("last"))
    broken = F.raise_error(F.concat(F.lit("areas overlap at "), F.to_json("p"), F.lit(" "), F.to_json("q"), F.lit(" of "), F.col("last")))
    once = once.select(
        "p", "q", "first.*", F.when((F.col("n") > 2) | (F.col("n") == 2) & (F.col("first.area") == F.col("last")), broken.cast("string")).when(F.col("n") == 2, F.col("last")).alias("other")
    )
    once = stored(once, "areas-segments")
    degree = once.select(F.explode(F.array("p", "q")).alias("node")).groupBy("node").count().where("count > 2").select("node")
    cut = once.join(degree, F.col("a") == F.col("node"), "left").withColumn("cut", F.col("node").isNotNull())
    runs = cut.groupBy("area", "ring").agg(F.sort_array(F.collect_list(F.struct("place", "a", "b", "other", "cut"))).alias("segments"))
    return runs.mapInArrow(_runs, "owner string, other string, geometry string")
