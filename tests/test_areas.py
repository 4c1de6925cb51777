import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import areas as A


def wkt(points):
    return "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in points) + ")"


def polygon(*rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"


def rings_in(text):
    return [[tuple(map(float, p.split())) for p in r.split(",")] for r in re.findall(r"\(([^()]+)\)", text)]


def normal(text):
    """A polygon whatever its rings' directions and starts: the shell, and the set of holes."""
    def one(ring):
        ring = ring[:-1] if ring[0] == ring[-1] else ring
        at = ring.index(min(ring))
        ring = ring[at:] + ring[:at]
        return tuple(ring) if ring[1] < ring[-1] else (ring[0], *ring[:0:-1])

    shell, *holes = map(one, rings_in(text))
    return shell, frozenset(holes)


def made_up_map(rng, n):
    """Cells of a crooked grid, some with an island that has an island: {id: (WKT, point within)}."""
    node = {(i, j): (10 * i + rng.randrange(-2, 3), 10 * j + rng.randrange(-2, 3)) for i in range(n + 1) for j in range(n + 1)}
    bend = {}
    for (i, j), (x, y) in node.items():
        for di, dj in ((1, 0), (0, 1)):
            if (to := (i + di, j + dj)) in node:
                bend[(i, j), to] = ((x + node[to][0]) / 2 + rng.choice([-0.5, 0, 0.5]), (y + node[to][1]) / 2 + rng.choice([-0.5, 0.5]))
    way = lambda a, b: [node[a], bend.get((a, b)) or bend[b, a]]
    out = {}
    for i in range(n):
        for j in range(n):
            corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            shell = [p for a, b in zip(corners, corners[1:] + corners[:1]) for p in way(a, b)]
            cx, cy = 10 * i + 5, 10 * j + 5
            diamond = lambda r, cx=cx, cy=cy: [(cx - r, cy), (cx, cy - r), (cx + r, cy), (cx, cy + r)]
            k = f"{i}.{j}"
            if rng.random() < 0.4:
                out[k] = polygon(shell, diamond(2)), (cx - 2.4, cy)
                out[k + ".island"] = polygon(diamond(2), diamond(1)), (cx - 1.4, cy)
                out[k + ".inner"] = polygon(diamond(1)), (cx, cy)
            else:
                out[k] = polygon(shell), (cx, cy)
    return out


def lines_of(areas, rng):
    """Every segment of the map once, in any order and direction."""
    found = set()
    for text, _ in areas.values():
        for ring in rings_in(text):
            found |= {tuple(sorted(s)) for s in zip(ring, ring[1:])}
    lines = [list(s) if rng.random() < 0.5 else list(s)[::-1] for s in found]
    rng.shuffle(lines)
    return lines


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_lines_give_the_polygons(spark, seed):
    rng = random.Random(seed)
    areas = made_up_map(rng, 4)
    lines = lines_of(areas, rng) + [[(21.3, 21.2), (21.9, 22.7)], [(200, 200), (201, 201), (201, 200)]]  # two dead ends
    df = spark.createDataFrame([(wkt(p),) for p in lines] + [(None,), ("LINESTRING (1 1)",)], "geometry string").repartition(3)
    objects = spark.createDataFrame([(k, f"POINT ({x} {y})") for k, (_, (x, y)) in areas.items()], "_oid string, geometry string")
    made, findings = A.assembled(objects, df)
    assert {r["_oid"]: normal(r["geometry"]) for r in made.collect()} == {k: normal(t) for k, (t, _) in areas.items()}
    assert findings.count() == 0


def test_findings(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    lines = spark.createDataFrame([(wkt(square),), (wkt([(x + 10, y) for x, y in square]),)], "geometry string")
    objects = spark.createDataFrame([("a", "POINT (1 1)"), ("b", "POINT (2 2)"), ("c", "POINT (7 7)"), ("d", None), ("e", "POINT (4 1)")], "_oid string, geometry string")
    made, findings = A.assembled(objects, lines)
    assert {r["_oid"] for r in made.where("geometry is null").collect()} == {"c", "d", "e"}
    told = sorted((r["code"], r["key"]) for r in findings.collect())
    assert told[:2] == [("AREA_WITHOUT_BOUNDARY", "c"), ("AREA_WITHOUT_BOUNDARY", "d")] and told[3][0] == "AREA_WITHOUT_OBJECT"
    assert told[4:] == [("AREA_WITH_SEVERAL_POINTS", "a"), ("AREA_WITH_SEVERAL_POINTS", "b")]
    assert A.assembled(objects, lines.limit(0))[0].where("geometry is not null").count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_boundaries_are_written_once_and_give_the_areas_back(spark, seed):
    rng = random.Random(seed)
    areas = made_up_map(rng, 4)
    df = spark.createDataFrame([(k, t) for k, (t, _) in areas.items()] + [("none", None)], "_oid string, geometry string").repartition(3)
    lines = A.boundaries(df).cache()
    written = [tuple(sorted(s)) for r in lines.collect() for s in zip(rings_in(r["geometry"])[0], rings_in(r["geometry"])[0][1:])]
    assert sorted(written) == sorted(tuple(sorted(s)) for s in lines_of(areas, rng))
    # A line goes on to where another meets it: no more lines than sides of cells and islands, which begin anywhere.
    islands = sum(k.endswith(("island", "inner")) for k in areas)
    assert lines.count() <= 2 * 4 * 5 + 2 * islands + 16
    objects = spark.createDataFrame([(k, f"POINT ({x} {y})") for k, (_, (x, y)) in areas.items()], "_oid string, geometry string")
    made, findings = A.assembled(objects, lines.select("geometry"))
    assert {r["_oid"]: normal(r["geometry"]) for r in made.collect()} == {k: normal(t) for k, (t, _) in areas.items()}
    assert findings.count() == 0


def test_overlapping_areas_are_refused(spark):
    square = polygon([(0, 0), (1, 0), (1, 1), (0, 1)])
    df = spark.createDataFrame([(k, square) for k in "abc"], "_oid string, geometry string")
    with pytest.raises(Exception, match="areas overlap at"):
        A.boundaries(df).collect()


def test_long_rings_are_labelled_in_few_rounds(spark):
    n = 300
    pointers = spark.range(n).select(F.col("id").alias("edge"), ((F.col("id") * 7 + 3) % n).alias("next"))
    expected, of = {}, {i: (i * 7 + 3) % n for i in range(n)}
    for i in range(n):
        seen, at = [], i
        while at not in seen:
            seen.append(at)
            at = of[at]
        expected[i] = min(seen)
    assert {r["edge"]: r["label"] for r in A.labelled(pointers).collect()} == expected
