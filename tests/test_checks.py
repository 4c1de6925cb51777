import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.geometry import interior_point, rings_of_wkt
from weftline.operators import checks
from weftline.operators.rules import Catalog
from weftline.operators.signatures import compare_signatures, signatures


def catalog(spark, parcels, owners, name=lambda k: k):
    c = Catalog()
    p = spark.createDataFrame([(name(k), size, None if o is None else name(o), [name(n) for n in near], notes) for k, size, o, near, notes in parcels], "id string, size double, owner string, near array<string>, notes array<struct<t:string,n:int>>")
    o = spark.createDataFrame([(name(k), label) for k, label in owners], "id string, label string")
    return c.add(p.withColumnRenamed("id", "key"), input_id="x", cls="Parcel", oid="key").add(o.withColumnRenamed("id", "key"), input_id="x", cls="Owner", oid="key")


REFS = {"Parcel": ["owner", "near"]}
OWNERS = [("o1", "Ann"), ("o2", "Ann"), ("o3", "Bob")]
PARCELS = [("p1", 5.0, "o1", ["p2"], [("a", 1), ("b", None)]), ("p2", 5.0, "o2", ["p1", "p3"], []), ("p3", 5.0, "o2", [], None), ("p4", 5.0, None, ["p4"], []), ("p5", 6.5, "o3", [], [])]
IGNORED = {"*": ("key",)}


def test_other_identifiers_compare_as_equal(spark):
    names = {k: f"n{i}" for i, k in enumerate(random.Random(1).sample([k for k, *_ in [*PARCELS, *OWNERS]], 8))}
    flipped = [(k, s, o, near[::-1], notes and notes[::-1]) for k, s, o, near, notes in PARCELS]
    assert compare_signatures(catalog(spark, PARCELS, OWNERS), catalog(spark, flipped[::-1], OWNERS[::-1], names.get), REFS, ignored=IGNORED).count() == 0
    told = signatures(catalog(spark, PARCELS, OWNERS), REFS, ignored=IGNORED)
    assert told.select("signature").distinct().count() == 8  # owners of one label are told apart by their parcels


@pytest.mark.parametrize(
    ("change", "missing"),
    [
        (lambda p, o: p.__setitem__(4, ("p5", 7.0, "o3", [], [])), {"Parcel": 1, "Owner": 1}),
        (lambda p, o: p.__setitem__(2, ("p3", 5.0, "o1", [], None)), {"Parcel": 3, "Owner": 2}),
        (lambda p, o: o.__setitem__(2, ("o3", "Bea")), {"Parcel": 1, "Owner": 1}),
    ],
)
def test_changes_show_in_what_reaches_them(spark, change, missing):
    parcels, owners = list(PARCELS), list(OWNERS)
    change(parcels, owners)
    found = compare_signatures(catalog(spark, PARCELS, OWNERS), catalog(spark, parcels, owners), REFS, ignored=IGNORED)
    assert {(r["cls"], r["kind"]): r["n"] for r in found.collect()} == {(c, k): n for c, n in missing.items() for k in ("MISSING", "UNEXPECTED")}


def test_expected_losses_dont_count(spark):
    parcels = [(k, None, o, near, notes) for k, _, o, near, notes in PARCELS]
    assert compare_signatures(catalog(spark, PARCELS, OWNERS), catalog(spark, parcels, OWNERS), REFS, ignored={**IGNORED, "Parcel": ("size",)}).count() == 0


def test_breaches_across_objects(spark):
    p = spark.createDataFrame([("1", "x", "a", ["a", "b"]), ("2", "x", "c", []), ("3", None, None, None), ("4", None, "a", ["z", "y"])], "_oid string, k string, owner string, many array<string>")
    o = spark.createDataFrame([("a",), ("b",), ("d",)], "_oid string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(checks.not_unique(p, ["k"])) == [("NOT_UNIQUE", "x", 2)]
    assert rows(checks.without_target(p, "owner", o)) == [("NO_TARGET", "2", 1)] and rows(checks.without_target(p, "many", o)) == [("NO_TARGET", "4", 2)]
    assert rows(checks.beyond_cardinality(o, p, "owner", 1, 1)) == [("CARDINALITY", "a", 2), ("CARDINALITY", "b", 0), ("CARDINALITY", "d", 0)]


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(2)
    shapes = {f"g{i}.{j}": [(10 * i, 10 * j), (10 * i + 10, 10 * j), (10 * i + 10, 10 * j + 10), (10 * i, 10 * j + 10)] for i in range(5) for j in range(5)}  # neighbours share edges
    for k in range(25):
        x, y, w, h = rng.uniform(-5, 60), rng.uniform(-5, 60), rng.choice([0.5, 3, 20, 200]), rng.uniform(0.5, 4)
        shapes[f"r{k}"] = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    wkt = lambda p: "POLYGON ((" + ", ".join(f"{a!r} {b!r}" for a, b in [*p, p[0]]) + "))"
    df = spark.createDataFrame([(k, wkt(p)) for k, p in shapes.items()] + [("none", None)], "_oid string, geometry string").repartition(3)
    box = {k: (p[0][0], p[1][0], p[0][1], p[2][1]) for k, p in shapes.items()}
    meet = lambda p, q: max(p[0], q[0]) < min(p[1], q[1]) and max(p[2], q[2]) < min(p[3], q[3])
    expected = {(a, b) for a in box for b in box if a < b and meet(box[a], box[b])}
    assert {tuple(r) for r in checks.overlaps(df).collect()} == expected and expected


def test_a_hole_is_no_overlap():
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    assert not checks.overlap([ring, hole], [hole]) and checks.overlap([ring], [hole]) and checks.overlap([ring], [ring])


def odd(rings, x, y):
    n = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            n += (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
    return n % 2 == 1


@pytest.mark.parametrize(
    "wkt",
    [
        "POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0))",  # a bow tie
        "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 5 2, 5 5, 2 5, 2 2), (5 5, 8 5, 8 8, 5 8, 5 5))",  # holes that touch
        "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (0 0, 5 2, 5 5, 0 0))",  # a hole that touches the shell
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 9, 5 5), (6 6, 8 6, 8 8, 6 8, 6 6)))",
    ],
)
def test_interior_points_without_repair(wkt):
    rings = rings_of_wkt(wkt)
    assert odd(rings, *interior_point(rings))


def test_no_inside():
    assert interior_point([[(0.0, 0.0), (5.0, 5.0), (0.0, 0.0)]]) is None and interior_point([]) is None


def test_shapes_are_not_broadcast(spark):
    rows = spark.range(50).selectExpr("cast(id as string) as _oid", "concat('POLYGON ((', id, ' 0, ', id + 1, ' 0, ', id + 1, ' 1, ', id, ' 0))') as geometry")
    plan = checks.overlaps(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
