import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.bands import band_join, fold
from weftline.operators.rules import Catalog, lower
from weftline.plans.job import rule_of


@pytest.mark.parametrize("buckets", [4, 50])
def test_equals_all_pairs(spark, buckets):
    rng = random.Random(buckets)
    values = [(i, rng.choice([5.0, rng.gauss(0, 10), rng.uniform(-100, 100)])) for i in range(300)] + [(300, None), (301, float("inf"))]
    ranges = [(i, *sorted([rng.gauss(0, 20), rng.choice([5.0, rng.gauss(0, 20)])])) for i in range(80)]
    ranges += [(80, 3.0, 2.0), (81, None, 5.0), (82, 5.0, 5.0), (83, -1e9, 1e9), (84, float("-inf"), float("inf"))]
    v, r = spark.createDataFrame(values, "v int, x double").repartition(3), spark.createDataFrame(ranges, "r int, low double, high double").repartition(3)
    met = band_join(v, F.col("x"), r, F.col("low"), F.col("high"), buckets)
    expected = sorted((a, b) for a, x in values for b, low, high in ranges if None not in (x, low, high) and low <= x <= high)
    assert sorted((t["v"], t["r"]) for t in met.collect()) == expected
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_value_and_empty_sides(spark):
    v = spark.createDataFrame([(i, 7) for i in range(50)], "v int, x bigint")
    r = spark.createDataFrame([(1, 7, 7), (2, 8, 9), (3, 0, 10)], "r int, low bigint, high bigint")
    assert band_join(v, F.col("x"), r, F.col("low"), F.col("high")).count() == 100
    assert band_join(v.limit(0), F.col("x"), r, F.col("low"), F.col("high")).count() == 0
    assert band_join(v, F.col("x"), r.limit(0), F.col("low"), F.col("high")).count() == 0


@pytest.mark.parametrize("of_children", [True, False])
@pytest.mark.parametrize("buckets", [2, 50])
def test_fold_counts_the_pairs(spark, of_children, buckets):
    rng = random.Random(buckets)
    values = [(i, rng.choice([5.0, rng.gauss(0, 10), rng.uniform(-100, 100)]), i % 3) for i in range(300)] + [(300, None, 1), (301, float("inf"), 1), (302, float("-inf"), 2)]
    ranges = [(i, *sorted([rng.gauss(0, 20), rng.choice([5.0, rng.gauss(0, 20)])]), i % 4) for i in range(120)]
    ranges += [(120, 3.0, 2.0, 1), (121, None, 5.0, 1), (122, 5.0, 5.0, 1), (123, -1e9, 1e9, 2), (124, float("-inf"), float("inf"), 1)]
    v, r = spark.createDataFrame(values, "v bigint, x double, g int").repartition(3), spark.createDataFrame(ranges, "r bigint, low double, high double, h int").repartition(3)
    parents, children, key, place, shared = (r, v, "r", "v", "g") if of_children else (v, r, "v", "r", "h")
    got = fold(parents, key, children, F.col("x"), F.col("low"), F.col("high"), of_children=of_children, shared=[shared], place=place, met=lambda df: df.where("g <> h"), buckets=buckets)
    pairs = [(a, b) if of_children else (b, a) for b, x, g in values for a, low, high, h in ranges if None not in (x, low, high) and low <= x <= high and g != h]
    expected = {p: (sum(a == p for a, _ in pairs), min(b for a, b in pairs if a == p)) for p, _ in pairs}
    assert {t[key]: (t["n"], t[place]) for t in got.collect()} == expected


def _clients(spark, mode: str, n: int = 60):
    catalog = Catalog().add(spark.range(n).selectExpr("id as k", "id % 7 * 1.5 as v", "id % 3 as g"), input_id="t", cls="P", oid="k")
    catalog.add(spark.range(n).selectExpr("id as k", "id % 11 * 0.9 as w", "id % 3 as g", f"if(id % 5 = 0, null, {n} - id) as place"), input_id="t", cls="C", oid="k")
    bag = {
        "mode": mode, "from": {"class": "C", "alias": "c", "where": "c.k <> 4"}, "band": {"value": "c.w", "low": "p.v - 2", "high": "p.v + 1"},
        "where": "c.g + 0 <> p.g", "assign": {"key": "c.k", "w": "c.w"}, "order": "c.place",
    }
    return lower(rule_of({"id": "r", "output": "out", "targetClass": "T", "sources": [{"alias": "p", "class": "P"}], "assign": {"k": "p.k"}, "bags": {"bag": bag}}), catalog, oid="preserve").targets


def test_summary_is_what_embed_gives(spark):
    embedded = {t["k"]: (len(t["bag"]), tuple(t["bag"][0]) if t["bag"] else None) for t in _clients(spark, "embed").collect()}
    told = {t["k"]: (t["bag"]["n"], t["bag"]["first"] and tuple(t["bag"]["first"])) for t in _clients(spark, "summary").collect()}
    assert told == embedded and len({n for n, _ in told.values()}) > 3


def test_summary_makes_no_pairs(spark):
    rows = _clients(spark, "summary", 200_000).agg(F.sum("bag.n").alias("n")).first()
    per = lambda i: (i % 7) * 1.5
    kinds = {(i % 7, i % 3): 0 for i in range(21)}
    for i in range(200_000):
        kinds[i % 7, i % 3] += 1
    others: dict = {}
    for i in range(200_000):
        if i != 4:
            others[i % 11 * 0.9, i % 3] = others.get((i % 11 * 0.9, i % 3), 0) + 1
    assert rows["n"] == sum(n * m for (a, g), n in kinds.items() for (w, h), m in others.items() if g != h and per(a) - 2 <= round(w, 9) <= per(a) + 1)


def test_summary_of_referring_records(spark):
    catalog = Catalog().add(spark.range(4).selectExpr("id as k"), input_id="t", cls="P", oid="k")
    catalog.add(spark.range(9).selectExpr("id as k", "id % 3 as of"), input_id="t", cls="C", oid="k")
    bag = {"mode": "summary", "from": {"class": "C", "alias": "c"}, "parentRef": {"attribute": "of"}, "order": "-c.k", "assign": {"key": "c.k"}}
    rule = rule_of({"id": "r", "output": "out", "targetClass": "T", "sources": [{"alias": "p", "class": "P"}], "assign": {"k": "p.k"}, "bags": {"bag": bag}})
    rows = lower(rule, catalog, oid="preserve").targets.select("k", "bag.n", "bag.first.key").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(0, 3, 6), (1, 3, 7), (2, 3, 8), (3, 0, None)]
