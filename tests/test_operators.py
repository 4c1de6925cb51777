import pytest
from pyspark.sql import functions as F

from weftline.operators import bags, identity, lookups, references, transfer
from weftline.operators.rules import Catalog, Join, Ref, Rule, Source, lower, matched


@pytest.fixture
def family(spark):
    c = Catalog()
    c.add(spark.createDataFrame([("p1", "Ann"), ("p2", "Bob"), ("p3", None)], "id string, name string"), input_id="a", cls="Parent", oid="id")
    c.add(spark.createDataFrame([("c1", "p1", 5), ("c2", "p1", 7), ("c3", "p9", 1), ("c4", None, 2)], "id string, parent string, n int"), input_id="a", cls="Child", oid="id")
    return c


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


CHILD, PARENT = Source("c", "Child"), Source("p", "Parent")
ON = Join("p", (("c.parent", "p._oid"),))


def test_join_kinds_and_misses(family):
    inner, misses = matched(Rule("r", "o", "T", (CHILD, PARENT), {}, joins=(ON,)), family)
    assert pairs(inner.select(F.col("c._oid").alias("c"), "name"), "c", "name") == [("c1", "Ann"), ("c2", "Ann")]
    assert pairs(misses[0], "code", "key") == [("RUN_JOIN_MISSING", ""), ("RUN_JOIN_MISSING", "p9")]
    left, none = matched(Rule("r", "o", "T", (CHILD, PARENT), {}, joins=(Join("p", ON.on, "left"),)), family)
    assert left.count() == 4 and not none


def test_join_to_a_bound_alias_filters(family):
    rule = Rule("r", "o", "T", (CHILD, PARENT), {}, joins=(ON, Join("p", (("p.name", "'Bob'"),))))
    assert matched(rule, family)[0].count() == 0


def test_filters_on_right_sources_and_unknown_kinds_are_refused(family):
    with pytest.raises(ValueError, match="joined source"):
        matched(Rule("r", "o", "T", (CHILD, Source("p", "Parent", where="p.name = 'Ann'")), {}, joins=(ON,)), family)
    with pytest.raises(ValueError, match="join kind"):
        matched(Rule("r", "o", "T", (CHILD, PARENT), {}, joins=(Join("p", ON.on, "full"),)), family)
    with pytest.raises(KeyError):
        family.records("Nobody")


def test_null_condition_drops_and_null_assignment_beats_defaults(family):
    f = lower(Rule("r", "o", "T", (Source("p", "Parent", where="p.name <> 'Bob'"),), {"x": "nullif(p.name, 'Ann')"}, defaults={"x": "'d'", "y": "'d'"}), family, defaults={"y": "'g'", "z": "'g'"})
    assert pairs(f.targets, "x", "y", "z") == [(None, "d", "g")]


def test_void_identity_falls_back(family):
    f = lower(Rule("r", "o", "T", (PARENT,), {"id": "p.id"}, identity=("p.name",)), family, namespace="n")
    own = lower(Rule("r", "o", "T", (PARENT,), {"id": "p.id"}), family, namespace="n")
    a, b = ({r["id"]: r["_oid"] for r in x.targets.collect()} for x in (f, own))
    assert a["p3"] == b["p3"] and a["p1"] != b["p1"]


def test_preserved_and_unknown_identifiers(family):
    assert pairs(lower(Rule("r", "o", "T", (PARENT,), {}), family, oid="preserve").targets, "_oid") == [("p1",), ("p2",), ("p3",)]
    with pytest.raises(ValueError, match="identifier strategy"):
        lower(Rule("r", "o", "T", (PARENT,), {}), family, oid="external")
    with pytest.raises(ValueError, match="basket strategy"):
        identity.basket("expression", F.lit(None), F.lit(None))


def test_lookup_nulls_and_ambiguity(spark):
    table = spark.createDataFrame([("k", None, 1), ("k", "v", 2), ("m", "w", 1), ("m", "w", 2), (None, "x", 1)], "key string, v string, ord int")
    df = spark.createDataFrame([("k",), ("m",), ("z",), (None,)], "by string")
    got = lookups.lookup(df, F.col("by"), table, F.col("key"), {"v1": F.col("v")}, F.col("ord"))
    assert pairs(got, "by", "v1", "_found", "v1_ambiguous") == sorted([("k", None, True, True), ("m", "w", True, False), ("z", None, False, False), (None, None, False, False)], key=repr)
    assert pairs(lookups.lookup_diagnostics(got, F.col("by"), ["v1"], optional=True), "code", "key") == [("LOOKUP_AMBIGUOUS", "k")]


def test_bag_order_duplicates_and_empty(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([("b", 1), ("a", 1), ("a", 1), (None, 1), ("x", None)], "oid string, parent int")
    df = bags.embed(parents, F.col("id"), children, F.col("parent"), {"oid": F.col("oid")}, order=F.col("oid"), distinct_by=["oid", "parent"])
    assert {r["id"]: [x["oid"] for x in r["bag"]] for r in df.collect()} == {1: ["a", "b", None], 2: []}
    assert pairs(bags.missing_fields(df, "bag", ["oid"], "id"), "source_oid", "field", "n") == [(1, "oid", 1)]
    back = bags.expand(df, "bag", oid="id")
    assert pairs(back, "item_oid") == [("1-0",), ("1-1",), ("1-2",)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_are_gapless_in_order(spark, partitions):
    df = identity.numbered_oids(spark.range(1000).repartition(partitions).withColumn("k", -F.col("id")), ["k"], start=5)
    assert sorted((int(r["_oid"]), r["id"]) for r in df.collect()) == [(5 + i, 999 - i) for i in range(1000)]


def refs_and_targets(spark):
    refs = spark.createDataFrame(
        [("r1", "O", "o1", "x", None, "b1", None, "s1", None, None, None, False, 0), ("r2", "O", "o2", "x", None, "b2", None, "s1", None, None, None, False, 0),
         ("r3", "O", "o3", "x", None, "b3", None, "s1", "other", None, None, True, 0), ("r4", "O", "o4", "x", None, "b1", None, "s1", None, "Z", None, False, 0),
         ("r5", "O", "o5", "x", "i9", "b1", None, "s1", None, None, None, True, 0)],
        "ref_id string, owner_class string, owner_oid string, role string, src_input string, src_basket string, src_class string, src_oid string, target_rule string, expected_class string, card_max int, required boolean, ord int",
    )
    targets = spark.createDataFrame([("i", "b1", "C", "s1", "rule", "T", "t1"), ("i", "b2", "C", "s1", "rule", "T", "t2"), ("i", "b2", "C", "s1", "rule2", "T", "t3")], references.TARGET)
    return refs, targets


def test_reference_tiers(spark):
    found = references.resolve(*refs_and_targets(spark))
    assert pairs(found, "ref_id", "outcome", "target_oid") == [
        ("r1", "RESOLVED", "t1"), ("r2", "AMBIGUOUS", None), ("r3", "MISSING_MANDATORY", None), ("r4", "TYPE_MISMATCH", None), ("r5", "MISSING_MANDATORY", None)
    ]
    assert references.severity("AMBIGUOUS", "lenient") == "ERROR" and references.severity("MISSING_MANDATORY", "lenient") == "WARNING"


def test_attached_roles(spark, family):
    parents = lower(Rule("p", "o", "Parent", (PARENT,), {}), family)
    children = lower(Rule("c", "o", "Child", (CHILD,), {"n": "c.n"}, refs=(Ref("parent", "c.parent", "p"),)), family)
    done = references.attach(children.targets, references.resolve(children.refs, parents.id_map), {"parent": 1})
    oids = {r["_source_oid"]: r["_oid"] for r in parents.targets.collect()}
    assert pairs(done, "n", "parent") == sorted([(5, oids["p1"]), (7, oids["p1"]), (1, None), (2, None)], key=repr)


def test_subgraph_limits(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    seeds = spark.createDataFrame([("n3",)], "node string")
    assert pairs(transfer.subgraph(edges, seeds, max_depth=1), "node", "depth") == [("n2", 1), ("n3", 0), ("n4", 1)]
    assert pairs(transfer.subgraph(edges, seeds, max_depth=9, both_ways=False), "node") == [("n3",), ("n4",), ("n5",), ("n6",)]
    assert pairs(transfer.subgraph(edges, seeds, max_depth=9, max_objects=2), "node") == [("n2",), ("n3",)]


def test_comparison(spark):
    schema = "k int, x double, tags array<string>, note string"
    a = spark.createDataFrame([(1, 1.0, ["a", "b"], "n"), (2, 2.0, [], None), (3, 3.0, [], "z"), (3, 3.0, [], "z"), (None, 0.0, [], "q")], schema)
    b = spark.createDataFrame([(1, 1.0005, ["b", "a"], "m"), (2, 2.5, [], None), (4, 0.0, [], "z"), (None, 0.0, [], "q")], schema)
    how = transfer.Comparison(("k",), multisets=("tags",), numeric=("x",), ignored=("note",))
    got = pairs(transfer.compare(a, b, how), "kind", "attribute", "expected", "actual")
    assert got == sorted([("DIFFERENT", "x", "2.0", "2.5"), ("MISSING", None, None, None), ("UNEXPECTED", None, None, None), ("DUPLICATE", None, "1", "2")], key=repr)
    assert transfer.compare(a.dropDuplicates(), a.dropDuplicates(), how).isEmpty()


def test_embed_then_expand_gives_the_rows_back(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    df = bags.embed(customers, F.col("c_custkey"), orders, F.col("o_custkey"), {"o_orderkey": F.col("o_orderkey")}, order=F.col("o_orderkey"))
    back = bags.expand(df, "bag", oid="c_custkey").select("item.o_orderkey", F.col("c_custkey").alias("owner"))
    known = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", F.col("o_custkey").alias("owner"))
    assert transfer.compare(known, back, transfer.Comparison(("o_orderkey",))).isEmpty()


def test_output_order(spark):
    df = spark.createDataFrame([("b", "C", "2", None), ("b", "C", "1", "x"), ("b", "B", "3", None), ("a", "Z", "9", "x")], "_basket string, _class string, _oid string, ref string")
    assert [r["_oid"] for r in transfer.output_order(df, ["ref"]).collect()] == ["9", "3", "2", "1"]


def test_constraints(spark):
    df = spark.createDataFrame([("1", None, "long text"), ("2", 50.0, "ok"), ("3", -1.0, "no")], "_oid string, x double, t string")
    limits = [transfer.Constraint("x", mandatory=True, low=0, high=10), transfer.Constraint("t", max_length=5, values=("ok", "long text"))]
    assert pairs(transfer.violations(df, limits), "oid", "attribute", "code") == [
        ("1", "t", "LENGTH"), ("1", "x", "MANDATORY"), ("2", "x", "RANGE"), ("3", "t", "VALUE"), ("3", "x", "RANGE")
    ]
