import copy
import hashlib
from decimal import Decimal

import pytest
import yaml
from pyspark.sql import functions as F

from weftline.operators import references
from weftline.functions.registry import REGISTRY, Call, column_of, expression_of, function
from weftline.plans import bundle, runner
from weftline.plans.job import check_geometry, check_oid_domain, check_plans, check_structure, job_of, lineage, load_job, rule_order
from weftline.plans.runner import JobRefused, as_json, catalog_of, markdown, run
from weftline.sources import formats


@pytest.fixture
def plain(sf_dir, tmp_path):
    return {
        "job": {
            "name": "sales",
            "inputs": [
                {"id": "c", "class": "Customer", "path": f"{sf_dir}/customer.parquet", "oid": "c_custkey"},
                {"id": "o", "class": "Order", "path": f"{sf_dir}/orders.parquet", "oid": "o_orderkey"},
            ],
            "outputs": [{"id": "out", "path": f"{tmp_path}/out"}],
        },
        "mapping": {
            "oidStrategy": {"default": "deterministicUuid", "namespace": "ns"},
            "enums": {"status": {"F": "done"}},
            "mandatory": {"Client": ["name"]},
            "rules": [
                {
                    "id": "sales", "target": {"output": "out", "class": "Sale"}, "sources": [{"alias": "o", "class": "Order"}],
                    "assign": {"price": "o.o_totalprice"}, "refs": [{"role": "client", "sourceRef": "o.o_custkey", "targetRule": "clients"}],
                    "losses": [{"sourcePath": "priority", "reasonCode": "DROPPED"}],
                },
                {"id": "clients", "targetClass": "Client", "output": "out", "sources": [{"alias": "c", "class": "Customer", "input": "c"}], "assign": {"name": "c.c_name"}},
            ],
        },
    }


def test_run_commits(spark, plain, tmp_path, sf_dir):
    report = run(spark, job_of(plain))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert report["status"] == "COMMITTED" and {r["rule"]: r["created"] for r in report["rules"]} == {"sales": orders.count(), "clients": 150}
    assert report["losses"] == [{"rule": "sales", "reason_code": "DROPPED", "n": orders.count()}]
    sales, clients = (spark.read.parquet(f"{tmp_path}/out/{c}") for c in ("Sale", "Client"))
    joined = sales.join(clients, sales.client == clients["_oid"])
    assert joined.count() == orders.join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")).count()
    assert "sales" in markdown(report) and '"COMMITTED"' in as_json(report)
    with pytest.raises(FileExistsError):  # nothing is written over
        run(spark, job_of(plain))


def test_integer_identifiers_are_consecutive(spark, plain, tmp_path):
    plain["mapping"]["oidStrategy"] = {"default": "integer"}
    run(spark, job_of(plain))
    sales, clients = (spark.read.parquet(f"{tmp_path}/out/{c}") for c in ("Sale", "Client"))
    numbers = sorted(int(r["_oid"]) for df in (clients, sales) for r in df.select("_oid").collect())
    assert numbers == list(range(1, len(numbers) + 1))
    assert max(int(r["_oid"]) for r in clients.collect()) == clients.count()
    assert sales.where("client is not null").join(clients, sales.client == clients["_oid"], "left_anti").isEmpty()


def test_strict_policy_rolls_back(spark, plain, tmp_path):
    plain["mapping"]["rules"][0]["refs"][0] |= {"required": True, "sourceRef": "o.o_custkey + 1000000"}
    report = run(spark, job_of(plain))
    assert report["status"] == "ROLLED_BACK" and not (tmp_path / "out").exists()
    assert {d["code"] for d in report["diagnostics"]} == {"RUN_REF_MISSING_MANDATORY"}
    plain["job"]["failPolicy"] = "reportOnly"
    assert run(spark, job_of(plain))["status"] == "REPORTED"
    plain["job"]["failPolicy"] = "lenient"
    assert run(spark, job_of(plain))["status"] == "COMMITTED"


def test_expressions_are_checked_before_running(spark, plain):
    plain["mapping"]["rules"][1]["assign"]["name"] = "c.no_such_column"
    with pytest.raises(JobRefused, match="EXPR-INVALID"):
        run(spark, job_of(plain))


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (lambda p: p["mapping"]["rules"][0]["target"].update(output="none"), "MAP-UNKNOWN-OUTPUT"),
        (lambda p: p["mapping"]["rules"][0].update(id="clients"), "MAP-DUPLICATE-RULE"),
        (lambda p: p["mapping"]["rules"][0]["sources"][0].update({"class": "X"}), "MAP-UNKNOWN-CLASS"),
        (lambda p: p["mapping"]["rules"][0]["sources"].append({"alias": "o", "class": "Order"}), "MAP-DUPLICATE-ALIAS"),
        (lambda p: p["mapping"]["rules"][0].update(joins=[{"right": "z", "on": [["1", "1"]]}]), "MAP-JOIN-ALIAS"),
        (lambda p: p["mapping"]["rules"][0].update(joins=[{"right": "o", "on": []}]), "MAP-JOIN-NON-EQUI"),
        (lambda p: p["mapping"]["rules"][0].update(identity={"sourceKey": ["price"]}), "MAP-IDENTITY-KEY"),
        (lambda p: p["mapping"]["rules"][0]["refs"][0].update(targetRule="none"), "MAP-UNKNOWN-RULE"),
        (lambda p: p["mapping"]["rules"][0]["refs"][0].update(expectedClass="Other"), "MAP-REF-CLASS"),
        (lambda p: p["mapping"]["rules"][1]["assign"].clear(), "MAP-MANDATORY-MISSING"),
        (lambda p: p["mapping"]["rules"][1].update(refs=[{"role": "x", "sourceRef": "c.c_custkey", "targetRule": "sales"}]), "MAP-CYCLIC-DEPENDENCY"),
        (lambda p: p["mapping"]["oidStrategy"].update(default="external"), "MAP-OID-STRATEGY"),
        (lambda p: p["mapping"].update(basketStrategy={"default": "expression"}), "MAP-BASKET-STRATEGY"),
        (lambda p: p["job"].update(failPolicy="never"), "MAP-FAIL-POLICY"),
    ],
)
def test_structure(plain, change, code):
    assert not check_structure(job_of(plain))
    change(plain)
    assert code in {d.code for d in check_structure(job_of(plain))}


def test_yaml_and_order(plain, tmp_path):
    (tmp_path / "job.yaml").write_text(yaml.safe_dump(plain))
    job = load_job(f"{tmp_path}/job.yaml")
    assert job == job_of(plain) and rule_order(job.rules) == ["clients", "sales"]


def test_bundle(plain):
    base = {"job": plain["job"], "mapping": {"oidStrategy": plain["mapping"]["oidStrategy"]}}
    other = copy.deepcopy(plain)
    other["mapping"]["enums"]["status"] = {"F": "closed"}
    job = bundle.assemble({"a": plain, "b": other}, base)
    assert [r["id"] for r in job["mapping"]["rules"]] == ["a.sales", "a.clients", "b.sales", "b.clients"]
    assert job["mapping"]["rules"][2]["refs"][0]["targetRule"] == "b.clients"
    assert job["mapping"]["enums"] == {"status": {"F": "done"}, "b_status": {"F": "closed"}}
    other["mapping"]["defaults"], plain["mapping"]["defaults"] = {"x": "1"}, {"x": "2"}
    with pytest.raises(bundle.BundleConflict):
        bundle.assemble({"a": plain, "b": other}, base)


def test_summaries(spark, plain, tmp_path):
    report = run(spark, job_of(plain), commit=False)
    told = bundle.summary(report)
    assert bundle.summaries_match(told, bundle.summary(report)) == []
    changed = copy.deepcopy(told)
    assert told["rules"]["sales"]["filtered"] == 0
    changed["rules"]["sales"]["created"] += 1
    assert bundle.summaries_match(told, changed)[0].startswith("/rules/sales/created")
    (tmp_path / "f").write_bytes(b"x")
    assert bundle.source_matches(f"{tmp_path}/f", hashlib.sha256(b"x").hexdigest())



def test_one_yaml_job_uses_functions_lookups_and_bags(spark, plain, tmp_path, sf_dir):
    rules = plain["mapping"]["rules"]
    rules[0]["assign"] |= {
        "status": {"enumMapDefault": ["o.o_orderstatus", "status", "'other'"]},
        "client_name": {"lookup": ["Customer", "c_custkey", "o.o_custkey", "c_name"]},
        "cheap": {"lte": ["o.o_totalprice", 100000]},
    }
    rules[1] |= {
        "where": {"existsIn": ["o", "Order", "o_custkey", "c.c_custkey"]},
        "bags": {"orders": {"from": {"class": "Order", "alias": "x"}, "parentRef": {"attribute": "o_custkey"}, "assign": {"key": "x.o_orderkey"}, "mandatory": ["key"]}},
        "metadata": {"direction": "forward"},
    }
    plain["job"]["outputs"][0]["format"] = "xtf"
    (tmp_path / "job.yaml").write_text(yaml.safe_dump(plain))
    report = run(spark, load_job(f"{tmp_path}/job.yaml"))
    assert report["status"] == "COMMITTED" and set(report["phases"]) >= {"transform", "references", "write"}
    clients = formats.read_input(spark, f"{tmp_path}/out/Client", {"class": "Client"}, "xtf")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    met = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    assert clients.count() == met.select("c_custkey").distinct().count()
    assert clients.select(F.sum(F.size("orders"))).first()[0] == met.count()
    sales = formats.read_input(spark, f"{tmp_path}/out/Sale", {"class": "Sale"}, "xtf")
    found = {(r["status"], r["cheap"]): r["n"] for r in sales.groupBy("status", "cheap").agg(F.count("*").alias("n")).collect()}
    expected = orders.groupBy(F.when(F.col("o_orderstatus") == "F", "done").otherwise("other").alias("status"), (F.col("o_totalprice") <= 100000).alias("cheap")).count()
    assert found == {(r[0], r[1]): r[2] for r in expected.collect()}
    linked = sales.join(clients, sales.client == clients["_oid"])
    assert linked.count() == met.count() and linked.where("client_name <> name").isEmpty()


def test_roles_of_several_and_created_objects_get_numbers(spark, plain, tmp_path):
    plain["mapping"]["oidStrategy"] = {"default": "integer"}
    plain["mapping"]["rules"][0]["refs"][0]["max"] = 5
    plain["mapping"]["rules"][0]["create"] = [{"class": "Note", "assign": {"k": "o.o_orderkey"}}]
    run(spark, job_of(plain))
    sales, clients, notes = (spark.read.parquet(f"{tmp_path}/out/{c}") for c in ("Sale", "Client", "Note"))
    numbers = sorted(int(r["_oid"]) for df in (clients, sales, notes) for r in df.select("_oid").collect())
    assert numbers == list(range(1, len(numbers) + 1))
    each = sales.select(F.explode("client").alias("to"))
    assert each.count() and each.join(clients, each["to"] == clients["_oid"], "left_anti").isEmpty()


def test_blank_preserved_identifiers_get_numbers(spark, plain, tmp_path):
    plain["mapping"]["oidStrategy"] = {"default": "preserve"}
    plain["job"]["inputs"][1]["oid"] = "if(o_orderkey % 2 = 0, ' ', concat('k', o_orderkey))"
    run(spark, job_of(plain))
    found = {r["_oid"] for r in spark.read.parquet(f"{tmp_path}/out/Sale").collect()}
    blank = {x for x in found if not x.startswith("k")}
    assert blank == {str(k + 1) for k in range(len(blank))} and len(blank) > 100


def test_a_failed_move_takes_the_others_back(spark, plain, tmp_path, monkeypatch):
    (tmp_path / "out").mkdir()
    seen = []

    class Late(runner._Timer):
        def phase(self, name):
            if name == "report":  # another writer takes the second place
                seen.append(name)
            super().phase(name)

    monkeypatch.setattr(runner, "_Timer", Late)
    plain["job"]["outputs"].append({"id": "second", "path": f"{tmp_path}/file"})
    (tmp_path / "file").write_text("no folder")
    plain["mapping"]["rules"][1]["output"] = "second"
    with pytest.raises(Exception):
        run(spark, job_of(plain))
    assert seen and not [p for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]


def test_expanded_bag_and_its_losses(spark, tmp_path):
    rows = [("a", [(1, [7, 8]), (2, [])]), ("b", [(3, [9]), (4, None), (5, [1])]), ("c", []), ("d", None)]
    spark.createDataFrame(rows, "k string, items array<struct<n:int,more:array<int>>>").write.parquet(f"{tmp_path}/in.parquet")
    plain = {
        "job": {"name": "x", "inputs": [{"id": "i", "class": "P", "path": f"{tmp_path}/in.parquet", "oid": "k"}], "outputs": [{"id": "o", "path": f"{tmp_path}/out"}]},
        "mapping": {
            "oidStrategy": {"default": "preserve"},
            "rules": [{
                "id": "r", "target": {"output": "o", "class": "P"}, "sources": [{"alias": "p", "class": "P"}], "assign": {"k": "p.k"},
                "bags": {"items": {
                    "mode": "expand", "items": "items", "alias": "x", "target": "Item", "maxItems": 2, "parentRef": {"role": "parent"}, "assign": {"n": "x.n"},
                    "nestedBags": {"more": {"mode": "expand", "items": "x.more", "alias": "y", "target": "More", "parentRef": {"role": "item"}, "assign": {"v": "y"}}},
                }},
            }],
        },
    }
    report = run(spark, job_of(plain))
    assert report["losses"] == [{"rule": "r", "reason_code": "BAG_MAX_ITEMS_EXCEEDED", "n": 1}]
    items = spark.read.parquet(f"{tmp_path}/out/Item").collect()
    assert sorted((r["parent"], r["n"]) for r in items) == [("a", 1), ("a", 2), ("b", 3), ("b", 4)]
    more = spark.read.parquet(f"{tmp_path}/out/More").collect()
    assert sorted(r["v"] for r in more) == [7, 8, 9]
    assert sorted(int(r["_oid"]) for r in [*items, *more]) == list(range(1, 8))
    assert {r["item"] for r in more} <= {r["_oid"] for r in items}


def test_jdbc_input_of_a_job(spark, tmp_path):
    url, driver = "jdbc:derby:memory:weftjob;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(1, "POINT (1 2)"), (2, ""), (3, None)], "K int, G string")
    df.coalesce(1).write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "places").save()
    query = {"id": "q", "class": "Place", "sql": 'select "K" as id, "G" as shape from places', "columns": {"ID": "id"}, "geometry": [{"column": "shape", "attribute": "geom", "encoding": "wkt"}]}
    plain = {
        "job": {"name": "db", "inputs": [{"id": "db", "connection": {"url": url, "driver": driver}, "queries": [query]}], "outputs": [{"id": "o", "path": f"{tmp_path}/out"}]},
        "mapping": {"oidStrategy": {"default": "preserve"}, "rules": [{"id": "r", "target": {"output": "o", "class": "P"}, "sources": [{"alias": "p", "class": "Place"}], "assign": {"id": "p.id", "geom": "p.geom"}}]},
    }
    run(spark, job_of(plain))
    found = {(r["id"], r["geom"], r["_oid"]) for r in spark.read.parquet(f"{tmp_path}/out/P").collect()}
    assert found == {(1, "POINT (1 2)", "q.1"), (2, None, "q.2"), (3, None, "q.3")}
    plain["job"]["inputs"][0]["connection"] = {}
    assert "MAP-JDBC-INPUT" in {d.code for d in check_structure(job_of(plain))}


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (lambda r: r["assign"].update(x={"noSuch": ["1"]}), "EXPR-UNKNOWN-FUNCTION"),
        (lambda r: r["assign"].update(x={"substring": ["'a'"]}), "EXPR-ARITY"),
        (lambda r: r["assign"].update(x={"now": []}), "EXPR-NON-DETERMINISTIC"),
        (lambda r: r.update(bags={"b": {"mode": "melt"}}), "MAP-BAG-MODE"),
        (lambda r: r.update(bags={"b": {"mode": "expand"}}), "MAP-BAG-TARGET"),
        (lambda r: r.update(bags={"b": {"from": {"class": "X", "alias": "x"}}}), "MAP-UNKNOWN-CLASS"),
        (lambda r: r.update(bags={"price": {"from": {"class": "Order", "alias": "x"}}}), "MAP-DUPLICATE-ATTRIBUTE"),
        (lambda r: r.update(bags={"b": {"maxItems": 0}}), "MAP-BAG-MAX-ITEMS"),
    ],
)
def test_calls_and_bags_are_checked(plain, change, code):
    change(plain["mapping"]["rules"][0])
    assert code in {d.code for d in check_structure(job_of(plain))}


def test_planning_finds_wrong_types_and_keys(spark, plain):
    rule = plain["mapping"]["rules"][0]
    rule["assign"]["x"] = {"eq": ["o.o_totalprice", "o.o_orderstatus"]}
    rule["identity"] = {"sourceKey": ["o.nothing"]}
    job = job_of(plain)
    assert {d.code for d in check_plans(job, catalog_of(spark, job))} == {"EXPR-INVALID", "MAP-IDENTITY-KEY"}


def test_lineage(spark, plain):
    plain["mapping"]["rules"][0]["assign"] |= {"both": {"concat": ["o.o_orderstatus", "o.o_orderpriority"]}, "when": {"now": []}}
    job = job_of(plain)
    told = {(x["rule"], x["attribute"]): (x["columns"], x["deterministic"]) for x in lineage(job, catalog_of(spark, job))}
    assert told["sales", "both"] == (["o.o_orderpriority", "o.o_orderstatus"], True) and not told["sales", "when"][1]


def test_own_functions(spark):
    @function("twice", 1)
    def twice(_, x):
        return x * 2

    try:
        assert spark.range(3).select(column_of(Call("Twice", ("id",))).alias("x")).collect()[2]["x"] == 4
        with pytest.raises(ValueError):
            function("TWICE", 1)(twice)
    finally:
        del REGISTRY["twice"]
    assert expression_of({"if": ["a", {"null": None}, 3]}) == Call("if", ("a", Call("null"), "3"))


def test_domains_and_geometries_fit():
    assert check_oid_domain("integer", "UUIDOID").code == "MAP-OID-TYPE" and check_oid_domain("integer", None) is None
    assert check_geometry("AREA", "SURFACE") is None and check_geometry("COORD", "AREA").code == "GEOM-TYPE"
    assert check_geometry("COORD", "COORD", 3, 2).code == "GEOM-DIMENSION"


def test_run_bundle(spark, plain, tmp_path):
    (tmp_path / "source").write_bytes(b"data")
    source = {"path": f"{tmp_path}/source", "sha256": hashlib.sha256(b"data").hexdigest()}
    base = {"job": plain["job"], "mapping": {"oidStrategy": plain["mapping"]["oidStrategy"]}}
    modules = {"a": plain}
    told = bundle.run_bundle(spark, {"base": base, "source": source}, modules, commit=False)
    assert told["ok"] and told["summary"]["rules"]["a.clients"]["created"] == 150
    again = bundle.run_bundle(spark, {"base": base, "source": source, "expectedSummary": {**told["summary"], "diagnostics": {"X": 1}}}, modules, commit=False)
    assert not again["ok"] and again["differences"]
    with pytest.raises(bundle.BundleConflict):
        bundle.run_bundle(spark, {"base": base, "source": {**source, "sha256": "0"}}, modules)


def test_bundle_renames_value_maps_in_calls(plain):
    base = {"job": plain["job"], "mapping": {}}
    other = copy.deepcopy(plain)
    other["mapping"]["enums"]["status"] = {"F": "closed"}
    for p in (plain, other):
        p["mapping"]["rules"][0]["assign"]["s"] = {"coalesce": [{"enumMap": ["o.o_orderstatus", "status"]}, "'x'"]}
    job = bundle.assemble({"a": plain, "b": other}, base)
    assert job["mapping"]["rules"][2]["assign"]["s"] == {"coalesce": [{"enumMap": ["o.o_orderstatus", "b_status"]}, "'x'"]}


def test_decimal_limits(spark):
    from weftline import functions as W

    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    lit = lambda x: F.lit(x).cast("decimal(38,10)")
    assert value(W.mul(F.lit(0.000001), F.lit(1000000))) == 1
    assert value(W.mul(lit("-1.5"), lit("2.0000000001"))) == Decimal("-3.0000000002")
    assert value(W.mul(F.lit(123456789012345), F.lit(10))) == 1234567890123450
    assert value(W.mul(F.lit(1e-12), F.lit(1e12))) == 1
    assert value(W.div(F.lit(1), F.lit(0.0000001))) == 10_000_000
    assert value(W.div(F.lit(12345678901), F.lit(10))) == Decimal("1234567890.1")
    assert value(W.div(F.lit(2), F.lit(3))) == Decimal("0.6666666667") and value(W.div(F.lit(1), F.lit(0))) is None
    assert [value(W.number_text(lit(x))) for x in ("0.0001", "100", "12345678901234567890", "-2.50")] == ["0.0001", "100", "12345678901234567890", "-2.5"]


def _disk(spark, plain, tmp_path, monkeypatch):
    """The run's report, and the labels of tables that it left."""
    made = []
    monkeypatch.setattr("weftline.storage.shared_folder", lambda spark, label: made.append(f"{tmp_path}/shared/{label}-{len(made)}") or made[-1])
    report = run(spark, job_of(plain))
    assert made
    return report, sorted(p.name for p in (tmp_path / "shared").iterdir())


@pytest.mark.parametrize("oid", ["integer", "deterministicUuid", "preserve"])
def test_a_run_leaves_no_tables_of_its_own(spark, plain, tmp_path, monkeypatch, oid):
    plain["mapping"]["oidStrategy"] = {"default": oid, "namespace": "ns"}
    plain["mapping"]["rules"][0]["create"] = [{"class": "Note", "assign": {"k": "o.o_orderkey"}}]
    report, left = _disk(spark, plain, tmp_path, monkeypatch)
    assert report["status"] == "COMMITTED" and left == []
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_expanded_objects_are_numbered_behind_their_rule(spark, tmp_path, monkeypatch):
    rows = [(f"k{i:02}", [(j, list(range(j % 3))) for j in range(i % 13)], [j for j in range(i % 4)]) for i in range(60)]
    spark.createDataFrame(rows, "k string, items array<struct<n:int,more:array<int>>>, notes array<int>").repartition(7).write.parquet(f"{tmp_path}/in.parquet")
    more = {"mode": "expand", "items": "x.more", "alias": "y", "target": "More", "parentRef": {"role": "item"}, "assign": {"v": "y"}}
    bags = {
        "items": {"mode": "expand", "alias": "x", "target": "Item", "parentRef": {"role": "parent"}, "where": "x.n <> 1", "assign": {"n": "x.n"}, "nestedBags": {"more": more}},
        "notes": {"mode": "expand", "alias": "z", "target": "Text", "parentRef": {"role": "parent"}, "assign": {"v": "z"}},
    }
    rule = lambda k, **x: {"id": k, "target": {"output": "o", "class": k}, "sources": [{"alias": "p", "class": "P"}], "assign": {"k": "p.k"}, **x}
    plain = {
        "job": {"name": "x", "inputs": [{"id": "i", "class": "P", "path": f"{tmp_path}/in.parquet", "oid": "k"}], "outputs": [{"id": "o", "path": f"{tmp_path}/out"}]},
        "mapping": {"oidStrategy": {"default": "integer"}, "rules": [rule("First", bags=bags), rule("Last")]},
    }
    assert _disk(spark, plain, tmp_path, monkeypatch)[1] == []
    got = {c: spark.read.parquet(f"{tmp_path}/out/{c}").collect() for c in ("First", "Item", "More", "Text", "Last")}
    spans = [sorted(int(r["_oid"]) for c in cs for r in got[c]) for cs in (("First",), ("Item", "More", "Text"), ("Last",))]
    assert sum(spans, []) == list(range(1, sum(map(len, spans)) + 1))
    of = {r["_oid"]: r["k"] for r in got["First"]}
    items = {r["_oid"]: (of[r["parent"]], r["n"]) for r in got["Item"]}
    assert sorted(items.values()) == sorted((k, n) for k, i, _ in rows for n, _ in i if n != 1)
    assert sorted((*items[r["item"]], r["v"]) for r in got["More"]) == sorted((k, n, v) for k, i, _ in rows for n, m in i if n != 1 for v in m)
    assert sorted((of[r["parent"]], r["v"]) for r in got["Text"]) == sorted((k, v) for k, _, notes in rows for v in notes)


def test_packed_identifiers(spark):
    texts = ["0b1e2f3a-0000-4000-8000-0123456789ab", "0B1E2F3A-0000-4000-8000-0123456789AB", "7", "", "ä-1", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", references.packed(F.col("t")).alias("b"))
    assert [r["u"] for r in rows.select(references.unpacked(F.col("b")).alias("u")).collect()] == texts
    assert rows.select("b").distinct().count() == len(texts) and max(len(r["b"]) for r in rows.where("t like '0b%'").collect()) == 17
