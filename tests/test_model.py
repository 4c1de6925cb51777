import copy

import pytest

from weftline.plans.job import check_structure, job_of
from weftline.plans.model import model_of
from weftline.plans.runner import run

MODEL = {
    "Party": {"attributes": {"name": {"mandatory": True}}},
    "Client": {"extends": "Party", "oid": "I32OID", "attributes": {"kind": {"values": ["kind.good", "kind.bad"]}, "place": {"geometry": "COORD"}}},
    "Sale": {"attributes": {"k": {"type": "bigint"}, "area": {"geometry": "AREA"}}, "roles": {"client": {"class": "Party", "min": 1}, "clients": {"class": "Party", "max": None}}},
    "In": {"attributes": {"line": {"geometry": "POLYLINE"}, "surface": {"geometry": "SURFACE"}}},
}


def job(tmp_path):
    return {
        "model": MODEL,
        "job": {"name": "j", "inputs": [{"id": i, "class": c, "path": f"{tmp_path}/{i}.parquet", "oid": "id"} for i, c in (("c", "C"), ("s", "In"))], "outputs": [{"id": "o", "path": f"{tmp_path}/out"}]},
        "mapping": {"oidStrategy": {"default": "integer"}, "rules": [
            {"id": "clients", "target": {"output": "o", "class": "Client"}, "sources": [{"alias": "c", "class": "C"}], "assign": {"name": "c.name", "kind": "c.kind", "place": "c.place"}},
            {"id": "sales", "target": {"output": "o", "class": "Sale"}, "sources": [{"alias": "s", "class": "In"}], "assign": {"k": "s.id"}, "refs": [{"role": "client", "sourceRef": "s.client", "targetRule": "clients"}, {"role": "clients", "sourceRef": "s.client", "targetRule": "clients"}]},
        ]},
    }


def test_facts_follow_the_model(spark, tmp_path):
    spark.createDataFrame([(1, "Ann", "good", "1.5  2"), (2, "Bob", "kind.bad", "POINT (3 4)"), (3, "Cid", "odd", None)], "id int, name string, kind string, place string").write.parquet(f"{tmp_path}/c.parquet")
    spark.createDataFrame([(7, 1), (8, 2)], "id bigint, client int").write.parquet(f"{tmp_path}/s.parquet")
    plain = job(tmp_path)
    before = copy.deepcopy(plain)
    made = job_of(plain)
    assert plain == before and made.rules[1].refs[0].expected_class == "Client" and made.rules[1].refs[0].required and made.rules[1].refs[1].card_max is None
    assert made.mandatory["Client"] == ("name",) and not [d for d in check_structure(made) if d.severity == "ERROR"]
    report = run(spark, made)
    assert {d["code"]: d["n"] for d in report["diagnostics"]} == {"ENUM_UNKNOWN_VALUE": 1}
    got = {r["name"]: (r["kind"], r["place"]) for r in spark.read.parquet(f"{tmp_path}/out/Client").collect()}
    assert got == {"Ann": ("kind.good", "POINT (1.5 2)"), "Bob": ("kind.bad", "POINT (3 4)"), "Cid": ("odd", None)}
    assert sorted((r["k"], r["client"], r["clients"]) for r in spark.read.parquet(f"{tmp_path}/out/Sale").collect()) == [(7, "1", ["1"]), (8, "2", ["2"])]


@pytest.mark.parametrize(
    ("change", "code"),
    [
        (lambda j: j["mapping"]["rules"][0]["assign"].update(colour="'x'"), "MODEL-ATTRIBUTE"),
        (lambda j: j["mapping"]["rules"][0]["target"].update({"class": "Other"}), "MODEL-CLASS"),
        (lambda j: j["mapping"]["oidStrategy"].update(default="uuid"), "MAP-OID-TYPE"),
        (lambda j: j["mapping"]["rules"][1]["assign"].update(area="s.line"), "GEOM-TYPE"),
        (lambda j: j["mapping"]["rules"][1]["refs"].append({"role": "k", "sourceRef": "s.client"}), "MODEL-ROLE"),
        (lambda j: j["mapping"]["rules"][0]["assign"].pop("name"), "MAP-MANDATORY-MISSING"),
        (lambda j: j["mapping"]["rules"][1]["refs"][0].update(targetRule="sales"), "MAP-REF-CLASS"),
    ],
)
def test_breaches_of_the_model(tmp_path, change, code):
    plain = job(tmp_path)
    change(plain)
    assert code in {d.code for d in check_structure(job_of(plain))}


def test_surfaces_fit_areas_and_bases(tmp_path):
    plain = job(tmp_path)
    plain["mapping"]["rules"][1]["assign"]["area"] = "s.surface"
    assert not [d for d in check_structure(job_of(plain)) if d.severity == "ERROR"]
    model = model_of(MODEL)
    assert list(model.fields("Client")) == ["name", "kind", "place"] and model.is_a("Client", "Party") and model.domain("Client") == "I32OID"
    with pytest.raises(ValueError, match="extend each other"):
        model_of({"A": {"extends": "B"}, "B": {"extends": "A"}}).lineage("A")
