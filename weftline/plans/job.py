"""Jobs: inputs, rules and outputs as plain data (YAML or dicts), checked before anything runs.

Expressions in a job are Spark SQL over the aliases of a rule's sources, which
Spark parses, types and plans, or calls of named functions as data:
{"enumMap": ["o.status", "states"]}. See functions.registry.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml
from pyspark.errors import AnalysisException, ParseException

from weftline.functions.registry import JOINED, REGISTRY, Context, calls_in, column_of, deterministic, expression_of
from weftline.operators.rules import Bag, Catalog, Create, Join, Loss, Ref, Rule, Source, matched, prepared
from weftline.plans.model import Model, applied, model_of, sources_of_geometry

OIDS = {"preserve", "integer", "uuid", "deterministicUuid"}
BASKETS = {"preserve", "generateUuid", "preserveOrGenerateUuid", "byTopic"}
POLICIES = {"strict", "lenient", "reportOnly"}


@dataclass(frozen=True)
class Input:
    id: str
    cls: str
    path: str
    oid: str
    format: str | None = None
    basket: str | None = None
    order: str | None = None
    options: dict = field(default_factory=dict)
    #: Of a database: how to connect, and the query that gives the class.
    connection: dict = field(default_factory=dict)
    query: dict = field(default_factory=dict)
    #: Bags whose structures are records too: attribute, and the name of their class.
    structures: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Output:
    id: str
    path: str
    format: str = "parquet"
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Job:
    name: str
    inputs: tuple[Input, ...]
    outputs: tuple[Output, ...]
    rules: tuple[Rule, ...]
    fail_policy: str = "strict"
    oid: str = "integer"
    namespace: str = ""
    basket: str = "preserve"
    enums: dict[str, dict[str, str]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    #: The file that the job came from; relative files of embedded databases lie beside it.
    base: str = field(default="", compare=False)
    #: Mandatory attributes by target class, for coverage checks.
    mandatory: dict[str, tuple[str, ...]] = field(default_factory=dict)
    model: Model | None = None


@dataclass(frozen=True)
class Diagnostic:
    code: str
    severity: str
    message: str
    rule: str | None = None


def _source(d: dict) -> Source:
    inputs = d.get("inputs") or ([d["input"]] if d.get("input") else [])
    return Source(d["alias"], d["class"], tuple(inputs), _maybe(d.get("where")))


def _maybe(e):
    return None if e is None else expression_of(e)


def _assign(d: dict | None) -> dict:
    return {k: expression_of(e) for k, e in (d or {}).items()}


def _bag(attribute: str, d: dict) -> Bag:
    """A bag from its plain form: from {class, alias, input(s), where}, parentRef {attribute, role}, nestedBags."""
    start, parent = d.get("from"), d.get("parentRef") or {}
    mode = d.get("mode", "embed")
    ref = parent.get("attribute")
    if ref and start and "." not in ref:
        ref = f"{start['alias']}.{ref}"
    return Bag(
        attribute,
        _assign(d.get("assign")),
        _source(start) if start and mode != "expand" else None,
        mode,
        _maybe(d.get("where")),
        ref,
        _maybe(d.get("order")),
        d.get("items"),
        (start or {}).get("alias", d.get("alias", "item")),
        d.get("target"),
        parent.get("role"),
        d.get("maxItems"),
        tuple(d.get("mandatory", [])),
        tuple(_bag(k, b) for k, b in (d.get("nestedBags") or {}).items()),
        tuple(expression_of(d["band"][k]) for k in ("value", "low", "high")) if d.get("band") else None,
    )


def _refs(refs: list[dict] | None) -> tuple[Ref, ...]:
    return tuple(
        Ref(
            r["role"], _maybe(r.get("sourceRef")), r.get("targetRule"), r.get("sourceClass"), r.get("sourceInput"), r.get("expectedClass"),
            r.get("required", False), r.get("max", 1), r.get("singleton", False),
        )
        for r in refs or []
    )


def rule_of(d: dict) -> Rule:
    """A rule from its plain form."""
    target = d.get("target") or {"output": d.get("output"), "class": d.get("targetClass")}
    return Rule(
        d["id"],
        target["output"],
        target["class"],
        tuple(_source(s) for s in d.get("sources", [])),
        _assign(d.get("assign")) | {a["target"]: expression_of(a["expr"]) for a in d.get("attributes", [])},
        tuple(Join(j["right"], tuple((expression_of(p[0]), expression_of(p[1])) for p in j["on"]), j.get("type", "inner")) for j in d.get("joins", [])),
        _maybe(d.get("where")),
        _assign(d.get("defaults")),
        tuple((d.get("identity") or {}).get("sourceKey", [])),
        _refs(d.get("refs")),
        tuple(Loss(x["sourcePath"], x["reasonCode"], x.get("description", ""), _maybe(x.get("when"))) for x in d.get("losses", [])),
        tuple(
            Create(c["class"], _assign(c["assign"]), c.get("id"), _refs(c.get("refs")), (c.get("identity") or {}).get("oidStrategy")) for c in d.get("create", [])
        ),
        tuple(_bag(k, b) for k, b in (d.get("bags") or {}).items()),
        tuple(sorted((str(k), str(v)) for k, v in (d.get("metadata") or {}).items())),
    )


def _structures(cls: str, d: dict) -> tuple[tuple[str, str], ...]:
    """Of `structures`, a list of attributes, or the names of classes by attribute; a class is named by its attribute otherwise."""
    stated = d.get("structures") or {}
    return tuple((a, (stated.get(a) if isinstance(stated, dict) else None) or f"{cls}.{a}") for a in stated)


def _inputs(d: dict) -> list[Input]:
    """An input, or one for each query of a database input and for each class of a transfer."""
    if "queries" in d:
        return [
            Input(d["id"], q["class"], "", q.get("oidColumn", ""), "jdbc", None, None, {}, dict(d.get("connection", {})), {**q, "id": q.get("id", d["id"])})
            for q in d["queries"]
        ]
    if "classes" in d:  # several classes of one transfer: each has the input's options and its own
        shared = {"format": d.get("format"), "basket": d.get("basket"), "order": d.get("order"), "oid": d.get("oid", "_oid")}
        return [
            Input(d["id"], cls, d["path"], own.get("oid", shared["oid"]), shared["format"], own.get("basket", shared["basket"]), own.get("order", shared["order"]), {**d.get("options", {}), "class": cls, **own.get("options", {})}, structures=_structures(cls, own))
            for cls, own in d["classes"].items()
        ]
    return [Input(d["id"], d["class"], d["path"], d["oid"], d.get("format"), d.get("basket"), d.get("order"), dict(d.get("options", {})), structures=_structures(d["class"], d))]


def job_of(d: dict) -> Job:
    """A job from its plain form; older field names (input, targetClass, output) are understood. Facts of a `model` (see
    plans.model) count where the job states nothing else."""
    model = model_of(d["model"]) if d.get("model") else None
    d = applied(d, model) if model else d
    job, mapping = d.get("job", {}), d.get("mapping", {})
    oid, basket = mapping.get("oidStrategy") or {}, mapping.get("basketStrategy") or {}
    return Job(
        job.get("name", ""),
        tuple(x for i in job.get("inputs", []) for x in _inputs(i)),
        tuple(Output(o["id"], o["path"], o.get("format", "parquet"), dict(o.get("options", {}))) for o in job.get("outputs", [])),
        tuple(rule_of(r) for r in mapping.get("rules", [])),
        job.get("failPolicy", "strict"),
        oid.get("default", "integer"),
        oid.get("namespace", ""),
        basket.get("default", "preserve"),
        {k: {str(a): str(b) for a, b in v.items()} for k, v in mapping.get("enums", {}).items()},
        _assign(mapping.get("defaults")),
        mandatory={k: tuple(v) for k, v in mapping.get("mandatory", {}).items()},
        model=model,
    )


def load_job(path: str) -> Job:
    return replace(job_of(yaml.safe_load(Path(path).read_text())), base=path)


def rule_order(rules: tuple[Rule, ...]) -> list[str]:
    """Rules so that those referred to come first; ValueError names a cycle. A reference to the own rule is none."""
    needs = {r.id: {x.target_rule for x in (*r.refs, *(x for c in r.create for x in c.refs)) if x.target_rule and x.target_rule != r.id} for r in rules}
    done: list[str] = []
    while len(done) < len(needs):
        ready = [k for k in needs if k not in done and needs[k] <= {*done} | (needs[k] - set(needs))]
        if not ready:
            raise ValueError(f"rules refer to each other: {sorted(set(needs) - set(done))}")
        done += ready
    return done


def check_structure(job: Job) -> list[Diagnostic]:
    """Names, references among parts, strategies, coverage of mandatory attributes, identity keys."""
    out: list[Diagnostic] = []
    error = lambda code, text, rule=None: out.append(Diagnostic(code, "ERROR", text, rule))
    for i in job.inputs:
        if i.format == "jdbc" and not (i.connection.get("url") and i.query.get("sql")):
            error("MAP-JDBC-INPUT", f"input {i.id}: a database needs a connection's url and a query's sql")
    for kind, names in (("INPUT", [(i.id, i.cls) for i in job.inputs]), ("OUTPUT", [o.id for o in job.outputs]), ("RULE", [r.id for r in job.rules])):
        for n in {n for n in names if names.count(n) > 1}:
            error(f"MAP-DUPLICATE-{kind}", f"{kind.lower()} {n} is defined twice")
    for value, known, code in ((job.oid, OIDS, "MAP-OID-STRATEGY"), (job.basket, BASKETS, "MAP-BASKET-STRATEGY"), (job.fail_policy, POLICIES, "MAP-FAIL-POLICY")):
        if value not in known:
            error(code, f"{value!r} is none of {sorted(known)}")
    outputs, inputs, rules = {o.id for o in job.outputs}, {i.id for i in job.inputs}, {r.id: r for r in job.rules}
    classes = {i.cls for i in job.inputs} | {name for i in job.inputs for _, name in i.structures}
    for r in job.rules:
        aliases = [s.alias for s in r.sources]
        if not r.sources:
            error("MAP-MISSING-SOURCE", "the rule has no source", r.id)
        if r.output not in outputs:
            error("MAP-UNKNOWN-OUTPUT", f"no output {r.output!r}", r.id)
        if len(set(aliases)) < len(aliases):
            error("MAP-DUPLICATE-ALIAS", f"aliases {aliases} repeat", r.id)
        for s in r.sources:
            if s.cls not in classes:
                error("MAP-UNKNOWN-CLASS", f"no input has class {s.cls!r}", r.id)
            for i in set(s.inputs) - inputs:
                error("MAP-UNKNOWN-INPUT", f"no input {i!r}", r.id)
        for j in r.joins:
            if j.right not in aliases:
                error("MAP-JOIN-ALIAS", f"no source {j.right!r}", r.id)
            if not j.on:
                error("MAP-JOIN-NON-EQUI", "a join states pairs of equal expressions", r.id)
            if j.kind not in ("inner", "left"):
                error("MAP-JOIN-TYPE", f"join type {j.kind!r}", r.id)
        if len(set(r.identity)) < len(r.identity) or any("." not in k or k.partition(".")[0] not in aliases for k in r.identity):
            error("MAP-IDENTITY-KEY", f"identity keys {list(r.identity)} must be distinct and qualified by an alias", r.id)
        for c in r.create:
            if c.oid not in (None, "deterministicUuid", "integer"):
                error("MAP-OID-STRATEGY", f"create {c.cls}: strategy {c.oid!r}", r.id)
            if c.id and [x.id for x in r.create].count(c.id) > 1:
                error("MAP-DUPLICATE-CREATE", f"create {c.id} is defined twice", r.id)
        for x in (*r.refs, *(x for c in r.create for x in c.refs)):
            if x.target_rule and x.target_rule not in rules:
                error("MAP-UNKNOWN-RULE", f"reference {x.role} to no rule {x.target_rule!r}", r.id)
            elif x.target_rule and x.expected_class and rules[x.target_rule].cls != x.expected_class:
                error("MAP-REF-CLASS", f"rule {x.target_rule} makes {rules[x.target_rule].cls}, reference {x.role} expects {x.expected_class}", r.id)
        for b in r.bags:
            out.extend(_check_bag(r, b, classes))
        bags = {b.attribute for b in r.bags if b.mode != "expand"}
        if twice := bags & {*r.assign, *r.defaults}:
            error("MAP-DUPLICATE-ATTRIBUTE", f"{sorted(twice)} are bags and have values", r.id)
        for c in (c for e in _expressions(r, job) for c in calls_in(e)):
            f = REGISTRY.get(c.name.lower())
            if not f and c.name.lower() not in JOINED:
                error("EXPR-UNKNOWN-FUNCTION", f"no function {c.name!r}", r.id)
            elif f and (len(c.args) < f.least or f.most is not None and len(c.args) > f.most):
                error("EXPR-ARITY", f"{f.name} with {len(c.args)} arguments", r.id)
            elif f and not f.deterministic:
                out.append(Diagnostic("EXPR-NON-DETERMINISTIC", "WARNING", f"{f.name} gives another value in every run", r.id))
        covered = {*r.assign, *r.defaults, *job.defaults, *(x.role for x in r.refs), *bags}
        for a in job.mandatory.get(r.cls, ()):
            if a not in covered:
                error("MAP-MANDATORY-MISSING", f"mandatory attribute {a} of {r.cls} has no value", r.id)
    try:
        rule_order(job.rules)
    except ValueError as e:
        error("MAP-CYCLIC-DEPENDENCY", str(e))
    return out + (check_model(job) if job.model else [])


def check_model(job: Job) -> list[Diagnostic]:
    """Rules against the model: unknown attributes and roles, roles of another class, identifiers and geometries that don't fit."""
    out = []
    for r in job.rules:
        if r.cls not in job.model.classes:
            out.append(Diagnostic("MODEL-CLASS", "ERROR", f"no class {r.cls}", r.id))
            continue
        fields = job.model.fields(r.cls)
        bags = [b.attribute for b in r.bags if b.mode != "expand"]
        for name in dict.fromkeys([*r.assign, *r.defaults, *(x.role for x in r.refs), *bags]):
            if name not in fields:
                out.append(Diagnostic("MODEL-ATTRIBUTE", "ERROR", f"{r.cls} has no {name}", r.id))
        out += [Diagnostic("MODEL-ROLE", "ERROR", f"{x.role} of {r.cls} is no role", r.id) for x in r.refs if x.role in fields and "class" not in fields[x.role].metadata]
        found = [check_oid_domain(job.oid, job.model.domain(r.cls)), *(check_geometry(a, b) for _, a, b in sources_of_geometry(r, job.model))]
        out += [replace(f, rule=r.id) for f in found if f]
    return out


def _expressions(r: Rule, job: Job) -> list:
    bags = [e for b in all_bags(r.bags) for e in (*b.assign.values(), b.where, b.order, b.source and b.source.where, *(b.band or ()))]
    of_rule = [*r.assign.values(), *r.defaults.values(), r.where, *(s.where for s in r.sources), *(x.source_oid for x in r.refs), *(x.when for x in r.losses), *(x.source_oid for c in r.create for x in c.refs)]
    return [e for e in [*job.defaults.values(), *of_rule, *bags, *(e for c in r.create for e in c.assign.values())] if e is not None]


def all_bags(bags: tuple[Bag, ...]):
    """Bags and the bags within them."""
    for b in bags:
        yield b
        yield from all_bags(b.bags)


def _check_bag(r: Rule, b: Bag, classes: set[str]) -> list[Diagnostic]:
    out = []
    if b.mode not in ("embed", "summary", "expand") or b.mode == "summary" and (b.source is None or b.mandatory):
        out.append(Diagnostic("MAP-BAG-MODE", "ERROR", f"bag {b.attribute}: mode {b.mode!r}", r.id))
    if b.source and b.source.cls not in classes:
        out.append(Diagnostic("MAP-UNKNOWN-CLASS", "ERROR", f"bag {b.attribute}: no input has class {b.source.cls!r}", r.id))
    if b.max_items is not None and b.max_items < 1:
        out.append(Diagnostic("MAP-BAG-MAX-ITEMS", "ERROR", f"bag {b.attribute}: maxItems {b.max_items}", r.id))
    if b.mode == "expand" and not b.target:
        out.append(Diagnostic("MAP-BAG-TARGET", "ERROR", f"bag {b.attribute}: an expanded bag names the class of its objects", r.id))
    for x in b.bags:
        if x.mode != b.mode and (x.mode, b.mode) != ("embed", "summary"):
            out.append(Diagnostic("MAP-BAG-MODE", "ERROR", f"bag {x.attribute} within {b.attribute}: mode {x.mode!r} within {b.mode!r}", r.id))
    if b.mode == "expand" and r.joins:
        out.append(Diagnostic("MAP-BAG-JOIN", "ERROR", f"bag {b.attribute}: a rule with joins can't expand a bag", r.id))
    return [*out, *(d for x in b.bags for d in _check_bag(r, x, classes))]


PLANNING = (AnalysisException, ParseException, KeyError, ValueError)


def _planned(job: Job, r: Rule, catalog: Catalog, attributes: dict) -> Context:
    one = r if r.joins or len(r.sources) == 1 else Rule(r.id, r.output, r.cls, r.sources[:1], {}, refs=r.refs, bags=r.bags)
    context = Context(enums=job.enums)
    df, _ = matched(one, catalog, context)
    context.df = prepared(one, one.sources[0], df, catalog, context, attributes)
    return context


def check_plans(job: Job, catalog: Catalog) -> list[Diagnostic]:
    """Expressions that Spark can't resolve or type, found by planning each rule without running it."""
    out = []
    for r in job.rules:
        attributes = {**job.defaults, **r.defaults, **r.assign}
        try:
            context = _planned(job, r, catalog, attributes)
        except PLANNING as e:
            out.append(Diagnostic("EXPR-INVALID", "ERROR", str(e).splitlines()[0], r.id))
            continue
        for name, e in attributes.items():
            try:
                context.df.select(column_of(e, context))
            except PLANNING as error:
                out.append(Diagnostic("EXPR-INVALID", "ERROR", f"{name}: {str(error).splitlines()[0]}", r.id))
        for key in r.identity:
            try:
                if not (kind := context.df.select(key).schema[0].dataType.typeName()) or kind in ("array", "struct", "map", "binary"):
                    out.append(Diagnostic("MAP-IDENTITY-KEY", "ERROR", f"identity key {key} is {kind}", r.id))
            except PLANNING as error:
                out.append(Diagnostic("MAP-IDENTITY-KEY", "ERROR", f"{key}: {str(error).splitlines()[0]}", r.id))
    return out


def lineage(job: Job, catalog: Catalog) -> list[dict]:
    """Of every attribute of every rule: the source columns that its analysed plan refers to, and whether it is deterministic."""
    out = []
    for r in job.rules:
        attributes = {**job.defaults, **r.defaults, **r.assign}
        context = _planned(job, r, catalog, attributes)
        for name, e in attributes.items():
            column = column_of(e, context)
            tree = context.df.select(column.alias("x"))._jdf.queryExecution().analyzed().expressions().head()
            found = tree.references().iterator()
            names = set()
            while found.hasNext():
                a = found.next()
                names.add(".".join([*(q for q in a.qualifier().mkString(".").split(".") if q), a.name()]))
            out.append({"rule": r.id, "attribute": name, "columns": sorted(names), "deterministic": bool(tree.deterministic()) and deterministic(e)})
    return out


#: Domains of identifiers, and which strategies make identifiers that fit them. Fixed values.
OID_DOMAINS = {"UUIDOID": {"uuid", "deterministicUuid", "preserve"}, "STANDARDOID": {"preserve"}, "I32OID": {"integer", "preserve"}, "ANYOID": OIDS}


def check_oid_domain(strategy: str, domain: str | None) -> Diagnostic | None:
    """A finding where a class's domain of identifiers doesn't take what the strategy makes; no domain takes all."""
    if domain is None or strategy in OID_DOMAINS.get(domain.upper(), OIDS):
        return None
    return Diagnostic("MAP-OID-TYPE", "ERROR", f"strategy {strategy} makes no {domain}")


#: Kinds of geometry, and the kinds that each may be assigned to. Fixed values.
GEOMETRY_FITS = {"COORD": {"COORD"}, "POLYLINE": {"POLYLINE"}, "SURFACE": {"SURFACE", "AREA"}, "AREA": {"AREA", "SURFACE"}}


def check_geometry(source: str, target: str, source_dimension: int = 2, target_dimension: int = 2) -> Diagnostic | None:
    """Surfaces and areas fit each other, other kinds only their own; three dimensions don't go into two."""
    if target.upper() not in GEOMETRY_FITS.get(source.upper(), set()):
        return Diagnostic("GEOM-TYPE", "ERROR", f"{source} can't become {target}")
    if source_dimension > target_dimension:
        return Diagnostic("GEOM-DIMENSION", "ERROR", f"{source_dimension} dimensions can't become {target_dimension}")
    return None

