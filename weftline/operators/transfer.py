"""Operators over whole transfers: inventory, connected subgraphs, comparison, output order, constraints."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.identity import numbered_oids
from weftline.operators.rules import ENVELOPE, Catalog
from weftline.storage import stored


def inventory(catalog: Catalog) -> DataFrame:
    """(cls, input, basket, n_objects) over all inputs."""
    parts = [catalog.records(c, (i,)).select("_class", "_input", "_basket") for c, i in catalog.classes()]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy(F.col("_class").alias("cls"), F.col("_input").alias("input"), F.col("_basket").alias("basket")).agg(F.count("*").alias("n_objects"))


def inventory_references(catalog: Catalog, references: dict[str, list[str]]) -> DataFrame:
    """(cls, attribute, n_set, n_distinct) of reference attributes by class."""
    parts = []
    for cls, attributes in references.items():
        df = catalog.records(cls)
        for a in attributes:
            parts.append(df.agg(F.count(a).alias("n_set"), F.count_distinct(a).alias("n_distinct")).select(F.lit(cls).alias("cls"), F.lit(a).alias("attribute"), "n_set", "n_distinct"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def inventory_values(catalog: Catalog, attributes: dict[str, list[str]]) -> DataFrame:
    """(cls, attribute, value, n) of classification attributes by class; null is a value. A class is read once for all of them."""
    parts = []
    for cls, names in attributes.items():
        each = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in names))
        rows = catalog.records(cls).select(F.explode(each).alias("e")).groupBy("e.attribute", "e.value").agg(F.count("*").alias("n"))
        parts.append(rows.select(F.lit(cls).alias("cls"), "attribute", "value", "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


#: How a text of geometry begins, by kind. Fixed values.
GEOMETRY_WORDS = {"POINT": "COORD", "LINESTRING": "POLYLINE", "MULTILINESTRING": "POLYLINE", "POLYGON": "SURFACE", "MULTIPOLYGON": "SURFACE"}


def inventory_geometries(catalog: Catalog, attributes: dict[str, list[str]]) -> DataFrame:
    """(cls, attribute, kind, n) of attributes that hold WKT; rows without geometry aren't counted."""
    kinds = F.create_map(*(F.lit(x) for kv in GEOMETRY_WORDS.items() for x in kv))
    parts = []
    for cls, names in attributes.items():
        for a in names:
            kind = F.coalesce(F.try_element_at(kinds, F.upper(F.regexp_extract(F.col(a), r"^\s*([A-Za-z]+)", 1))), F.lit("UNKNOWN"))
            rows = catalog.records(cls).where(F.col(a).isNotNull()).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
            parts.append(rows.select(F.lit(cls).alias("cls"), F.lit(a).alias("attribute"), "kind", "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def model_inventory(catalog: Catalog) -> DataFrame:
    """(cls, input, place, attribute, type, nullable) of all classes; from schemas, no data is read."""
    rows = []
    spark = None
    for cls, input_id in catalog.classes():
        df = catalog.records(cls, (input_id,))
        spark = df.sparkSession
        fields = [f for f in df.schema if f.name not in ENVELOPE]
        rows += [(cls, input_id, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "cls string, input string, place int, attribute string, type string, nullable boolean")


def reference_edges(catalog: Catalog, references: dict[str, list[str]]) -> DataFrame:
    """(src, dst, attribute) between objects, named by class and identifier: those that hold a reference, and every object
    with the identifier referred to. A reference attribute is an identifier or an array of them."""
    objects = reduce(lambda a, b: a.unionByName(b), (catalog.records(c, (i,)).select("_class", "_oid") for c, i in catalog.classes()))
    held = []
    for cls, names in references.items():
        df = catalog.records(cls)
        for a in names:
            to = F.col(a) if df.schema[a].dataType.typeName() == "array" else F.array(a)
            held.append(df.select(node_of("_class", "_oid").alias("src"), F.lit(a).alias("attribute"), F.explode(to.cast("array<string>")).alias("_to")))
    refs = reduce(lambda a, b: a.unionByName(b), held).where("_to is not null")
    return refs.join(objects, F.col("_to") == F.col("_oid")).select("src", node_of("_class", "_oid").alias("dst"), "attribute")


def node_of(cls: str, oid: str) -> Column:
    return F.concat_ws("#", cls, oid)


def seeds_of(catalog: Catalog, pattern: str, how: str = "equals") -> DataFrame:
    """(node) of all objects whose class equals `pattern`, ends in it after a dot, or contains it."""
    tests = {"equals": lambda c: c == pattern, "suffix": lambda c: c == pattern or c.endswith(f".{pattern}"), "contains": lambda c: pattern in c}
    found = [catalog.records(c, (i,)).select(node_of("_class", "_oid").alias("node")) for c, i in catalog.classes() if tests[how](c)]
    if not found:
        raise KeyError(f"no class {how} {pattern!r}")
    return reduce(lambda a, b: a.unionByName(b), found)


def extract(catalog: Catalog, references: dict[str, list[str]], seeds: DataFrame, *, max_depth: int, max_objects: int | None = None) -> tuple[dict[tuple[str, str], DataFrame], DataFrame]:
    """The part of a transfer that the seeds reach over references in either direction: its records by class and input, in
    their original order, and the provenance (node, depth) of every object."""
    reached = stored(subgraph(reference_edges(catalog, references), seeds, max_depth=max_depth, max_objects=max_objects), "graph-reached")
    parts = {}
    for cls, input_id in catalog.classes():
        df = catalog.records(cls, (input_id,)).withColumn("_node", node_of("_class", "_oid"))
        parts[cls, input_id] = df.join(reached.select("node"), F.col("_node") == F.col("node"), "left_semi").drop("_node").orderBy("_ord")
    return parts, reached


def extract_to(catalog: Catalog, references: dict[str, list[str]], seeds: DataFrame, path: str, *, max_depth: int, max_objects: int | None = None, options: dict | None = None) -> DataFrame:
    """Write the part of a transfer that `extract` gives as one transfer file at `path` (.xtf or .itf); its provenance."""
    from weftline.sources.formats import format_of

    parts, reached = extract(catalog, references, seeds, max_depth=max_depth, max_objects=max_objects)
    by_class: dict[str, DataFrame] = {}
    for (cls, _), df in parts.items():
        df = df.drop("_input", "_class", "_ord")
        by_class[cls] = df if cls not in by_class else by_class[cls].unionByName(df, allowMissingColumns=True)
    write = format_of(path).write_all
    if write is None:
        raise ValueError(f"{path} is no transfer of several classes")
    write(by_class, path, {"roles": references, **(options or {})})
    return reached


def subgraph(edges: DataFrame, seeds: DataFrame, *, max_depth: int, both_ways: bool = True, max_objects: int | None = None) -> DataFrame:
    """(node, depth): what the seeds reach over `edges` (src, dst) in at most `max_depth` steps.

    One join per level, from the last level's nodes only; every level is written.
    With `max_objects` the nodes of the last level are those with the smallest names.
    """
    links = edges.select("src", "dst")
    if both_ways:
        links = links.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = stored(links.where("src is not null and dst is not null").distinct(), "graph-edges")
    seen = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "graph-seen")
    if max_objects is not None:
        seen = stored(seen.orderBy("node").limit(max_objects), "graph-seen")
    levels = [seen]
    count = seen.count() if max_objects is not None else 0
    for depth in range(1, max_depth + 1):
        # Over links in both directions a node's neighbours lie in its own level, the one before or the one after.
        known = reduce(lambda a, b: a.union(b), levels[-2:] if both_ways and max_objects is None else levels)
        step = levels[-1].join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        step = step.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        if max_objects is not None:
            step = step.orderBy("node").limit(max(max_objects - count, 0))
        step = stored(step, "graph-level")
        if not (new := step.count()):
            break
        count += new
        levels.append(step)
    return reduce(lambda a, b: a.union(b), levels)


@dataclass(frozen=True)
class Comparison:
    """How two transfers are compared: key columns, and for attributes a tolerance, or multiset order, or not at all."""

    keys: tuple[str, ...]
    tolerance: float = 0.001
    ignored: tuple[str, ...] = ()
    multisets: tuple[str, ...] = ()
    numeric: tuple[str, ...] = field(default=())


def compare(expected: DataFrame, actual: DataFrame, how: Comparison) -> DataFrame:
    """(key, kind, attribute, expected, actual): MISSING, UNEXPECTED and DUPLICATE objects, and DIFFERENT attributes.

    Attributes are those that both sides have. A null key is a value. Of objects that
    share a key the one whose attributes sort first is compared, and the key is
    reported once for each side that repeats it.
    """
    names = [c for c in expected.columns if c in actual.columns and c not in how.keys and c not in how.ignored]

    def one(df: DataFrame, side: str) -> DataFrame:
        key = F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in how.keys)), {"ignoreNullFields": "false"})
        values = F.struct(*((F.sort_array(c) if c in how.multisets else F.col(c)).alias(c) for c in names))
        return df.select(key.alias(f"key_{side}"), values.alias("v")).groupBy(f"key_{side}").agg(F.min("v").alias(side), F.count("*").alias(f"n_{side}"))

    both = one(expected, "e").join(one(actual, "a"), F.col("key_e") == F.col("key_a"), "full_outer")

    def differs(c: str) -> Column:
        e, a = F.col(f"e.{c}"), F.col(f"a.{c}")
        if c in how.numeric:
            return ~F.coalesce(F.abs(e - a) <= how.tolerance, e.isNull() & a.isNull())
        return ~e.eqNullSafe(a)

    text = lambda c: c.cast("string")
    met = F.col("key_e").isNotNull() & F.col("key_a").isNotNull()
    found = [
        F.when(F.col("key_a").isNull(), F.struct(F.lit("MISSING").alias("kind"), F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))),
        F.when(F.col("key_e").isNull(), F.struct(F.lit("UNEXPECTED").alias("kind"), F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))),
    ]
    for side in ("e", "a"):
        n = F.col(f"n_{side}")
        found.append(F.when(n > 1, F.struct(F.lit("DUPLICATE").alias("kind"), F.lit(None).cast("string").alias("attribute"), text(F.lit(1)).alias("expected"), text(n).alias("actual"))))
    for c in names:
        found.append(F.when(met & differs(c), F.struct(F.lit("DIFFERENT").alias("kind"), F.lit(c).alias("attribute"), text(F.col(f"e.{c}")).alias("expected"), text(F.col(f"a.{c}")).alias("actual"))))
    rows = both.select(F.coalesce("key_e", "key_a").alias("key"), F.explode(F.array_compact(F.array(*found))).alias("d"))
    return rows.select("key", "d.*")


def compare_summary(expected: DataFrame, actual: DataFrame, how: Comparison) -> DataFrame:
    """(kind, attribute, n) of `compare`."""
    return compare(expected, actual, how).groupBy("kind", "attribute").agg(F.count("*").alias("n"))


def output_order(objects: DataFrame, references: list[str]) -> DataFrame:
    """Objects in the order of writing: within a basket those without references first, then by class and identifier."""
    has = reduce(lambda a, b: a | b, (F.col(r).isNotNull() for r in references), F.lit(False))
    return objects.orderBy("_basket", has, "_class", "_oid")


def output_places(objects: DataFrame, references: list[str], name: str = "place") -> DataFrame:
    """`objects` with their place, from 1 on, in the order of `output_order`; no task sees them all."""
    has = reduce(lambda a, b: a | b, (F.col(r).isNotNull() for r in references), F.lit(False))
    placed = numbered_oids(objects.withColumn("_has", has), ["_basket", "_has", "_class", "_oid"], name=name)
    return placed.withColumn(name, F.col(name).cast("long")).drop("_has")


@dataclass(frozen=True)
class Constraint:
    attribute: str
    mandatory: bool = False
    low: float | None = None
    high: float | None = None
    max_length: int | None = None
    values: tuple[str, ...] = ()


def violations(objects: DataFrame, constraints: list[Constraint], oid: str = "_oid") -> DataFrame:
    """(oid, attribute, code) of every value that breaks a constraint; null breaks only 'mandatory'."""
    checks = []
    for c in constraints:
        x = F.col(c.attribute)
        tests = {"MANDATORY": x.isNull() if c.mandatory else None, "RANGE": None, "LENGTH": None, "VALUE": None}
        if c.low is not None or c.high is not None:
            low = F.lit(False) if c.low is None else x < c.low
            tests["RANGE"] = low | (F.lit(False) if c.high is None else x > c.high)
        if c.max_length is not None:
            tests["LENGTH"] = F.length(x) > c.max_length
        if c.values:
            tests["VALUE"] = ~x.isin(*c.values)
        checks += [F.when(t, F.struct(F.lit(c.attribute).alias("attribute"), F.lit(code).alias("code"))) for code, t in tests.items() if t is not None]
    rows = objects.select(F.col(oid).alias("oid"), F.explode(F.array_compact(F.array(*checks))).alias("v"))
    return rows.select("oid", "v.*")
