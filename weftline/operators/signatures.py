"""Canonical signatures: objects told apart by what they hold and refer to, whatever their identifiers.

An object's first signature is a hash of its class and attributes. In every round it takes in the signatures of the
objects that it refers to, and of those that refer to it, by attribute and direction, until a round tells no more
objects apart (colour refinement). What an object gathers is summed, hash by hash, so an object that many refer to is
aggregated where the references lie. Two sums of 64 bits make a signature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from weftline.operators.rules import ENVELOPE, Catalog
from weftline.operators.transfer import node_of, reference_edges
from weftline.storage import stored


def canonical(c: Column, kind: DataType) -> Column:
    """A value as text: null is null, a bag the sorted texts of its structures, a whole number without a decimal point."""
    if isinstance(kind, ArrayType):
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(F.sort_array(F.transform(c, lambda x: F.coalesce(canonical(x, kind.elementType), F.lit("\x00")))), "\x1f"), F.lit("]")))
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(f"{f.name}="), F.coalesce(canonical(c[f.name], f.dataType), F.lit("\x00"))) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.concat_ws("\x1e", *fields))
    text = c.cast("string")
    if kind.typeName() in ("double", "float", "decimal"):
        text = F.regexp_replace(text, r"^(-?[0-9]+)[.]0+$", "$1")
    return text


def _hash(*c: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *c) for seed in (1, 2)]


def _start(catalog: Catalog, references: dict[str, list[str]], ignored: dict[str, tuple[str, ...]]) -> DataFrame:
    """(node, cls, a, b) of every object."""
    parts = []
    for cls, input_id in catalog.classes():
        df = catalog.records(cls, (input_id,))
        left_out = {*ENVELOPE, *references.get(cls, ()), *ignored.get(cls, ()), *ignored.get("*", ())}
        names = sorted(c for c in df.columns if c not in left_out)
        # Names count with their values, so an attribute that is null and one that a table lacks are alike.
        held = F.concat_ws("\x1d", *(F.concat(F.lit(f"{n}="), canonical(F.col(n), df.schema[n].dataType)) for n in names)) if names else F.lit("")
        a, b = _hash(F.lit(cls), held)
        parts.append(df.select(node_of("_class", "_oid").alias("node"), F.lit(cls).alias("cls"), a.alias("a"), b.alias("b")))
    return reduce(lambda x, y: x.unionByName(y), parts)


def signatures(catalog: Catalog, references: dict[str, list[str]], *, ignored: dict[str, tuple[str, ...]] | None = None, most_rounds: int = 50) -> DataFrame:
    """(node, cls, signature) of every object of a transfer.

    `references`: attributes by class that hold identifiers; `ignored`: attributes by class, or under '*', that don't count
    (expected losses). Objects of one signature can't be told apart by what they hold and reach in `most_rounds` steps;
    rounds end as soon as one tells no more of them apart. References to no object count by their attribute only.
    """
    state = stored(_start(catalog, references, ignored or {}), "signatures")
    if not any(references.values()):
        return state.select("node", "cls", F.concat_ws(":", F.hex("a"), F.hex("b")).alias("signature"))
    edges = reference_edges(catalog, references).select("src", "dst", "attribute")
    both = edges.select(F.col("src").alias("node"), F.concat(F.lit(">"), "attribute").alias("by"), F.col("dst").alias("other")).union(
        edges.select(F.col("dst").alias("node"), F.concat(F.lit("<"), "attribute").alias("by"), F.col("src").alias("other"))
    )
    both = stored(both, "signatures-edges")
    kinds = state.select("a", "b").distinct().count()
    for _ in range(most_rounds):
        other = state.groupBy(F.col("node").alias("other")).agg(F.min("a").alias("oa"), F.min("b").alias("ob"))
        told = both.join(other, "other").select("node", *(h.alias(n) for n, h in zip(("x", "y"), _hash(F.col("by"), F.col("oa"), F.col("ob")))))
        # Sums of hashes wrap around: they are taken by 32 bits, which a sum of longs holds for four thousand million references.
        low, high = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF), lambda c: F.shiftrightunsigned(c, 32)
        sums = told.groupBy("node").agg(*(F.sum(f(c)).alias(f"{c}{i}") for c in ("x", "y") for i, f in ((0, low), (1, high))))
        joined = state.join(sums, "node", "left")
        a, b = _hash(F.col("a"), F.col("b"), *(F.coalesce(f"{c}{i}", F.lit(0)) for c in ("x", "y") for i in (0, 1)))
        state = stored(joined.select("node", "cls", a.alias("a"), b.alias("b")), "signatures")
        new = state.select("a", "b").distinct().count()
        if new == kinds:
            break
        kinds = new
    return state.select("node", "cls", F.concat_ws(":", F.hex("a"), F.hex("b")).alias("signature"))


def compare_signatures(expected: Catalog, actual: Catalog, references: dict[str, list[str]], *, ignored: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(cls, kind, n): how many objects of each class are MISSING from `actual`, or UNEXPECTED in it, by signatures.

    Transfers that differ in their identifiers alone, and in what is ignored, have no such object. One changed object
    shows as a missing and an unexpected one, and so do those that reach it. Both sides take the same number of rounds:
    their objects are refined together.
    """
    both = Catalog()
    for side, catalog in (("e", expected), ("a", actual)):
        for cls, input_id in catalog.classes():
            df = catalog.records(cls, (input_id,))
            names = references.get(cls, [])
            mark = lambda c: F.concat(F.lit(f"{side}|"), c.cast("string"))
            kept = {n: F.transform(n, mark) if df.schema[n].dataType.typeName() == "array" else mark(F.col(n)) for n in names}
            both._frames[cls, f"{side}|{input_id}"] = df.withColumns({**kept, "_oid": mark(F.col("_oid"))})
    told = signatures(both, references, ignored=ignored)
    is_expected = F.col("node").contains("#e|")
    counts = told.groupBy("cls", "signature").agg(F.sum(F.when(is_expected, 1).otherwise(-1)).alias("more")).where("more <> 0")
    kind = F.when(F.col("more") > 0, "MISSING").otherwise("UNEXPECTED")
    return counts.groupBy("cls", kind.alias("kind")).agg(F.sum(F.abs("more")).alias("n"))
