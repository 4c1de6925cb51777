"""Correlated lookups as joins: one join for all values looked up by the same key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_matches(table: DataFrame, key: Column, values: dict[str, Column], order: Column) -> DataFrame:
    """(k, <name>, <name>_ambiguous ...): per key the value of the first record by `order`, and whether others differ.

    A null value is a value: it's returned where the first record has it, and it
    differs from others. Null keys match nothing.
    """
    rows = table.select(key.cast("string").alias("k"), order.alias("o"), *(v.alias(n) for n, v in values.items())).where("k is not null")
    found = []
    for n in values:
        differ = F.coalesce(F.min(n) != F.max(n), F.lit(False)) | ((F.count(n) > 0) & (F.count(n) < F.count("*")))
        found += [F.min_by(n, "o").alias(n), differ.alias(f"{n}_ambiguous")]
    return rows.groupBy("k").agg(*found)


def lookup(df: DataFrame, by: Column, table: DataFrame, key: Column, values: dict[str, Column], order: Column) -> DataFrame:
    """`df` with one column for each of `values` (null: no match), `_found` and `<name>_ambiguous`.

    `by` and `key` match as text. Pass `table` filtered to one input for a scoped lookup.
    """
    right = first_matches(table, key, values, order).withColumn("_found", F.lit(True))
    joined = df.withColumn("_by", by.cast("string")).join(right, F.col("_by") == F.col("k"), "left")
    flags = {f"{n}_ambiguous": F.coalesce(F.col(f"{n}_ambiguous"), F.lit(False)) for n in values}
    return joined.withColumns({"_found": F.coalesce("_found", F.lit(False)), **flags}).drop("_by", "k")


def lookup_diagnostics(df: DataFrame, by: Column, names: list[str], optional: bool = False) -> DataFrame:
    """(code, key, n) of what `lookup` missed, unless `optional`, and found ambiguous."""
    parts = [] if optional else [df.where(~F.col("_found") & by.isNotNull()).select(F.lit("LOOKUP_NO_MATCH").alias("code"), by.cast("string").alias("key"))]
    parts += [df.where(F.col(f"{n}_ambiguous")).select(F.lit("LOOKUP_AMBIGUOUS").alias("code"), by.cast("string").alias("key")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("code", "key").agg(F.count("*").alias("n"))


def exists(df: DataFrame, on: list[tuple[Column, Column]], table: DataFrame, name: str = "found") -> DataFrame:
    """`df` with a boolean: whether `table` has a record that equals it, as text, in all pairs (of df, of table)."""
    keys = table.select(*(t.cast("string").alias(f"_t{i}") for i, (_, t) in enumerate(on))).dropna().distinct().withColumn("_hit", F.lit(True))
    left = df.withColumns({f"_l{i}": c.cast("string") for i, (c, _) in enumerate(on)})
    condition = F.lit(True)
    for i in range(len(on)):
        condition = condition & (F.col(f"_l{i}") == F.col(f"_t{i}"))
    joined = left.join(keys, condition, "left").withColumn(name, F.coalesce("_hit", F.lit(False)))
    return joined.drop("_hit", *(f"{s}{i}" for i in range(len(on)) for s in ("_l", "_t")))
