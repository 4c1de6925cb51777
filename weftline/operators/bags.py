"""Nested records: children embedded as arrays of structures, and arrays expanded to objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def embed(
    parents: DataFrame,
    parent_key: Column,
    children: DataFrame,
    child_key: Column,
    fields: dict[str, Column],
    *,
    order: Column,
    bag: str = "bag",
    where: Column | None = None,
    distinct_by: list[str] | None = None,
) -> DataFrame:
    """`parents` with an array of structures: their children's `fields`, by `order`, nulls last; none: an empty array.

    Children that repeat `distinct_by` count once. Filters run before children
    are gathered; a parent's bag must fit a row.
    """
    rows = children if where is None else children.where(F.coalesce(where, F.lit(False)))
    if distinct_by:
        rows = rows.dropDuplicates(distinct_by)
    item = F.struct(order.isNull().alias("_last"), order.alias("_order"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("_item"))
    bags = rows.select(child_key.cast("string").alias("_bag_key"), item.alias("_row")).where("_bag_key is not null")
    bags = bags.groupBy("_bag_key").agg(F.transform(F.sort_array(F.collect_list("_row")), lambda x: x["_item"]).alias(bag))
    joined = parents.withColumn("_parent_key", parent_key.cast("string")).join(bags, F.col("_parent_key") == F.col("_bag_key"), "left")
    empty = F.array().cast(bags.schema[bag].dataType)
    return joined.withColumn(bag, F.coalesce(F.col(bag), empty)).drop("_parent_key", "_bag_key")


def embed_where(
    parents: DataFrame, parent_key: str, children: DataFrame, condition: Column, fields: dict[str, Column], *, order: Column, bag: str = "bag"
) -> DataFrame:
    """Like `embed`, by any condition over both sides (their columns must differ by name).

    An equality must be among the conditions: without it Spark would compare all
    parents with all children, which is refused.
    """
    plan = parents.join(children, condition)._jdf.queryExecution().executedPlan().toString()
    if "NestedLoop" in plan or "CartesianProduct" in plan:
        raise ValueError("the condition has no equality between parents and children")
    item = F.struct(order.isNull().alias("_last"), order.alias("_order"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("_item"))
    bags = parents.join(children, condition).groupBy(F.col(parent_key).alias("_bag_key")).agg(F.sort_array(F.collect_list(item)).alias("_rows"))
    bags = bags.select("_bag_key", F.transform("_rows", lambda x: x["_item"]).alias(bag))
    joined = parents.join(bags, F.col(parent_key).eqNullSafe(F.col("_bag_key")), "left").drop("_bag_key")
    return joined.withColumn(bag, F.coalesce(F.col(bag), F.array().cast(bags.schema[bag].dataType)))


def synthetic(condition: Column, fields: dict[str, Column]) -> Column:
    """A bag of one structure made from the row itself, empty where the condition isn't true."""
    one = F.array(F.struct(*(c.alias(n) for n, c in fields.items())))
    return F.when(F.coalesce(condition, F.lit(False)), one).otherwise(F.filter(one, lambda _: F.lit(False)))


def expand(df: DataFrame, bag: str, *, max_items: int | None = None, oid: str = "_oid", prefix: str = "item") -> DataFrame:
    """A row for each of the first `max_items` structures: the row's columns, `prefix` (the structure), `prefix`_at from 0,
    and `prefix`_oid, the parent's identifier and the place joined by '-'."""
    items = F.slice(bag, 1, max_items) if max_items else F.col(bag)
    return df.select("*", F.posexplode(items).alias(f"{prefix}_at", prefix)).withColumn(
        f"{prefix}_oid", F.concat_ws("-", F.col(oid).cast("string"), F.col(f"{prefix}_at").cast("string"))
    )


def overflow(df: DataFrame, bag: str, max_items: int, oid: str = "_oid") -> DataFrame:
    """(source_oid, reason_code, n_lost) of rows whose bag is longer than `max_items`."""
    lost = F.size(bag) - max_items
    return df.where(lost > 0).select(F.col(oid).alias("source_oid"), F.lit("BAG_MAX_ITEMS_EXCEEDED").alias("reason_code"), lost.alias("n_lost"))


def unwrapped(c: Column, kind: DataType, most: int = 4) -> Column:
    """A bag without the elements that wrap it: up to `most` structures of one field each give way to that field.

    What is left becomes an array where it was wrapped structures; anything else stays.
    """
    depth = 0
    while isinstance(kind, StructType) and len(kind) == 1 and depth < most and isinstance(kind[0].dataType, StructType | ArrayType):
        c, kind, depth = c[kind[0].name], kind[0].dataType, depth + 1
    return F.when(c.isNotNull(), F.array(c)) if depth and isinstance(kind, StructType) else c


def first_of(bag: str, field: str) -> Column:
    """A field of the first structure; null for an empty bag."""
    return F.try_element_at(F.col(bag), F.lit(1))[field]


def missing_fields(df: DataFrame, bag: str, mandatory: list[str], oid: str = "_oid") -> DataFrame:
    """(source_oid, field, n) of mandatory fields that are null in structures of a bag."""
    rows = df.select(F.col(oid).alias("source_oid"), F.explode(bag).alias("s"))
    each = rows.select("source_oid", F.explode(F.array(*(F.when(F.col("s")[f].isNull(), F.lit(f)) for f in mandatory))).alias("field"))
    return each.where("field is not null").groupBy("source_oid", "field").agg(F.count("*").alias("n"))
