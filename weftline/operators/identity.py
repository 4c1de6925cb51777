"""Object identifiers and baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.identity import name_uuid
from weftline.storage import stored


def identity_text(keys: dict[str, Column]) -> Column:
    """'name=value|name=value' of identity keys; null where a value is null or empty, so the whole identity is void."""
    parts = [F.concat(F.lit(f"{k}="), F.when(v.cast("string") != "", v.cast("string"))) for k, v in keys.items()]
    text = parts[0]
    for p in parts[1:]:
        text = F.concat(text, F.lit("|"), p)
    return text


def deterministic_uuid(namespace: str, rule: str, target_class: str, keys: dict[str, Column], source: dict[str, Column]) -> Column:
    """The UUID of an object's identity, or of its source record where the identity is void.

    `source`: input, basket, class and oid of the source record; a missing basket
    reads 'null'.
    """
    basis = F.concat_ws(
        "::", F.lit(namespace), F.lit(rule), source["input"], F.coalesce(source["basket"], F.lit("null")), source["class"], source["oid"]
    )
    if keys:
        basis = F.coalesce(F.concat(F.lit(f"{namespace}::{rule}::{target_class}::"), identity_text(keys)), basis)
    return name_uuid(basis)


def numbered_oids(df: DataFrame, order: list[str], start: int = 1, name: str = "_oid") -> DataFrame:
    """`df` with consecutive numbers, as text, in the order of `order`.

    No global window: rows are range-partitioned and sorted, each partition counts
    its rows, and the few counts (one a partition) give every partition its offset.
    `order` should be unique, or rows that tie may swap numbers.
    """
    placed = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}),
        "numbered",
        "zstd",
    )
    # In a partition the identifiers rise by one from its first, which is the partition's number shifted.
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    at = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + at + start).cast("string"))
    numbered = numbered.drop("_part", "_at", "_before")
    numbered._stored_at = placed._stored_at
    return numbered


def preserved_oid(oid: Column, fallback: Column) -> Column:
    """The source's identifier, or `fallback` where it is blank."""
    return F.coalesce(F.when(F.trim(oid) != "", oid), fallback)


def duplicate_oids(targets: DataFrame, by: tuple[str, ...] = ("_output", "_class", "_oid")) -> DataFrame:
    """(by ..., n) of identifiers that several objects have."""
    return targets.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def basket(strategy: str, preserved: Column, topic: Column) -> Column:
    """preserve; generateUuid (one per object); preserveOrGenerateUuid; byTopic (the UUID of 'basket:' and the topic)."""
    kinds = {
        "preserve": lambda: preserved,
        "generateUuid": F.uuid,
        "preserveOrGenerateUuid": lambda: F.coalesce(preserved, F.uuid()),
        "byTopic": lambda: name_uuid(F.concat(F.lit("basket:"), topic)),
    }
    if strategy not in kinds:
        raise ValueError(f"unknown basket strategy {strategy!r}")
    return kinds[strategy]()


def numbered_within(objects: DataFrame, start: int) -> DataFrame:
    """`objects` (_depth, _source_oid, _oid, ...) with consecutive numbers from `start` on in the order of _source_oid and
    _oid, as `number`, and with that of the object one level up as `up`; _oid goes.

    An object's _oid begins with that of the object it lies in, so by text it comes behind it, before the next one of that
    level. All objects of a source record lie in one partition, as they were in one row; no join looks for a parent.
    Objects of the same source and _oid share the first one's number.
    """
    placed = objects.repartitionByRange("_source_oid").sortWithinPartitions("_source_oid", "_oid")
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    placed = placed.withColumn("_first", F.min("_at").over(Window.partitionBy("_source_oid", "_oid")))
    before = Window.partitionBy("_source_oid").orderBy("_oid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deepest = objects.agg(F.max("_depth")).first()[0] or 0
    above = [F.when(F.col("_depth") == d, F.last(F.when(F.col("_depth") == d - 1, F.col("_first")), ignorenulls=True).over(before)) for d in range(1, deepest + 1)]
    placed = placed.withColumn("_up", F.coalesce(*above) if above else F.lit(None).cast("long"))
    placed = stored(placed.drop("_oid"), "numbered", "zstd")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    told = placed.join(F.broadcast(offsets), "_part")
    number = lambda c: (F.col("_before") + F.col(c) + start).cast("string")
    told = told.withColumn("number", number("_first")).withColumn("up", number("_up")).drop("_part", "_at", "_first", "_up", "_before", "_depth")
    told._stored_at = placed._stored_at
    return told
