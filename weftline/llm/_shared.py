"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.storage import shared_folder, stored

__all__ = ["few_files", "free_names", "in_blocks", "n_partitions", "released", "shared_folder", "sized", "stored"]


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """`names`, lengthened where a table has a column of that name (Spark takes names in either case)."""
    used = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's pass over batches that gives freed memory back to the system at its end.

    Python workers live on when a task ends. What their allocators keep of a pass would
    lie beside the JVM's heap in the next stage.
    """

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def few_files(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """`df`, of up to `rows` small rows, in no more tasks than hold `each` of them, or run at once: a task writes a file, and small tables would have many."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // each))
    return df.coalesce(tasks) if tasks < n_partitions(spark) else df


#: Bytes of a value by type, and of a row beside its values, when a table is broadcast as a hash table.
WIDTHS, ROW = {"long": 8, "double": 8, "integer": 4, "boolean": 1}, 32


def _width(kind: T.DataType) -> int | None:
    """Bytes of a value; None where they depend on the value."""
    if isinstance(kind, T.StructType):
        each = [_width(f.dataType) for f in kind]
        return None if None in each else sum(each) + 8 * len(each)
    return WIDTHS.get(kind.typeName())


def sized(df: DataFrame, most: int = 128 << 20) -> DataFrame:
    """A stored table of a few numbers a row, for a join with whole texts: broadcast up to `most` bytes, by the number of rows,
    which the files' footers tell, and the width of a row; beyond that, and with columns of no fixed width, both sides are
    sorted and merged. The joined rows are the same."""
    width = _width(df.schema)
    return F.broadcast(df) if width is not None and df.count() * (ROW + width) <= most else df.hint("merge")


def in_blocks(rows: DataFrame, weight: Column, most: int, label: str) -> tuple[list[int], DataFrame]:
    """The numbers of the blocks that hold rows, and `rows`, stored, with columns `row` and `block`.

    Rows keep the order they have within their partitions (`row`) and fill one block after the other: by a running sum, a
    block's weights come to `most` and less than one row's weight more. The driver sees one sum a partition.
    """
    numbered = rows.withColumns({"w": weight.cast("long"), "part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    numbered = stored(numbered, label)
    sums = sorted((r["part"], r["w"]) for r in numbered.groupBy("part").agg(F.sum("w").alias("w")).collect())
    before, offsets = 0, []
    for part, w in sums:
        offsets.append((part, before))
        before += w or 0
    spark = rows.sparkSession
    starts = spark.createDataFrame(offsets, "part int, before long")
    running = F.sum("w").over(Window.partitionBy("part").orderBy("row"))
    blocks = numbered.join(F.broadcast(starts), "part").withColumn("block", F.floor((F.col("before") + running - F.col("w")) / most).cast("long"))
    blocks = stored(blocks.drop("w", "part", "before"), label)
    return sorted(r["block"] for r in blocks.select("block").distinct().collect()), blocks
