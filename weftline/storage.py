"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session (tests, notebooks) names no spark.checkpoint.dir.
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints/weftline"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = DEFAULT_CHECKPOINT_DIR
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back; `compression` is Spark's own choice unless stated.

    Cuts the lineage: a lost executor costs the tasks that were running, never
    the steps before. The table also has a known size, so Catalyst broadcasts it
    only below spark.sql.autoBroadcastJoinThreshold, and both sides of a later
    join get their own exchange, which AQE can split where a key is hot.
    """
    path = shared_folder(df.sparkSession, label)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read._stored_at = path
    return read


def dropped(*frames: DataFrame | None) -> None:
    """Deletes what `stored` wrote for these frames; others are left alone. Nothing that reads them may run afterwards."""
    for df in frames:
        if df is not None and (path := getattr(df, "_stored_at", None)):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
