"""GeoPackage tables: SQLite files, opened from their bytes where the task runs."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def wkb_of(blob: bytes | None) -> bytes | None:
    """The WKB behind a GeoPackage geometry's header."""
    if not blob or blob[:2] != b"GP":
        return blob
    return bytes(blob[8 + ENVELOPE_BYTES[blob[3] >> 1 & 7] :])


def _open(content: bytes) -> sqlite3.Connection:
    c = sqlite3.connect(":memory:")
    c.deserialize(content)
    return c


def read(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """Options: table, schema (DDL), geometry (its column, given as WKB), fetchSize, and recordsPerTask: so many row numbers of
    a file, which all executors must mount, go to a task. Without it a file is read whole and must fit a task's memory."""
    schema = StructType.fromDDL(options["schema"])
    table, geometry, size = options["table"], options.get("geometry"), int(options.get("fetchSize", 10_000))
    names = schema.fieldNames()
    if options.get("recordsPerTask"):
        from weftline.sources import ranges

        return ranges.read(spark, ranges.GeopackageRanges, options["schema"], {"path": path, "records": int(options["recordsPerTask"]), "table": table, "geometry": geometry})
    select = ", ".join(f'"{n}"' for n in names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with _open(bytes(content)) as c:
                    cursor = c.execute(f'select {select} from "{table}"')
                    while rows := cursor.fetchmany(size):
                        out = pd.DataFrame(rows, columns=names, dtype=object)
                        if geometry:
                            out[geometry] = out[geometry].map(wkb_of)
                        yield out

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, schema)
