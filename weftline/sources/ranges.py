"""Large shapefiles and GeoPackages read by many tasks: ranges of records, each read from its place in bounded batches.

For files in a folder that the driver and all executors mount; what only Spark's readers reach is read whole, a task a
file (`shapefile.read`, `geopackage.read`).
"""

from __future__ import annotations

import glob
import json
import os
import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftline.sources.geopackage import wkb_of
from weftline.sources.shapefile import HEADER, dbf_fields, dbf_values, wkt_of_record

BATCH = 1000


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def local_files(path: str) -> list[str]:
    found = sorted(glob.glob(path.removeprefix("file://").removeprefix("file:")))
    if not found:
        raise FileNotFoundError(f"{path} is no file that this machine mounts")
    return found


class _Reader(DataSourceReader):
    def __init__(self, spec: dict, schema: StructType):
        self.spec, self.schema, self.names = spec, schema, schema.fieldNames()

    def _batches(self, rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for r in rows:
            held.append(r)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class ShapefileReader(_Reader):
    """Partitions are runs of records of the .shx file, which has the place of each record of the .shp file."""

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in local_files(self.spec["path"]):
            n = (os.path.getsize(path.removesuffix(".shp") + ".shx") - HEADER) // 8
            out += [Range(path, at, min(n, at + self.spec["records"])) for at in range(0, n, self.spec["records"])]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        yield from self._batches(self._rows(part), to_arrow_schema(self.schema))

    def _rows(self, part: Range) -> Iterator[tuple]:
        if part.end <= part.start:
            return
        spec, stem = self.spec, part.path.removesuffix(".shp")
        with open(f"{stem}.shx", "rb") as shx, open(part.path, "rb") as shp, open(f"{stem}.dbf", "rb") as dbf:
            head = dbf.read(32)
            start, size = struct.unpack_from("<HH", head, 8)
            fields = dbf_fields(head + dbf.read(start - 32), spec["encoding"])
            known = [f[0] for f in fields]
            for i in range(part.start, part.end):
                shx.seek(HEADER + 8 * i)
                place, length = (2 * x for x in struct.unpack(">ii", shx.read(8)))
                dbf.seek(start + i * size)
                row = dbf.read(size)
                if row[:1] == b"*":
                    if spec["deleted"] == "error":
                        raise ValueError(f"record {i} is deleted")
                    continue
                own = dict(zip(known, dbf_values(row, fields, spec["encoding"])))
                shp.seek(place + 8)
                shape = wkt_of_record(shp.read(length))
                yield (own.get(spec["oid"]) if spec["oid"] else f"shp.{i + 1}", *(own.get(f) for f in spec["fields"]), shape)


class GeopackageReader(_Reader):
    """Partitions are ranges of row numbers; a table without such, or a view, is one."""

    def _open(self, path: str) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in local_files(self.spec["path"]):
            with self._open(path) as c:
                try:
                    low, high = c.execute(f'select min(rowid), max(rowid) from "{self.spec["table"]}"').fetchone()
                except sqlite3.OperationalError:
                    low = None
            if low is None:  # no row numbers, or no rows
                out.append(Range(path, 0, -1))
            else:
                out += [Range(path, at, min(high + 1, at + self.spec["records"])) for at in range(low, high + 1, self.spec["records"])]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        yield from self._batches(self._rows(part), to_arrow_schema(self.schema))

    def _rows(self, part: Range) -> Iterator[tuple]:
        if part.start == part.end:
            return
        select = ", ".join(f'"{n}"' for n in self.names)
        within, bounds = ("", ()) if part.end < part.start else (" where rowid >= ? and rowid < ?", (part.start, part.end))
        at = self.names.index(self.spec["geometry"]) if self.spec["geometry"] else -1
        with self._open(part.path) as c:
            cursor = c.execute(f'select {select} from "{self.spec["table"]}"{within}', bounds)
            while rows := cursor.fetchmany(BATCH):
                for r in rows:
                    yield tuple(wkb_of(v) if i == at else v for i, v in enumerate(r))


class _Source(DataSource):
    def schema(self) -> str:
        return self.options["ddl"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.kind(json.loads(self.options["spec"]), schema)


class ShapefileRanges(_Source):
    kind = ShapefileReader

    @classmethod
    def name(cls) -> str:
        return "shapefile_ranges"


class GeopackageRanges(_Source):
    kind = GeopackageReader

    @classmethod
    def name(cls) -> str:
        return "geopackage_ranges"


def read(spark: SparkSession, source: type[_Source], ddl: str, spec: dict) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("ddl", ddl).option("spec", json.dumps(spec)).load()
