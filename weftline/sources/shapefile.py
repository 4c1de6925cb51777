"""Shapefiles, read and written: records of .shp and .dbf of equal names."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC, VERSION, HEADER = 9994, 1000, 100
KINDS = {0: "null", 1: "point", 3: "polyline", 5: "polygon", 8: "multipoint"}


def shapes(content: bytes) -> Iterator[str | None]:
    """WKT of each record of a .shp file."""
    at = HEADER
    while at + 8 <= len(content):
        size = struct.unpack_from(">i", content, at + 4)[0] * 2
        yield wkt_of_record(content[at + 8 : at + 8 + size])
        at += 8 + size


def wkt_of_record(record: bytes) -> str | None:
    kind = struct.unpack_from("<i", record)[0]
    pair = lambda p: f"{p[0]!r} {p[1]!r}"
    if kind == 0:
        return None
    if kind == 1:
        return f"POINT ({pair(struct.unpack_from('<dd', record, 4))})"
    if kind == 8:
        n = struct.unpack_from("<i", record, 36)[0]
        return "MULTIPOINT (" + ", ".join(f"({pair(struct.unpack_from('<dd', record, 40 + 16 * i))})" for i in range(n)) + ")"
    if kind not in KINDS:
        raise ValueError(f"shape type {kind} isn't two-dimensional")
    n_parts, n = struct.unpack_from("<ii", record, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n]
    points = [struct.unpack_from("<dd", record, 44 + 4 * n_parts + 16 * i) for i in range(n)]
    parts = [points[a:z] for a, z in zip(starts, starts[1:])]
    ring = lambda p: "(" + ", ".join(map(pair, p)) + ")"
    if kind == 3:
        return f"LINESTRING {ring(parts[0])}" if n_parts == 1 else "MULTILINESTRING (" + ", ".join(map(ring, parts)) + ")"
    polygons = [f"({', '.join(map(ring, p))})" for p in polygons_of(parts)]
    return f"POLYGON {polygons[0]}" if len(polygons) == 1 else f"MULTIPOLYGON ({', '.join(polygons)})"


def area(ring: list[tuple[float, float]]) -> float:
    """Signed; positive where the ring runs clockwise."""
    return sum((x2 - x1) * (y2 + y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) / 2


def inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def polygons_of(rings: list) -> list[list]:
    """Clockwise rings are shells; each other ring is a hole of the smallest shell around it."""
    shells = [[r] for r in rings if area(r) >= 0]
    for hole in (r for r in rings if area(r) < 0):
        around = [s for s in shells if inside(hole[0], s[0])]
        if around:
            min(around, key=lambda s: area(s[0])).append(hole)
        else:
            shells.append([hole])
    return shells


def dbf_fields(content: bytes, encoding: str) -> list[tuple[str, str, int]]:
    """Name, kind and width of the fields that a .dbf file's head states."""
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode(encoding), chr(content[at + 11]), content[at + 16]))
        at += 32
    return fields


def dbf_values(row: bytes, fields: list[tuple[str, str, int]], encoding: str) -> list[str | None]:
    """A record's values as text."""
    values, place = [], 1
    for _, kind, width in fields:
        values.append(value_text(row[place : place + width].decode(encoding), kind))
        place += width
    return values


def dbf_records(content: bytes, encoding: str, deleted: str = "error") -> tuple[list[str], Iterator[list[str | None] | None]]:
    """Field names, and each record's values as text; None for a deleted record that is skipped."""
    n, start, size = struct.unpack_from("<IHH", content, 4)
    fields = dbf_fields(content, encoding)

    def rows():
        for i in range(n):
            row = content[start + i * size : start + (i + 1) * size]
            if row[:1] == b"*":
                if deleted == "error":
                    raise ValueError(f"record {i} is deleted")
                yield None
                continue
            yield dbf_values(row, fields, encoding)

    return [f[0] for f in fields], rows()


def value_text(raw: str, kind: str) -> str | None:
    text = raw.strip(" \0")
    if not text or kind in "NF" and set(text) == {"*"} or kind == "D" and text == "00000000" or kind == "L" and text == "?":
        return None
    if kind == "D":
        return f"{text[:4]}-{text[4:6]}-{text[6:]}"
    if kind == "L":
        return "true" if text.upper() in ("T", "Y", "1") else "false"
    return text


def read(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """Attributes as text, `_oid`, and `geometry` (option geometryAttribute) as WKT.

    `path` names .shp files or .zip archives of one shapefile (option member picks
    one of several). Options: fields (comma-joined DBF names), dbfEncoding,
    deletedRecordPolicy (error or skip), oidField, column.<FIELD>=<attribute>, and
    recordsPerTask: so many records of a file, which all executors must mount, go to
    a task; without it a file is read whole.
    """
    fields = [f.strip() for f in options["fields"].split(",")]
    geometry, encoding = options.get("geometryAttribute", "geometry"), options.get("dbfEncoding", "ISO-8859-1")
    deleted, member, oid = options.get("deletedRecordPolicy", "error"), options.get("member"), options.get("oidField")
    names = [options.get(f"column.{f}", f) for f in fields]

    schema = ", ".join(f"`{n}` string" for n in ["_oid", *names, geometry])
    if options.get("recordsPerTask") and not path.endswith(".zip"):
        from weftline.sources import ranges

        spec = {"path": path, "records": int(options["recordsPerTask"]), "fields": fields, "encoding": encoding, "deleted": deleted, "oid": oid}
        return ranges.read(spark, ranges.ShapefileRanges, schema, spec)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shp, dbf in zip(frame["shp"], frame["dbf"]):
                known, records = dbf_records(bytes(dbf), encoding, deleted)
                rows = []
                for i, (shape, values) in enumerate(zip(shapes(bytes(shp)), records), 1):
                    if values is not None:
                        own = dict(zip(known, values))
                        rows.append([own.get(oid) if oid else f"shp.{i}", *(own.get(f) for f in fields), shape])
                yield pd.DataFrame(rows, columns=["_oid", *names, geometry], dtype=object)

    files = spark.read.format("binaryFile")
    if path.endswith(".zip"):
        packed = files.load(path).select("content")
        pairs = packed.mapInPandas(lambda frames: (_unzipped(f, member) for f in frames), "shp binary, dbf binary")
    else:
        stem = path.removesuffix(".shp")
        name = F.regexp_replace("path", r"\.[^.]*$", "")
        side = lambda ext: files.load(f"{stem}.{ext}").select(name.alias(f"{ext}_name"), F.col("content").alias(ext))
        pairs = side("shp").join(side("dbf"), F.col("shp_name") == F.col("dbf_name")).select("shp", "dbf")
    return pairs.mapInPandas(run, schema)


def _unzipped(frame: pd.DataFrame, member: str | None) -> pd.DataFrame:
    rows = []
    for content in frame["content"]:
        z = zipfile.ZipFile(io.BytesIO(bytes(content)))
        found = [n for n in z.namelist() if n.lower().endswith(".shp") and (member is None or n == member)]
        if len(found) != 1:
            raise ValueError(f"{len(found)} shapefiles in the archive; name one with option member")
        rows.append((z.read(found[0]), z.read(found[0][:-4] + ".dbf")))
    return pd.DataFrame(rows, columns=["shp", "dbf"])


def field_names(names: list[str], strategy: str = "strict") -> dict[str, str]:
    """DBF names of at most 10 characters: strict refuses longer ones, truncate cuts and numbers them, stable adds a digest."""
    import hashlib

    out: dict[str, str] = {}
    for n in names:
        if len(n) <= 10:
            short = n
        elif strategy == "strict":
            raise ValueError(f"{n!r} is longer than 10 characters")
        else:
            short = n[:6] + hashlib.md5(n.encode()).hexdigest()[:4] if strategy == "stable" else n[:10]
        k = 1
        while short.upper() in (s.upper() for s in out.values()):
            short, k = f"{n[: 10 - len(str(k))]}{k}", k + 1
        out[n] = short
    return out


def dbf_field(kind) -> tuple[str, int, int]:
    """Type, width and decimals of the DBF field for a column's type."""
    name = kind.typeName()
    if name.startswith("decimal"):
        return "N", min(kind.precision + 2, 40), kind.scale
    whole = {"byte": 4, "short": 6, "integer": 11, "long": 20}
    return ("N", whole[name], 0) if name in whole else {"boolean": ("L", 1, 0), "date": ("D", 8, 0), "float": ("N", 24, 8), "double": ("N", 32, 10)}.get(name, ("C", 254, 0))


def encoded(wkt: str | None) -> bytes:
    """The record content of a WKT point, line string or polygon."""
    import re

    if not wkt:
        return struct.pack("<i", 0)
    kind = wkt.split("(")[0].strip().upper()
    rings = [[tuple(map(float, p.split())) for p in part.split(",")] for part in re.findall(r"\(([^()]+)\)", wkt)]
    if kind == "POINT":
        return struct.pack("<idd", 1, *rings[0][0])
    code = {"LINESTRING": 3, "MULTILINESTRING": 3, "POLYGON": 5}[kind]
    if code == 5:
        rings = [r if (area(r) >= 0) == (i == 0) else r[::-1] for i, r in enumerate(rings)]
    points = [p for r in rings for p in r]
    xs, ys = zip(*points)
    starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
    head = struct.pack("<iddddii", code, min(xs), min(ys), max(xs), max(ys), len(rings), len(points))
    return head + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in points)


def write(df: DataFrame, path: str, options: dict) -> None:
    """One shapefile at a local `path`: rows come to the driver one partition at a time, so `maxRecords` (1,000,000) bounds them.

    Options: geometryAttribute, shapeType (point, polyline, polygon: what the
    geometries must be), fieldNameStrategy (strict, truncate, stable), dbfEncoding,
    overflowPolicy (strict, truncate), writeSidecarMapping, prj (text of the
    reference system, written beside), failOnMultipleBaskets (true). Fields have the
    types of the columns: numbers, dates, booleans and texts.
    """
    limit = int(options.get("maxRecords", 1_000_000))
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} records; a shapefile is one file, written by the driver")
    if "_basket" in df.columns and str(options.get("failOnMultipleBaskets", True)).lower() != "false" and df.select("_basket").distinct().limit(2).count() > 1:
        raise ValueError("objects of several baskets; set failOnMultipleBaskets to false")
    wanted = {None: None, "point": 1, "polyline": 3, "polygon": 5}[options.get("shapeType")]
    fields = {c: dbf_field(df.schema[c].dataType) for c in df.columns}
    geometry, encoding = options.get("geometryAttribute", "geometry"), options.get("dbfEncoding", "UTF-8")
    names = [c for c in df.columns if c != geometry and not c.startswith("_")]
    shorts = field_names(names, options.get("fieldNameStrategy", "strict"))
    stem, row_width = path.removesuffix(".shp"), 1 + sum(fields[c][1] for c in names)
    box, n, at, code = [float("inf"), float("inf"), float("-inf"), float("-inf")], 0, HEADER, 0
    # A cell is text: dates without hyphens, booleans T and F, numbers plain, to the field's decimals.
    cell = {"D": lambda c, _: F.date_format(c, "yyyyMMdd"), "L": lambda c, _: F.when(c, "T").otherwise("F"), "C": lambda c, _: c.cast("string")}
    cell["N"] = lambda c, decimals: c.cast(f"decimal(38,{decimals})").cast("string")
    typed = [F.when(F.col(c).isNotNull(), cell[fields[c][0]](F.col(c), fields[c][2])).alias(c) for c in names]
    ordered = df.select(*typed, F.col(geometry).cast("string").alias(geometry))
    with open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx, open(f"{stem}.dbf", "wb") as dbf:
        for f in (shp, shx):
            f.write(b"\0" * HEADER)
        head_size = 33 + 32 * len(names)
        dbf.write(b"\0" * head_size)
        for row in ordered.toLocalIterator():
            record = encoded(row[geometry])
            n += 1
            shx.write(struct.pack(">ii", at // 2, len(record) // 2))
            shp.write(struct.pack(">ii", n, len(record) // 2) + record)
            at += 8 + len(record)
            if row[geometry]:
                own_code = struct.unpack_from("<i", record)[0]
                if own_code != (code or own_code) or wanted and own_code != wanted:
                    raise ValueError(f"record {n} has a geometry of type {own_code}; the file has type {wanted or code}")
                code = own_code
                own = struct.unpack_from("<dd", record, 4) * 2 if code == 1 else struct.unpack_from("<dddd", record, 4)
                box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
            cells = [(row[c] or "").encode(encoding) for c in names]
            wide = [c for c, x in zip(names, cells) if len(x) > fields[c][1]]
            if any(fields[c][0] != "C" or options.get("overflowPolicy", "strict") == "strict" for c in wide):
                raise ValueError(f"record {n} has a value too long for {wide}")
            dbf.write(b" " + b"".join(x.rjust(fields[c][1]) if fields[c][0] == "N" else x[: fields[c][1]].ljust(fields[c][1]) for c, x in zip(names, cells)))
        dbf.write(b"\x1a")
        box = box if n and code else [0.0] * 4
        for f, size in ((shp, at), (shx, HEADER + 8 * n)):
            f.seek(0)
            f.write(struct.pack(">i20xi", MAGIC, size // 2) + struct.pack("<ii4d32x", VERSION, code, *box))
        dbf.seek(0)
        today = date.today()
        dbf.write(struct.pack("<BBBBIHH20x", 3, today.year - 1900, today.month, today.day, n, head_size, row_width))
        for c in names:
            kind, width, decimals = fields[c]
            dbf.write(struct.pack("<11sc4xBB14x", shorts[c].encode(encoding), kind.encode(), width, decimals))
        dbf.write(b"\r")
    if shorts != {c: c for c in names} and str(options.get("writeSidecarMapping", True)).lower() != "false":
        with open(f"{stem}.fields.json", "w") as f:
            json.dump(shorts, f)
    if options.get("prj"):
        with open(f"{stem}.prj", "w") as f:
            f.write(options["prj"])
