"""Line-oriented transfer files: TOPI and TABL open a table, OBJE an object, STPT/LIPT/ARCP/ELIN its lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.curves import Curve, stroked, transfer_lines, wkt_of_curves
from weftline.operators import areas
from weftline.storage import stored


#: Lines that end the object before them.
BOUNDS = ("OBJE", "ETAB", "ETOP", "ENDE")


def objects(text: str) -> Iterator[tuple[str, str, str, list[str | None], str | None]]:
    """(topic, table, oid, values, WKT of the object's lines): '@' is undefined, '_' a blank; a line that ends in a
    backslash goes on in the CONT line behind it.

    ELIN ends a line: several lines of an object are one multi-line. Lines with arcs are curves.
    """
    return objects_of_lines(text.replace("\r\n", "\n").split("\n"))


def objects_of_lines(lines: Iterable[str], topic: str = "", table: str = "") -> Iterator[tuple[str, str, str, list[str | None], str | None]]:
    """The objects of lines that stand in this topic and table."""
    current, points, ended = None, [], []
    for line in lines:
        word, _, rest = line.partition(" ")
        if word == "CONT":
            if current is not None:
                current[3].extend(_values(rest))
            continue
        if word in BOUNDS and current is not None:
            yield (*current, _lines(ended + [points] if points else ended))
            current, points, ended = None, [], []
        if word == "TOPI":
            topic = rest.strip()
        elif word == "TABL":
            table = rest.strip()
        elif word == "OBJE":
            values = _values(rest)
            current = (topic, table, values[0], values[1:])
        elif word in ("STPT", "LIPT", "ARCP"):
            x, y = map(float, rest.split()[:2])
            points.append(((x, y), word == "ARCP"))
        elif word == "ELIN" and points:
            ended.append(points)
            points = []


def _values(text: str) -> list[str | None]:
    return [None if v == "@" else v.replace("_", " ") for v in text.rstrip().removesuffix("\\").split()]


def _lines(lines: list[Curve]) -> str | None:
    if not lines:
        return None
    if len(lines) == 1 and len(lines[0]) == 1:
        return wkt_of_curves(lines).replace("LINESTRING", "POINT")
    return wkt_of_curves(lines)


def read(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """Objects of option `table` (of option `topic`): `_oid`, the attributes of option `fields` in order, `geometry`.

    Option encoding (ISO-8859-1). A file is read by ranges of lines, a task each. A table depends on the lines before: one pass
    finds where topics and tables begin, and an object that goes on in the next range is put together from both. With an
    encoding whose line ends are no single bytes a file is read whole.

    A polygon's lines stand in a helper table, which option `lines` names. Option `kind` area: the lines bound the areas
    of all objects, and the point at each object names its own; what doesn't fit is told by `area_findings`. Surface: a
    row's first attribute names the object that it bounds. Arcs are stroked for that within option `tolerance` (0.001).
    """
    if not options.get("lines"):
        return _table(spark, path, options)
    own, lines = _with_lines(spark, path, options)
    if options["kind"] == "area":
        return areas.assembled(own, lines)[0]
    if options["kind"] != "surface":
        raise ValueError(f"option kind: {options['kind']!r} is neither area nor surface")
    return areas.surfaces(own, lines)


def area_findings(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """(code, key) of areas without a boundary, without an object, or with several points; options as in `read`."""
    return areas.assembled(*_with_lines(spark, path, options))[1]


def _with_lines(spark: SparkSession, path: str, options: dict) -> tuple[DataFrame, DataFrame]:
    """The objects of the table, and the line strings (owner, geometry) of its helper table."""
    helper = {**options, "table": options["lines"], "fields": "owner"}
    found = _table(spark, path, helper).select("owner", stroked(F.col("geometry"), float(options.get("tolerance", 0.001))).alias("geometry"))
    inner = F.regexp_extract("geometry", r"^MULTILINESTRING \((.*)\)$", 1)
    each = F.when(inner != "", F.transform(F.split(inner, r"(?<=\)), *"), lambda p: F.concat(F.lit("LINESTRING "), p))).otherwise(F.array("geometry"))
    return _table(spark, path, options), found.select("owner", F.explode(each).alias("geometry"))


def _table(spark: SparkSession, path: str, options: dict) -> DataFrame:
    fields = [f.strip() for f in options["fields"].split(",")]
    want, topic, encoding = options["table"], options.get("topic"), options.get("encoding", "ISO-8859-1")

    schema = ", ".join(f"`{n}` string" for n in ["_topic", "_oid", *fields, "geometry"])
    columns = ["_topic", "_oid", *fields, "geometry"]

    def frame_of(found) -> pd.DataFrame:
        rows = [[t, oid, *(values + [None] * len(fields))[: len(fields)], line] for t, table, oid, values, line in found if table == want and topic in (None, t)]
        return pd.DataFrame(rows, columns=columns, dtype=object)

    if "\nO".encode(encoding) != b"\nO":
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for content in frame["content"]:
                    yield frame_of(objects(bytes(content).decode(encoding)))

        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)

    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value")
    )
    # Where each range begins: in what topic and table, and whether lines before its first bound belong to an object of the range before.
    begins = lambda w: (F.substring("value", 1, 5) == F.lit(f"{w} ".encode())) | F.col("value").isin(w.encode(), f"{w}\r".encode())
    marks = lines.groupBy("file", "start").agg(*(F.max(F.when(begins(w), F.struct("at", "value"))).alias(w) for w in ("TOPI", "TABL")))
    state: dict[tuple[str, int], tuple[str, str]] = {}
    name = lambda mark, other: other if mark is None else bytes(mark["value"]).decode(encoding).partition(" ")[2].strip()

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole objects, and of each range its lines before the first bound and its last object, as `rest`."""
        key, text, n = None, [], 0

        def flush(final: bool) -> Iterator[pd.DataFrame]:
            nonlocal text, n
            bounds = [i for i, line in enumerate(text) if line.partition(" ")[0] in BOUNDS]
            where, rest = state_of[0], []
            if n == 0:  # the lines before the first bound
                if not bounds and not final:
                    return
                first = bounds[0] if bounds else len(text)
                rest.append((key[0], key[1], 0, *where, "\n".join(text[:first])))
                for line in text[:first]:
                    where = _moved(line, where)
                text, n, bounds = text[first:], 1, [i - first for i in bounds]
            end = bounds[-1] if bounds else 0
            found = frame_of(objects_of_lines(text[: end + 1], *where))
            if len(found):
                yield found.assign(**dict.fromkeys(REST))
            for line in text[:end]:
                where = _moved(line, where)
            text, state_of[0] = text[end:], where
            if final:
                rest.append((key[0], key[1], 1, *where, "\n".join(text)))
                text = []
            if rest:
                yield pd.DataFrame([[None] * len(columns) + list(r) for r in rest], columns=[*columns, *REST], dtype=object)

        state_of = [("", "")]
        for frame in frames:
            for (file, start), own in frame.groupby(["file", "start"], sort=False):
                if (file, start) != key:
                    if key is not None:
                        yield from flush(True)
                    key, n = (file, start), 0
                    state_of[0] = state[key]
                text += [bytes(v).decode(encoding).removesuffix("\r") for v in own["value"]]
                yield from flush(False)
        if key is not None:
            yield from flush(True)

    rest_schema = "_file string, _start bigint, _side int, _in_topic string, _in_table string, _rest string"
    conf = "spark.sql.files.minPartitionNum"  # the same ranges in both passes, however many tasks can run meanwhile
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, before or spark.sparkContext.defaultParallelism)
    try:
        now, last = ("", ""), None
        for r in sorted(marks.collect(), key=lambda r: (r["file"], r["start"])):  # a row a range
            now = now if r["file"] == last else ("", "")
            state[r["file"], r["start"]], last = now, r["file"]
            now = (name(r["TOPI"], now[0]), name(r["TABL"], now[1]))
        both = stored(lines.select("file", "start", "value").mapInPandas(parts, f"{schema}, {rest_schema}"), "transfer-objects", "zstd")
    finally:
        spark.conf.set(conf, before) if before else spark.conf.unset(conf)
    broken = both.where("_file is not null").groupBy("_file").agg(F.sort_array(F.collect_list(F.struct("_start", "_side", "_in_topic", "_in_table", "_rest"))).alias("rests"))

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The objects at the ends of ranges: the last of each, with the lines of the next ones up to their first bound."""
        for frame in frames:
            for rests in frame["rests"]:
                found: list = []
                held, where = [], ("", "")
                for r in rests:
                    if r["_side"] == 1:
                        if r["_rest"]:
                            found += objects_of_lines([*held, "ENDE"], *where)
                            held, where = r["_rest"].split("\n"), (r["_in_topic"], r["_in_table"])
                    elif r["_rest"]:
                        held += r["_rest"].split("\n")
                yield frame_of([*found, *objects_of_lines(held, *where)])

    return both.where("_file is null").select(*columns).unionByName(broken.select("rests").mapInPandas(joined, schema))


#: Of an object that a range of lines begins or ends with.
REST = ["_file", "_start", "_side", "_in_topic", "_in_table", "_rest"]


def _moved(line: str, where: tuple[str, str]) -> tuple[str, str]:
    """Topic and table behind a line."""
    word, _, name = line.partition(" ")
    return (name.strip(), where[1]) if word == "TOPI" else (where[0], name.strip()) if word == "TABL" else where


def _value(c: Column) -> Column:
    text = F.regexp_replace(F.trim(c.cast("string")), r"\s", "_")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("@"))


def object_lines(df: DataFrame, names: list[str], geometry: Column | None = None) -> Column:
    """The OBJE line of each row and its CONT lines, 75 characters at most but for longer values, and the lines of its geometry (WKT)."""
    number = F.when(F.col("_oid").rlike("^[0-9]+$"), F.col("_oid")).otherwise(F.raise_error(F.concat(F.lit("no whole number: "), F.col("_oid"))))
    line = F.concat_ws(" ", F.lit("OBJE"), number, *(_value(F.col(c)) for c in names))
    line = F.regexp_replace(line, r"(.{1,73})(?: |$)", "$1 \\\\\nCONT ")
    line = F.regexp_replace(line, r" \\\nCONT $", "")
    return line if geometry is None else F.concat_ws("\n", line, transfer_lines(geometry))


def helper_lines(df: DataFrame, geometry: str, kind: str) -> DataFrame:
    """(owner, geometry): the lines of a helper table for polygons (`_oid`, WKT): each boundary of areas once, or each ring of a surface."""
    if kind == "area":
        return areas.boundaries(df, geometry).select(F.lit(None).cast("string").alias("owner"), "geometry")
    rings = F.split(F.regexp_extract(geometry, r"^\s*POLYGON\s*\(\s*\((.*)\)\s*\)\s*$", 1), r"\)\s*,\s*\(")
    return df.where(F.col(geometry).isNotNull()).select(F.col("_oid").alias("owner"), F.explode(rings).alias("r")).select("owner", F.concat(F.lit("LINESTRING ("), "r", F.lit(")")).alias("geometry"))
