"""Transfers of several classes as one file: parts are written by tasks in order, and joined by one commit."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.geometry import point_on_surface
from weftline.operators.identity import numbered_oids
from weftline.sources import transferfile, xmltransfer

Frames = dict[str, DataFrame]
#: Of the XML transfer format, version 2.3. Fixed value.
NAMESPACE = "http://www.interlis.ch/INTERLIS2.3"


def commit_text(rows: DataFrame, keys: list[str], path: str, encoding: str = "UTF-8") -> None:
    """The column `value` of `rows`, by `keys`, as one text file at `path`, which must not exist.

    Tasks write parts of ranges of the keys beside the place; the driver's JVM then copies part after part, a buffer at a
    time, and renames the whole. A failed task leaves nothing behind, and readers see all of the file or none.
    """
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(path)):
        raise FileExistsError(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        placed.select("value").write.option("encoding", encoding).option("lineSep", "\n").text(f"{draft}/parts")
        parts = [s.getPath() for s in fs.listStatus(at(f"{draft}/parts")) if s.getPath().getName().startswith("part-")]
        parts.sort(key=lambda p: int(p.getName().split("-")[1]))
        out = fs.create(at(f"{draft}/whole"), False)
        try:
            for p in parts:
                part = fs.open(p)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                finally:
                    part.close()
        finally:
            out.close()
        if fs.exists(at(path)) or not fs.rename(at(f"{draft}/whole"), at(path)):
            raise FileExistsError(path)
    finally:
        fs.delete(at(draft), True)


def _names(cls: str) -> tuple[str, str, str]:
    """Model, topic and name of a class."""
    parts = cls.split(".")
    return (parts[0], parts[-2], parts[-1]) if len(parts) > 2 else (parts[0], "Topic", parts[-1]) if len(parts) == 2 else ("Model", "Topic", cls)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _by_topic(frames: Frames) -> list[tuple[str, str, str, DataFrame]]:
    """(model, topic, name, objects), classes of a topic together in the order they came."""
    named = [(*_names(cls), df) for cls, df in frames.items()]
    order = {t: i for i, t in reversed(list(enumerate(n[:2] for n in named)))}
    return sorted(named, key=lambda n: order[n[:2]])


def _text_rows(spark: SparkSession, rows: list[tuple[int, int, str]]) -> DataFrame:
    return spark.createDataFrame([(t, r, "", v) for t, r, v in rows], "table int, rank int, key string, value string")


def write_itf(frames: Frames, path: str, options: dict) -> None:
    """Objects (`_oid`, attributes) by class (model.topic.table) as one line-oriented transfer file.

    Identifiers must be whole numbers, so use the integer strategy. Undefined values are '@', blanks '_'; a line longer
    than 75 characters goes on in CONT lines. Option geometryAttribute (WKT, 'geometry'); option geometry, by class: area
    or surface (the default for polygons). A surface's rings stand in a helper table behind the object's, whose rows name
    it. Areas have theirs before it: each boundary of two areas once, and with the object a point inside.
    """
    geometry, kinds = options.get("geometryAttribute", "geometry"), options.get("geometry") or {}
    tables = _by_topic(frames)
    spark = tables[0][3].sparkSession
    models = list(dict.fromkeys(m for m, *_ in tables))
    fixed = [(0, 0, "\n".join(["SCNT", options.get("comment", "weftline"), "////", f"MTID {models[0]}", *(f"MODL {m}" for m in models)]))]
    rows: list[DataFrame] = []
    last = None
    for n, (model, topic, name, df) in enumerate(tables):
        base = 10 * n + 10
        if (model, topic) != last:
            fixed.append((base, 0, f"TOPI {topic}"))
        names = [c for c in df.columns if not c.startswith("_") and c != geometry]
        drawn = None
        if geometry in df.columns:
            kind = kinds.get(name) or kinds.get(f"{model}.{topic}.{name}") or "surface"
            wkt = F.col(geometry)
            is_polygon = F.coalesce(F.upper(F.ltrim(wkt)).startswith("POLYGON"), F.lit(False))
            inside = point_on_surface(F.when(is_polygon, wkt))
            point = F.when(inside.isNotNull(), F.concat(F.lit("POINT ("), inside["x"].cast("string"), F.lit(" "), inside["y"].cast("string"), F.lit(")"))) if kind == "area" else F.lit(None)
            drawn = F.when(is_polygon, point.cast("string")).otherwise(wkt)
            helper = transferfile.helper_lines(df.where(is_polygon), geometry, kind)
            lines = numbered_oids(helper, ["owner", "geometry"])
            text = transferfile.object_lines(lines, ["owner"] if kind == "surface" else [], F.col("geometry"))
            table = base + (1 if kind == "area" else 5)
            rows.append(lines.select(F.lit(table).alias("table"), F.lit(1).alias("rank"), F.lpad("_oid", 20, "0").alias("key"), text.alias("value")))
            fixed += [(table, 0, f"TABL {name}_{geometry}"), (table, 2, "ETAB")]
        text = transferfile.object_lines(df, names, drawn)
        rows.append(df.select(F.lit(base + 3).alias("table"), F.lit(1).alias("rank"), F.lpad("_oid", 20, "0").alias("key"), text.alias("value")))
        fixed += [(base + 3, 0, f"TABL {name}"), (base + 3, 2, "ETAB")]
        if n + 1 == len(tables) or tables[n + 1][:2] != (model, topic):
            fixed.append((base + 9, 0, "ETOP"))
        last = (model, topic)
    fixed.append((10 * len(tables) + 20, 0, "EMOD\nENDE"))
    commit_text(_union([*rows, _text_rows(spark, fixed)]), ["table", "rank", "key"], path, options.get("encoding", "ISO-8859-1"))


def write_xtf(frames: Frames, path: str, options: dict) -> None:
    """Objects (`_oid`, `_basket`, attributes) by class (model.topic.class) as one XML transfer.

    A basket of a topic stands once, its objects without references first, then by class and identifier. Option `roles`
    names references by class, or for all classes; `structures` (attribute to element) see `xmltransfer.object_xml`.
    """
    classes = _by_topic(frames)
    spark = classes[0][3].sparkSession
    roles_of, structures = options.get("roles") or (), options.get("structures")
    objects, topics = [], list(dict.fromkeys(c[:2] for c in classes))
    for n, (model, topic, name, df) in enumerate(classes):
        full = f"{model}.{topic}.{name}"
        stated = roles_of.get(full, roles_of.get(name, ())) if isinstance(roles_of, dict) else roles_of
        roles = tuple(r for r in stated if r in df.columns)
        attributes = [c for c in df.columns if not c.startswith("_")]
        given = [(F.size(r) > 0) if df.schema[r].dataType.typeName() == "array" else F.col(r).isNotNull() for r in roles]
        refers = F.coalesce(reduce(lambda a, b: a | b, given), F.lit(False)) if given else F.lit(False)
        home = F.coalesce("_basket", F.lit("")) if "_basket" in df.columns else F.lit("")
        objects.append(
            df.select(
                F.lit(topics.index((model, topic))).alias("topic"), home.alias("basket"), F.when(refers, 2).otherwise(1).alias("rank"), F.lit(n).alias("cls"),
                F.col("_oid").alias("key"), xmltransfer.object_xml(df, full, attributes, roles, structures, marks=("TID", "REF")).alias("value"),
            )
        )
    rows = _union(objects)
    elements = F.array(*(F.lit(f"{m}.{t}") for m, t in topics))
    element = F.element_at(elements, F.col("topic") + 1)
    opening = F.concat(F.lit("<"), element, F.lit(' BID="'), xmltransfer.escaped(F.col("basket")), F.lit('">'))
    baskets = rows.select("topic", "basket").distinct()
    frame = lambda rank, value: baskets.select("topic", "basket", F.lit(rank).alias("rank"), F.lit(0).alias("cls"), F.lit("").alias("key"), value.alias("value"))
    rows = rows.unionByName(frame(0, opening)).unionByName(frame(3, F.concat(F.lit("</"), element, F.lit(">"))))
    models = "".join(f'<MODEL NAME="{m}" VERSION="{options.get("modelVersion", "1")}" URI="{options.get("modelUri", "")}"/>' for m in dict.fromkeys(m for m, _ in topics))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<TRANSFER xmlns="{NAMESPACE}">\n<HEADERSECTION SENDER="{options.get("sender", "weftline")}" VERSION="2.3"><MODELS>{models}</MODELS></HEADERSECTION>\n<DATASECTION>'
    ends = spark.createDataFrame([(-1, "", 0, 0, "", head), (len(topics), "", 0, 0, "", "</DATASECTION>\n</TRANSFER>")], "topic int, basket string, rank int, cls int, key string, value string")
    commit_text(rows.unionByName(ends), ["topic", "basket", "rank", "cls", "key"], path)
