import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.functions.geometry import wkb_text
from weftline.sources import formats, shapefile, transferfile
from weftline.sources.formats import read_input, write_output


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_format_resolution_and_options():
    assert formats.format_of("a/b.CSV").id == "csv" and formats.format_of("x.dat", "shp").id == "shp"
    with pytest.raises(formats.UnknownFormat):
        formats.format_of("x.jdbc")
    assert formats.option_bool({"a": "YES"}, "a", False) and formats.option_char({"s": "tab"}, "s", ",") == "\t"
    for bad in (lambda: formats.option_bool({"a": "maybe"}, "a", True), lambda: formats.option_char({"s": "ab"}, "s", ","), lambda: formats.option_required({}, "t")):
        with pytest.raises(ValueError):
            bad()


def test_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("bfsnr;name\n2601;'Solo;thurn'\n2610;Olten\n")
    df = read_input(spark, f"{tmp_path}/m.csv", {"separator": "semicolon", "delimiter": "'", "schema": "bfsnr int, name string"})
    assert rows(df) == [(2601, "Solo;thurn"), (2610, "Olten")]
    with pytest.raises(formats.UnknownFormat):
        write_output(df, f"{tmp_path}/o.csv")


def test_parquet_by_basket(spark, tmp_path):
    df = spark.createDataFrame([("b1", 1), ("b2", 2)], "_basket string, x int")
    write_output(df, f"{tmp_path}/o.parquet")
    assert (tmp_path / "o.parquet" / "_basket=b1").is_dir()
    assert read_input(spark, f"{tmp_path}/o.parquet").count() == 2


def test_xml_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b1", "t1", "Ann & <Co>", 3), ("b1", "t2", None, 4), ("b2", "t3", "x", None)], "_basket string, _oid string, name string, n int")
    write_output(df, f"{tmp_path}/o.xtf", {"class": "Thing", "objectsPerFile": 1})
    options = {"class": "Thing", "basketTag": "basket", "schema": "name string, n int"}
    back = read_input(spark, f"{tmp_path}/o.xtf/*/*", options, "xtf").select("_basket", "_oid", "name", "n")
    assert rows(back) == rows(df)
    flat = read_input(spark, f"{tmp_path}/o.xtf/*/*", {"class": "Thing", "schema": "name string, n int"}, "xtf")
    assert flat.select("_oid").count() == 3


def test_jdbc(spark, tmp_path):
    url = "jdbc:derby:memory:weft;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(1, "a", b"\1"), (2, None, b"\2")], "k int, v string, b binary")
    df.coalesce(1).write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "t").save()
    found = formats.read_jdbc(spark, {"url": url, "driver": driver}, {"sql": 'select "k" as kk, "v" as vv from t', "columns": {"KK": "key", "VV": "value"}, "asText": True})
    assert rows(found) == [("1", "a"), ("2", None)]
    with pytest.raises(ValueError, match="base64"):
        formats.read_jdbc(spark, {"url": url, "driver": driver}, {"sql": "select * from t", "asText": True})
    split = {"sql": 'select "k" as k from t', "partitionColumn": "k", "lowerBound": 1, "upperBound": 3, "numPartitions": 2}
    assert formats.read_jdbc(spark, {"url": url, "driver": driver}, split).rdd.getNumPartitions() == 2
    assert formats.connection_url("jdbc:sqlite:x.db", "/d") == "jdbc:sqlite:/d/x.db"


def test_geopackage(spark, tmp_path):
    point = b"GP\0\1" + struct.pack("<i", 2056) + b"\1\1\0\0\0" + struct.pack("<dd", 1.5, 2.5)
    with sqlite3.connect(tmp_path / "m.gpkg") as c:
        c.execute("create table s (id integer, name text, geom blob)")
        c.executemany("insert into s values (?, ?, ?)", [(1, "a", point), (2, None, None)])
    df = read_input(spark, f"{tmp_path}/m.gpkg", {"table": "s", "schema": "id bigint, name string, geom binary", "geometry": "geom"})
    got = df.select("id", "name", wkb_text("geom").alias("p"))
    assert rows(got) == [(1, "a", "POINT (1.5 2.5)"), (2, None, None)]


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    point = lambda i: b"GP\0\1" + struct.pack("<i", 2056) + b"\1\1\0\0\0" + struct.pack("<dd", i, 2.5)
    with sqlite3.connect(tmp_path / "m.gpkg") as c:
        c.execute("create table s (id integer, name text, geom blob)")
        c.executemany("insert into s values (?, ?, ?)", [(i, f"n{i}", point(i) if i % 3 else None) for i in range(5000)])
        c.execute("delete from s where id between 1000 and 1999")
        c.execute("create table empty (id integer, name text, geom blob)")
        c.execute("create view v as select * from s where id < 7")
    schema = {"schema": "id bigint, name string, geom binary", "geometry": "geom"}
    read = lambda **o: read_input(spark, f"{tmp_path}/m.gpkg", {**schema, **o})
    split = read(table="s", recordsPerTask=700)
    assert split.rdd.getNumPartitions() == 8 and rows(split) == rows(read(table="s")) and split.count() == 4000
    assert read(table="empty", recordsPerTask=10).count() == 0 and read(table="v", recordsPerTask=2).count() == 7
    df = spark.range(2500).selectExpr("cast(id as string) as id", "if(id % 5 = 0, null, concat('POINT (', id, '.0 ', id + 1, '.0)')) as geometry")
    write_output(df.coalesce(1), f"{tmp_path}/p.shp")
    split, whole = (read_input(spark, f"{tmp_path}/p.shp", {"fields": "id", **o}) for o in ({"recordsPerTask": 600}, {}))
    assert split.rdd.getNumPartitions() == 5 and rows(split) == rows(whole) and split.count() == 2500
    with pytest.raises(Exception, match="mounts"):
        read_input(spark, f"{tmp_path}/none.shp", {"fields": "id", "recordsPerTask": 5}).count()


SHAPES = ["POINT (1.0 2.0)", "POINT (3.5 -4.0)", None]
POLYGON = "POLYGON ((0.0 0.0, 0.0 10.0, 10.0 10.0, 10.0 0.0, 0.0 0.0), (2.0 2.0, 4.0 2.0, 4.0 4.0, 2.0 4.0, 2.0 2.0))"


def test_shapefile_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"ü{i}", w) for i, w in enumerate(SHAPES)], "id string, a_rather_long_name string, geometry string")
    with pytest.raises(ValueError, match="longer"):
        write_output(df, f"{tmp_path}/p.shp")
    write_output(df.coalesce(1), f"{tmp_path}/p.shp", {"fieldNameStrategy": "truncate"})
    assert (tmp_path / "p.shp").stat().st_size == 100 + 28 * 2 + 12 and (tmp_path / "p.shx").stat().st_size == 100 + 8 * 3
    assert (tmp_path / "p.fields.json").exists()
    options = {"fields": "id,a_rather_l", "column.a_rather_l": "a_rather_long_name", "dbfEncoding": "UTF-8"}
    back = read_input(spark, f"{tmp_path}/p.shp", options)
    assert rows(back.drop("_oid")) == rows(df)
    assert rows(back.select("_oid")) == [("shp.1",), ("shp.2",), ("shp.3",)]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        for ext in ("shp", "dbf"):
            z.write(tmp_path / f"p.{ext}", f"p.{ext}")
    assert rows(read_input(spark, f"{tmp_path}/p.zip", options).drop("_oid")) == rows(df)


def test_polygons_and_lines(spark, tmp_path):
    for name, wkt in (("a", POLYGON), ("b", "LINESTRING (0.0 0.0, 1.0 1.0)"), ("c", "MULTILINESTRING ((0.0 0.0, 1.0 1.0), (2.0 2.0, 3.0 3.0))")):
        write_output(spark.createDataFrame([("1", wkt)], "id string, geometry string"), f"{tmp_path}/{name}.shp")
        assert read_input(spark, f"{tmp_path}/{name}.shp", {"fields": "id"}).first()["geometry"] == wkt
    two = shapefile.polygons_of([[(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (1, 5), (5, 5), (5, 1), (1, 1)], [(2, 2), (3, 2), (3, 3), (2, 2)]])
    assert [len(p) for p in two] == [1, 2]


@pytest.mark.parametrize(("raw", "kind", "value"), [(" x ", "C", "x"), ("", "C", None), ("***", "N", None), ("00000000", "D", None), ("20240131", "D", "2024-01-31"), ("Y", "L", "true"), ("F", "L", "false"), ("?", "L", None)])
def test_dbf_values(raw, kind, value):
    assert shapefile.value_text(raw, kind) == value


TRANSFER = """SCNT
TOPI Roads
TABL Axis
OBJE 10 main_road @ 7
STPT 1.0 2.0
LIPT 3.0 4.0
ELIN
OBJE 11 a \\
CONT b \\
CONT 13
ETAB
TABL Other
OBJE 1 x
ETAB
ETOP
ENDE
"""


def test_transfer_file(spark, tmp_path):
    (tmp_path / "m.itf").write_text(TRANSFER)
    df = read_input(spark, f"{tmp_path}/m.itf", {"table": "Axis", "fields": "name,note,n"})
    assert rows(df) == [("Roads", "10", "main road", None, "7", "LINESTRING (1 2, 3 4)"), ("Roads", "11", "a", "b", "13", None)]
    assert [o[2] for o in transferfile.objects(TRANSFER)] == ["10", "11", "1"]


def test_written_transfer_file_is_as_expected(spark, tmp_path):
    """Byte by byte: long objects, blanks, undefined values, surfaces, arcs; one file, and none where a task fails."""
    shape = "POLYGON ((0 0, 10 0, 10 10.5, 0 0), (1 1, 2 1, 2 2, 1 1))"
    plots = spark.createDataFrame([("10", "b1", "x" * 60, "long text behind it", shape), ("9", "b2", "b", None, None)], "_oid string, _basket string, a string, b string, geometry string")
    roads = spark.createDataFrame([("3", "main", "COMPOUNDCURVE ((0 0, 1 0), CIRCULARSTRING (1 0, 2 1, 3 0))"), ("4", "end", "POINT (7 8)")], "_oid string, name string, geometry string")
    formats.format_of("x.itf").write_all({"M.T.Plot": plots, "M.U.Road": roads}, f"{tmp_path}/m.itf", {})
    assert (tmp_path / "m.itf").read_text() == f"""SCNT
weftline
////
MTID M
MODL M
TOPI T
TABL Plot
OBJE 9 b @
OBJE 10 {"x" * 60} \\
CONT long_text_behind_it
ETAB
TABL Plot_geometry
OBJE 1 10
STPT 0 0
LIPT 10 0
LIPT 10 10.5
LIPT 0 0
ELIN
OBJE 2 10
STPT 1 1
LIPT 2 1
LIPT 2 2
LIPT 1 1
ELIN
ETAB
ETOP
TOPI U
TABL Road
OBJE 3 main
STPT 0 0
LIPT 1 0
ARCP 2 1
LIPT 3 0
ELIN
OBJE 4 end
STPT 7 8
ETAB
TABL Road_geometry
ETAB
ETOP
EMOD
ENDE
"""
    read = lambda **o: {r["_oid"]: tuple(r)[2:] for r in read_input(spark, f"{tmp_path}/m.itf", o).collect()}
    got = read(table="Plot", fields="a,b", lines="Plot_geometry", kind="surface")
    assert got == {"10": ("x" * 60, "long text behind it", "POLYGON ((0 0, 10 0, 10 10.5, 0 0), (1 1, 2 1, 2 2, 1 1))".replace("1 1, 2 1, 2 2, 1 1", "1 1, 2 2, 2 1, 1 1")), "9": ("b", None, None)}
    assert read(table="Road", fields="name")["3"][1] == "COMPOUNDCURVE ((0 0, 1 0), CIRCULARSTRING (1 0, 2 1, 3 0))"
    with pytest.raises(Exception, match="no whole number"):
        formats.write_output(plots.withColumn("_oid", F.lit("x1")), f"{tmp_path}/bad.itf", {"class": "M.T.Plot"}, "itf")
    with pytest.raises(FileExistsError):
        formats.write_output(plots, f"{tmp_path}/m.itf", {"class": "M.T.Plot"}, "itf")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".m.itf.crc")) == ["m.itf"]


def test_areas_of_transfer_files(spark, tmp_path):
    """A planar map: each boundary once, a point an area; read again the areas are equal."""
    plots = [("1", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), ("2", "POLYGON ((10 0, 20 0, 20 10, 10 10, 10 0))"), ("3", "POLYGON ((4 4, 6 4, 6 6, 4 6, 4 4))"), ("4", None)]
    df = spark.createDataFrame(plots, "_oid string, geometry string")
    formats.write_output(df, f"{tmp_path}/m.itf", {"class": "M.T.Plot", "geometry": {"Plot": "area"}}, "itf")
    text = (tmp_path / "m.itf").read_text()
    assert text.index("TABL Plot_geometry") < text.index("TABL Plot\n") and text.count("LIPT") == 4 + 3 + 4 and text.split("TABL Plot\n")[1].count("STPT") == 3
    options = {"table": "Plot", "fields": "none", "lines": "Plot_geometry", "kind": "area"}
    got = {r["_oid"]: r["geometry"] for r in read_input(spark, f"{tmp_path}/m.itf", options).collect()}
    points = lambda t: t and sorted(tuple(sorted(set(r.split(", ")))) for r in t.replace("POLYGON ((", "").replace("))", "").split("), ("))
    assert {k: points(v) for k, v in got.items()} == {k: points(v) for k, v in plots}
    assert [(r["code"], r["key"]) for r in transferfile.area_findings(spark, f"{tmp_path}/m.itf", options).collect()] == [("AREA_WITHOUT_BOUNDARY", "4")]


def test_one_xml_transfer(spark, tmp_path):
    shops = spark.createDataFrame([("s1", "b1", "A & B", None, 1), ("s2", "b2", None, "p1", 2)], "_oid string, _basket string, name string, place string, n int")
    places = spark.createDataFrame([("p1", "b2", 1.5), ("p2", "b2", None)], "_oid string, _basket string, x double")
    formats.format_of("x.xtf").write_all({"M.T.Shop": shops, "M.T.Place": places}, f"{tmp_path}/o.xtf", {"roles": {"M.T.Shop": ["place"]}, "sender": "me"})
    assert (tmp_path / "o.xtf").read_text() == """<?xml version="1.0" encoding="UTF-8"?>
<TRANSFER xmlns="http://www.interlis.ch/INTERLIS2.3">
<HEADERSECTION SENDER="me" VERSION="2.3"><MODELS><MODEL NAME="M" VERSION="1" URI=""/></MODELS></HEADERSECTION>
<DATASECTION>
<M.T BID="b1">
<M.T.Shop TID="s1"><name>A &amp; B</name><n>1</n></M.T.Shop>
</M.T>
<M.T BID="b2">
<M.T.Place TID="p1"><x>1.5</x></M.T.Place>
<M.T.Place TID="p2"></M.T.Place>
<M.T.Shop TID="s2"><place REF="p1"/><n>2</n></M.T.Shop>
</M.T>
</DATASECTION>
</TRANSFER>
"""
    options = {"oid": "TID", "bid": "BID", "basketTag": "M.T"}
    back = read_input(spark, f"{tmp_path}/o.xtf", {**options, "class": "M.T.Shop", "schema": "name string, place struct<_a_REF:string>, n decimal(10,2)"})
    assert [tuple(r) for r in back.select("_basket", "_oid", "name", "place", F.col("n").cast("int")).orderBy("_oid").collect()] == [("b1", "s1", "A & B", None, 1), ("b2", "s2", None, "p1", 2)]
    assert read_input(spark, f"{tmp_path}/o.xtf", {**options, "class": "M.T.Place", "schema": "x double, deep struct<a:int,b:int>"}).count() == 2


def test_wkb_of_all_kinds():
    import struct

    from weftline.functions.geometry import wkt_of_wkb

    point = lambda x, y, e="<": struct.pack(f"{e}BIdd", e == "<", 1, x, y)
    line = lambda *p, e="<": struct.pack(f"{e}BII", e == "<", 2, len(p)) + b"".join(struct.pack(f"{e}dd", *x) for x in p)
    ring = struct.pack("<BIII", 1, 3, 1, 3) + b"".join(struct.pack("<dd", *x) for x in ((0, 0), (1, 0), (0, 0)))
    assert wkt_of_wkb(point(1, 2.5)) == wkt_of_wkb(point(1, 2.5, ">")) == "POINT (1 2.5)"
    assert wkt_of_wkb(line((0, 0), (1, 1), e=">")) == "LINESTRING (0 0, 1 1)"
    assert wkt_of_wkb(ring) == "POLYGON ((0 0, 1 0, 0 0))"
    assert wkt_of_wkb(struct.pack("<BII", 1, 6, 1) + ring) == "MULTIPOLYGON (((0 0, 1 0, 0 0)))"
    assert wkt_of_wkb(struct.pack("<BII", 1, 7, 2) + point(1, 2) + line((0, 0), (1, 1))) == "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))"
    assert wkt_of_wkb(struct.pack("<BIIddd", 1, 0xA0000001, 4326, 1, 2, 3)) == wkt_of_wkb(struct.pack("<BIddd", 1, 1001, 1, 2, 3)) == "POINT (1 2)"
    assert wkt_of_wkb(b"") is None


def test_dialects():
    assert formats.dialect_of("jdbc:postgresql://h/d") == "postgresql" and formats.dialect_of("jdbc:derby:x") == "default"


def test_wrapped_bags_are_unwrapped(spark):
    from weftline.operators.bags import unwrapped

    df = spark.createDataFrame([((((1, 2),),),), (None,)], "b struct<w:struct<v:struct<x:int,y:int>>>")
    got = df.select(unwrapped(F.col("b"), df.schema["b"].dataType).alias("b")).collect()
    assert [tuple(x) for x in got[0]["b"]] == [(1, 2)] and got[1]["b"] is None


def test_shapefile_fields_have_types(spark, tmp_path):
    df = spark.sql("select 'POINT (1 2)' as geometry, 7 as n, 2.5d as x, true as b, date'2024-01-31' as d, cast(1.25 as decimal(6,2)) as m, 'text' as t, 'b1' as _basket")
    write_output(df, f"{tmp_path}/a.shp", {"shapeType": "point", "prj": "LOCAL_CS[]"})
    head = (tmp_path / "a.dbf").read_bytes()
    kinds = {head[32 + 32 * i : 43 + 32 * i].rstrip(b"\0").decode(): chr(head[43 + 32 * i]) for i in range(6)}
    assert kinds == {"n": "N", "x": "N", "b": "L", "d": "D", "m": "N", "t": "C"}
    assert (tmp_path / "a.prj").read_text() == "LOCAL_CS[]"
    with pytest.raises(ValueError, match="type"):
        write_output(df, f"{tmp_path}/b.shp", {"shapeType": "polygon"})
    with pytest.raises(ValueError, match="baskets"):
        write_output(df.unionByName(df.withColumn("_basket", F.lit("b2"))), f"{tmp_path}/c.shp")
    with pytest.raises(ValueError, match="records"):
        write_output(df.unionByName(df), f"{tmp_path}/d.shp", {"maxRecords": 1})


@pytest.mark.parametrize("size", [7, 60, 333])
def test_transfer_file_is_read_by_ranges(spark, tmp_path, size):
    """Objects, long values, lines and tables that end anywhere in a range; the whole text read by one task is what must come out."""
    text = "SCNT\nhead OBJE\n////\nMODL M\n"
    for topic in "AB":
        text += f"TOPI {topic}\n"
        for table in ("One", "Two"):
            text += f"TABL {table}\n"
            for i in range(9 if table == "One" else 3):
                text += f"OBJE {i} grün_{i} @ \\\nCONT {'x' * 40}{i} {i}\r\n"
                text += "STPT 0 0\n" + "".join(f"{'ARCP' if j % 4 == 1 else 'LIPT'} {j} {i}\n" for j in range(1, 2 * i + 1)) + "ELIN\n" if i % 3 else ""
            text += "ETAB\n"
        text += "ETOP\n"
    for n, t in enumerate((text + "ENDE\n", text.replace("ETOP", "ETOP "), "OBJE 1 early\nETAB\n", "")):
        (tmp_path / f"{n}.itf").write_bytes(t.encode("ISO-8859-1"))
    expected = []
    for p in sorted(tmp_path.glob("*.itf")):
        expected += [(t, o, *(v + [None] * 4)[:4], g) for t, table, o, v, g in transferfile.objects(p.read_bytes().decode("ISO-8859-1")) if table == "One"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = read_input(spark, f"{tmp_path}/*.itf", {"table": "One", "fields": "a,b,c,d"}, "itf")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and len(got) == 36
