"""Formats by id: how each is read to one class per DataFrame, and written.

Everything is opened by Spark's readers, so a path may lie in any store they reach.
Files that Spark cannot split (GeoPackage, shapefile, transfer files) are read
whole, one task a file.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.functions.geometry import wkb_text
from weftline.sources import geopackage, shapefile, transferfile, transfers, xmltransfer


class UnknownFormat(ValueError):
    pass


TRUE, FALSE = {"true", "yes", "1"}, {"false", "no", "0"}
CHARACTERS = {"tab": "\t", "\\t": "\t", "semicolon": ";", "comma": ","}


def option_bool(options: dict, name: str, default: bool) -> bool:
    value = str(options.get(name, default)).lower()
    if value not in TRUE | FALSE:
        raise ValueError(f"option {name}: {value!r} is no boolean")
    return value in TRUE


def option_int(options: dict, name: str, default: int) -> int:
    return int(options.get(name, default))


def option_char(options: dict, name: str, default: str) -> str:
    value = CHARACTERS.get(str(options.get(name, default)).lower(), options.get(name, default))
    if len(value) != 1:
        raise ValueError(f"option {name}: {value!r} is not one character")
    return value


def option_required(options: dict, name: str) -> str:
    if not options.get(name):
        raise ValueError(f"option {name} is missing")
    return options[name]


@dataclass(frozen=True)
class Format:
    id: str
    extensions: tuple[str, ...]
    read: Callable[..., DataFrame] | None
    write: Callable[..., None] | None
    #: Of formats that hold several classes in one file: writes them all.
    write_all: Callable[..., None] | None = None


def read_parquet(spark: SparkSession, path: str, options: dict) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, options: dict) -> None:
    """Partitioned by basket where objects have one."""
    writer = df.write
    if option_bool(options, "byBasket", "_basket" in df.columns):
        writer = writer.partitionBy("_basket")
    writer.parquet(path)


def read_csv(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """Options: firstLineIsHeader, separator, delimiter (the quote), encoding, schema (DDL). All columns are text without a schema."""
    reader = spark.read.option("header", option_bool(options, "firstLineIsHeader", True)).option("sep", option_char(options, "separator", ","))
    reader = reader.option("quote", option_char(options, "delimiter", '"')).option("encoding", options.get("encoding", "UTF-8")).option("multiLine", option_bool(options, "multiLine", False))
    schema = options.get("schema")
    return (reader.schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)) if schema else reader).csv(path)


def read_jdbc(spark: SparkSession, connection: dict, query: dict, base_dir: str | None = None) -> DataFrame:
    """One query: its columns renamed by `columns`, scalars as text where `asText`, identifier from `oidColumn`.

    connection: url, driver, user, password, or userEnv and passwordEnv, properties.
    query: sql, columns, oidColumn, and for parallel reading partitionColumn,
    lowerBound, upperBound, numPartitions.
    """
    reader = spark.read.format("jdbc").option("url", connection_url(connection["url"], base_dir))
    for name in ("driver", "user", "password"):
        value = connection.get(name) or os.environ.get(connection.get(f"{name}Env", ""), "")
        if value:
            reader = reader.option(name, value)
    for name, value in connection.get("properties", {}).items():
        reader = reader.option(name, value)
    split = [k for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions") if k in query]
    if split:
        reader = reader.option("dbtable", f"({query['sql']}) q").options(**{k: query[k] for k in split})
    else:
        reader = reader.option("query", query["sql"])
    df = reader.option("fetchsize", query.get("fetchSize", 10_000)).load()
    for g in query.get("geometry", []):
        column = next((c for c in df.columns if c.lower() == g["column"].lower()), None)
        if column is None:
            raise ValueError(f"the query has no column {g['column']!r}")
        df = df.withColumn(column, geometry_text(df, column, g.get("encoding", "wkb"), dialect_of(connection["url"])))
        df = df.withColumnRenamed(column, g.get("attribute", column))
    if query.get("asText"):
        df = df.select(*(scalar_text(df, c, query.get("blobEncoding")).alias(c) for c in df.columns))
    return df.withColumnsRenamed(query.get("columns", {}))


#: Encodings of geometries that a database's columns may have. Fixed values.
DIALECTS = {"default": ("wkt", "wkb"), "postgresql": ("wkt", "wkb", "ewkb"), "duckdb": ("wkt", "wkb")}


def dialect_of(url: str) -> str:
    name = url.removeprefix("jdbc:").partition(":")[0].lower()
    return name if name in DIALECTS else "default"


def geometry_text(df: DataFrame, column: str, encoding: str, dialect: str = "default"):
    """WKT of a geometry column; empty is null."""
    if encoding not in DIALECTS[dialect]:
        raise ValueError(f"column {column}: {dialect} has no encoding {encoding!r}")
    c = F.col(column)
    if encoding == "wkt":
        return F.nullif(F.trim(c.cast("string")), F.lit(""))
    # Bytes, or their hexadecimal text, which some databases give.
    raw = c if df.schema[column].dataType.typeName() == "binary" else F.unhex(F.nullif(F.trim(c.cast("string")), F.lit("")))
    return wkb_text(raw)


def connection_url(url: str, base_dir: str | None) -> str:
    """A relative file of an embedded database lies below `base_dir`."""
    head, sep, file = url.partition("jdbc:sqlite:")
    return f"{sep}{base_dir}/{file}" if sep and base_dir and not head and not file.startswith(("/", ":")) else url


def scalar_text(df: DataFrame, column: str, blob_encoding: str | None = None):
    """A scalar in its text form: dates and times as ISO, decimals plain, bytes in base 64 if asked for."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "binary":
        if blob_encoding != "base64":
            raise ValueError(f"column {column} holds bytes; set blobEncoding to base64")
        return F.base64(c)
    if kind in ("timestamp", "timestamp_ntz"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")


FORMATS = [
    Format("xtf", ("xtf", "xml"), xmltransfer.read, xmltransfer.write, transfers.write_xtf),
    Format("itf", ("itf",), transferfile.read, lambda df, path, options: transfers.write_itf({options["class"]: df}, path, options), transfers.write_itf),
    Format("csv", ("csv",), read_csv, None),
    Format("gpkg", ("gpkg",), geopackage.read, None),
    Format("shp", ("shp", "zip"), shapefile.read, shapefile.write),
    Format("parquet", ("parquet",), read_parquet, write_parquet),
]


def format_of(path: str, explicit: str | None = None) -> Format:
    """The stated format, or that of the path's extension."""
    name = (explicit or path.rstrip("/").rpartition(".")[2]).lower()
    for f in FORMATS:
        if name == f.id or not explicit and name in f.extensions:
            return f
    raise UnknownFormat(f"no format {name!r} for {path!r}; jdbc inputs state their connection")


def read_input(spark: SparkSession, path: str, options: dict | None = None, explicit: str | None = None) -> DataFrame:
    f = format_of(path, explicit)
    if not f.read:
        raise UnknownFormat(f"{f.id} can't be read")
    return f.read(spark, path, options or {})


def write_output(df: DataFrame, path: str, options: dict | None = None, explicit: str | None = None) -> None:
    f = format_of(path, explicit)
    if not f.write:
        raise UnknownFormat(f"{f.id} can't be written")
    f.write(df, path, options or {})
