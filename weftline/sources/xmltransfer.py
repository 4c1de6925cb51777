"""XML transfers: baskets of objects, read by Spark's XML source and written as XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from weftline.operators.bags import unwrapped


def read(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """Objects of one class: option `class` names their element, `schema` (DDL) their attributes.

    The envelope comes from the identifier attribute (option `oid`, 'tid') to
    `_oid`. With option `basketTag`, rows are the baskets of that element; each
    gives its objects and, as `_basket`, its own identifier (option `bid`). Roles,
    which are elements with a `ref` only, become the identifiers that they refer to;
    a bag becomes an array of structures, whatever elements wrap them.
    """
    cls, oid, bid = options["class"], options.get("oid", "tid"), options.get("bid", "bid")
    basket = options.get("basketTag")
    reader = spark.read.format("xml").option("rowTag", basket or cls).option("attributePrefix", "_a_").option("ignoreNamespace", True)
    if options.get("schema"):
        stated = options["schema"]
        fields = StructType([StructField(f"_a_{oid}", StringType()), *(stated if isinstance(stated, StructType) else StructType.fromDDL(stated))])
        reader = reader.schema(StructType([StructField(f"_a_{bid}", StringType()), StructField(cls, ArrayType(fields))]) if basket else fields)
    df = reader.load(path)
    if basket:
        kind = df.schema[cls].dataType.typeName()
        objects = F.col(f"`{cls}`") if kind == "array" else F.array(f"`{cls}`")
        df = df.select(F.col(f"_a_{bid}").cast("string").alias("_basket"), F.explode(objects).alias("o")).select("_basket", "o.*")
    df = df.withColumnRenamed(f"_a_{oid}", "_oid").withColumn("_oid", F.col("_oid").cast("string"))
    return df.select(*(_plain(F.col(f.name), f.dataType).alias(f.name) for f in df.schema))


def _plain(c: Column, kind: DataType) -> Column:
    item = kind.elementType if isinstance(kind, ArrayType) else kind
    if isinstance(item, StructType) and item.fieldNames()[-1].lower() == "_a_ref" and item.fieldNames()[:-1] in ([], ["_VALUE"]):
        ref = item.fieldNames()[-1]
        return F.transform(c, lambda x: x[ref]) if isinstance(kind, ArrayType) else c[ref]
    return unwrapped(c, kind)


def _content(c: Column, kind: DataType, structure: str) -> Column:
    """The inside of an element: a scalar's text; a structure's element; those of all structures of a bag."""
    if isinstance(kind, ArrayType):
        return F.array_join(F.transform(F.array_compact(c), lambda x: _content(x, kind.elementType, structure)), "")
    if isinstance(kind, StructType):
        parts = [_element(c[f.name], f.dataType, f.name, f"{structure}.{f.name}") for f in kind]
        return F.concat(F.lit(f"<{structure}>"), *parts, F.lit(f"</{structure}>"))
    return escaped(c.cast("string"))


def _element(c: Column, kind: DataType, name: str, structure: str) -> Column:
    given = c.isNotNull() if not isinstance(kind, ArrayType) else F.coalesce(F.size(c) > 0, F.lit(False))
    return F.when(given, F.concat(F.lit(f"<{name}>"), _content(c, kind, structure), F.lit(f"</{name}>"))).otherwise("")


def _role(c: Column, kind: DataType, name: str, ref: str) -> Column:
    one = lambda x: F.concat(F.lit(f'<{name} {ref}="'), escaped(x.cast("string")), F.lit('"/>'))
    found = F.array_join(F.transform(F.array_compact(c), one), "") if isinstance(kind, ArrayType) else one(c)
    return F.when(c.isNotNull(), found).otherwise("")


def object_xml(df: DataFrame, cls: str, attributes: list[str], roles: tuple[str, ...] = (), structures: dict[str, str] | None = None, marks: tuple[str, str] = ("tid", "ref")):
    """An object's element: its identifier, its attributes that aren't null as elements, roles as references.

    A structure's element is named by `structures`, or by class and attribute; `marks` are the attributes of an
    identifier and of a reference.
    """
    tid, ref = marks
    name = lambda a: (structures or {}).get(a, f"{cls}.{a}")
    parts = [
        _role(F.col(a), df.schema[a].dataType, a, ref) if a in roles else _element(F.col(a), df.schema[a].dataType, a, name(a)) for a in attributes
    ]
    return F.concat(F.lit(f'<{cls} {tid}="'), escaped(F.coalesce("_oid", F.lit(""))), F.lit('">'), *parts, F.lit(f"</{cls}>"))


def escaped(text):
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def write(df: DataFrame, path: str, options: dict) -> None:
    """Objects of option `class` below `path`: well-formed files by basket (column `_basket`), of about
    `objectsPerFile` objects each, so that a large basket has many writers.

    Objects stand in the order of identifiers; the class's attributes in that of the columns.
    Options `roles` (names) and `structures` (attribute to element) see `object_xml`.
    """
    cls, basket, most = options["class"], options.get("basketTag", "basket"), int(options.get("objectsPerFile", 1_000_000))
    attributes = [c for c in df.columns if not c.startswith("_")]
    objects = df.select(F.coalesce("_basket", F.lit("")).alias("_basket"), "_oid", object_xml(df, cls, attributes, tuple(options.get("roles", ())), options.get("structures")).alias("value"))
    parts = objects.groupBy(F.col("_basket").alias("_b")).agg(F.ceil(F.count("*") / most).alias("_parts"))
    objects = objects.join(parts, F.col("_basket") == F.col("_b"))
    objects = objects.select("_basket", F.pmod(F.xxhash64("_oid", "value"), "_parts").alias("part"), F.lit(1).alias("_rank"), "_oid", "value")
    files = objects.select("_basket", "part").distinct()
    opening = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<transfer><{basket} bid="'), escaped(F.col("_basket")), F.lit('">'))
    frame = lambda rank, value: files.select("_basket", "part", F.lit(rank).alias("_rank"), F.lit("").alias("_oid"), value.alias("value"))
    rows = objects.unionByName(frame(0, opening)).unionByName(frame(2, F.lit(f"</{basket}></transfer>")))
    # Sorted by the writer's own partition columns first, or it would sort anew and lose the order within.
    named = rows.withColumn("basket", F.concat(F.lit("b"), F.md5("_basket"))).repartition("basket", "part")
    named.sortWithinPartitions("basket", "part", "_rank", "_oid").select("basket", "part", "value").write.partitionBy("basket", "part").text(path)
