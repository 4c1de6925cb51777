import pytest
from pyspark.sql import functions as F

from weftline.operators.rules import Catalog, Join, Rule, Source
from weftline.streaming.rules import stream_targets, write_targets


def test_stream_joins_static_class_and_drops_duplicates(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.limit(200).unionByName(events.limit(200)).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    users = spark.range(10_000).select(F.col("id").alias("user_id"), F.concat(F.lit("u"), "id").alias("name"))
    c = Catalog().add(stream, input_id="s", cls="Event", oid="event_id").add(users, input_id="u", cls="User", oid="user_id")
    rule = Rule(
        "r", "out", "Seen", (Source("e", "Event"), Source("u", "User")), {"ts": "cast(e.ts as timestamp)", "who": "u.name", "event_id": "e.event_id"},
        joins=(Join("u", (("e.user_id", "u.user_id"),)),), identity=("e.event_id",),
    )
    targets = stream_targets(rule, c, event_time="ts", watermark="1000 days")
    write_targets(targets, f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == events.limit(200).count() and got.select("event_id").distinct().count() == got.count()
    assert got.where(F.col("_class") != "Seen").isEmpty()


def test_static_rules_are_refused(spark, sf_dir):
    c = Catalog().add(spark.read.parquet(f"{sf_dir}/nation.parquet"), input_id="n", cls="Nation", oid="n_nationkey")
    with pytest.raises(ValueError, match="no streaming source"):
        stream_targets(Rule("r", "o", "T", (Source("n", "Nation"),), {}), c)
