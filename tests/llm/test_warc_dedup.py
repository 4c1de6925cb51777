import base64
import gzip
import hashlib
from pathlib import Path

from oracle import assert_same
from pyspark.sql import functions as F

from weftline.llm import warc_dedup as W
from weftline.llm.queries import ORACLE_SQL, QUERIES


def test_equals_sql(spark, sf_dir):
    name = "op10_warc_dedup"
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_revisits(spark, tmp_path):
    rows = [(3, "http://a/ b\nc", "same é"), (1, None, "same é"), (2, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\n"), (None, "u", "same é")]
    df = pages(spark, rows).selectExpr("*", "1 as payload", "2 as record_type")
    out = {r["page_id"]: r for r in W.archive_pages(df, f"file://{tmp_path}/w").collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in out.items()} == {
        1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("revisit", 2), 5: ("response", None), None: ("response", None)
    }
    assert out[3]["payload_bytes"] == 7 and out[4]["payload_bytes"] == 0
    assert out[3]["payload_digest"] == base64.b32encode(hashlib.sha1("same é".encode()).digest()).decode()
    assert {r["record_type"] for r in W.archive_pages(df, f"file://{tmp_path}/w100", min_bytes=100).collect()} == {"response"}
    assert W.archive_pages(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_files_are_warc(spark, tmp_path):
    W.archive_pages(pages(spark, [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>")]).coalesce(1), f"file://{tmp_path}/w")
    records = [r for p in Path(tmp_path, "w").glob("*.gz") for r in W.parse_archive(gzip.open(p))]
    assert {h["WARC-Type"]: b for h, b in records}["revisit"] == b""
    (response,) = (b for h, b in records if h["WARC-Type"] == "response")
    assert response.endswith(b"\r\n\r\n<p>x</p>")
    assert {h.get("WARC-Refers-To") for h, _ in records} == {None, "<urn:x-page:1>"}


def test_archives_with_revisits_are_rewritten(spark, tmp_path):
    first, second, target = (f"file://{tmp_path}/{x}" for x in "abc")
    W.write_archives(W.resolved_pages(pages(spark, [(5, "u", "one"), (7, "u", "one"), (8, "u", "two")])), f"{first}/1")
    # A later crawl has the original of 5 under a smaller id, and a revisit whose original is elsewhere.
    late = W.page_records(pages(spark, [(2, "u", "one")]))
    lost = W.page_records(pages(spark, [(9, "u", "gone")])).withColumns({"record_type": F.lit("revisit"), "refers_to": F.lit(77).cast("bigint"), "payload": F.lit(None).cast("string")})
    W.write_archives(late.unionByName(lost), f"{first}/2")
    out = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in W.deduplicated(spark, f"{first}/*", target).collect()}
    assert out == {2: ("response", None), 5: ("revisit", 2), 7: ("revisit", 2), 8: ("response", None), 9: ("revisit", 77)}
    assert second
