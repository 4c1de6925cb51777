"""URL filter: stated host and path rules, and association rules mined by FP-growth.

1. A URL's tokens are the words of its scheme, host, path and rest, each marked with the part it stands in.
2. Labelled URLs are transactions of their tokens, and of a mark where they are bad. Tokens that stand in the same
   transactions are one item (`_items`): FP-growth would otherwise find each of their combinations.
3. FP-growth finds the frequent sets of items; those with the mark, held against the same sets without it, give rules
   "these items: bad" with support and confidence. Rules that a shorter one implies are left out.
4. An inverted index has each rule at its rarest item. A URL's items are looked up there, and a rule that is found must
   lie within the URL's items. Rules come in blocks of a bounded size, each one pass over the URLs without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._shared import in_blocks, released, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEFORE = r"(?s)^.*?://"  # what stands before the host
WORD = r"[a-z\x{80}-\x{10FFFF}]+"
BAD = "bad"  # the mark; a token has a colon


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str


# The stated rules of the registered query.
RULES = [
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null and without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, BEFORE + "([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, BEFORE + "[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, by host and path together, then by host; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """Different words (letters, A-Z in lower case) of scheme `s:`, host `h:`, path `p:` and rest `q:`; null and a URL without `://` have none."""
    low = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    parts = {"s": r"(?s)^(.*?)://", "h": BEFORE + "([^/?#]*)", "p": BEFORE + "[^/?#]*([^?#]*)", "q": BEFORE + "[^?#]*(.*)"}

    def words(kind: str, part: str) -> Column:
        found = F.regexp_extract_all(F.regexp_extract(low, part, 1), F.lit(WORD), F.lit(0))
        return F.transform(found, lambda w: F.concat(F.lit(f"{kind}:"), w))

    return F.array_distinct(F.concat(*(words(k, e) for k, e in parts.items())))


def _items(tokens: DataFrame, least: int) -> DataFrame:
    """(token, item): of tokens in `least` rows or more, the smallest token that stands in the same rows.

    Rows are told by two hashes over all of a token's rows. At most (tokens a row) * rows / least come out.
    """
    rows = [F.bit_xor(F.xxhash64("row", F.lit(k))) for k in (0, 1)]
    of = tokens.groupBy("token").agg(F.count("*").alias("n"), *(r.alias(f"x{k}") for k, r in enumerate(rows))).where(F.col("n") >= least)
    of = stored(of, "url-tokens")
    return of.join(of.groupBy("n", "x0", "x1").agg(F.min("token").alias("item")), ["n", "x0", "x1"]).select("token", "item", "n")


def mine_rules(labelled: DataFrame, *, min_support: float = 0.002, min_rows: int = 5, min_confidence: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(token, item, n) and (items, bad, rows, confidence) of `labelled` (tokens, bad).

    A rule rests on `min_support` of all labelled rows and on `min_rows` of them at least that hold its items and are
    bad, and on `min_confidence` of those that hold its items. Rows without tokens count among all rows; a null `bad`
    leaves a row out. Without enough rows there is no rule.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.where("bad is not null").select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "url-labelled")
    n = rows.count()
    least = max(min_rows, math.ceil(min_support * n))
    tokens = rows.select("row", F.explode("tokens").alias("token"))
    items = stored(_items(tokens, least), "url-items")
    of_row = tokens.join(items, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    bad = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    transactions = stored(of_row.join(rows.select("row", bad.alias("mark")), "row").select(F.concat("items", "mark").alias("items")), "url-transactions")
    if n < least or transactions.isEmpty():
        return items, spark.createDataFrame([], "items array<string>, bad bigint, rows bigint, confidence double")
    # FP-growth takes the least number of rows as a share of the transactions, rounded up.
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / transactions.count())).fit(transactions)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    marked = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("bad"))
    rules = marked.join(sets.withColumnRenamed("freq", "rows"), "items").withColumn("confidence", F.col("bad") / F.col("rows"))
    return items, stored(rules.where(F.col("confidence") >= min_confidence), "url-rules")


class RuleIndex:
    """Rules by their rarest item."""

    def __init__(self, items: dict[str, str], counts: dict[str, int], rules: list[list[str]]):
        self.items = items
        self.at: dict[str, list[frozenset[str]]] = {}
        for rule in sorted(map(frozenset, rules), key=lambda r: (len(r), sorted(r))):
            if not self._implied(rule):
                self.at.setdefault(min(rule, key=lambda i: (counts[i], i)), []).append(rule)

    def _implied(self, held: frozenset[str] | set[str]) -> bool:
        return any(rule <= held for i in held for rule in self.at.get(i, ()))

    def match(self, tokens: list[str]) -> bool:
        return self._implied({self.items[t] for t in tokens if t in self.items})


def judged(urls: DataFrame, items: DataFrame, rules: DataFrame, tokens: str, name: str, *, block_items: int = 500_000) -> DataFrame:
    """`urls` with a boolean column `name`: whether a rule's items lie within those of the tokens in column `tokens`."""
    blocks, rules = in_blocks(rules, F.size("items"), block_items, "url-rule-blocks")
    found = items.collect() if blocks else []  # bounded by the support, see _items
    of, counts = {r["token"]: r["item"] for r in found}, {r["item"]: r["n"] for r in found}
    urls = urls.withColumn(name, F.lit(False))
    where = len(urls.columns) - 1
    for block in blocks:
        sent = urls.sparkSession.sparkContext.broadcast([r["items"] for r in rules.where(F.col("block") == block).orderBy("row").collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = RuleIndex(of, counts, sent.value)
            for b in batches:
                hit = [index.match(t or []) for t in b.column(b.schema.get_field_index(tokens)).to_pylist()]
                yield b.set_column(where, b.schema.field(where), pc.or_(b.column(where), pa.array(hit, pa.bool_())))

        urls = urls.mapInArrow(released(run), urls.schema)
    return urls


def filter_urls(pages: DataFrame, labels: DataFrame, *, rules: list[UrlRule] = RULES, **settings) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of `pages` (page_id, url).

    The longest stated rule that fits decides; else the mined ones: block if one matches, otherwise allow. They are
    mined from all pages that `labels` (doc_id, quality, toxic) names by its doc_id; of quality 0 or toxic is bad, and
    of several labels a bad one counts. Labels of an unknown page, of null ids, and with both values null do nothing.
    A null or empty URL, and one without `://`, has an empty host and path, no token, and is allowed. Null ids and
    repeated rows are judged like others; pages that repeat an id are each labelled by it. Without labels there is no
    mined rule; an empty table gives an empty one. Other columns are not read.
    """
    is_bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    told = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(is_bad).alias("bad"))
    pages = pages.select("page_id", "url")
    labelled = pages.join(told, pages["page_id"] == told["doc_id"]).select(tokens_of(F.col("url")).alias("tokens"), "bad")
    items, mined = mine_rules(labelled, **settings)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), tokens_of(F.col("url")).alias("tokens"))
    rows = rows.withColumns({"rule": name, "verdict": verdict})
    rows = rows.withColumn("tokens", F.when(F.col("verdict").isNull(), F.col("tokens")))  # ruled URLs need none
    rows = judged(rows, items, mined, "tokens", "hit")
    method = F.when(F.col("hit"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"))
