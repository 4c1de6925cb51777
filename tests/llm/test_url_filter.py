import itertools
import random
import re
from collections import Counter

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from weftline.llm.queries import ORACLE_SQL, QUERIES
from weftline.llm.url_filter import RuleIndex, UrlRule, filter_urls, host_of, mine_rules, path_of, rule_of, tokens_of

PAGES, LABELS = "page_id bigint, url string", "doc_id bigint, quality int, toxic int"


def plain_rules(transactions, least, confidence):
    """Every set of tokens, counted one by one; those that are bad often and surely enough."""
    sets, bad = Counter(), Counter()
    for tokens, is_bad in transactions:
        for n in range(1, len(tokens) + 1):
            for s in itertools.combinations(sorted(tokens), n):
                sets[s] += 1
                bad[s] += is_bad
    return [set(s) for s, n in bad.items() if n >= least and n / sets[s] >= confidence]


def test_query_equals_sql(spark, sf_dir):
    assert_same(QUERIES["op13_url_filter"](spark, sf_dir), ORACLE_SQL["op13_url_filter"], sf_dir)


@pytest.mark.parametrize("seed", range(2))
def test_mined_rules_judge_like_all_sets(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        tokens = sorted(rng.sample("abcdefgh", rng.randrange(1, 6)))
        tokens += ["x", "y", "z"] if "a" in tokens else []  # always together
        rows.append((tokens, rng.random() < (0.8 if {"a", "b"} <= set(tokens) else 0.2)))
    items, rules = mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_rows=8, min_support=0, min_confidence=0.6)
    of, counts = {r["token"]: r["item"] for r in items.collect()}, {r["item"]: r["n"] for r in items.collect()}
    assert of["x"] == of["y"] == of["z"]
    index = RuleIndex(of, counts, [r["items"] for r in rules.collect()])
    expected = plain_rules(rows, 8, 0.6)
    assert expected
    for n in range(0, 5):
        for tokens in itertools.combinations("abcdefghxyz", n):
            assert index.match(list(tokens)) == any(r <= set(tokens) for r in expected), tokens


def test_hosts_paths_and_rules(spark):
    rules = [UrlRule("com", "/", "allow"), UrlRule("a.com", "/x/", "block"), UrlRule("w.a.com", "/x/", "allow"), UrlRule("net", "/y/", "block")]
    told = {
        "http://A.com/x/1": ("a.com", "/x/1", "a.com/x/", "block"),
        "http://w.a.COM/x/?q#f": ("w.a.com", "/x/", "w.a.com/x/", "allow"),
        "http://v.w.a.com/x/": ("v.w.a.com", "/x/", "w.a.com/x/", "allow"),
        "http://ba.com/x/": ("ba.com", "/x/", "com/", "allow"),
        "http://a.com/X/": ("a.com", "/X/", "com/", "allow"),
        "http://com?q=/x/": ("com", "", None, None),
        "s://b.net/y": ("b.net", "/y", None, None),
        "a://b://net/y/": ("b:", "//net/y/", None, None),
        "net/y/": ("", "", None, None),
        "://net/y/\nz": ("net", "/y/\nz", "net/y/", "block"),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(u,) for u in told], "url string").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    assert {r["url"]: tuple(r)[1:] for r in df.select("*", name, verdict).collect()} == told


def test_tokens(spark):
    df = spark.createDataFrame([("HTTPS://www.Éa-1b.com/en/éx_12.html?utm=3&x#top",), ("no url",), (None,)], "url string")
    found = [r[0] for r in df.select(tokens_of(F.col("url"))).collect()]
    assert found == [["s:https", "h:www", "h:Éa", "h:b", "h:com", "p:en", "p:éx", "p:html", "q:utm", "q:x", "q:top"], [], []]


def test_edge_rows(spark):
    pages = [(i, f"http://bad.org/{'spam' if i % 2 else 'ham'}/{i}") for i in range(40)] + [(3, "http://good.org/spam/"), (3, "http://good.org/spam/")]
    pages += [(None, "http://bad.org/spam/"), (None, None), (50, None), (51, ""), (52, "http://x.net/fr/" + "w/" * 50_000), (53, "http://" + " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)))]
    labels = [(i, 0 if i % 2 else 1, None) for i in range(0, 20)] + [(None, 0, 1), (1, 1, 0), (2, None, None), (99, 0, 0), (53, 1, 1)] + [(53, 0, 0)] * 9
    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "1 as host", "2 as tokens", "3 as hit", "4 as rule", "5 as verdict")
    told = spark.createDataFrame(labels, LABELS).selectExpr("*", "6 as page_id", "7 as url")
    out = filter_urls(df, told).collect()
    assert len(out) == len(pages)
    judged = lambda r: "block" if r["host"].endswith(".org") and "spam" in re.findall("[a-z]+", r["path"]) or r["rule"] == "net/fr/" else "allow"
    assert [r for r in out if r["verdict"] != judged(r)] == []
    assert filter_urls(df.limit(0), told).count() == 0
    assert {r["verdict"] for r in filter_urls(df.where("page_id < 40"), told.limit(0)).collect()} == {"allow"}
