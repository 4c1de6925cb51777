import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from weftline.llm import ranked_search
from weftline.llm.queries import ORACLE_SQL, QUERIES
from weftline.llm.ranked_search import Ranker, rank_documents, term_counts

ITEMS = "item_id bigint, text string"


def plain(docs, items, k):
    """Every document scored for every item, by the stated formula; rows of (item_id, rank, doc_id, score)."""
    split = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    counts = [(i, len(w), Counter(w)) for i, t in docs if (w := split(t))]
    n_docs, n_terms = len(counts), sum(n for _, n, _ in counts)
    df = Counter(t for *_, c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, n, c in counts:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(split(text)) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        best = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item_id, r, doc_id, -score) for r, (score, _, doc_id) in enumerate(best, 1)]
    return sorted(out, key=repr)


def found(docs, items, **settings):
    return sorted(map(tuple, rank_documents(docs, items, **settings).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_equals_sql(spark, sf_dir):
    assert_same(QUERIES["op11_ranked_search"](spark, sf_dir), ORACLE_SQL["op11_ranked_search"], sf_dir)


@pytest.mark.parametrize("seed", range(3))
def test_equals_scoring_every_document(spark, documents, seed):
    rng = random.Random(seed)
    words = [f"W{i}" if i % 7 else f"é{i}" for i in range(80)]
    text = lambda n: " ".join(words[min(79, int(rng.expovariate(0.08)))] for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(300)] + [(i, "w70 W71-w70") for i in range(300, 330)]
    items = [(i, text(rng.choice([1, 3, 12]))) for i in range(20)] + [(7, text(4)), (99, "unheard of")]
    expected = plain(docs, items, 5)
    df, asked = documents(docs), spark.createDataFrame(items, ITEMS)
    assert found(df, asked, k=5) == expected
    assert found(df, asked, k=5, block_terms=15) == expected  # several blocks of items


def test_edge_rows(spark, documents):
    docs = [(None, None), (None, "tie word"), (None, "tie word"), (4, ""), (5, "--- !"), (3, "tie word"), (2, "TIE word"), (2, "tie word"), (8, "long " * 300_000 + "tail")]
    items = [(1, "Tie"), (1, "tie"), (None, "tail"), (2, None), (3, ""), (4, ";")]
    df = documents(docs, item_id="1", rank="2", terms="3")
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "5 as doc_id", "6 as score")
    assert found(df, asked) == plain(docs, items, 50)
    ties = [r[2] for r in sorted((r for r in found(df, asked, k=4) if r[0] == 1), key=lambda r: r[1])]
    assert ties == [2, 2, 2, 2, 3, 3, None, None]
    assert found(df.limit(0), asked) == [] and found(df, asked.limit(0)) == []
    assert rank_documents(df, asked.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_texts_go_piece_by_piece(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE", 7)
    n, terms, counts = term_counts("Ab cd, ab; x" .encode() * 20, {b"ab": 0, b"x": 1, b"xab": 2})
    assert n == 61 and dict(zip(terms.tolist(), counts.tolist())) == {0: 21, 1: 1, 2: 19}


def test_threshold_leaves_candidates_out():
    rng = np.random.default_rng(5)
    n = 4000
    often, rare = np.arange(n), np.sort(rng.choice(n, 200, replace=False))
    term = np.r_[np.zeros(n, np.int64), np.ones(200, np.int64)]
    impact = np.r_[rng.integers(1, 10, n), rng.integers(100, 200, 200)]
    kth, most = np.array([np.sort(impact[:n])[-50], np.sort(impact[n:])[-50]]), np.array([impact[:n].max(), impact[n:].max()])
    ranker = Ranker([np.array([0, 1])], np.ones(2), kth, most, 50)
    ranker.add(np.arange(n), np.zeros(n, bool), (term, np.r_[often, rare], impact))
    total = np.bincount(np.r_[often, rare], impact, n)
    assert ranker.scored <= 70 and (ranker.best[0][2] == np.sort(total)[::-1][:50]).all()


def test_blocks_follow_a_running_sum(spark):
    from weftline.llm._shared import in_blocks

    rows = spark.range(100).repartition(3).withColumn("n", F.lit(7))
    blocks, df = in_blocks(rows, F.col("n"), 70, "test")
    assert blocks == list(range(10)) and {r["count"] for r in df.groupBy("block").count().collect()} == {10}


def test_broadcasts_are_bounded_by_bytes(spark):
    from weftline.llm._shared import sized

    plan = lambda df, most: spark.range(9).join(sized(df, most), "id")._jdf.queryExecution().optimizedPlan().toString()
    numbers, texts = spark.range(100), spark.range(100).withColumn("t", F.lit("x"))
    assert "strategy=broadcast" in plan(numbers, 4800) and "strategy=merge" in plan(numbers, 4799) and "strategy=merge" in plan(texts, 1 << 20)
    wide = numbers.withColumn("s", F.struct("id", F.col("id").alias("b")))
    assert "strategy=broadcast" in plan(wide, 100 * (32 + 24 + 48)) and "strategy=merge" in plan(wide, 100 * (32 + 24 + 32) - 1)
