import math
import random

import numpy as np
import pytest
from oracle import assert_same

from weftline.llm.norm_search import Best, Negatives, Positives, Rows, hard_negatives, products
from weftline.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, every, k, low=80):
    """All pairs, by the stated rules."""
    v = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for a, la, x in v:
        if a is None or a % every:
            continue
        scored = [(max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(x, y)))), i, lb == la) for i, lb, y in v if i != a]
        for p, pid, _ in sorted((s for s in scored if s[2]), key=order)[:k]:
            fit = sorted((s for s in scored if not s[2] and low * p <= 100 * s[0] <= 100 * p), key=order)[:k]
            out += [(a, pid, r, n, p, s) for r, (s, n, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def found(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as norm", "2 as row", "3 as place").repartition(3)
    names = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    return sorted(map(tuple, hard_negatives(df, **settings).select(names).collect()), key=repr)


def test_query_equals_sql(spark, sf_dir):
    assert_same(QUERIES["op12_hard_negatives"](spark, sf_dir), ORACLE_SQL["op12_hard_negatives"], sf_dir)


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = [(i, [c * scale + rng.gauss(0, 0.3) for c in centre[i % 3]], rng.randrange(3)) for i in range(300) for scale in [rng.choice([0.1, 1, 3])]]
    rows += [(i, rows[8][1], 1) for i in range(300, 360)]  # one vector many times: ties by id
    expected = plain(rows, 10, 5)
    assert expected and found(spark, rows, every=10) == expected
    assert found(spark, rows, every=10, block_values=40) == expected  # several blocks of anchors


def test_edge_rows(spark):
    good = [0.5, 0.25]
    rows = [(0, good, 1), (0, good, 1), (None, good, 1), (None, good, 2), (1, good, 1), (2, good, 2), (7, good, 1), (3, None, 1), (4, good, None), (5, [None, 1.0], 1),
            (6, [math.nan, 1.0], 1), (8, [math.inf, 1.0], 2), (9, [], 2), (11, [1.0], 2), (12, [0.25, 0.5, 9.0], 2), (100, [3e38, 1e30], 1), (13, [3e38, 1e30], 3), (15, [3e38], 1)]
    out = found(spark, rows)
    assert out == plain(rows, 100, 5) and {r[4] for r in out if r[0] == 100} == {2**63 - 1}
    assert found(spark, []) == [] and found(spark, [(5, good, 1)]) == []


def rows_of(ids, vectors, labels):
    rows = Rows.__new__(Rows)
    rows.ids, rows.null, rows.label = np.array(ids), np.zeros(len(ids), bool), np.array(labels)
    rows.vectors = np.array(vectors, float)
    rows.norm = np.sqrt((rows.vectors**2).sum(axis=1))
    return rows


def test_buckets_are_passed_over():
    anchors = rows_of([0], [[100, 0]], [1])
    high = rows_of(range(1, 9), [[50 + i, 0] for i in range(8)], [1] * 4 + [2] * 4)
    low = rows_of(range(9, 17), [[9 - i, 1] for i in range(8)], [1] * 4 + [2] * 4)
    search = Positives(anchors, None, 3)
    search.add(high)
    search.add(low)
    assert search.passed == 1 and search.best[0].score.tolist() == [5300, 5200, 5100]
    mined = Negatives(anchors, [[6000]], 80, 3)
    mined.add(low)  # the window's lower limit is 4800
    assert mined.passed == 1
    mined.add(high)
    assert mined.windows[0][0][2].score.tolist() == [5700, 5600, 5500]


def test_products_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 5.0], [-(2.0**40), 1.0]])
    assert products(a, b).tolist() == [[2**60 + 15, -(2**63)]]
    assert products(a[:, :1], b[:, :0]).tolist() == [[0, 0]]


def test_ties_stand_by_id():
    best = Best(2)
    best.add(np.array([5, 3, 0]), np.array([False, False, True]), np.array([7, 7, 7]))
    assert best.ids.tolist() == [3, 5] and best.kth == 7
