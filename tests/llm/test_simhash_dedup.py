import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import simhash_dedup as S


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, radius=2):
    """Smallest member of each node's component."""
    nodes = sorted(set(nodes))
    parent = {x: x for x in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in nodes}


def test_equals_plain_version(small):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in small.collect()]
    part = plain_components([f for _, f in rows])
    low = {}
    for i, f in rows:
        low[part[f]] = min(i, low.get(part[f], i))
    expected = {(i, format(f, "016x"), low[part[f]]) for i, f in rows}
    assert {tuple(r) for r in S.near_duplicates(small).collect()} == expected


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 64, 5, np.uint64)
    fps = np.array([int(b) ^ sum({1 << int(k) for k in rng.integers(0, 64, n)}) for b in base for n in (0, 1, 1, 2, 2, 3, 4)], np.uint64)
    bits = np.unpackbits(S.near(fps, S._planes(fps), radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    for i, a in enumerate(fps):
        for j, b in enumerate(fps):
            assert bits[i, j] == ((int(a) ^ int(b)).bit_count() <= radius)


def test_large_buckets_are_refined_without_loss(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 64, dtype=np.uint64))
    near = {base ^ sum({1 << int(k) for k in rng.integers(0, 64, 3)}) for _ in range(300)}
    nodes = near | {int(x) for x in rng.integers(0, 1 << 64, 100, np.uint64)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in nodes], "fp bigint")
    got = {r["node"] & S.FULL: r["label"] & S.FULL for r in S.components(S.near_links(df, bucket_limit=16)).collect()}
    expected = plain_components(nodes)
    groups = lambda of: {frozenset(k for k in of if of[k] == v) for v in of.values()}
    assert groups({x: got.get(x, x) for x in nodes}) == groups(expected)


def test_long_chains_become_one_component(spark):
    links = spark.range(1, 400).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r["label"] for r in S.components(links).collect()} == {0}


def test_rounds_over_few_links_write_few_files(spark, monkeypatch):
    """Each file costs a task and, on a local disk, processes that set its permissions."""
    files, was = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def stored(df, label):
        files.append((label, len((out := stored_before(df, label)).inputFiles())))
        return out

    stored_before = S.stored
    monkeypatch.setattr(S, "stored", stored)
    links = spark.range(1, 2000).select(F.col("id").alias("u"), (F.col("id") - F.col("id") % 10).alias("v"))
    try:
        for k, v in zip(was, ("64", "false")):
            spark.conf.set(k, v)
        got = {(r["node"], r["label"]) for r in S.components(links).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {(k, k - k % 10) for k in range(2000)}
    assert len(files) > 4 and max(n for _, n in files[1:]) <= spark.sparkContext.defaultParallelism


def test_edge_rows(documents):
    text = "a b c d e f g h i j k l"
    rows = [(None, text), (5, text), (5, text), (7, None), (8, ""), (9, "x"), (10, "word " * 70000), (None, "alone here with nobody else around")]
    df = documents(rows, fp="1", label="2", u="3", n_same="4", gone_id="5", twice_id="6", place="7")
    out = {(r["doc_id"], r["component_id"]) for r in S.near_duplicates(df).collect()}
    assert out == {(None, 5), (5, 5), (7, 7), (8, 7), (9, 9), (10, 10), (None, None)}
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == [5, 7, 8, 9, 10]
    assert kept.where("doc_id is null").count() == 2
    assert S.near_duplicates(df.limit(0)).count() == 0 and S.keep_one(df.limit(0)).count() == 0


def plain_groups(texts, similarity=0.8, size=5):
    """Smallest id of each group of ids whose shingle sets are alike."""
    def cut(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = sorted((k, cut(t)) for k, t in texts.items())
    label = {k: k for k, _ in sets}
    for i, (a, p) in enumerate(sets):
        for b, q in sets[i + 1 :]:
            if p and min(len(p), len(q)) >= similarity * max(len(p), len(q)) and len(p & q) >= similarity * len(p | q):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    return label


def edited(seed, groups, copies):
    """Texts in groups of copies with a few words changed, all with one passage in common."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 7))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(groups):
        base = passage + [word() for _ in range(200)]
        for _ in range(copies):
            mine = list(base)
            for _ in range(int(rng.integers(0, 5))):
                mine[int(rng.integers(0, len(mine)))] = word()
            out.append(" ".join(mine))
    return out


@pytest.mark.parametrize("limit", [1024, 4])
def test_similar_groups_equal_plain_version(documents, limit):
    texts = dict(enumerate(edited(7, 12, 6)))
    got = {r["doc_id"]: r["component_id"] for r in S.similar_groups(documents(list(texts.items())), bucket_limit=limit).collect()}
    assert got == plain_groups(texts)


def test_each_lane_asks_its_nearest_earlier_one():
    rng = np.random.default_rng(2)
    fps = np.repeat(rng.integers(0, 1 << 64, (3, S.WIDE), np.uint64), 50, axis=0)[rng.permutation(150)]
    for _ in range(12):
        fps[:, int(rng.integers(0, S.WIDE))] ^= np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
    u, v, d = S._nearest(fps, 24)
    between = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2).astype(int)
    expected = {i: between[i, :i].min() for i in range(1, 150) if between[i, :i].min() <= 24}
    assert dict(zip(u.tolist(), d.tolist())) == expected and len(expected) == 147
    assert all(b < a and between[a, b] == n for a, b, n in zip(u, v, d))


def test_wide_distances():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 64, (70, S.WIDE), np.uint64)
    fps[1::2] = fps[::2] ^ (rng.random((35, S.WIDE)) < 0.5) * (np.uint64(1) << rng.integers(0, 64, (35, S.WIDE)).astype(np.uint64))
    for radius in (3, 98, 250):
        bits = np.unpackbits(S.near(fps, S._planes(fps), radius).view(np.uint8), axis=1, bitorder="little")[:, :70]
        assert (bits == (np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= radius)).all()


def test_link_behind_many_nearer_texts_is_found(documents):
    """Texts that share 400 shingles and are 0.784 alike, each other's nearest by chance; one pair among them is 0.82 alike."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 7))
    template, texts = [word() for _ in range(404)], {}
    for pair in range(6):
        own = [word() for _ in range(10)]
        for side in range(2):
            texts[2 * pair + side] = " ".join(template + own + [word() for _ in range(45)])
    for i in range(12, 120):
        texts[i] = " ".join(template + [word() for _ in range(55)])
    expected = plain_groups(texts)
    assert sorted(k for k, v in expected.items() if k != v) == [1, 3, 5, 7, 9, 11]
    assert {r["doc_id"]: r["component_id"] for r in S.similar_groups(documents(list(texts.items()))).collect()} == expected


def test_links_in_buckets_over_the_limit_need_one_common_key_only(documents):
    """Texts about 0.35 alike by a template, so that its buckets are large, and five pairs over 0.4 with one key in common."""
    rng = np.random.default_rng(13)
    some = lambda n: ["".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(n)]
    template, texts = some(110), {}
    keys = lambda t: S.wide_fingerprint(t.encode(), 5, S.rows_of(0.4))[1]
    while len(texts) < 10:
        own = some(15)
        one, other = (" ".join(template + own + some(83)) for _ in range(2))
        if (keys(one) == keys(other)).sum() == 1:
            texts |= {len(texts): one, len(texts) + 1: other}
    for i in range(10, 60):
        texts[i] = " ".join(template + some(98))
    expected = plain_groups(texts, similarity=0.4)
    assert sum(k != v for k, v in expected.items()) == 5
    got = {r["doc_id"]: r["component_id"] for r in S.similar_groups(documents(list(texts.items())), similarity=0.4, bucket_limit=4).collect()}
    assert got == expected


def test_one_component_and_many_others_in_one_bucket(documents):
    """A large group of near copies and texts that share its template: blocks of the group, and of the others, over a small limit."""
    rng = np.random.default_rng(17)
    some = lambda n: ["".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(n)]
    template, own = some(200), some(25)
    texts = {i: " ".join(template + own + some(1)) for i in range(60)}
    texts |= {60 + i: " ".join(template + some(70)) for i in range(40)}
    expected = plain_groups(texts)
    assert len(set(expected.values())) == 41
    for limit in (8, 1024):
        assert {r["doc_id"]: r["component_id"] for r in S.similar_groups(documents(list(texts.items())), bucket_limit=limit).collect()} == expected


def test_rows_of_a_key_follow_the_similarity():
    assert [S.rows_of(x) for x in (0.9, 0.8, 0.6, 0.4)] == [3, 3, 1, 1] and (1 - 0.8**3) ** S.KEYS < 5e-6


def test_rows_that_repeat_an_id_are_told_apart_by_their_text(documents):
    one = " ".join(f"one{k}" for k in range(40))
    other = " ".join(f"other{k}" for k in range(40))
    rows = [(1, one), (2, f"{one} end"), (2, other), (3, f"{other} end"), (2, other), (2, None), (2, "")]
    kept = S.keep_one(documents(rows)).collect()
    texts = [r["text"] for r in kept if r["text"]]
    assert len(texts) == 2 and {t.split()[0] for t in texts} == {"one0", "other0"}
    assert [r["doc_id"] for r in kept if not r["text"]] == [2]
