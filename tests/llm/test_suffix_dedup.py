import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm import suffix_dedup as S


def plain(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[x : x + length] for _, b in data for x in range(len(b) - length + 1))
    out = []
    for i, b in data:
        cover = bytearray(len(b))
        for x in range(len(b) - length + 1):
            if count[b[x : x + length]] > 1:
                cover[x : x + length] = b"\1" * length
        kept = bytes(v for v, c in zip(b, cover) if not c)
        runs = sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1]))
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, **settings):
    return sorted((tuple(r)[:5] for r in S.without_repeats(df, **settings).collect()), key=repr)


def test_equals_plain_version(small):
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert found(small) == plain(rows, 200)


def crossed(seed, n=60):
    """Texts put together from shared passages with small edits, so that repeats overlap and end anywhere."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randrange(20, 120))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a, z = sorted(rng.randrange(len(p)) for _ in range(2))
            p = p[a:z] if rng.random() < 0.6 else p
            if p and rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + word() + p[k + 1 :]
            parts.append(p)
        out.append((i, " ".join(parts)))
    return out


@pytest.mark.parametrize(("seed", "length", "limit"), [(1, 200, 4096), (2, 60, 4096), (3, 200, 2), (4, 70, 1)])
def test_crossed_passages_equal_plain_version(documents, seed, length, limit):
    rows = crossed(seed)
    assert found(documents(rows), length=length, bucket_limit=limit) == plain(rows, length)


def test_refinement_sorts():
    rng = np.random.default_rng(1)
    strings = rng.integers(97, 99, (500, 41)).astype(np.uint8)
    strings[100:200, :30] = strings[0, :30]
    bucket = rng.integers(0, 3, 500)
    ids = S.refine(bucket, strings)
    keys = [(int(b), bytes(s)) for b, s in zip(bucket, strings)]
    assert [keys[i] for i in np.argsort(ids, kind="stable")] == sorted(keys)
    assert all((ids[i] == ids[j]) == (keys[i] == keys[j]) for i in range(0, 500, 7) for j in range(0, 500, 11))


def test_edge_rows(documents):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300))
    rows = [(None, None), (None, "short"), (1, ""), (2, long), (2, long), (3, "a" * 199), (4, "a" * 1000), (5, "é" * 150)]
    df = documents(rows, rid="1", h="2", spans="3", bytes="4")
    assert found(df) == plain(rows, 200)
    assert S.without_repeats(df.limit(0)).count() == 0


def test_text_longer_than_a_chunk(documents):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij ") for _ in range(S.CHUNK + 5000))
    middle = text[S.CHUNK - 150 : S.CHUNK + 150]
    (a, b) = S.without_repeats(documents([(1, text), (2, f"{middle}!")])).orderBy("doc_id").collect()
    assert (a["n_removed"], a["n_spans"], b["n_removed"], b["kept"]) == (300, 1, 300, bytearray(b"!"))
