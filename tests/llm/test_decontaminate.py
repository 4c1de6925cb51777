import hashlib
import random
import re

from oracle import assert_same

from weftline.llm import decontaminate as D
from weftline.llm.queries import ORACLE_SQL, QUERIES

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, items):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    words = WORDS.findall((text or "").translate(low))
    hit, found = set(), set()
    for k, item in items:
        w = WORDS.findall((item or "").translate(low))
        size = min(10, len(w))
        grams = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)} if size else set()
        for a in range(len(words) - size + 1):
            if size and tuple(words[a : a + size]) in grams:
                found.add(k)
                hit.update(range(a, a + size))
    ids = ",".join(sorted(str(k) for k in found if k is not None))
    return len(words), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_equals_sql(spark, sf_dir):
    name = "op3_decontamination"
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_random_texts_equal_plain_version(spark, documents):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, text(rng.choice([2, 5, 9, 10, 12, 25]))) for k in range(12)]
    rows = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    for blocks in (200_000, 40):  # one automaton, and several passes
        got = {r["doc_id"]: tuple(r)[1:] for r in D.contamination(documents(rows), bench(spark, items), block_words=blocks).collect()}
        assert got == {i: plain(t, items) for i, t in rows}


def test_edge_rows(spark, documents):
    passage = "One two THREE four five six-seven eight nine ten été"
    items = [(1, passage), (1, passage), (None, "null id item"), (3, None), (4, "?!"), (5, "tiny one")]
    rows = [(None, None), (1, ""), (2, f"so {passage}, end"), (2, f"so {passage}, end"), (3, "a tiny, one"), (4, "null id item"), (5, "x " * 100_000 + passage)]
    df = documents(rows, c_words="1", item_id="2", c_spans="3")
    got = [tuple(r) for r in D.contamination(df, bench(spark, items)).collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain(t, items)) for i, t in rows), key=repr)
    assert D.contamination(df.limit(0), bench(spark, items)).count() == 0
    assert not any(r["contaminated"] for r in D.contamination(df, bench(spark, [])).collect())


def test_long_items_are_cut_into_blocks(spark, documents):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(1, text(100)), (2, text(30))]
    rows = [(i, text(80)) for i in range(40)]
    rows += [(100, items[0][1]), (101, items[0][1][20:70])]
    got = {r["doc_id"]: tuple(r)[1:] for r in D.contamination(documents(rows), bench(spark, items), block_words=20).collect()}
    assert got == {i: plain(t, items) for i, t in rows}


def test_spans_are_cut(spark, documents):
    passage = "One two THREE four five six-seven eight nine ten été"
    rest = "and much more text that is not in any of the items at all so that the document stays"
    df = documents([(1, f"Before it, {passage}! After it {rest}."), (2, rest), (3, passage), (4, None)], c_text="1", c_row="2", c_had="3")
    text = f"Before it, ! After it {rest}."
    for blocks in (200_000, 10):
        done = D.remove_contamination(df, bench(spark, [(1, passage), (2, "other words of another item that nobody uses")]), block_words=blocks)
        assert done.columns == df.columns
        assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in done.collect()} == {1: (text, len(text)), 2: (rest, len(rest)), 4: (None, None)}


def test_equal_items_are_one_block(spark, documents):
    words = " ".join(f"w{k}" for k in range(100))
    same, ids = bench(spark, [(7, words)] * 400), bench(spark, [(k, words) for k in range(400)] + [(500, "x y z " * 40)])
    blocks, items = D.item_blocks(same, "item_id", "text", 10, 1000)
    assert len(blocks) == 1 and D.block_items(items, blocks[0]) == [(["7"], words.encode())]
    blocks, items = D.item_blocks(ids, "item_id", "text", 10, 300)
    parts = [D.block_items(items, b) for b in blocks]
    assert len(blocks) in (2, 3) and all(len(t) + len(i) <= 400 + 1 for p in parts for i, t in [(i, t.split()) for i, t in p])
    rows = [(1, f"so {words}"), (2, "none")]
    got = {r["doc_id"]: tuple(r)[1:] for r in D.contamination(documents(rows), ids, block_words=300).collect()}
    assert got == {i: plain(t, [(k, words) for k in range(400)]) for i, t in rows} and got[1][2] == 400
