import zlib
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import packing as P
from weftline.llm.queries import tokenizer_file


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "", " ", "\n\n", "Don't they'll i'm x's", "ÉCOLE été. Straße, ǅ İstanbul ΣΑΣ σς", "a.b,c ##word** (x) 12a3 ½ ² 中文字 한국어", "é ö. ́", "<|endoftext|> a<|startoftext|>b",
    "tab\there nbsp em\x1c\x85", "KK Ω ﬁ ﬂ", "hello,. hello., hello!! Hello HELLO hello-", "🙂🙂 a🙂.", "'s 's' it's.",
]


def test_word_tokens_equal_the_tokenizer(small):
    texts = ODD + [r["text"] for r in small.collect()]
    words = P.WordTokens(tokenizer_file(), keep=500)
    got = [ids for k in range(0, len(texts), 7) for ids in words.ids(texts[k : k + 7])]
    assert got == direct(texts)


def check(rows, ids, most=2048, segments=256):
    """Pieces partition each document, sequences are gapless, padding is nought."""
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(by) == set(ids)
    for k, data in ids.items():
        at = 0
        for r in sorted(by[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(data) // 4
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(data[4 * r["start"] : 4 * at])
        assert at == len(data) // 4
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= most and not at & (at - 1) and len(pieces) <= segments


def test_pack_documents(small):
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    ids = {k: d + b"\1\0\0\0" for k, d in zip(texts, direct(list(texts.values())))}
    check(P.pack_documents(small, tokenizer_file()).collect(), ids)


def test_edge_rows(documents):
    rows = [(1, None), (2, ""), (3, "word " * 9000)]
    df = documents(rows, start="1", offset="2", sequence_id="3")
    ids = {k: d + b"\1\0\0\0" for (k, _), d in zip(rows, direct([t or "" for _, t in rows]))}
    check(P.pack_documents(df, tokenizer_file()).collect(), ids)
    twice = P.pack_documents(documents([(None, "a b"), (None, "a b")]), tokenizer_file()).collect()
    assert sum(r["length"] for r in twice) == 6
    assert P.pack_documents(df.limit(0), tokenizer_file()).count() == 0


@pytest.mark.parametrize("cut", [True, False])
def test_limits_hold_and_bins_are_well_filled(cut):
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 900, 3000)
    loss = (tokens * rng.random(3000)).astype(int)
    p = P.Packer(2048, 8, 700, cut, 256)
    for i, (n, k) in enumerate(zip(tokens.tolist(), loss.tolist())):
        p.add(i, n, k)
    p.finish()
    use = defaultdict(lambda: [0, 0, 0])
    placed = defaultdict(int)
    for key, start, length, sequence, offset in p.done:
        context = tokens[key] - loss[key]
        assert use[sequence][0] == offset
        for d, x in enumerate((length, 1, max(0, start + length - max(start, context)))):
            use[sequence][d] += x
        placed[key] += length
    assert placed == dict(enumerate(tokens.tolist()))
    assert all(a <= 2048 and b <= 8 and c <= 700 for a, b, c in use.values())
    least = max(tokens.sum() / 2048, 3000 / 8, loss.sum() / 700)
    if not cut:
        assert len(p.done) == 3000 + sum(max(0, -(-int(k) // 700) - 1) for k in loss) and len(use) < 1.25 * least


def test_pack_examples(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    examples = turns.groupBy("conv_id").agg({"text": "count"}).selectExpr("conv_id", "conv_id * 13 % 1500 as tokens", "conv_id * 13 % 1500 - 100 as loss")
    rows = P.pack_examples(examples, id_col="conv_id", tokens_col="tokens", loss_col="loss").collect()
    assert sum(r["length"] for r in rows) == sum(r["tokens"] for r in examples.collect())
    assert P.pack_examples(examples.limit(0), id_col="conv_id", tokens_col="tokens", loss_col="loss").count() == 0


def plain_pack(items, limits, window):
    """Bins by the dot-product rule, item by item in plain loops: (key, sequence) of whole items."""
    waiting, out, sequence, left = [], [], 0, list(limits)

    def place(until):
        nonlocal sequence, left
        while len(waiting) > until:
            fits = [x for x in waiting if all(d <= room for d, room in zip(x[1], left))]
            if not fits:
                sequence, left = sequence + 1, list(limits)
                continue
            score = lambda x: sum(d / most * room / most for d, room, most in zip(x[1], left, limits))
            best = max(map(score, fits))
            chosen = next(x for x in fits if abs(score(x) - best) < 1e-12)
            waiting.remove(chosen)
            out.append((chosen[0], sequence))
            left = [room - d for d, room in zip(chosen[1], left)]
            if left[0] < 1:
                sequence, left = sequence + 1, list(limits)

    for key, tokens, loss in items:
        if len(waiting) == window:
            place(window // 2)
        waiting.append((key, (tokens, 1, loss)))
    place(0)
    return out


@pytest.mark.parametrize(("seed", "limits"), [(1, (2048, 8, 700)), (2, (1000, 3, 1000)), (3, (500, 50, 120))])
def test_placement_equals_the_plain_rule(seed, limits):
    rng = np.random.default_rng(seed)
    items = [(i, n, int(n * rng.random() * min(1, limits[2] / n))) for i, n in enumerate(rng.integers(1, limits[0] // 2, 300).tolist())]
    p = P.Packer(*limits, cut=False, window=64)
    for key, tokens, loss in items:
        p.add(key, tokens, loss)
    p.finish()
    bins = lambda rows: sorted(sorted(k for k, s in rows if s == b) for b in {s for _, s in rows})
    assert bins([(key, sequence) for key, _, _, sequence, _ in p.done]) == bins(plain_pack(items, limits, 64))


def test_conversations_keep_all_three_limits(spark, sf_dir):
    """Instruction data: the assistant's words bear loss, the others are context."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    words = "size(split(text, ' '))"
    examples = turns.groupBy("conv_id").agg({"turn": "count"}).drop("count(turn)").join(
        turns.selectExpr("conv_id", f"{words} as n", f"if(role = 'assistant', {words}, 0) as l").groupBy("conv_id").sum("n", "l").withColumnsRenamed({"sum(n)": "tokens", "sum(l)": "loss"}),
        "conv_id",
    )
    rows = P.pack_examples(examples, id_col="conv_id", tokens_col="tokens", loss_col="loss", max_tokens=400, max_segments=3, max_loss=200, cut=True).collect()
    of = {r["conv_id"]: (r["tokens"], r["loss"]) for r in examples.collect()}
    use = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        tokens, loss = of[r["id"]]
        for d, x in enumerate((r["length"], 1, max(0, r["start"] + r["length"] - max(r["start"], tokens - loss)))):
            use[r["sequence_id"]][d] += x
    assert all(a <= 400 and b <= 3 and c <= 200 for a, b, c in use.values())
    assert sum(r["length"] for r in rows) == sum(t for t, _ in of.values())


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    texts = ["A plain sentence, with Words.", "", " two  blanks\n", "été 12"]
    words = P.WordTokens(path)
    assert not words.wordwise and P.WordTokens(tokenizer_file()).wordwise
    direct_ids = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert words.ids(texts) == direct_ids


def test_words_are_forgotten_at_the_end():
    words = P.WordTokens(tokenizer_file(), keep=10)
    words.ids(["some words " + "x" * 100])
    assert "some" in words.young and "x" * 100 not in words.young
    words.forget()
    assert not words.young and not words.old


def test_many_latin_texts_are_known_by_their_pieces_alone():
    texts = [f"Only, only only. ONLY! It's only{end}" for end in ("", ";", "?", "...")] * 60
    words = P.WordTokens(tokenizer_file())
    assert words.ids(texts) == direct(texts)
    assert not words.young and len(words.pieces.hashes) == len(["only", "it", "'s", *",.!;?", "..."])
    words.forget()
    assert not len(words.pieces.hashes) and not len(words.pieces.flat)


@pytest.mark.parametrize("collide", [False, True])
def test_pieces_equal_the_tokenizer(collide):
    """Every Latin-1 character in any order, apostrophes, digits, pieces around 8 and 16 characters; beside texts of other characters."""
    rng = np.random.default_rng(6)
    parts = [*map(chr, range(1, 256)), *"  ", "'ll", "'Re", "don't", "l'été", "''s", "a" * 8, "b" * 9, "a" * 16, "a" * 17, "." * 16, "." * 20, "\u0153uvre", "\u2019", "\0"]
    texts = ["".join(rng.choice(parts[: -3 if k % 5 else None], int(rng.integers(0, 400)))) for k in range(300)] + ODD + ["x" * 5000, "7" * 5000, "<|EndOfText|> a"]
    words = P.WordTokens(tokenizer_file(), keep=200)
    if collide:
        words.pieces.FACTORS = np.zeros(2, np.uint64)
    got = [ids for k in range(0, len(texts), 40) for ids in words.ids(texts[k : k + 40])]
    assert got == direct(texts)
    assert len(words.pieces.hashes) == 1 if collide else len(words.pieces.hashes) > 100
