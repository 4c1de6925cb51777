import random
import re

from oracle import assert_same

from weftline.llm.queries import ORACLE_SQL, QUERIES
from weftline.llm.sentence_dedup import without_repeats


def test_equals_sql(spark, sf_dir):
    name = "op9_sentence_dedup"
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


A = "The first sentence of a passage has quite a number of words. The second sentence of it has as many words as that.  A third one follows at once and has its words too."


def test_first_stays_and_others_go(documents):
    rows = [(3, f"Own words begin this text here. {A}\nOwn words end it."), (1, f"{A} Tail of one."), (2, "Nothing else is said in this short text of mine. " + A), (4, f"{A} {A}")]
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"]) for r in without_repeats(documents(rows)).collect()}
    assert got[1] == (4, 0, rows[1][1])
    assert got[2] == (4, 3, "Nothing else is said in this short text of mine. ")
    assert got[3][1:] == (3, "Own words begin this text here. Own words end it.")
    assert got[4][1] == 6


def plain(rows):
    """Every run of two sentences or more, of every length, held against all others."""
    split = lambda t: [s for p in re.split(r"(?<=[.!?][ \t\n])|(?<=\n)", t) if (s := p.strip().lower())]
    first, texts = {}, {i: split(t) for i, t in rows}
    runs = [(tuple(s[a:z]), i, a, z) for i, s in texts.items() for a in range(len(s)) for z in range(a + 2, len(s) + 1)]
    for run, i, a, _ in runs:
        first[run] = min(first.get(run, (i, a)), (i, a))
    removed = {(i, k) for run, i, a, z in runs if first[run] != (i, a) for k in range(a, z)}
    return {i: sum(j == i for j, _ in removed) for i in texts}


def test_equals_all_runs_of_every_length(documents):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["Yes.", "No!", "Why so?", "A longer one it is.", "Odd.", "Even."]) for _ in range(rng.randrange(2, 9)))) for i in range(40)]
    rows += [(i, " ".join(f"Own {i} {k}." for k in range(5))) for i in range(40, 45)]
    got = {r["doc_id"]: r["n_removed"] for r in without_repeats(documents(rows)).collect()}
    assert got == plain(rows) and 0 < sum(got.values()) and not any(got[i] for i in range(40, 45))


def test_short_notices_go(documents):
    notice = "We use cookies. They are fine. Read more."
    rows = [(1, f"One text starts. {notice}"), (2, f"{notice} Another text ends.")]
    assert {r["doc_id"]: r["text"] for r in without_repeats(documents(rows)).collect()} == {1: rows[0][1], 2: "Another text ends."}


def test_short_runs_stay_below_a_weight(documents):
    rows = [(i, "Yes. No. Yes. No. Yes.") for i in range(5)]
    assert all(r["n_removed"] == 0 for r in without_repeats(documents(rows), min_weight=12).collect())


def test_repeated_passages_of_short_sentences_go(documents):
    short = " ".join(f"Go {w}." for w in "north south east west up down left right in out".split())
    rows = [(1, f"Here the first text has its own beginning, unlike others. {short}"), (2, f"{short} And this is how the second text goes on by itself.")]
    got = {r["doc_id"]: r for r in without_repeats(documents(rows)).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "And this is how the second text goes on by itself."


def test_texts_without_blanks_count_by_characters(documents):
    chinese = "这是一个没有空格的句子它有很多的字用来测试重复的段落。这里还有第二个句子它也没有空格而且一样长所以可以算作一段。"
    tabs = "\t".join(f"w{k}" for k in range(20)) + "."
    rows = [(1, chinese), (2, chinese * 2), (3, tabs), (4, tabs)]
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"]) for r in without_repeats(documents(rows), min_weight=8).collect()}
    assert got == {1: (2, 0), 2: (4, 4), 3: (1, 0), 4: (1, 1)}


def test_edge_rows(documents):
    single = "one sentence only with more than twelve words in it so that it counts as a run"
    rows = [(None, None), (None, single), (1, ""), (2, single), (2, single), (5, single), (6, "A b c. " * 30_000)]
    df = documents(rows, h="1", at="2", removed="3", parts="4")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in without_repeats(df).collect()), key=repr)
    assert got == sorted([(None, 0), (None, 1), (1, 0), (2, 0), (2, 0), (5, 1), (6, 29_999)], key=repr)
    assert without_repeats(df.limit(0)).count() == 0
    long = "Several words make this sentence long enough. " * 3
    (r,) = without_repeats(documents([(1, long)])).collect()
    assert r["n_removed"] == 2 and r["kept_chars"] == len(r["text"])
