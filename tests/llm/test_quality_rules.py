import re
from collections import Counter

from oracle import assert_same

from weftline.llm.quality_rules import apply_quality_rules, line_verdicts
from weftline.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts):
    """Measures of (id, text, host), and the verdict by distinct texts per host and line."""
    rows, holders = [], {}
    for doc_id, text, host in texts:
        text = text or ""
        words = WORD.findall(text)
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        times = Counter(grams)
        again = {g for g in grams if times[g] > 1}
        covered = {p for i, g in enumerate(grams) if g in again for p in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]

        for x in lines:
            holders.setdefault((host, x.strip(" \t\r\x0b\x0c").lower()), set()).add(text)
        rows.append((doc_id, host, words, lines, len(covered), len(re.findall(r"[#*$%&|<>]", text))))
    out = {}
    for doc_id, host, words, lines, covered, symbols in rows:
        left = sum(len(x) for x in lines if len(holders[host, x.strip(" \t\r\x0b\x0c").lower()]) <= 20)
        chars = sum(map(len, lines))
        failed = len(words) < 20 or 100 * covered > 30 * len(words)
        depleted = left < chars and left < 100 and left < 0.2 * chars
        out[doc_id] = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), covered, failed, not failed and not depleted)
    return out


def found(df):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in line_verdicts(df).collect()}


def test_equals_plain_version(small):
    texts = [(r["doc_id"], r["text"], r["source"]) for r in small.collect()]
    assert found(small) == plain(texts)


def test_equals_sql(spark, sf_dir):
    name = "op5_quality_rules"
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_common_line_depletes_and_copies_do_not(documents):
    line = "this very line stands in each and every one of the documents of this host so it is boilerplate and nothing else at all"
    rows = [(i, f"{line}\n" + " ".join(f"w{i}x{k}" for k in range(60)), "a") for i in range(30)]
    rows += [(100, f"{line}\nshort tail here", "a"), (101, f"{line}\nshort tail here", "b")]
    copy = " ".join(f"copy{k}" for k in range(40)) + "\n" + " ".join(f"more{k}" for k in range(40))
    rows += [(200 + i, copy, "a") for i in range(40)]
    kept = {k: v[-1] for k, v in found(documents(rows)).items()}
    assert not kept[100] and kept[101]
    assert all(v for k, v in kept.items() if k != 100)
    cleaned = {r["doc_id"]: r["text"] for r in apply_quality_rules(documents(rows)).collect()}
    assert 100 not in cleaned and line not in cleaned[0] and cleaned[200] == copy


def test_edge_rows(documents):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, None), (None, text), (1, ""), (2, text), (2, text), (3, "x " * 5000), (4, " \n\t\n ")]
    df = documents(rows, h="1", lines="2", words="3", removed="4")
    out = line_verdicts(df).collect()
    assert len(out) == len(rows)
    assert sum(r["kept"] for r in out) == 3
    long = next(r for r in out if r["doc_id"] == 3)
    assert long["n_repeat_words"] == 5000 and long["base_failed"]
    assert apply_quality_rules(df).columns == df.columns
    assert line_verdicts(df.limit(0)).count() == 0


def test_different_documents_that_share_a_passage_count_each(documents):
    common = "\n".join(" ".join(f"c{line}x{k}" for k in range(10)) for line in range(20))
    rows = [(i, f"{common}\n" + " ".join(f"own{i}x{k}" for k in range(11)), "a") for i in range(60)]
    assert not any(v[-1] for v in found(documents(rows)).values())


def test_a_long_shared_line_counts_once_for_each_document(documents):
    line = " ".join(f"shared{k}" for k in range(80))
    rows = [(i, f"{line}\nown{i}x1 own{i}x2 own{i}x3", "a") for i in range(500)]
    df = documents(rows, v_id="1", v_hash="2", v_removed="3", own_hash="4", parts="5")
    assert not any(v[-1] for v in found(df).values())
    assert apply_quality_rules(df).count() == 0


def test_many_removed_lines_in_a_long_text(documents):
    common = [f"common line number {k} of this host" for k in range(300)]
    own = lambda i: [" ".join(f"w{i}x{n}x{k}" for k in range(8)) for n in range(300)]
    rows = [(i, "\n".join(x for pair in zip(common, own(i)) for x in pair), "a") for i in range(25)]
    df = documents(rows)
    out = {r["doc_id"]: r for r in apply_quality_rules(df).collect()}
    assert out[3]["text"] == "\n".join(own(3)) and out[3]["n_chars"] == len(out[3]["text"])
    assert found(df) == plain(rows)
