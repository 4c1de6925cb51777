"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items form one suffix automaton, broadcast as item texts
and built once per task. Training documents are streamed through it: each
token updates the state and the longest matching length; a length that reaches the
window (10 words, or a whole shorter item) marks the words it spans. Words outside
the benchmark's vocabulary reset the automaton, so runs of known words shorter
than the shortest window are skipped without a step.

The automaton is bounded: different items fill blocks of about `block_words` words
by a running sum, and the documents are held against one block after the other (a
stated query set against all rows). One block needs one pass and no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._shared import free_names, in_blocks, released, stored

WINDOW = 10
#: A-Z to a-z; digits, a-z and every byte of a non-ASCII character stay; the rest parts words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class SuffixAutomaton:
    """Of several word sequences, each with the ids of its items; knows for every 10-word window and whole short item which sequences hold it."""

    def __init__(self, items: list[tuple[list[str | None], bytes]], window: int = WINDOW):
        self.window, self.items = window, [i for i, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        known = self.vocabulary
        texts = [[known.setdefault(w, len(known)) for w in words_of(text)] for _, text in items]
        for words in texts:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: Of a state: the items of the windows, and the shorter whole items (length, item), that end there.
        self.holders: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.shortest = window
        for k, words in enumerate(texts):
            if not words:
                continue
            state = n = 0
            for w in words:
                state, n = self.next[state][w], n + 1
                if n >= window:
                    self.holders.setdefault(self._at(state, window), set()).add(k)
            if n < window:
                self.short.setdefault(self._at(state, n), []).append((n, k))
                self.shortest = min(self.shortest, n)

    def _extend(self, last: int, w: int) -> int:
        """Append word `w` behind the string of state `last`; the state of the longer string."""
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        """The part of state `q` whose strings are no longer than that of `p` and `w`."""
        nxt, link = self.next, self.link
        clone = self._state(dict(nxt[q]), link[q], self.length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def _state(self, nxt: dict[int, int], link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _at(self, state: int, n: int) -> int:
        """The state of the last `n` words of the strings of `state`."""
        while self.length[self.link[state]] >= n and state:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word spans (start, end), merged and ascending, and the indexes of items with an occurring window."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= self.shortest:
                self._stream(ids[a:b].tolist(), a, spans, found)
        return spans, found

    def _stream(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = n = 0
        for i, w in enumerate(ids, at + 1):
            while (to := nxt[state].get(w)) is None and state:
                state = link[state]
                n = length[state]
            if to is not None:
                state, n = to, n + 1
            longest = 0
            if n >= window:
                longest = window
                found |= self.holders.get(self._at(state, window), set())
            if self.short and n:
                s = state
                while s > 0:
                    for size, k in self.short.get(s, ()):
                        if size <= n:
                            found.add(k)
                            longest = max(longest, size)
                    s = link[s]
            if longest:
                start = i - longest
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Number of words, hit word spans, and ids of items of a row.
Marks = tuple[int, list[tuple[int, int]], list[str]]


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int, block_words: int) -> tuple[list[int], DataFrame]:
    """The numbers of the blocks, and (block, row, id, text) of the items, about `block_words` words to a block.

    A longer item comes in parts that share `window` - 1 words, so each of its windows lies in one of them. Equal rows
    count once. Rows of equal text follow each other in a block; the first has the text and its words count, the others
    have null and count as a word.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    items = items.withColumn("words", F.filter(F.split("text", SPLIT), lambda w: w != "")).where(F.size("words") > 0)
    step = block_words - window + 1
    if step < 1:
        raise ValueError("block_words must be at least the window")
    n_parts = F.greatest(F.ceil((F.size("words") - (window - 1)) / step), F.lit(1)).cast("int")
    items = items.withColumn("at", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    items = items.select("id", F.array_join(F.slice("words", F.col("at") * step + 1, F.lit(block_words)), " ").alias("text")).distinct()
    place = Window.partitionBy("text").orderBy("id")
    placed = items.withColumn("first", F.row_number().over(place) == 1).sortWithinPartitions("text", F.desc("first"))
    blocks, placed = in_blocks(placed, F.when(F.col("first"), F.size(F.split("text", " "))).otherwise(1), block_words, "decontaminate-items")
    leads = F.row_number().over(Window.partitionBy("block", "text").orderBy("row")) == 1
    return blocks, placed.select("block", "row", "id", F.when(leads, F.col("text")).alias("text"))


def block_items(items: DataFrame, block: int) -> list[tuple[list[str | None], bytes]]:
    """The different texts of a block, each with the ids of its items."""
    out: list[tuple[list[str | None], bytes]] = []
    for r in items.where(F.col("block") == block).orderBy("row").collect():
        if r["text"] is not None:
            out.append(([], r["text"].encode()))
        out[-1][0].append(r["id"])
    return out


def _scanned(docs: DataFrame, text_col: str, items: list[tuple], window: int, schema: str | object, finish: Callable) -> DataFrame:
    """`finish(batch, marks)` over the batches of `docs`. The automaton is built once a task and goes with it."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(sent.value, window)
        for b in batches:
            marks: list[Marks] = []
            for t in b.column(b.schema.get_field_index(text_col)):
                words = words_of(t.as_buffer().to_pybytes()) if t.is_valid else []
                spans, found = automaton.scan(words)
                marks.append((len(words), spans, sorted({i for k in found for i in automaton.items[k]} - {None})))
            yield finish(b, marks)

    return docs.mapInArrow(released(run), schema)


SPANS = "array<struct<start:bigint,end:bigint>>"


def scanned(docs: DataFrame, benchmark: DataFrame, schema: Callable, finish: Callable, *, text_col: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, block_words: int = 200_000) -> DataFrame:
    """`finish(batch, marks)` over all rows of `docs`, with their marks against the whole benchmark.

    With one block of items this is one pass without a shuffle. With several, the
    rows are numbered and written once; each block's pass then reads id and text
    and writes the rows that it hits only, so that one block at a time is held, and
    the hits, gathered by row, are joined to the rows again.
    """
    spark = docs.sparkSession
    blocks, items = item_blocks(benchmark, item_id, item_text, window, block_words)
    if len(blocks) <= 1:
        return _scanned(docs, text_col, block_items(items, blocks[0]) if blocks else [], window, schema(docs), finish)
    items = stored(items, "decontaminate-blocks")
    rid, had, of_row = free_names(docs.columns, "c_row", "c_had", "c_of_row")
    docs = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "decontaminate-rows")

    def hits(b: pa.RecordBatch, marks: list[Marks]) -> pa.RecordBatch:
        some = [i for i, (_, spans, _) in enumerate(marks) if spans]
        spans = [[{"start": x, "end": y} for x, y in marks[i][1]] for i in some]
        typed = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(some, pa.int64())), pa.array(spans, typed), pa.array([marks[i][2] for i in some], pa.list_(pa.string()))],
            names=[of_row, "spans", "items"],
        )

    found = None
    for k in blocks:
        one = _scanned(docs.select(rid, text_col), text_col, block_items(items, k), window, f"{of_row} bigint, spans {SPANS}, items array<string>", hits)
        one = stored(one, "decontaminate-hits")
        found = one if found is None else found.union(one)
    found = found.groupBy(of_row).agg(F.struct(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).alias(had))
    joined = docs.join(found, F.col(rid) == F.col(of_row), "left").drop(rid, of_row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = []
            for t, h in zip(b.column(b.schema.get_field_index(text_col)), b.column(b.num_columns - 1)):
                h = h.as_py() or {"spans": [], "items": []}
                n_words = len(words_of(t.as_buffer().to_pybytes())) if t.is_valid else 0
                marks.append((n_words, _merged([(x["start"], x["end"]) for x in h["spans"]]), sorted(h["items"])))
            yield finish(b, marks)

    return joined.mapInArrow(run, schema(docs.drop(rid)))


def contamination(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of `docs`.

    A null or empty text has no words; a null or wordless item has no window; a null
    item id names no item but its windows hit. Items that share an id count once.
    Null ids and repeated rows are scanned like others; an empty table gives an
    empty table, an empty benchmark no hit; other columns are not read.
    """
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def finish(b: pa.RecordBatch, marks: list[Marks]) -> pa.RecordBatch:
        hit = [sum(y - x for x, y in spans) for _, spans, _ in marks]
        digest = [hashlib.sha256(",".join(items).encode()).hexdigest() for *_, items in marks]
        columns = [[m[0] for m in marks], hit, [len(m[2]) for m in marks]]
        return pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=names
        )

    schema = lambda d: f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return scanned(docs.select("doc_id", "text"), benchmark, schema, finish, **settings)


_WORD = re.compile(rb"[^ ]+")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """`text` without the words of `spans` and what parts them; one blank stands where a span was."""
    places = [m.span() for m in _WORD.finditer(text.translate(NORMAL))]
    out, at = [], 0
    for a, b in spans:
        out += [text[at : places[a][0]].rstrip(b" "), b" "]
        at = places[b - 1][1]
    return b"".join([*out, text[at:].lstrip(b" ")])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, max_coverage: float = 0.8, **settings) -> DataFrame:
    """`docs` (doc_id, text, lang, source, n_chars) with hit spans cut from the texts.

    A document with more than `max_coverage` of its words hit is removed whole.
    Untouched texts stay as they are, null and empty ones too; n_chars follows the
    text. Null ids and repeated rows are treated like others; an empty table gives
    an empty table; further columns pass through, whatever their names.
    """
    names = docs.columns

    def finish(b: pa.RecordBatch, marks: list[Marks]) -> pa.RecordBatch:
        b = b.select(names)
        where = names.index("text")
        kept = [sum(y - x for x, y in spans) <= max_coverage * n for n, spans, _ in marks]
        if any(spans for _, spans, _ in marks):
            new = [
                cut(t.as_buffer().to_pybytes(), spans).decode() if spans and stays else t.as_py()
                for t, (_, spans, _), stays in zip(b.column(where), marks, kept)
            ]
            b = b.set_column(where, b.schema.field(where), pa.array(new, b.schema.field(where).type))
        return b if all(kept) else b.filter(pa.array(kept, pa.bool_()))

    touched = scanned(docs, benchmark, lambda d: d.select(names).schema, finish, **settings)
    return touched.withColumn("n_chars", F.length("text").cast("long")).select(names)
