"""Packing into fixed-length sequences as vector bin packing with the dot-product heuristic.

An item demands tokens, one segment and loss-bearing tokens; a sequence offers
`max_tokens`, `max_segments` and `max_loss`. The open sequence takes, of the items
that fit, the one whose demand has the largest dot product with what is left
(both as shares of the limits). Where none fits and items may be cut, the best one
is cut to fill the sequence.

An item is a context followed by its loss-bearing tokens. A sequence that closes
short of `max_tokens` is dealt into sequences of powers of two, which need no
padding. Every input partition is packed by itself, streaming, with a window of
`window` items: no shuffle, and memory that doesn't grow with the input.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._shared import released


@dataclass
class Packer:
    """Places items that are added one by one; `done` collects (key, start, length, sequence, offset)."""

    max_tokens: int = 2048
    max_segments: int = 256
    max_loss: int = 2048
    cut: bool = True
    window: int = 2048
    sequence: int = 0
    done: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self._limits = np.array([self.max_tokens, self.max_segments, self.max_loss], float)
        self._keys: list = []
        self._start = np.zeros(self.window, np.int64)
        self._tokens = np.zeros(self.window, np.int64)
        self._context = np.zeros(self.window, np.int64)  # of the tokens left, those that bear no loss
        self._n = 0
        self._open: list[tuple] = []
        self._left = self._limits.copy()

    def add(self, key, tokens: int, loss: int) -> None:
        """Tokens beyond a limit are placed in pieces that fill it; the rest waits in the window."""
        start, context = 0, tokens - loss
        while tokens - start > self.max_tokens or tokens - max(start, context) > self.max_loss:
            size = self._most(tokens - start, max(0, context - start), self.max_tokens, self.max_loss)
            self._close([(key, start, size)])
            start += size
        if start == tokens:
            return
        if self._n == self.window:
            self._pack(self.window // 2)
        i = self._n
        self._keys[i:] = [key]
        self._start[i], self._tokens[i], self._context[i] = start, tokens - start, max(0, context - start)
        self._n += 1

    def finish(self) -> None:
        self._pack(0)
        if self._open:
            self._close(self._open)
        self._open, self._left = [], self._limits.copy()

    @staticmethod
    def _most(tokens: int, context: int, room: int, loss_room: int) -> int:
        """The longest head of an item that the room takes."""
        return int(min(tokens, room, context + loss_room))

    def _pack(self, until: int) -> None:
        n = self._n
        tokens, start, context = self._tokens[:n], self._start[:n], self._context[:n]
        alive, waiting = np.ones(n, bool), n
        share = np.stack([tokens, np.ones(n, np.int64), tokens - context], axis=1) / self._limits
        while waiting > until:
            left = self._left
            fits = alive & (tokens <= left[0]) & (tokens - context <= left[2])
            if left[1] < 1 or not (fits.any() or self.cut and left[0] >= 1 and left[2] >= 1):
                self._close(self._open)
                self._open, self._left = [], self._limits.copy()
                continue
            whole = bool(fits.any())
            score = share @ (left / self._limits)
            i = int(np.argmax(np.where(fits if whole else alive, score, -1.0)))
            size = int(tokens[i]) if whole else self._most(tokens[i], context[i], left[0], left[2])
            self._open.append((self._keys[i], int(start[i]), size))
            self._left = left - (size, 1, max(0, size - int(context[i])))
            start[i] += size
            tokens[i] -= size
            context[i] = max(0, context[i] - size)
            if not tokens[i]:
                alive[i] = False
                waiting -= 1
            else:
                share[i] = np.array([tokens[i], 1, tokens[i] - context[i]]) / self._limits
            if self._left[0] < 1:
                self._close(self._open)
                self._open, self._left = [], self._limits.copy()
        self._keys = [k for k, a in zip(self._keys, alive) if a]
        for kept in (self._start, self._tokens, self._context):
            kept[:waiting] = kept[:n][alive]
        self._n = waiting

    def _close(self, pieces: list[tuple]) -> None:
        total = sum(size for _, _, size in pieces)
        sizes = [total] if total == self.max_tokens or not self.cut else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        room, offset = sizes.pop(0), 0
        for key, start, size in pieces:
            while size:
                if not room:
                    self.sequence, room, offset = self.sequence + 1, sizes.pop(0), 0
                part = min(size, room)
                self.done.append((key, start, part, self.sequence, offset))
                start, size, room, offset = start + part, size - part, room - part, offset + part
        self.sequence += 1


def pack_examples(
    examples: DataFrame,
    *,
    id_col: str,
    tokens_col: str,
    loss_col: str,
    max_tokens: int = 2048,
    max_segments: int = 32,
    max_loss: int = 1024,
    cut: bool = False,
    window: int = 2048,
) -> DataFrame:
    """(id, start, length, sequence_id, offset) for rows that state their token and loss-token counts.

    Examples within all limits stay whole unless `cut`. Null or negative counts
    count as 0, loss tokens beyond the tokens as all of them; an example without
    tokens has no piece. Null and repeated ids are packed like others; an empty
    table gives an empty table; other columns are not read.
    """
    limits = (max_tokens, max_segments, max_loss, cut, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(*limits, sequence=TaskContext.get().partitionId() << 33)
        kind = None

        def out():
            rows, packer.done = packer.done, []
            columns = list(zip(*rows)) or [()] * 5
            names = ["id", "start", "length", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind] + [pa.int64()] * 4)], names=names)

        for b in batches:
            kind = b.schema.field(0).type
            for key, tokens, loss in zip(*(c.to_pylist() for c in b.columns)):
                packer.add(key, tokens, loss)
            yield out()
        packer.finish()
        if packer.done:
            yield out()

    tokens = F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0))
    loss = F.least(F.greatest(F.coalesce(F.col(loss_col).cast("long"), F.lit(0)), F.lit(0)), tokens)
    kind = examples.schema[id_col].dataType.simpleString()
    return examples.select(F.col(id_col).alias("id"), tokens.alias("tokens"), loss.alias("loss")).mapInArrow(
        run, f"id {kind}, start bigint, length bigint, sequence_id bigint, offset bigint"
    )


# The steps before the merges of a tokenizer whose ids are those of its words.
WORDWISE_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
WORDWISE_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


def _wordwise(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, drops white space and parts letters from signs, as `WordTokens` takes for granted."""
    steps = [json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    return steps[0].get("normalizers") == WORDWISE_NORMALIZER and WORDWISE_SPLIT in steps[1].get("pretokenizers", [])


class Pieces:
    """Token ids of Latin-1 texts by arrays; of a wordwise tokenizer, whose own steps tell what each character is.

    A piece is known by its characters: as two 64-bit numbers that hold up to 16 of
    them, and by a hash of both, under which the known ones are sorted. Hits are
    held against the numbers, so a hash shared by two pieces can't go unseen. Longer
    pieces are encoded each time.
    """

    SPACE, LETTER, SIGN, DIGIT = range(4)
    MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

    def __init__(self, tokenizer, ends: np.ndarray):
        self.tokenizer, self.ends = tokenizer, ends
        self.added = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]

        def cut(text: str) -> int:
            return len(tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text)))

        def kind(c: str) -> int:
            return self.SPACE if not cut(c) else self.DIGIT if cut(c + c) == 2 else self.LETTER if cut("a" + c) == 1 else self.SIGN

        self.kinds = np.array([kind(chr(i)) for i in range(256)], np.uint8)
        self.lower = bytes(ord(chr(i).lower()) for i in range(256))
        self.clear()

    def clear(self) -> None:
        self.hashes, self.low, self.high = (np.zeros(0, np.uint64) for _ in range(3))
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def bytes_of(self, text: str) -> bytes | None:
        """The text in lower-case Latin-1, or None where it has other characters, NUL or a token of its own."""
        try:
            data = text.encode("latin-1").translate(self.lower)
        except UnicodeEncodeError:
            return None
        return None if b"\0" in data or any(t in data for t in self.added) else data

    def ids(self, texts: list[bytes], most: int) -> list[bytes]:
        """Of each text of `bytes_of`. Over `most` known pieces are forgotten."""
        if len(self.hashes) > most:
            self.clear()
        n = sum(map(len, texts)) + len(texts)
        data = b" ".join([*texts, bytes(24)])
        starts, size = self._cut(np.frombuffer(data, np.uint8)[:n])
        at = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        low, high = at[starts] & self.MASKS[np.minimum(size, 8)], at[starts + 8] & self.MASKS[np.clip(size - 8, 0, 8)]
        hashes = low * self.FACTORS[0] + high * self.FACTORS[1]
        short = size <= 16
        distinct, where, inverse = np.unique(hashes[short], return_index=True, return_inverse=True)
        where = np.flatnonzero(short)[where]
        new = where[np.searchsorted(self.hashes, distinct) == np.searchsorted(self.hashes, distinct, "right")]
        if len(new):
            ids, count = self._encoded(data, starts[new], size[new])
            place = np.searchsorted(self.hashes, hashes[new])
            for name, values in (("low", low[new]), ("high", high[new]), ("first", len(self.flat) + np.cumsum(count) - count), ("count", count), ("hashes", hashes[new])):
                setattr(self, name, np.insert(getattr(self, name), place, values))
            self.flat = np.concatenate([self.flat, ids])
        number = np.searchsorted(self.hashes, distinct)[inverse]
        # Pieces that are long, or share their hash with another one, are encoded here.
        same = (self.low[number] == low[short]) & (self.high[number] == high[short])
        alone = np.concatenate([np.flatnonzero(~short), np.flatnonzero(short)[~same]])
        first, count, flat = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), self.flat
        first[short], count[short] = self.first[number], self.count[number]
        if len(alone):
            ids, count[alone] = self._encoded(data, starts[alone], size[alone])
            first[alone] = len(flat) + np.cumsum(count[alone]) - count[alone]
            flat = np.concatenate([flat, ids])
        end = np.cumsum(count)
        out = flat[np.repeat(first - (end - count), count) + np.arange(end[-1] if len(end) else 0)].tobytes()
        pieces = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        cuts = [0, *(4 * np.r_[0, end][pieces]).tolist()]
        return [out[a:z] for a, z in zip(cuts, cuts[1:])]

    def _cut(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces start, and their sizes. A lone apostrophe stays with the letters behind it ('s, 'll), if any."""
        kind = self.kinds[chars]
        before = np.r_[np.uint8(self.SPACE), kind[:-1]]
        edge = (kind != before) | (kind == self.DIGIT)
        quote = np.flatnonzero((chars[:-1] == ord("'")) & edge[:-1] & (kind[1:] == self.LETTER))
        edge[quote + 1] = False
        edges = np.flatnonzero(edge)
        own = kind[edges] != self.SPACE
        return edges[own], np.diff(np.r_[edges, len(chars)])[own]

    def _encoded(self, data: bytes, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has. Letters are encoded as one text."""
        pieces = [data[a : a + k].decode("latin-1") for a, k in zip(starts.tolist(), size.tolist())]
        letters = np.array([p.isalpha() for p in pieces], bool)
        count = np.zeros(len(pieces), np.int64)
        simple = [p for p, x in zip(pieces, letters) if x]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(simple)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(simple):
            letters[:], ids, last = False, ids[:0], last[:0]
        count[letters] = np.diff(np.r_[-1, last])
        other = [p for p, x in zip(pieces, letters) if not x]
        each = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        count[~letters] = [len(x) for x in each]
        out = np.zeros(count.sum(), "<u4")
        mine = np.repeat(letters, count)
        out[mine], out[~mine] = ids, np.array([i for x in each for i in x], "<u4")
        return out, count


class WordTokens:
    """Token ids of texts as bytes (little-endian, 32 bits each).

    Where the tokenizer drops white space, a text's ids are those of its words: a
    word of Latin letters and signs behind them has the ids of its letters in lower
    case, then those of the signs. Ids are then kept in two generations of about
    `keep` words, of 64 characters at most each; the older goes when the younger is
    full. Texts of any other tokenizer are encoded whole.

    Many Latin-1 texts at a time are cut into the tokenizer's pieces (runs of
    letters, runs of signs, single digits) by whole arrays of characters: see
    `Pieces`. That spares an object for each word.
    """

    #: What may follow a word's letters and shares no token with them.
    SIGNS = ".,;:!?#*$%&|<>()[]{}\"'-_/"
    #: Characters from which on arrays cost less than words.
    MANY = 4096

    def __init__(self, path: str, keep: int = 150_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.wordwise = _wordwise(self.tokenizer)
        self.pieces = Pieces(self.tokenizer, self.ends) if self.wordwise else None
        self.keep, self.young, self.old = keep, {}, {}

    def forget(self) -> None:
        """Give the kept words back; the next task of this worker begins without them."""
        self.young, self.old = {}, {}
        if self.pieces:
            self.pieces.clear()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text; words that are new are learned together."""
        if not self.wordwise:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        plain = [self.pieces.bytes_of(text) for text in texts]
        if sum(map(len, filter(None, plain))) >= self.MANY:
            found = iter(self.pieces.ids([x for x in plain if x is not None], 2 * self.keep))
            others = iter(self._by_words([text for text, x in zip(texts, plain) if x is None]))
            return [next(others if x is None else found) for x in plain]
        return self._by_words(texts)

    def _by_words(self, texts: list[str]) -> list[bytes]:
        words = [text.replace("\n", " ").split(" ") for text in texts]
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        if missing := set().union(*words).difference(self.young):
            self._learn(missing)
        known = self.young.__getitem__
        out = [b"".join(map(known, w)) for w in words]
        for w in missing:
            if len(w) > 64:  # long words don't come again, and would take the room
                self.young.pop(w, None)
        return out

    def _learn(self, words: set[str]) -> None:
        young, old = self.young, self.old
        new, tied = set(), []
        for w in words:
            if (ids := old.get(w)) is not None:
                young[w] = ids
                continue
            stem = w.rstrip(self.SIGNS)
            # Lower case and composition change nothing else within Latin-1.
            if stem.isalpha() and max(stem) < "\u0100":
                low = stem.lower()
                if low != w:
                    rest = w[len(stem) :]
                    tied.append((w, low, rest))
                    if rest and rest not in young:
                        new.add(rest)
                    w = low
                if w in young:
                    continue
            new.add(w)
        simple = [w for w in new if w.isalpha()]
        other = [w for w in new if not w.isalpha()]
        if simple:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(simple)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(simple):
                flat, cuts = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
                young.update(zip(simple, [flat[a:z] for a, z in zip(cuts, cuts[1:])]))
            else:
                other += simple
        if other:
            for s, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
                young[s] = np.array(e.ids, "<u4").tobytes()
        for w, low, rest in tied:
            young[w] = young[low] + young[rest] if rest else young[low]


_loaded: dict[str, WordTokens] = {}


def _tokens(path: str, keep: int) -> WordTokens:
    """Loaded once a worker; its words are forgotten at the end of each task."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordTokens(path)
    _loaded[path].keep = keep
    return _loaded[path]


def _tokenized(words: WordTokens, b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple]:
    """(id, token ids) of a batch's rows, about `most` characters at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(b.column(0), b.column(1)):
        ids.append(doc_id.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield from zip(ids, words.ids(texts))
            ids, texts, size = [], [], 0
    yield from zip(ids, words.ids(texts))


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int = 256,
    max_loss: int = 2048,
    window: int = 2048,
    keep_words: int = 150_000,
) -> DataFrame:
    """Tokenize (doc_id, text) and pack; one row per piece. A task keeps the ids of twice `keep_words` words.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    null or empty text has the end token only. Every token of a document bears
    loss; documents may be cut. Null ids and repeated rows are packed like others;
    an empty table gives an empty table; other columns are not read.
    """
    limits = (max_tokens, max_segments, max_loss, True, window)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokens(tokenizer_path, keep_words)
        packer = Packer(*limits, sequence=TaskContext.get().partitionId() << 33)
        held: dict[int, list] = {}  # number of a document: its id, ids, and the tokens that have no piece yet
        kind, number = None, 0

        def out():
            rows, packer.done = packer.done, []
            table = []
            for key, start, length, sequence, offset in rows:
                doc = held[key]
                crc = zlib.crc32(memoryview(doc[1])[4 * start : 4 * (start + length)])
                table.append((doc[0], start, length, crc, len(doc[1]) // 4, sequence, offset))
                doc[2] -= length
                if not doc[2]:
                    del held[key]
            columns = list(zip(*table)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind] + [pa.int64()] * 6)], names=names)

        try:
            for b in batches:
                kind = b.schema.field(0).type
                for doc_id, ids in _tokenized(words, b):
                    ids += end
                    held[number] = [doc_id, ids, len(ids) // 4]
                    packer.add(number, len(ids) // 4, len(ids) // 4)
                    number += 1
                    if len(packer.done) >= 4096:
                        yield out()
        finally:
            words.forget()
        packer.finish()
        if packer.done:
            yield out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run), ", ".join([f"doc_id {kind}"] + [f"{c} bigint" for c in names[1:]]))
