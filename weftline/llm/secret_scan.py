"""Secret scan with a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query: an OR of ANDs that
every match must satisfy. Texts are taken in segments; a segment's index has, for
each trigram of any query, the documents that hold it. Queries intersect and unite
these postings, and only the candidates are verified with the expression itself. A
rule without mandatory trigrams scans every text. Segments are indexed where they
are read, so nothing is shuffled and no posting list grows with the corpus.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._shared import released

# The base rules' expressions, and the least length of what counts.
BASE_RULES = {
    "assign": (r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
# Further kinds of secrets with published formats.
MORE_RULES = {
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "github": (r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    "google": (r"AIza[0-9A-Za-z_-]+", 0, 39),
    "stripe": (r"sk_live_[0-9A-Za-z]+", 0, 24),
    "github_fine": (r"github_pat_[A-Za-z0-9_]+", 0, 82),
    "gitlab": (r"glpat-[A-Za-z0-9_-]+", 0, 26),
    "npm": (r"npm_[A-Za-z0-9]+", 0, 40),
    "pypi": (r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]+", 0, 70),
    "sendgrid": (r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 69),
    "slack_hook": (r"hooks\.slack\.com/services/[A-Za-z0-9/]+", 0, 60),
    "storage_key": (r"AccountKey=[A-Za-z0-9+/=]+", 0, 80),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
}
RULES = BASE_RULES | MORE_RULES
SEGMENT_BYTES = 4 << 20

Query = list[frozenset[bytes]] | None


def _trigrams(literal: str) -> frozenset[bytes]:
    b = literal.encode()
    return frozenset(b[i : i + 3] for i in range(len(b) - 2))


def _either(sets: list[frozenset[bytes]]) -> Query:
    """An OR of ANDs without its redundant terms; None where a term demands nothing."""
    least = [s for s in set(sets) if not any(t < s for t in sets)]
    return None if frozenset() in least else sorted(least, key=sorted)


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _either([x | y for x, y in itertools.product(a, b)])


def _study(tree, most: int = 64) -> tuple[set[str] | None, Query]:
    """Of a parsed expression: all strings it matches, lower case, if few; else None and what they demand."""
    exact: set[str] | None = {""}
    need: Query = None
    run = {""}  # the literal strings that end here, since the last part that could be anything
    for op, arg in tree:
        part: set[str] | None
        own: Query = None
        if op is sre.LITERAL:
            part = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            part, own = _study(arg[3], most)
        elif op is sre.BRANCH:
            told = [_study(t, most) for t in arg[1]]
            part = set().union(*(p for p, _ in told)) if all(p is not None for p, _ in told) else None
            if part is None:
                queries = [q if p is None else _either([_trigrams(s) for s in p]) for p, q in told]
                own = None if None in queries else _either([s for q in queries for s in q])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            part, own = _study(inner, most)
            if part is not None and high == 1:
                part = part | {""} if low == 0 else part
            elif part is not None and low:
                own, part = _either([_trigrams(s) for s in part]), None
            elif part is not None or not low:
                part, own = None, None
        elif op is sre.AT:
            part = {""}
        else:
            part = None
        if part is not None and len(run) * len(part) <= most:
            run = {x + y for x, y in itertools.product(run, part)}
            continue
        exact = None
        need = _both(need, _either([_trigrams(s) for s in run]))
        if part is not None:
            run = part
        else:
            need, run = _both(need, own), {""}
    if exact is None:
        return None, _both(need, _either([_trigrams(s) for s in run]))
    return run, None


def trigram_query(expression: str) -> Query:
    """What a text must hold, in lower case, for the expression to match; None: no trigram is mandatory."""
    exact, need = _study(_parser.parse(expression))
    return need if exact is None else _either([_trigrams(s) for s in exact])


class Scanner:
    """Rules, their expressions and trigram queries; built where the tasks run."""

    def __init__(self, rules: dict[str, tuple[str, int, int]]):
        self.rules = [(k, re.compile(e), group, least, trigram_query(e)) for k, (e, group, least) in rules.items()]
        grams = sorted({g for *_, q in self.rules for s in q or () for g in s})
        self.number = {g: i for i, g in enumerate(grams)}
        self.table = np.full(1 << 24, -1, np.int16)
        for g, i in self.number.items():
            self.table[int.from_bytes(g, "big")] = i

    def postings(self, texts: list[bytes]) -> np.ndarray:
        """Bit (trigram, text): which texts of a segment hold the trigram, letters in either case."""
        # Two zero bytes part the texts, so no trigram reaches over. A long text is coded part by part.
        flat = np.frombuffer(b"\0\0".join(texts).lower() + b"\0\0", np.uint8)
        ends = np.cumsum([len(t) + 2 for t in texts])
        found = np.zeros((len(self.number), len(texts)), bool)
        for start in range(0, len(flat) - 2, SEGMENT_BYTES):
            part = flat[start : start + SEGMENT_BYTES + 2]
            code = part[:-2].astype(np.int32)
            code <<= 8
            code |= part[1:-1]
            code <<= 8
            code |= part[2:]
            gram = self.table[code]
            at = np.flatnonzero(gram >= 0)
            found[gram[at], np.searchsorted(ends, start + at, "right")] = True
        return found

    def segment(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Spans (start, end, rule number) of each text, in code points, in order."""
        found = self.postings(texts)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        decoded: dict[int, str] = {}
        for k, (_, expression, group, least, query) in enumerate(self.rules):
            if query is None:
                candidates = range(len(texts))
            else:
                hit = np.zeros(len(texts), bool)
                for grams in query:
                    hit |= found[[self.number[g] for g in grams]].all(axis=0)
                candidates = np.flatnonzero(hit).tolist()
            for i in candidates:
                if i not in decoded:
                    decoded[i] = texts[i].decode()
                for m in expression.finditer(decoded[i]):
                    if m.end(group) - m.start(group) >= least:
                        spans[i].append((m.start(), m.end(), k))
            if query is None:
                decoded = {i: decoded[i] for i in decoded if spans[i]}
        return [sorted(s, key=lambda x: (x[0], x[2])) for s in spans]


def _segments(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SEGMENT_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


Spans = list[tuple[int, int, int]]


def scanned(docs: DataFrame, text_col: str, rules: dict[str, tuple[str, int, int]], schema, finish: Callable) -> DataFrame:
    """`finish(batch, spans of its rows, kinds)` over the batches of `docs`: one pass, no shuffle.

    `rules`: kind -> (expression, group, least length of that group). Null and empty
    texts have no spans. The scanner is built once a task and goes with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kinds = [r[0] for r in scanner.rules]
        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(b.schema.get_field_index(text_col))]
            yield finish(b, [spans for part in _segments(texts) for spans in scanner.segment(part)], kinds)

    return docs.mapInArrow(released(run), schema)


def _joined(spans):
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def secret_report(docs: DataFrame, *, rules: dict[str, tuple[str, int, int]] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of `docs` (doc_id, text).

    Spans are in code points, end exclusive, by start, then kind as listed. Null and
    empty texts have none. Null ids and repeated rows are scanned like others; an
    empty table gives an empty table; other columns are not read.
    """
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    typed = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def finish(b: pa.RecordBatch, spans: list[Spans], kinds: list[str]) -> pa.RecordBatch:
        rows = [[{"kind": kinds[k], "start": x, "end": y} for x, y, k in s] for s in spans]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, typed)], names=["doc_id", "s_spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = scanned(docs.select("doc_id", "text"), "text", rules, f"doc_id {id_type}, s_spans {kind}", finish)
    count = lambda kind: F.size(F.filter("s_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("s_spans", lambda s: s["kind"].isin(*BASE_RULES))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_RULES),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("s_spans")).alias("spans"),
    )


def redact(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """`text` with each run of overlapping spans replaced by `mark`."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, *, mark: str = "[secret]", rules: dict[str, tuple[str, int, int]] = RULES) -> DataFrame:
    """`docs` (doc_id, text, lang, source, n_chars) with every secret in the texts replaced; n_chars follows.

    Null and empty texts stay as they are. Null ids and repeated rows are treated
    like others; an empty table gives an empty table; further columns pass through,
    whatever their names.
    """
    names = docs.columns
    where = names.index("text")

    def finish(b: pa.RecordBatch, spans: list[Spans], kinds: list[str]) -> pa.RecordBatch:
        if not any(spans):
            return b
        new = [redact(t.as_py(), [(x, y) for x, y, _ in s], mark) if s else t.as_py() for t, s in zip(b.column(where), spans)]
        return b.set_column(where, b.schema.field(where), pa.array(new, b.schema.field(where).type))

    found = scanned(docs, "text", rules, docs.schema, finish)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(names)
