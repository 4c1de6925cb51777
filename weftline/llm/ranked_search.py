"""Ranked lexical search: a threshold-seeded join of items and documents.

1. One pass over the documents counts all terms, and the occurrences of the items' terms; the counts are stored.
2. A term's weight times its share in a document is an impact. Of every term the k-th highest impact and the highest are
   stored: an item's k-th score is at least the k-th impact of any of its terms, which seeds its threshold.
3. An item's terms are ordered by their highest impact. Where what remains behind a place, the sum of the highest impacts
   there, lies below the threshold, documents that hold only those terms can't be among the k: the terms before it
   generate the candidates. Candidates that still can reach the threshold are rescored exactly over all terms. Each
   task raises its thresholds by the k best it has seen, and gives those; the k best of all tasks are the result.

Items come in blocks of a bounded number of terms, each held against all documents. No posting list is shuffled.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._shared import in_blocks, released, stored
from weftline.llm.decontaminate import NORMAL, SPLIT

PIECE = 4 << 20  # bytes of a text that are split into words at once
DOCS = 4096  # documents scored at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms of a text, and the numbers and occurrences of those in the vocabulary. A long text goes piece by piece."""
    flat, at, n, found = text.translate(NORMAL), 0, 0, [np.zeros(0, np.int32)]
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        words = flat[at:end].split()
        ids = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))
        found.append(ids[ids >= 0])
        n, at = n + len(words), end
    return n, *np.unique(np.concatenate(found), return_counts=True)


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the rows with at least one term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            told = [term_counts(t.as_buffer().to_pybytes(), known) if t.is_valid else (0, [], []) for t in b.column(1)]
            some = [i for i, t in enumerate(told) if t[0]]
            ends = np.cumsum([0, *(len(told[i][1]) for i in some)], dtype=np.int32)
            lists = [
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0), *(told[i][k] for i in some)]).astype(np.int32))) for k in (1, 2)
            ]
            ids = b.column(0).take(pa.array(some, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([told[i][0] for i in some], pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, terms array<int>, tfs array<int>")


def _postings(b: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, place of the document in the batch, impact) of a batch of counted documents."""
    terms, tfs = (b.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
    doc = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
    m = np.array([50 + 50 * n * n_docs // n_terms for n in b.column(1).to_pylist()], np.int64)
    return terms, doc, weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))


def _impacts(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term, kth, most): the k-th highest impact of each term, 0 if fewer, and the highest."""
    sent = counted.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, impact = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            t, _, i = _postings(b, sent.value, n_docs, n_terms)
            term, impact = np.r_[term, t], np.r_[impact, i]
            order = np.lexsort((-impact, term))
            term, impact = term[order], impact[order]
            start = np.maximum.accumulate(np.where(np.r_[True, term[1:] != term[:-1]], np.arange(len(term)), 0)) if len(term) else term
            best = np.arange(len(term)) - start < k
            term, impact = term[best], impact[best]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(impact)], names=["term", "impact"])

    best = counted.mapInArrow(released(run), "term bigint, impact bigint")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    best = best.withColumn("place", place).where(F.col("place") <= k)
    return best.groupBy("term").agg(F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth"), F.max("impact").alias("most"))


class Ranker:
    """Items against documents, batch by batch; keeps the k best of each item."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, kth: np.ndarray, most: np.ndarray, k: int):
        self.weights, self.k = weights, k
        self.terms = [t[np.argsort(-most[t], kind="stable")] for t in items]
        #: Of each item and place: the most that the terms from there on can add.
        self.rest = [np.r_[np.cumsum(most[t][::-1])[::-1], 0] for t in self.terms]
        self.least = np.array([kth[t].max(initial=0) for t in items], np.int64)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]
        self.scored = 0  # candidates that were rescored

    def add(self, ids: np.ndarray, null: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        term, doc, impact = postings
        order = np.argsort(term, kind="stable")
        term, doc, impact = term[order], doc[order], impact[order]
        known, starts = np.unique(term, return_index=True)
        slices = dict(zip(known.tolist(), itertools.pairwise([*starts.tolist(), len(term)])))
        for item, terms in enumerate(self.terms):
            least, rest = self.least[item], self.rest[item]
            total = np.zeros(len(ids), np.int64)
            # The terms behind `head` can't bring a document to the threshold by themselves.
            head = next((p for p in range(len(terms) + 1) if rest[p] < least), len(terms))
            for t in terms[:head].tolist():
                if at := slices.get(t):
                    total[doc[slice(*at)]] += impact[slice(*at)]
            alive = np.flatnonzero((total > 0) & (total + rest[head] >= least))
            if not len(alive):
                continue
            self.scored += len(alive)
            for t in terms[head:].tolist():
                if at := slices.get(t):
                    total[doc[slice(*at)]] += impact[slice(*at)]
            alive = alive[total[alive] >= least]
            if len(alive):
                self._keep(item, ids[alive], null[alive], total[alive])

    def _keep(self, item: int, *new: np.ndarray) -> None:
        ids, null, score = map(np.concatenate, zip(self.best[item], new))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.best[item] = ids[order], null[order], score[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], score[order[-1]])


def _ranked(counted: DataFrame, items: list[np.ndarray], weights: np.ndarray, kth: np.ndarray, most: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(place, doc_id, score): of each item, by its place in `items`, the k best."""
    sent = counted.sparkSession.sparkContext.broadcast((items, weights, kth, most))
    kind = counted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(*sent.value, k)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                b = whole.slice(at, DOCS)
                null = b.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = b.column(0).cast(pa.int64()).fill_null(0).to_numpy()
                ranker.add(ids, null, _postings(b, ranker.weights, n_docs, n_terms))
        place = np.repeat(np.arange(len(items)), [len(b[0]) for b in ranker.best])
        ids, null, score = (np.concatenate([np.zeros(0, kind), *(b[i] for b in ranker.best)]) for i, kind in enumerate((np.int64, bool, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(ids, mask=null), pa.array(score)], names=["place", "doc_id", "score"])

    best = counted.mapInArrow(released(run), "place bigint, doc_id bigint, score bigint").withColumn("doc_id", F.col("doc_id").cast(kind))
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 50, block_terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of `items` (item_id, text) the k best rows of `docs` (integer doc_id, text).

    Scores are those of the contract: a term's weight by its document frequency times its share in a document,
    in whole numbers. Only scores above 0 are ranked; equal scores stand by ascending doc_id, null ids last. A
    null text and one without terms is no document and ranks nothing. Rows of `docs` that repeat an id are
    documents of their own and may both be ranked; a row of `items` that repeats an id has ranks of its own. An
    empty table on either side gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    words = F.array_distinct(F.filter(F.split(F.translate("text", UPPER, LOWER), SPLIT), lambda w: w != ""))
    asked = items.select("item_id", words.alias("terms")).where(F.size("terms") > 0)
    blocks, asked = in_blocks(asked, F.size("terms"), block_terms, "ranked-items")
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for block in blocks:
        rows = asked.where(F.col("block") == block).orderBy("row").collect()
        vocabulary: dict[bytes, int] = {}
        own = [np.array([vocabulary.setdefault(t.encode(), len(vocabulary)) for t in r["terms"]], np.int64) for r in rows]
        counted = stored(_counted(docs, vocabulary), "ranked-counts")
        n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        kth, most = np.zeros((2, len(vocabulary)), np.int64)
        for r in stored(_impacts(counted, weights, n_docs, n_terms, k), "ranked-impacts").collect():
            kth[r["term"]], most[r["term"]] = r["kth"], r["most"]
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"place bigint, item_id {kind}")
        one = _ranked(counted, own, weights, kth, most, n_docs, n_terms, k).join(F.broadcast(ids), "place").select("item_id", "rank", "doc_id", "score")
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    return found
