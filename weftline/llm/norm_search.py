"""Hard-negative mining by norm-bucketed search.

1. Candidates are sorted by norm, largest first, and dealt out by ranges of it; a bucket is a run of rows of that order.
2. Anchors come in blocks of a bounded size, each held against all buckets. By Cauchy-Schwarz no score of a bucket exceeds
   the anchor's norm times the bucket's largest: a bucket is passed over where that lies below what the anchor still needs.
3. For positives that is the k-th score so far, seeded with the k-th score among the rows of the largest norms. For
   negatives it is the window's lower limit, which the positive's score gives, or the window's k-th score so far.
4. Tasks give the best of their buckets; the best of all tasks are the result.

Scores are exact whole numbers: in doubles where no sum can exceed 2**53, else in Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._shared import in_blocks, n_partitions, released, stored

BUCKET = 2048  # rows
SLICE = 512  # anchors scored at once
SLACK = 1 + 1e-9  # of rounded norms


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of whole numbers as doubles; shorter vectors are filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(vectors.flatten().to_numpy(zero_copy_only=False))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; beyond 64 bits the nearest number of 64 bits."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in r] for r in m] or np.zeros((0, d)), object) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The first `k` by score (highest first) and id (smallest first, null last) of what is added."""

    __slots__ = ("k", "ids", "null", "score")

    def __init__(self, k: int):
        self.k = k
        self.ids, self.null, self.score = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def kth(self) -> int | None:
        """Below this no score takes a place any more; None while there are fewer than `k`."""
        return int(self.score[-1]) if len(self.score) == self.k else None

    def add(self, ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        ids, null, score = np.r_[self.ids, ids], np.r_[self.null, null], np.r_[self.score, score]
        order = np.lexsort((ids, null, -1 - score))[: self.k]  # -1 - x is its own kind of descending and can't overflow
        self.ids, self.null, self.score = ids[order], null[order], score[order]


def _reach(anchors: Rows, bucket: Rows) -> np.ndarray:
    """What no score of an anchor within the bucket exceeds."""
    with np.errstate(all="ignore"):
        return np.nan_to_num(anchors.norm * bucket.norm.max() * SLACK, nan=np.inf, posinf=np.inf)


class Rows:
    """A bucket, or a block of anchors."""

    def __init__(self, b: pa.RecordBatch):
        self.null = b.column(0).is_null().to_numpy(zero_copy_only=False)
        self.ids = b.column(0).cast(pa.int64()).fill_null(0).to_numpy()
        self.label, self.norm = b.column(1).to_numpy(), b.column(3).to_numpy()
        self.vectors = matrix(b.column(2))

    def __len__(self) -> int:
        return len(self.ids)

    def others(self, ids: np.ndarray, null: np.ndarray, at: int) -> np.ndarray:
        """Which rows don't carry the id of row `at`."""
        return (ids != self.ids[at]) | (null != self.null[at])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for b in batches:
        for at in range(0, b.num_rows, BUCKET):
            yield Rows(b.slice(at, BUCKET))


class Positives:
    """Of each anchor the first `k` rows of its label."""

    def __init__(self, anchors: Rows, seeds: np.ndarray | None, k: int):
        self.anchors, self.best = anchors, [Best(k) for _ in anchors.ids]
        #: Below this a row can't be among the first k. Where fewer than k rows are known, the lowest number.
        self.least = np.full(len(anchors), np.iinfo(np.int64).min) if seeds is None else seeds.copy()
        self.passed = 0  # pairs of an anchor and a bucket that were passed over

    def add(self, bucket: Rows) -> None:
        anchors, reach = self.anchors, _reach(self.anchors, bucket)
        near = np.flatnonzero(reach >= self.least)
        self.passed += len(anchors) - len(near)
        for at in range(0, len(near), SLICE):
            own = near[at : at + SLICE]
            for i, score in zip(own.tolist(), products(anchors.vectors[own], bucket.vectors)):
                some = np.flatnonzero((bucket.label == anchors.label[i]) & (score >= self.least[i]))
                some = some[anchors.others(bucket.ids[some], bucket.null[some], i)]
                if len(some):
                    self.best[i].add(bucket.ids[some], bucket.null[some], score[some])
                    if (kth := self.best[i].kth) is not None:
                        self.least[i] = max(self.least[i], kth)


class Negatives:
    """Of each anchor and window (upper limit, the lower one follows) the first `k` rows of other labels."""

    def __init__(self, anchors: Rows, tops: list[list[int]], low: int, k: int):
        self.anchors, self.passed = anchors, 0
        self.windows = [[(t, -(-low * t // 100), Best(k)) for t in own] for own in tops]

    def add(self, bucket: Rows) -> None:
        anchors, reach = self.anchors, _reach(self.anchors, bucket).tolist()
        needs = [[max(bottom, -(2**63) if best.kth is None else best.kth) for _, bottom, best in own] for own in self.windows]
        near = np.array([i for i, own in enumerate(needs) if any(n <= reach[i] for n in own)], np.int64)
        self.passed += len(anchors) - len(near)
        for at in range(0, len(near), SLICE):
            own = near[at : at + SLICE]
            for i, score in zip(own.tolist(), products(anchors.vectors[own], bucket.vectors)):
                some = np.flatnonzero((bucket.label != anchors.label[i]) & (score >= min(needs[i])))
                some = some[anchors.others(bucket.ids[some], bucket.null[some], i)]
                for (top, bottom, best), need in zip(self.windows[i], needs[i]):
                    fit = some[(score[some] >= max(need, bottom)) & (score[some] <= top)]
                    if len(fit):
                        best.add(bucket.ids[fit], bucket.null[fit], score[fit])


def _given(found: list[tuple[int, int, Best]]) -> pa.RecordBatch:
    """(place, top, id, score) of lists by anchor's place and window."""
    sizes = [len(b.ids) for *_, b in found]
    columns = [np.repeat(np.array([f[k] for f in found], np.int64), sizes) for k in (0, 1)]
    ids, null, score = (np.concatenate([np.zeros(0, kind), *(getattr(b, name) for *_, b in found)]) for name, kind in (("ids", np.int64), ("null", bool), ("score", np.int64)))
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ids, mask=null), pa.array(score)], names=["place", "top", "id", "score"])


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("place", "top").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


GIVEN = "place bigint, top bigint, id bigint, score bigint"


def by_norm(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector, norm) of the rows that take part, stored by norm, the largest first. Equal norms are dealt out by id."""
    x = F.col("embedding")
    fit = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(F.col("label").isNotNull() & x.isNotNull() & fit)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda v: 256 * v.cast("double")).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                norm = np.sqrt((matrix(b.column(2)) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm)], names=["vec_id", "label", "vector", "norm"])

    normed = rows.mapInArrow(released(run), "vec_id bigint, label bigint, vector array<double>, norm double")
    parts = n_partitions(rows.sparkSession)
    return stored(normed.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"), "norm-sorted")


def hard_negatives(rows: DataFrame, *, every: int = 100, k: int = 5, low: int = 80, block_values: int = 2_000_000) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `rows` (vec_id, embedding, label).

    Anchors are rows whose vec_id is divisible by `every`; their positives the first `k` other rows of the label;
    their negatives, for each positive, the first `k` rows of other labels with `low` percent of its score to all of it.

    Rows with a null label or vector, or a component that is null or not finite, take no part. A null vec_id is no
    anchor, and stands behind others of its score. Rows that share an id are rows of their own, but never another
    row of each other: an anchor's own id is neither positive nor negative for it, and an anchor that comes twice
    has its rows twice. Shorter vectors count as filled up with zeros; an empty one scores 0. Scores beyond 64 bits
    are given as the nearest number of 64 bits. An empty table gives an empty one; other columns are not read.
    """
    spark = rows.sparkSession
    candidates = by_norm(rows)
    top = candidates.orderBy(F.desc("norm"), "vec_id").limit(BUCKET)
    top = spark.sparkContext.broadcast(top.toArrow())
    anchors = candidates.where(F.col("vec_id") % every == 0)
    lowest = np.iinfo(np.int64).min

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [Rows(b) for b in top.value.to_batches() if b.num_rows]
        for b in batches:
            search = Positives(Rows(b), None, k)
            for bucket in first:
                search.add(bucket)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([lowest if s.kth is None else s.kth for s in search.best], pa.int64())], names=[*b.schema.names, "seed"])

    anchors = anchors.mapInArrow(released(seeded), "vec_id bigint, label bigint, vector array<double>, norm double, seed bigint")
    blocks, anchors = in_blocks(anchors, F.size("vector") + 1, block_values, "norm-anchors")
    found = None
    for block in blocks:
        one = _mined(candidates, anchors.where(F.col("block") == block).orderBy("row").drop("row", "block").toArrow(), k, low)
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return found


def _mined(candidates: DataFrame, block: pa.Table, k: int, low: int) -> DataFrame:
    """The result for one block of anchors."""
    spark = candidates.sparkSession
    sent = spark.sparkContext.broadcast(block)
    anchors = lambda: Rows(sent.value.combine_chunks().to_batches()[0])

    def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Positives(anchors(), sent.value.column("seed").to_numpy(), k)
        for bucket in _buckets(batches):
            search.add(bucket)
        yield _given([(i, 0, b) for i, b in enumerate(search.best)])

    positives = stored(_first(candidates.mapInArrow(released(positive), GIVEN), k), "norm-positives").where("score >= 0")
    tops: list[list[int]] = [[] for _ in range(block.num_rows)]
    for r in positives.select("place", "score").distinct().collect():  # k at most an anchor of the block
        tops[r["place"]].append(r["score"])
    tops_sent = spark.sparkContext.broadcast(tops)

    def negative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Negatives(anchors(), tops_sent.value, low, k)
        for bucket in _buckets(batches):
            search.add(bucket)
        yield _given([(i, top, best) for i, own in enumerate(search.windows) for top, _, best in own])

    negatives = stored(_first(candidates.mapInArrow(released(negative), GIVEN), k), "norm-negatives")
    names = spark.createDataFrame(list(enumerate(block.column("vec_id").to_pylist())), "place bigint, anchor_id bigint")
    asked = positives.select("place", F.col("score").alias("top"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = negatives.join(asked, ["place", "top"]).join(F.broadcast(names), "place")
    return joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
