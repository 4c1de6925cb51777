"""SimHash near-duplicate groups by bit-sliced comparison.

1. A 64-bit fingerprint per document from its 3-word shingles (numpy, per batch).
2. Equal fingerprints become one node. Every node goes to one bucket per band of
   64 bits: of `radius` + 1 bands, two fingerprints within the radius agree in one.
3. A bucket above `bucket_limit` is refined, not cut: its members share the band,
   so the other bits are banded again. Nodes are distinct, so after a few levels
   the free bits alone bound the bucket. No link is lost and no bucket is large.
4. Within a bucket the fingerprints stand as 64 vertical bit planes. Distances are
   counted for 64 lanes a word with carry-save adders, two planes a step, and
   words whose lanes are all beyond the radius are abandoned.
5. A bucket emits a star per group of linked nodes; connected components over the
   stars use large-star/small-star rounds, each round a written table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._shared import few_files, free_names, n_partitions, released, sized, stored

SEED = 42
SHINGLE = 3
FULL = (1 << 64) - 1
U64 = np.uint64


def fingerprint(text: bytes) -> int:
    """Of UTF-8 text: bit i is 1 where over half of the shingles' hashes have it. No words: 0."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    total, n = np.zeros(64, np.int64), 0
    while len(part := np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in itertools.islice(shingles, 65536)), U64)):
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(total * 2 > n, bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in b.column(1)], U64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bands(mask: int, parts: int) -> list[int]:
    """The bits that `mask` leaves free, in `parts` runs, each joined to `mask`."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in itertools.pairwise(cuts)]


def _planes(fps: np.ndarray) -> np.ndarray:
    """Row i holds bit i of every fingerprint (of one or more words), 64 lanes a word."""
    fps = fps.reshape(len(fps), -1)
    lanes = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), U64)
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(U64)


def near(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """Bit matrix (queries x words): which lanes of `planes` lie within `radius` of each query."""
    queries = queries.reshape(len(queries), -1)
    q, words = len(queries), planes.shape[1]
    out = np.zeros((q, words), U64)
    at = np.arange(words)
    count = [np.zeros((q, words), U64) for _ in range(max(1, radius.bit_length()))]  # vertical counters, lowest bit first
    over = np.zeros((q, words), U64)
    for i in range(0, len(planes), 2):
        flips = [0 - ((queries[:, k // 64] >> U64(k % 64)) & U64(1))[:, None] for k in (i, i + 1)]
        a, b = planes[i][at] ^ flips[0], planes[i + 1][at] ^ flips[1]
        half = count[0] ^ a
        carry = (count[0] & a) | (half & b)
        count[0] = half ^ b
        for k in range(1, len(count)):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if i % 8 == 6 and i >= 2 * radius:  # abandon the words that no query can still reach
            alive = (_beyond(count, over, radius) != U64(FULL)).any(axis=0)
            if not alive.any():
                return out
            if alive.mean() < 0.7:
                at, over, count = at[alive], over[:, alive], [c[:, alive] for c in count]
    out[:, at] = ~_beyond(count, over, radius)
    return out


def _beyond(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counters exceed `radius`."""
    more, same = over.copy(), ~over
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more |= same & count[k]
            same = same & ~count[k]
    return more


def _labels(fps: np.ndarray, radius: int) -> np.ndarray:
    """The smallest index of each fingerprint's group; groups are linked within this bucket."""
    n = len(fps)
    planes, label = _planes(fps), np.arange(n)
    links = [
        np.unpackbits(near(fps[k : k + 64], planes, radius).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
        for k in range(0, n, 64)
    ]
    while True:
        new = np.concatenate([np.where(m, label, n).min(axis=1) for m in links])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(fps: np.ndarray, group: np.ndarray, most: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of many small groups that stand one after the other: each lane against the next ones, all groups at once."""
    left, right = [], []
    for s in range(1, most):
        lanes = np.flatnonzero(group[s:] == group[:-s])
        if not len(lanes):
            break
        planes = _planes(fps[lanes] ^ fps[lanes + s])  # distance to the zero fingerprint
        hit = np.unpackbits(near(np.zeros(1, U64), planes, radius).view(np.uint8), bitorder="little")[: len(lanes)].astype(bool)
        left.append(lanes[hit])
        right.append(lanes[hit] + s)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int, small: int = 16) -> Iterator[pa.RecordBatch]:
    """From (mask, value, fp) sorted by bucket: a star of links per group of near fingerprints."""

    def linked(mask: np.ndarray, value: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(fps)])
        group = np.cumsum(new) - 1
        few = (sizes[group] > 1) & (sizes[group] <= small)
        a, b = _pairs(f := fps[few], group[few], small, radius)
        label = np.arange(len(f))
        while len(a):
            low = np.minimum(label[a], label[b])
            was = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (was == label).all():
                break
        us, vs = [f], [f[label]]
        for k in np.flatnonzero(sizes > small):
            own = fps[starts[k] : starts[k] + sizes[k]]
            us.append(own)
            vs.append(own[_labels(own, radius)])
        u, v = np.concatenate(us), np.concatenate(vs)
        apart = u != v
        return pa.RecordBatch.from_arrays([pa.array(x[apart].view(np.int64)) for x in (u, v)], names=["u", "v"])

    kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    for b in batches:
        columns = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, b.columns)]
        if len(columns[0]):
            last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            cut = int(np.argmax(last))  # sorted: the last bucket may go on in the next batch
            kept = [c[cut:] for c in columns]
            if cut:
                yield linked(columns[0][:cut], columns[1][:cut], columns[2][:cut].view(U64))
    if len(kept[0]):
        yield linked(kept[0], kept[1], kept[2].view(U64))


def near_links(nodes: DataFrame, radius: int = 2, bucket_limit: int = 1024) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of distinct `fp` within `radius` bits."""
    spark, parts = nodes.sparkSession, radius + 1
    masks = _bands(0, parts)
    members = nodes.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    found = None
    while True:
        members = members.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        large = stored(
            members.groupBy("mask", "value").count().where(F.col("count") > bucket_limit).select("mask", "value"), "simhash-large"
        )
        more = not large.isEmpty()
        fit = members.join(large, ["mask", "value"], "left_anti") if more else members
        links = (
            fit.select("mask", "value", "fp")
            .repartition(n_partitions(spark), "mask", "value")
            .sortWithinPartitions("mask", "value")
            .mapInArrow(lambda batches: bucket_links(batches, radius), "u bigint, v bigint")
        )
        found = links if found is None else found.union(links)
        if not more:
            return found
        finer = {m: _bands(m, parts) for m in masks}
        children = F.create_map(
            *itertools.chain.from_iterable(
                (F.lit(_signed(m)), F.array(*(F.lit(_signed(c)) for c in kids))) for m, kids in finer.items()
            )
        )
        members = stored(
            members.join(large, ["mask", "value"], "left_semi").select("fp", F.explode(children[F.col("mask")]).alias("mask")),
            "simhash-refined",
        )
        masks = sorted({c for kids in finer.values() for c in kids})


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches, by alternating star rounds.

    `links` has columns u and v. Every round is written, so lost executors repeat
    one round at most; rounds grow with the logarithm of the component size. A
    round never makes more links than it has, so few links are written to few files.
    """
    edges = stored(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components"
    )
    state, rows = None, edges.count()
    written = lambda df, label: stored(few_files(df, 2 * rows), label)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "components-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "components-large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "components-low")
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "components")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        state = new


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, bucket_limit: int = 1024
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of `docs`.

    Documents link where their fingerprints differ in at most `radius` bits;
    component_id is the smallest id reached. Null and empty texts have fingerprint
    zero and link like others. Null ids take part in linking but name no component
    unless it has nothing else (then component_id is null). Repeated rows give equal
    rows; an empty table an empty one. No other column of `docs` is read.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "simhash-fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    groups = components(near_links(nodes, radius, bucket_limit))
    labelled = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    named = stored(labelled.join(lowest, "label").select("fp", "component_id"), "simhash-components")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Groups by similarity of texts


WIDE = 8  # words of a wide fingerprint
KEYS = 18  # of a text; each joins some smallest hashes under orders of their own
MOST_ROWS = 3
ORDERS = np.random.default_rng(22).integers(0, 1 << 64, (2, WIDE + KEYS * MOST_ROWS), U64) | U64(1)


def _mixed(h: np.ndarray, orders: slice) -> np.ndarray:
    """A column of new hashes for each order."""
    x = (h[:, None] ^ ORDERS[1, orders]) * ORDERS[0, orders]
    x ^= x >> U64(31)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(29)
    return x


def rows_of(similarity: float) -> int:
    """How many smallest hashes a key joins: as many as leave 5e-6 at most of the pairs just alike enough without a common key."""
    return next((r for r in range(MOST_ROWS, 1, -1) if (1 - similarity**r) ** KEYS <= 5e-6), 1)


def wide_fingerprint(text: bytes, shingle: int, rows: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """A SimHash of 512 bits over the different shingles of a text, and its keys; None without words."""
    words = text.lower().split()
    if not words:
        return None
    columns = [words[i:] for i in range(min(shingle, len(words)))]
    h = np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*columns)), U64))
    total, least = np.zeros(64 * WIDE, np.int64), np.full(KEYS * rows, FULL, U64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        bits = np.unpackbits(_mixed(part, slice(0, WIDE)).view(np.uint8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint16)
        np.minimum(least, _mixed(part, slice(WIDE, WIDE + KEYS * rows)).min(axis=0), out=least)
    keys = least[:KEYS].copy()
    for r in range(1, rows):
        keys = (keys ^ keys >> U64(32)) * ORDERS[0, 0] + least[r * KEYS : (r + 1) * KEYS]
    return np.packbits(total * 2 > len(h), bitorder="little").view(U64), keys


def radius_of(similarity: float, bits: int = 64 * WIDE) -> int:
    """Bits at which sets of this Jaccard similarity differ, and four and a half standard deviations more.

    Of large sets 3.4e-6 miss it. Bits of small sets aren't normal: some 2e-2 of the pairs of 4 and 5 shingles at 0.8 miss
    it, and from 16 shingles on 5e-5 at most.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 4.5 * math.sqrt(bits * share * (1 - share)))


def _nearest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's lanes: those with an earlier one within the radius, the nearest earlier one, and its distance."""
    planes, us, vs, ds = _planes(fps), [], [], []
    for at in range(0, len(fps), 64):
        hit = np.unpackbits(near(fps[at : at + 64], planes, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
        own = np.arange(at, min(at + 64, len(fps)))
        q, lane = np.nonzero(hit.astype(bool) & (np.arange(len(fps)) < own[:, None]))
        distance = np.full(hit.shape, 64 * WIDE + 1)
        distance[q, lane] = np.bitwise_count(fps[at + q] ^ fps[lane]).sum(axis=1, dtype=np.int64)
        best = distance.argmin(axis=1)
        some = np.unique(q)
        us.append(own[some])
        vs.append(best[some])
        ds.append(distance[some, best[some]])
    return np.concatenate(us), np.concatenate(vs), np.concatenate(ds)


def similar_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """From (key, node, fp) sorted by key and node: of each node the nearest smaller one of its bucket within the radius, as (u, v, d)."""

    def linked(key: np.ndarray, node: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        us, vs, ds = [[np.zeros(0, np.int64)] for _ in range(3)]
        pair = starts[sizes == 2]  # most buckets of more than one have two: all of them at once
        if len(pair):
            apart = fps[pair] ^ fps[pair + 1]
            hit = np.unpackbits(near(np.zeros((1, fps.shape[1]), U64), _planes(apart), radius).view(np.uint8), bitorder="little")[: len(pair)].astype(bool)
            us.append(node[pair[hit] + 1])
            vs.append(node[pair[hit]])
            ds.append(np.bitwise_count(apart[hit]).sum(axis=1, dtype=np.int64))
        for k in np.flatnonzero(sizes > 2):
            own = slice(starts[k], starts[k] + sizes[k])
            u, v, d = _nearest(fps[own], radius)
            us.append(node[own][u])
            vs.append(node[own][v])
            ds.append(d)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, ds)], names=["u", "v", "d"])

    key, node, fps = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDE), U64)
    for b in batches:
        new = np.frombuffer(b"".join(b.column(2).to_pylist()), U64).reshape(-1, WIDE)
        key, node = (np.r_[old, c.to_numpy(zero_copy_only=False)] for old, c in zip((key, node), b.columns))
        fps = np.concatenate([fps, new])
        cut = int(np.argmax(key == key[-1])) if len(key) else 0
        if cut:
            yield linked(key[:cut], node[:cut], fps[:cut])
            key, node, fps = key[cut:], node[cut:], fps[cut:]
    if len(key):
        yield linked(key, node, fps)


def shingles(text: bytes, size: int) -> set[bytes]:
    words = text.lower().split()
    return set(map(b" ".join, zip(*(words[i:] for i in range(min(size, len(words)))))))


def alike(texts: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of the stored `pairs` (u, v: ids; u once) whose texts (doc_id, text) have shingle sets of at least this Jaccard similarity.

    A repeated id stands for one of its texts; which one doesn't matter, as equal ids leave one row anyway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _buckets(batches):
            u, v, sides = b.column(0)[0].as_py(), b.column(1)[0].as_py(), {}
            for side, t in zip(b.column(2).to_pylist(), b.column(3)):
                sides[side] = t
            p, q = (shingles(sides[k].as_buffer().to_pybytes(), shingle) for k in (0, 1))
            both = len(p & q)
            if both >= similarity * (len(p) + len(q) - both):
                yield pa.RecordBatch.from_arrays([pa.array([u], pa.int64()), pa.array([v], pa.int64())], names=["u", "v"])

    sides = F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(0).alias("side")), F.struct(F.col("v").alias("id"), F.lit(1).alias("side"))))
    asked = stored(pairs.select("u", "v", sides.alias("s")).select("u", "v", "s.*"), "similar-asked")
    both = texts.join(sized(asked), F.col("doc_id") == F.col("id")).select("u", "v", "side", "text")
    return both.repartition(n_partitions(texts.sparkSession), "u").sortWithinPartitions("u", "side", F.xxhash64("text")).mapInArrow(run, "u bigint, v bigint")


ACROSS = "key bigint, node bigint, fp binary, keys array<bigint>, k int, label bigint, side int"


def _across(
    fps: np.ndarray, keys: np.ndarray, k: np.ndarray, label: np.ndarray, side: np.ndarray, radius: int
) -> Iterator[tuple[int, np.ndarray]]:
    """Of a cell's lanes: each lane with the later ones within the radius that have another label, if any.

    Side 0: all with all, in a cell of one block; 1 and 2: two blocks, held against each other.

    A pair counts in the first bucket only that it shares: where it agrees in an earlier key, it is left to that.
    """
    planes = _planes(fps)
    for at in range(0, len(fps), 64):
        hit = np.unpackbits(near(fps[at : at + 64], planes, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)].astype(bool)
        for i in range(at, min(at + 64, len(fps))):
            to = i + 1 + np.flatnonzero(hit[i - at, i + 1 :])
            to = to[(label[to] != label[i]) & ((side[to] != side[i]) | (side[i] == 0))]
            to = to[~(keys[to, : k[i]] == keys[i, : k[i]]).any(axis=1)]
            if len(to):
                yield i, to


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch for each value of the first column, which is sorted."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for start, end in itertools.pairwise(cuts):
            if start == end:
                continue
            if kept and kept[-1].column(0)[0] != b.column(0)[start]:
                yield pa.concat_batches(kept)
                kept = []
            kept.append(b.slice(start, end - start))
    if kept:
        yield pa.concat_batches(kept)


def _members(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Fingerprints, keys, number of the key that made the bucket, labels and sides, of a cell in the columns of ACROSS."""
    fps = np.frombuffer(b"".join(b.column(2).to_pylist()), U64).reshape(-1, WIDE)
    keys = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, KEYS)
    return fps, keys, *(b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))


def unjoined(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Of cells (ACROSS, sorted by key): the members that have one of another label within the radius."""
    for b in _buckets(batches):
        some = np.zeros(b.num_rows, bool)
        for i, to in _across(*_members(b), radius):
            some[i] = True
            some[to] = True
        if some.any():
            yield b.filter(pa.array(some))


def joined(batches: Iterator[pa.RecordBatch], radius: int, similarity: float, shingle: int) -> Iterator[pa.RecordBatch]:
    """Of cells (ACROSS and text, sorted by key): links (u, v) that join all labels which have alike texts in a cell.

    Every pair within the radius is compared by its shingles, but those that links join already. Shingles are told
    apart by 64-bit hashes.
    """
    for b in _buckets(batches):
        fps, keys, k, label, side = _members(b)
        hashes = []
        for t in b.column(7):
            words = t.as_buffer().to_pybytes().lower().split()
            columns = [words[i:] for i in range(min(shingle, len(words)))]
            hashes.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*columns)), U64)))
        sizes = np.array([len(h) for h in hashes])
        vocabulary, places = np.unique(np.concatenate(hashes), return_inverse=True)
        sets = np.split(places, np.cumsum(sizes)[:-1])
        marked = np.zeros(len(vocabulary), bool)
        label, us, vs = label.copy(), [], []
        for i, to in _across(fps, keys, k, label.copy(), side, radius):
            # Jaccard is at most the smaller size by the greater.
            to = to[(label[to] != label[i]) & (np.minimum(sizes[to], sizes[i]) >= similarity * np.maximum(sizes[to], sizes[i]))]
            marked[sets[i]] = True
            for part in (to[x : x + 256] for x in range(0, len(to), 256)):
                both = np.add.reduceat(marked[np.concatenate([sets[j] for j in part])], np.r_[0, np.cumsum(sizes[part])[:-1]], dtype=np.int64)
                for j in part[both >= similarity * (sizes[part] + sizes[i] - both)].tolist():
                    if label[j] != label[i]:
                        us.append(i)
                        vs.append(j)
                        label[label == label[j]] = label[i]
            marked[sets[i]] = False
        if us:
            node = b.column(1).to_numpy(zero_copy_only=False)
            u, v = node[us], node[vs]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])


def _cells(members: DataFrame, labelled: DataFrame, mixed: DataFrame, limit: int) -> DataFrame:
    """The `members` (key, k, node) of mixed buckets in their cells, with what `labelled` says of nodes; `key` becomes the cell's.

    A bucket up to `limit` is one cell. Of a larger one, members of its commonest
    label and the others are dealt into blocks, and every block of others is held
    against each block of others and of the commonest label, which isn't held
    against itself. Rows so grow with the bucket, times the blocks of others.
    """
    large = F.col("n_major") + F.col("n_rest") > limit
    blocks = lambda c: F.when(large, F.ceil(F.col(c) * 2 / limit)).otherwise(1).cast("int")
    major = large & (F.col("label") == F.col("major"))
    placed = members.join(sized(mixed), "key").join(labelled.select("node", "fp", "keys", "label"), "node").withColumns({"rests": blocks("n_rest"), "majors": F.when(large, blocks("n_major")).otherwise(0), "is_major": major})
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.when(major, F.col("majors")).otherwise(F.col("rests"))).cast("int"))
    # Others meet others (kind 0, each pair of blocks once), and blocks of the commonest label (kind 1).
    cell = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.alias("side"))
    one = F.lit(1)
    others = F.transform(
        F.sequence(F.lit(0), F.col("rests") - 1),
        lambda i: cell(0, F.least(i, F.col("block")), F.greatest(i, F.col("block")), F.when(i == F.col("block"), 0).when(F.col("block") < i, 1).otherwise(2)),
    )
    to_major = F.when(
        F.col("majors") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("majors"), one) - 1), lambda i: cell(1, F.col("block"), i, F.lit(1)))
    ).otherwise(F.filter(others, lambda _: F.lit(False)))
    of_major = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda i: cell(1, i, F.col("block"), F.lit(2)))
    placed = placed.withColumn("cell", F.explode(F.when(F.col("is_major"), of_major).otherwise(F.concat(others, to_major))))
    return placed.select(F.xxhash64("key", "cell.kind", "cell.a", "cell.b").alias("key"), "node", "fp", "keys", "k", "label", F.col("cell.side").alias("side"))


def similar_groups(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, bucket_limit: int = 1024) -> DataFrame:
    """(doc_id, component_id) per document with an id: groups of texts whose `shingle`-word sets are `similarity` alike.

    Candidates come from SimHashes of 512 bits, which bit-sliced comparison holds
    against `radius_of(similarity)`. Texts meet in buckets of an equal key of
    `rows_of(similarity)` smallest shingle hashes; of 18 keys alike texts miss all
    with a chance of 2.5e-6, whatever the buckets' sizes.

    1. In each bucket (over the limit: in each of its blocks) a text proposes the
       nearest one before it; the nearest of all buckets is compared exactly, by
       shingle sets. So every text asks once, and large groups become one component.
    2. In buckets that still hold several components every pair within the radius
       is compared exactly, until a pair joins its two components; see `_cells`.

    Equal fingerprints with equal keys are one node. Documents without words, or
    without id, are groups of their own, left out here. Repeated rows get equal
    results, an empty table gives an empty table, other columns are not read.
    """
    radius, spark, rows_a_key = radius_of(similarity), docs.sparkSession, rows_of(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps, keys = [], [], []
            for doc_id, text in zip(b.column(0), b.column(1)):
                if doc_id.is_valid and text.is_valid and (made := wide_fingerprint(text.as_buffer().to_pybytes(), shingle, rows_a_key)):
                    ids.append(doc_id.as_py())
                    fps.append(made[0].tobytes())
                    keys.append(made[1].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fp", "keys"]
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    rows = stored(texts.mapInArrow(released(run), "doc_id bigint, fp binary, keys array<bigint>"), "similar-fingerprints")
    # Equal fingerprints and keys come from equal shingle sets, but for chance.
    nodes = stored(rows.groupBy("fp", "keys").agg(F.min("doc_id").alias("node")), "similar-nodes")
    # Fingerprints travel only where a bucket has two members: first keys and nodes meet, then these fetch the rest.
    keyed = nodes.select("node", F.posexplode("keys").alias("k", "value")).select(F.xxhash64("k", "value").alias("key"), "k", "node")
    counted = keyed.groupBy("key").count().where("count > 1")
    blocks = F.when(F.col("count") > bucket_limit, F.ceil(F.col("count") * 2 / bucket_limit)).otherwise(1)
    shared = stored(counted.select("key", blocks.cast("int").alias("n")), "similar-shared")
    met = stored(keyed.join(shared, "key"), "similar-met")
    block = F.pmod(F.xxhash64("node", "key"), F.col("n")).cast("int")
    links = (
        met.join(nodes.select("node", "fp"), "node")
        .select(F.xxhash64("key", block).alias("key"), "node", "fp")
        .repartition(n_partitions(spark), "key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(released(lambda batches: similar_links(batches, radius)), "u bigint, v bigint, d bigint")
    )
    pairs = stored(links.groupBy("u").agg(F.min(F.struct("d", "v")).alias("best")).select("u", "best.v"), "similar-pairs")
    near_ones = stored(alike(texts, pairs, similarity, shingle), "similar-links")
    groups = components(near_ones)
    labelled = stored(nodes.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node")), "similar-labels")
    groups = labelled.select("node", "label")
    by_label = met.select("key", "node").join(groups, "node").groupBy("key", "label").count()
    mixed = by_label.groupBy("key").agg(F.max(F.struct("count", "label")).alias("most"), F.sum("count").alias("n"), F.count("*").alias("labels"))
    mixed = mixed.where("labels > 1").select("key", F.col("most.label").alias("major"), F.col("most.count").alias("n_major"), (F.col("n") - F.col("most.count")).alias("n_rest"))
    open_ = stored(
        _cells(met.drop("n"), labelled, stored(mixed, "similar-mixed"), bucket_limit)
        .repartition(n_partitions(spark), "key")
        .sortWithinPartitions("key", "node")
        .mapInArrow(released(lambda batches: unjoined(batches, radius)), ACROSS),
        "similar-open",
    )
    if not open_.isEmpty():
        asked = stored(open_.select(F.col("node").alias("id")).distinct(), "similar-open-ids")
        some = texts.join(sized(asked), F.col("doc_id") == F.col("id")).groupBy(F.col("id").alias("node")).agg(F.max("text").alias("text"))
        rest = (
            open_.join(some, "node")
            .select("key", "node", "fp", "keys", "k", "label", "side", "text")
            .repartition(n_partitions(spark), "key")
            .sortWithinPartitions("key", "node")
            .mapInArrow(released(lambda batches: joined(batches, radius, similarity, shingle)), "u bigint, v bigint")
        )
        rest = stored(rest, "similar-rest")
        if not rest.isEmpty():
            groups = components(near_ones.union(rest))
    named = nodes.join(groups.distinct(), "node", "left").select("fp", "keys", F.coalesce("label", "node").alias("component_id"))
    return rows.join(stored(named, "similar-components"), ["fp", "keys"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One row of `docs` (doc_id, text, ...) for each of `similar_groups`: that with the smallest id.

    Rows that repeat an id are documents of their own where their texts differ: they
    are told apart by a hash of id and text, which takes the place of the id in the
    comparison. Of rows equal in id and text one stays. Rows without an id stay, and
    so does, for each id, its row without words (null or empty). An empty table gives
    an empty table; further columns pass through, whatever their names.
    """
    own, gone_id, twice_id, place = free_names(docs.columns, "own_id", "gone_id", "twice_id", "place")
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(twice_id)).agg(F.count("*").alias("n")).where("n > 1").select(twice_id)
    twice = stored(twice, "similar-repeated")
    repeats = not twice.isEmpty()
    key = docs.withColumn(own, F.col("doc_id").cast("long"))
    if repeats:
        key = docs.join(sized(twice), F.col("doc_id") == F.col(twice_id), "left").withColumn(
            own, F.when(F.col(twice_id).isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).otherwise(F.col("doc_id").cast("long"))
        )
    texts = key.select(F.col(own).alias("doc_id"), "text")
    gone = similar_groups(texts, **settings).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    left = key.join(sized(stored(gone, "similar-gone")), F.col(own) == F.col(gone_id), "left_anti")
    if not repeats:
        return left.select(docs.columns)
    once = left.where(F.col(twice_id).isNull())
    rank = F.row_number().over(Window.partitionBy(own).orderBy(F.lit(0)))
    repeated = left.where(F.col(twice_id).isNotNull()).withColumn(place, rank).where(F.col(place) == 1)
    return once.select(docs.columns).unionByName(repeated.select(docs.columns))
