"""Exact substring dedup with suffix sorting by bucket-pointer refinement.

Every byte that a string of `length` bytes covers which also starts elsewhere is
removed. All suffixes of a corpus are too many to sort, so the suffixes sorted are
those at anchors: of the q-grams of a window of `length` bytes the one with the
smallest hash. Equal windows have equal anchors at equal offsets, so

1. anchors are bucketed by their q-gram, and buckets of one are done (a count with
   partial aggregation, so a q-gram that a third of all rows hold costs no more);
2. buckets are split by the bytes around the anchor that its windows span; windows
   of a class with two members are repeated, whatever else its bucket holds;
3. one member of each class of the other buckets sends these bytes. Its suffix from
   the anchor, and its prefix backwards, are sorted: the bucket identifiers of 8-byte
   blocks give those of 16, 32, 64, ... bytes, and a bucket is refined by sorting on
   the identifiers at later offsets, as long as it has two members. Sorted order and
   common-prefix lengths then give, for every window offset, which windows are equal.

A bucket with over `bucket_limit` classes isn't sorted in one task. It is refined
across tasks by the same pointers: its windows' offsets are halved, windows of a
half share the bytes at later offsets, and the identifier of these bytes parts the
bucket. Again one member of each class goes on, and halves are halved until a part
is small enough to sort; a part of one offset has one class, so this ends. Strings
are taken for equal by 128 bits of hashes: those of the q-gram or of the part, and
that of the bytes. Rows are numbered once, in a stored copy of ids and texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._shared import n_partitions, released, sized, stored

U64 = np.uint64
GRAM = 32
CHUNK = 1 << 20
PLACE = U64((1 << 24) - 1)
BYTE_CODES = np.random.default_rng(20).integers(0, 1 << 64, 256, U64)
MULTIPLIERS = [U64(x | 1) for x in np.random.default_rng(21).integers(0, 1 << 64, 5, U64)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the 32 bytes from each place on: of halves, of halves of halves, and so on."""
    h = BYTE_CODES[data]
    for k, m in enumerate(MULTIPLIERS):
        h = h[: -(1 << k)] * m + h[1 << k :]
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def anchors(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts joined to `data`, up to `ends`: per anchor its q-gram's hash and place, and its first and last window."""
    flat = np.frombuffer(data, np.uint8)
    if len(flat) < length:
        return (np.zeros(0, U64),) + (np.zeros(0, np.int64),) * 3
    hashes = _gram_hashes(flat)
    low = _sliding_min((hashes & ~PLACE) | np.arange(len(hashes), dtype=U64), length - GRAM + 1)
    place = (low & PLACE).astype(np.int64)
    end = np.repeat(ends, np.diff(np.r_[0, ends]))[: len(place)]
    windows = np.flatnonzero(np.arange(len(place)) + length <= end)  # those within one text
    if not len(windows):
        return (np.zeros(0, U64),) + (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.r_[True, np.diff(place[windows]) != 0])
    first, last = windows[new], windows[np.r_[new[1:], len(windows)] - 1]
    return hashes[place[first]], place[first], first, last


def _chunks(rids: list[int], texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Texts joined to chunks; one longer than a chunk comes in parts that share `length` - 1 bytes."""
    ids, offsets, parts, size = [], [], [], 0
    for rid, text in zip(rids, texts):
        for at in range(0, max(len(text) - length + 1, 0), CHUNK):
            part = text[at : at + CHUNK + length - 1] if len(text) > CHUNK else text
            ids.append(rid)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield ids, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])
                ids, offsets, parts, size = [], [], [], 0
    if parts:
        yield ids, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, with_class: bool) -> Iterator[pa.RecordBatch]:
    """From (rid, text): (h) of each anchor, or (h, sig, rid, pack); pack holds first window, windows and anchor offset."""
    for b in batches:
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(1)]
        for ids, offsets, data, ends in _chunks(b.column(0).to_pylist(), texts, length):
            h, place, first, last = anchors(data, ends, length)
            columns = [pa.array(h.view(np.int64))]
            if with_class:
                view = memoryview(data)
                digest = xxhash.xxh3_64_intdigest
                sig = np.fromiter(
                    (digest(view[a:z]) for a, z in zip(first.tolist(), (last + length).tolist())), U64, len(first)
                )
                which = np.searchsorted(ends, first, "right")
                start = first - np.r_[0, ends][which] + np.array(offsets, np.int64)[which]
                pack = start << 16 | (last - first) << 8 | (place - first)
                columns += [pa.array(sig.view(np.int64)), pa.array(np.array(ids, np.int64)[which]), pa.array(pack)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "sig", "rid", "pack"][: len(columns)])


def _pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-preserving identifiers of the pairs (a, b)."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].reshape(a.shape)


def refine(bucket: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Identifiers, in sorted order, of `strings` (rows of bytes) within their buckets, by bucket-pointer refinement."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    codes = np.ascontiguousarray(padded).view(">u8").astype(U64)
    blocks = np.unique(codes, return_inverse=True)[1].reshape(codes.shape)  # identifiers of 8-byte blocks
    ids, done = _pair_ranks(bucket, blocks[:, 0]), 1
    while done < padded.shape[1] // 8:
        # ids cover `done` blocks; so does each identifier in `blocks`, and the next one starts where ids end.
        active = np.bincount(ids)[ids] > 1
        if not active.any():
            break
        later = np.zeros(n, np.int64)
        later[active] = blocks[active, 1] if blocks.shape[1] > 1 else 0
        ids = _pair_ranks(ids, later)
        odd = blocks.shape[1] % 2
        if odd:
            blocks = np.concatenate([blocks, np.zeros((n, 1), blocks.dtype)], axis=1)
        blocks = _pair_ranks(blocks[:, 0::2], blocks[:, 1::2])  # reused: identifiers of blocks twice as long
        done *= 2
    return ids


def _sorted_prefixes(bucket: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order, and the common-prefix length of each row with the one before (-1: another bucket)."""
    order = np.argsort(refine(bucket, strings), kind="stable")
    s, g = strings[order], bucket[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return order, np.r_[-1, np.where(g[1:] == g[:-1], common, -1)]


def repeated_windows(bucket: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bit (context, offset): windows that start `offset` bytes before the anchor and have an equal in the bucket.

    left: bytes before the anchor, nearest first; right: from the anchor on. Of a
    context the offsets low to high are windows of its own.
    """
    n, length = right.shape
    found = np.zeros((n, left.shape[1] + 1), bool)
    order_l, common_l = _sorted_prefixes(bucket, left)
    order_r, common_r = _sorted_prefixes(bucket, right)
    class_l, class_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= offset) & (offset <= high))
        if len(own) < 2:
            continue
        class_l[order_l] = np.cumsum(common_l < offset)
        class_r[order_r] = np.cumsum(common_r < length - offset)
        key = class_l[own] * (n + 1) + class_r[own]
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        found[own[order[np.r_[False, same] | np.r_[same, False]]], offset] = True
    return found


def _context_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From (rid, text, asked: [(h, pack, large)]): the bytes that the windows span."""
    for b in batches:
        rows: list[tuple] = []
        for rid, text, asked in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            data = text.as_buffer().to_pybytes()
            for x in asked:
                start, windows = x["pack"] >> 16, x["pack"] >> 8 & 255
                rows.append((x["h"], rid, x["pack"], data[start : start + windows + length], x["large"]))
            if len(rows) >= 8192:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "rid", "pack", "bytes", "large"])


def _sorted_buckets(batches: Iterator[pa.RecordBatch], length: int, most: int = 16384) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by bucket: the spans (rid, start, end) of windows with an equal; whole buckets at a time.

    Of a context the windows that start `low` to `high` bytes before its anchor count.
    """

    def spans(table: pa.Table) -> pa.RecordBatch:
        h, rid, pack, least, most_ = (table.column(c).to_numpy() for c in ("bucket", "rid", "pack", "low", "high"))
        start, offset = pack >> 16, pack & 255
        n = len(h)
        column = table.column("bytes").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        places = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        flat = np.r_[np.frombuffer(column.buffers()[2], np.uint8), np.zeros(1, np.uint8)]
        anchor = places[:-1] + offset
        reach = length - GRAM
        to_left = anchor[:, None] - 1 - np.arange(reach)
        to_right = anchor[:, None] + np.arange(length)
        left = np.where(to_left >= places[:-1, None], flat[np.maximum(to_left, 0)], 0).astype(np.uint8)
        right = np.where(to_right < places[1:, None], flat[np.minimum(to_right, len(flat) - 1)], 0).astype(np.uint8)
        bucket = np.unique(h, return_inverse=True)[1]
        found = repeated_windows(bucket, left, right, least, most_)
        # Offsets fall as windows move on: runs of offsets are runs of windows.
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        at = start[row] + offset[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(rid[row]), pa.array(at - high), pa.array(at - low + length)], names=["rid", "start", "end"]
        )

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= most:
            table = pa.Table.from_batches(held)
            h = table.column("bucket").to_numpy()
            cut = int(np.argmax(h == h[-1]))  # the last bucket may go on
            if cut:
                for part in _whole_buckets(h[:cut], most):
                    yield spans(table.slice(part.start, part.stop - part.start))
                held = table.slice(cut).to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        for part in _whole_buckets(table.column("bucket").to_numpy(), most):
            yield spans(table.slice(part.start, part.stop - part.start))


def _whole_buckets(h: np.ndarray, most: int) -> Iterator[slice]:
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    at = 0
    while at < len(h):
        k = np.searchsorted(starts, at + most, "right") - 1
        end = len(h) if at + most >= len(h) else int(starts[k]) if starts[k] > at else int(starts[k + 1]) if k + 1 < len(starts) else len(h)
        yield slice(at, end)
        at = end


OFFSET, WINDOWS, FIRST = "(pack & 255)", "(shiftright(pack, 8) & 255)", "shiftright(pack, 16)"


def _halves(members: DataFrame, length: int) -> DataFrame:
    """Of contexts (bucket, rid, pack, bytes, a, b): a row for each half of the offsets a to b that has windows of theirs.

    The half's windows share the bytes from a before the anchor on, up to where the
    window ends that starts b before it; with these the bucket is parted. `low` to
    `high` are the context's own windows of the half, `sig` is what they span.
    """
    halves = F.expr("explode(array(struct(a as a, (a + b) div 2 as b), struct((a + b) div 2 + 1 as a, b as b)))")
    parts = members.select("bucket", "rid", "pack", "bytes", halves.alias("half")).where("half.a <= half.b")
    parts = parts.select("bucket", "rid", "pack", "bytes", "half.*").withColumns(
        {"low": F.expr(f"greatest(a, {OFFSET} - {WINDOWS})"), "high": F.expr(f"least(b, {OFFSET})")}
    )
    shared = f"substring(bytes, cast({OFFSET} - a + 1 as int), cast(a + {length} - b as int))"
    own = f"substring(bytes, cast({OFFSET} - high + 1 as int), cast(high + {length} - low as int))"
    return parts.where("low <= high").select(
        F.expr(f"xxhash64(bucket, a, b, {shared})").alias("bucket"), "rid", "pack", "bytes", "a", "b", "low", "high", F.expr(f"xxhash64(low, high, {own})").alias("sig")
    )


def _told(rows: DataFrame, label: str, with_bytes: bool = False) -> DataFrame:
    """`rows` (bucket, sig, rid, pack ...) of buckets with two members: with n, how many are of the same class, the
    bucket's `kinds` of classes, and whether the row is the one that stands for its class (`sends`).

    Where rows hold bytes, they don't move for this as long as the classes can be broadcast, and go where they aren't needed.
    """
    classes = stored(rows.groupBy("bucket", "sig").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pack")).alias("sender")), f"{label}-classes")
    kinds = stored(classes.groupBy("bucket").agg(F.count("*").alias("kinds")).where("kinds > 1"), f"{label}-buckets")
    classes = classes.join(kinds, "bucket", "left").where("n > 1 or kinds is not null")
    classes = stored(classes.select(F.col("bucket").alias("c_bucket"), F.col("sig").alias("c_sig"), "n", "sender", F.coalesce("kinds", F.lit(1)).alias("kinds")), f"{label}-classes")
    met = rows.join(sized(classes) if with_bytes else classes, (F.col("bucket") == F.col("c_bucket")) & (F.col("sig") == F.col("c_sig")))
    met = met.withColumn("sends", F.struct("rid", "pack") == F.col("sender")).drop("c_bucket", "c_sig", "sender")
    if with_bytes:
        met = met.withColumn("bytes", F.when(F.col("sends") & (F.col("kinds") > 1), F.col("bytes"))).where("n > 1 or bytes is not null")
    return met


def repeated_spans(texts: DataFrame, *, length: int = 200, bucket_limit: int = 1024) -> DataFrame:
    """(rid, spans): the byte spans that repeated strings cover, unordered and overlapping, per row of `numbered` texts that has any."""
    if not GRAM < length <= GRAM + 223:
        raise ValueError("length must be 33 to 255")
    spark = texts.sparkSession

    def rows(with_class: bool) -> DataFrame:
        schema = "h bigint, sig bigint, rid bigint, pack bigint" if with_class else "h bigint"
        return texts.select("rid", "text").mapInArrow(released(lambda batches: _anchor_rows(batches, length, with_class)), schema)

    grams = rows(False).groupBy("h").count().where("count > 1").select(F.col("h").alias("g"))
    met = stored(rows(True).join(stored(grams, "suffix-grams"), F.col("h") == F.col("g")).select(F.col("h").alias("bucket"), "sig", "rid", "pack"), "suffix-anchors")
    told = stored(_told(met, "suffix"), "suffix-told")
    spans = told.where("n > 1").select("rid", F.expr(f"{FIRST} as start"), F.expr(f"{FIRST} + {WINDOWS} + {length} as end"))
    asked = told.where("kinds > 1 and sends")

    # Texts are dealt out once for the contexts of all buckets, and once more at the end.
    of_row = asked.groupBy(F.col("rid").alias("a_rid")).agg(
        F.collect_list(F.struct(F.col("bucket").alias("h"), "pack", (F.col("kinds") > bucket_limit).alias("large"))).alias("asked")
    )
    joined = texts.join(of_row, F.col("rid") == F.col("a_rid")).select("rid", "text", "asked")
    contexts = joined.mapInArrow(released(lambda batches: _context_rows(batches, length)), "bucket bigint, rid bigint, pack bigint, bytes binary, large boolean")
    contexts = stored(contexts, "suffix-contexts", "zstd")

    def sorted_in_tasks(members: DataFrame) -> DataFrame:
        return (
            members.select("bucket", "rid", "pack", "bytes", "low", "high")
            .repartition(n_partitions(spark), "bucket")
            .sortWithinPartitions("bucket")
            .mapInArrow(released(lambda batches: _sorted_buckets(batches, length)), "rid bigint, start bigint, end bigint")
        )

    spans = spans.union(sorted_in_tasks(contexts.where("not large").withColumns({"low": F.expr(f"{OFFSET} - {WINDOWS}"), "high": F.expr(OFFSET)})))
    if not told.where(F.col("kinds") > bucket_limit).isEmpty():
        large = contexts.where("large").withColumns({"a": F.lit(0).cast("long"), "b": F.lit(length - GRAM).cast("long")})
        while not large.isEmpty():
            parted = stored(_told(_halves(large, length), "suffix-parts", with_bytes=True), "suffix-parted", "zstd")
            place = f"{FIRST} + {OFFSET}"
            spans = spans.union(parted.where("n > 1").select("rid", F.expr(f"{place} - high as start"), F.expr(f"{place} - low + {length} as end")))
            left = parted.where("kinds > 1 and sends")
            spans = spans.union(sorted_in_tasks(left.where(F.col("kinds") <= bucket_limit)))
            large = left.where(F.col("kinds") > bucket_limit)
    return spans.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def numbered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, text, rid), written once, so that every later scan gives a row the same number."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    return stored(docs.select("doc_id", text, F.monotonically_increasing_id().alias("rid")), "suffix-rows", "zstd")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending, with touching and overlapping ones joined."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def without_repeats(docs: DataFrame, *, length: int = 200, bucket_limit: int = 1024, with_rest: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of `docs` (doc_id, text).

    A null text is empty; texts shorter than `length` bytes stay whole. Repeated
    rows are occurrences of their own, so from `length` bytes on nothing of them is
    left. Null ids pass through; an empty table gives an empty table; other columns
    are not read. `kept` holds the remaining bytes (a span may cut a character), or
    null without `with_rest`.
    """
    texts = numbered(docs)
    found = repeated_spans(texts, length=length, bucket_limit=bucket_limit)
    joined = texts.join(found.withColumnRenamed("rid", "s_rid"), F.col("rid") == F.col("s_rid"), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, n_removed, n_spans, digests, rest = [], [], [], [], []
            for text, spans in zip(b.column(1), b.column(2).to_pylist()):
                data = text.as_buffer().to_pybytes()
                cut = merged([(s["start"], s["end"]) for s in spans or ()])
                kept = b"".join(data[a:z] for (_, a), (z, _) in zip([(0, 0), *cut], [*cut, (len(data), 0)]))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(kept))
                n_spans.append(len(cut))
                digests.append(hashlib.sha256(kept).hexdigest())
                rest.append(kept if with_rest else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string()), pa.array(rest, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return joined.select("doc_id", "text", "spans").mapInArrow(released(run), schema)
