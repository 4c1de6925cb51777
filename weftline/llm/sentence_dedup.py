"""Substring dedup by sliding sentence spans.

Runs of consecutive sentences are hashed and joined globally, and the sentences
that a non-first repeated run covers are removed. A run has `span` sentences: a
longer repeated run is covered by those within it, so hashing these is hashing all.
With a `min_weight`, from each sentence a run goes forward, and one backward, on
until it weighs that much: short sentences make longer runs, and every repeated
passage of that weight is covered by runs that lie within it. A sentence weighs its
words, or a sixth of its characters where that is more, so texts without spaces
count as well. A text of fewer sentences than a run is no run of several; it is
held against others as a whole where it weighs `alone_weight`.
The first of equal runs is that in the document with the smallest id, and there
the earliest. DataFrame functions only; rows that move are hashes, and texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._shared import stored

#: Sentences end behind . ! or ? with white space after it, behind full-width ones, and at line ends; the parts joined give the text.
ENDS = r"(?<=[.!?][\x20\x09-\x0D])|(?<=[\n\u3002\uFF01\uFF1F])"
BLANKS = " \t\n\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"
CHARS_A_WORD = 6
#: A run is one number, its first sentence times this and its length.
MOST = 4096


def _parts(text: Column) -> Column:
    return F.split(text, ENDS, -1)


def _normal(part: Column) -> Column:
    return F.lower(F.btrim(part, F.lit(BLANKS)))


def spans(docs: DataFrame, span: int, min_weight: int, alone_weight: int) -> DataFrame:
    """(doc_id, text_hash, runs): of each run its hash h, the number `at` of its first sentence from 1 on, its sentences `n`,
    and whether an equal run came earlier in the text."""
    reach = max(span, min_weight)  # a sentence weighs 1 at least, so no run is longer
    if not 1 <= span <= reach < MOST:
        raise ValueError(f"span and min_weight must be below {MOST}")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.filter(F.transform(_parts(F.col("text")), _normal), lambda s: s != "").alias("sentences"),
    )
    weight = lambda s: F.greatest(F.regexp_count(s, F.lit(WORD)), F.floor(F.length(s) / CHARS_A_WORD).cast("int"))
    d = d.withColumn("weights", F.transform("sentences", weight)).withColumn("backward", F.reverse("weights"))
    d = d.withColumn("total", F.size("weights"))

    def length(weights: str, i: str) -> str:
        """Sentences of the run that begins at place `i` of `weights`; 0 where they end before it weighs enough."""
        full = f"a.n >= {span} and a.w >= {min_weight}"
        walk = f"aggregate(slice({weights}, {i}, {reach}), struct(0 as n, 0 as w), (a, x) -> if({full}, a, struct(a.n + 1 as n, a.w + x as w)), a -> if({full}, a.n, 0))"
        return walk

    forward = f"transform(sequence(1, total), i -> i * {MOST}L + {length('weights', 'i')})"
    backward = f"transform(sequence(1, total), i -> struct(i as i, {length('backward', 'i')} as n))"
    backward = f"transform({backward}, x -> (total - x.i - x.n + 2) * {MOST}L + x.n)"
    alone = f"if(total < {span} and aggregate(weights, 0, (a, x) -> a + x) >= {alone_weight}, array({MOST}L + total), cast(array() as array<bigint>))"
    codes = f"filter(array_distinct(concat({forward}, {backward}, {alone})), c -> c % {MOST} > 0)"
    d = d.withColumn("codes", F.expr(f"if(total > 0, {codes}, cast(array() as array<bigint>))"))
    run = f"struct(xxhash64(array_join(slice(sentences, cast(c div {MOST} as int), cast(c % {MOST} as int)), ' ')) as h, cast(c div {MOST} as int) as at, cast(c % {MOST} as int) as n)"
    d = d.select("doc_id", "text_hash", F.expr(f"transform(codes, c -> {run})").alias("runs"))
    d = d.withColumn("ordered", F.when(F.size(F.array_distinct("runs.h")) < F.size("runs"), F.sort_array("runs")))
    runs = F.expr(
        "coalesce(transform(ordered, (x, i) -> struct(x.h as h, x.at as at, x.n as n, get(ordered, i - 1).h <=> x.h as later)),"
        " transform(runs, x -> struct(x.h as h, x.at as at, x.n as n, false as later)))"
    )
    return d.select("doc_id", "text_hash", runs.alias("runs"))


def removed_sentences(docs: DataFrame, *, span: int = 2, min_weight: int = 0, alone_weight: int = 12) -> DataFrame:
    """(doc_id, text_hash, removed) for each different id and text with removed sentences; these are numbered from 1 on."""
    rows = stored(spans(docs, span, min_weight, alone_weight), "sentence-runs")
    repeated = (
        rows.select("doc_id", F.explode("runs.h").alias("r_h"))
        .groupBy("r_h")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("times"))
        .where("times > 1")
        .select("r_h", "first_id")
    )
    each = rows.select("doc_id", "text_hash", F.inline("runs"))
    again = each.join(stored(repeated, "sentence-repeats"), F.col("h") == F.col("r_h")).where(
        ~F.col("doc_id").eqNullSafe(F.col("first_id")) | F.col("later")
    )
    covered = again.groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("at") * F.lit(MOST).cast("long") + F.col("n")).alias("codes"))
    numbers = f"flatten(transform(codes, c -> sequence(cast(c div {MOST} as int), cast(c div {MOST} + c % {MOST} - 1 as int))))"
    return covered.select("doc_id", "text_hash", F.array_distinct(F.expr(numbers)).alias("removed"))


def without_repeats(docs: DataFrame, *, span: int = 2, min_weight: int = 0, alone_weight: int = 12) -> DataFrame:
    """(doc_id, n_sentences, n_removed, kept_chars, text) per row of `docs` (doc_id, text).

    Null and empty texts have no sentences. A text of fewer than `span` sentences that
    weighs `alone_weight` is one run. Rows with equal id and text are one document with equal results, and
    rows that share an id hold a first run together; a null id is first only where
    all documents with the run have none. Other columns are not read.
    """
    found = removed_sentences(docs, span=span, min_weight=min_weight, alone_weight=alone_weight).withColumnsRenamed({"doc_id": "r_id", "text_hash": "r_hash"})
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    d = d.join(
        stored(found, "sentence-removed"), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left"
    )
    d = d.withColumn("parts", _parts(F.col("text")))
    # White space between sentences is no sentence; it stays.
    d = d.withColumn("places", F.expr("filter(transform(parts, (p, i) -> if(btrim(p, ' \t\n\r\x0b\x0c') <> '', i + 1, 0)), i -> i > 0)"))
    d = d.withColumn("cut", F.expr("transform(removed, n -> get(places, n - 1))"))
    d = d.withColumn("stay", F.expr("array_except(sequence(1, size(parts)), cut)"))
    kept = F.expr("array_join(transform(stay, i -> get(parts, i - 1)), '')")
    return d.select(
        "doc_id",
        F.size("places").cast("long").alias("n_sentences"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text"),
    ).withColumn("kept_chars", F.length("text").cast("long"))
