"""Quality rules: per-document measures and cross-document line frequency.

DataFrame functions only, no Python on the executors. One pass over the texts
gives each document's measures and the hashes of its text and normalised lines;
all later steps work on that small table. A line is over the limit when more
than `max_docs` distinct documents of one host hold it. Documents are told apart
by the hash of the whole text: exact copies count as one, so they don't condemn
their own lines, but near copies count each, as do different documents that
share a passage.

A document is depleted, and rejected, when its lines within the limit hold fewer
than `min_left_chars` characters and less than `min_left_share` of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._shared import free_names, stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
BLANKS = " \t\r\x0b\x0c"
WINDOW = 8


def _line_hash(line):
    return F.xxhash64(F.lower(F.btrim(line, F.lit(BLANKS))))


def _lines(text):
    """The \\n-split lines that hold a word, each with its place among all lines from 0 on."""
    placed = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("at")))
    return F.filter(placed, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per row of `docs`: measures, text hash and hashed lines, without texts."""
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    d = d.select(
        "doc_id",
        "host",
        "text",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        _lines(F.col("text")).alias("lines"),
    )
    d = d.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines.line"))).alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(_line_hash(x["line"]).alias("h"), F.length(x["line"]).alias("chars"), x["at"].alias("at"))).alias("lines"),
        F.when(
            F.size("words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(1))),
                lambda i: F.xxhash64(F.slice("words", i, WINDOW)),
            ),
        )
        .otherwise(F.array(F.xxhash64("words")))
        .alias("windows"),
    )
    d = d.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    )
    same = "(get(sorted, i - 1).h <=> x.h or get(sorted, i + 1).h <=> x.h)"
    d = d.withColumn(
        "starts",
        F.expr(
            f"sort_array(transform(filter(transform(sorted, (x, i) -> struct(x.p as p, {same} as twice)), y -> y.twice), y -> y.p))"
        ),
    )
    step = f"least({WINDOW}, get(starts, i) - get(starts, i - 1))"
    return d.select(
        "doc_id",
        "host",
        "text_hash",
        "lines",
        *(F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")),
        F.when(
            F.col("starts").isNotNull(),
            F.expr(f"{WINDOW} + aggregate(sequence(1, size(starts) - 1), 0, (a, i) -> a + {step})"),
        )
        .otherwise(0)
        .cast("long")
        .alias("n_repeat_words"),
    )


def line_verdicts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 20,
    min_left_chars: int = 100,
    min_left_share: float = 0.2,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Measures and verdict of every row of `docs`.

    Null or empty text: no words, all measures 0, base_failed true. A null host is
    a host of its own. Rows that repeat an id and text get equal results; a null id
    is a value like any other. An empty table gives an empty table. Other columns
    of `docs` are not read, whatever their names. `removed` holds the places of the
    lines over the limit among the text's lines, from 0 on (null: none).
    """
    rows = stored(measured(docs, id_col, text_col, host_col), "quality-measures")
    lines = rows.dropDuplicates(["host", "text_hash"]).select("host", F.explode(F.array_distinct("lines.h")).alias("h"))
    frequent = stored(
        lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > max_docs).select("host", "h"),
        "quality-lines",
    ).withColumnsRenamed({"host": "f_host", "h": "f_h"})
    here = rows.select("doc_id", "text_hash", "host", F.inline("lines"))
    removed = (
        here.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("h") == F.col("f_h")))
        .groupBy(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"))
        .agg(F.collect_set(F.struct("at", "chars")).alias("cut"))
    )
    out = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left")
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    gone = F.coalesce(F.aggregate("cut", F.lit(0).cast("long"), lambda a, x: a + x["chars"]), F.lit(0))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (F.col("left") < F.col("chars")) & (F.col("left") < min_left_chars) & (F.col("left") < min_left_share * F.col("chars"))
    return (
        out.withColumn("chars", chars)
        .withColumn("left", F.col("chars") - gone)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            base_failed.alias("base_failed"),
            (~base_failed & ~depleted).alias("kept"),
            (F.col("chars") - F.col("left")).alias("removed_chars"),
            F.col("cut.at").alias("removed"),
            "text_hash",
        )
    )


def apply_quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """`docs` (doc_id, text, lang, source, n_chars) without rejected documents and without lines over the limit.

    Takes the limits of `line_verdicts`. n_chars follows the new text. Every row
    of a repeated document is kept or rejected alike. Null and empty texts have too
    few words and go; null ids and hosts are values like others; ties and repeated
    rows give equal results; an empty table gives an empty table. Further columns
    pass through, whatever their names.
    """
    v_id, v_hash, v_removed, own, parts = free_names(docs.columns, "v_id", "v_hash", "v_removed", "own_hash", "parts")
    v = (
        line_verdicts(docs, **limits)
        .where("kept")
        .select(F.col("doc_id").alias(v_id), F.col("text_hash").alias(v_hash), F.col("removed").alias(v_removed))
        .dropDuplicates([v_id, v_hash])
    )
    kept = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))).join(
        stored(v, "quality-kept"), F.col("doc_id").eqNullSafe(F.col(v_id)) & (F.col(own) == F.col(v_hash))
    )
    kept = kept.withColumn(parts, F.when(F.col(v_removed).isNotNull(), F.split("text", "\n", -1)))
    stay = f"array_except(sequence(0, size({parts}) - 1), {v_removed})"
    text = F.expr(f"if({v_removed} is null, text, array_join(transform({stay}, i -> get({parts}, i)), '\\n'))")
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
