"""Quality rules: per-document base rules and cross-document line frequency.

Lines are normalised and hashed; per host (the ``source`` column) the distinct documents that hold a line are
counted; lines above the limits are removed and documents that lose too many of their words are rejected. All in
built-in expressions. The text itself is never shuffled: only line hashes and per-document counts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, words

SYMBOL = "[#*$%&|<>]"
#: A line is removed where this many documents of its host hold it, however many the host has.
MIN_DOCS = 10
#: A document is rejected where fewer than this share of its words is left.
MIN_LEFT = 0.5
SALTS = 16


def _covered(at: Column) -> Column:
    """Words that windows at these sorted positions cover: each adds three, less the overlap with the next."""
    steps = F.sequence(F.lit(1), F.size(at))
    gain = lambda i: F.when(i < F.size(at), F.least(F.lit(3), F.get(at, i) - F.get(at, i - 1))).otherwise(3)
    return F.when(F.size(at) > 0, F.aggregate(steps, F.lit(0).cast("long"), lambda a, i: a + gain(i))).otherwise(F.lit(0).cast("long"))


def window_hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def with_repeat_words(d: DataFrame) -> DataFrame:
    """Adds n_repeat_words, the words of the array ``w`` in 3-word windows that occur twice or more.

    A window's hash and position share one 64-bit integer, so sorting primitive integers brings equal windows together:
    the position takes as many low bits as the text's length needs, the hash what is left. Neighbours of one hash are
    compared word by word; a text where two unlike windows share a hash is sorted by the words themselves.
    """
    n, digest = F.size("w"), lambda i: window_hash(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    span, none = F.sequence(F.lit(0), n - 3), F.array().cast("array<bigint>")
    d = d.withColumn("_b", F.length(F.bin(n)))
    low = F.expr("shiftleft(1L, _b) - 1L")
    packed = F.transform(span, lambda i: digest(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    d = d.withColumn("_p", F.sort_array(F.when(n >= 3, packed).otherwise(none)))
    high = lambda c: c.bitwiseAND(F.bitwise_not(low))
    meets = lambda c, k: high(c) == high(F.get("_p", k))
    d = d.withColumn("_t", F.filter("_p", lambda c, k: F.coalesce(meets(c, k - 1), F.lit(False)) | F.coalesce(meets(c, k + 1), F.lit(False))))
    # ``_t`` holds whole runs of equal hashes, so unlike words in a run show between neighbours.
    at = lambda c: c.bitwiseAND(low).cast("int")
    word = lambda c, j: F.get("w", at(c) + j)
    unlike = lambda c, e: (word(c, 0) != word(e, 0)) | (word(c, 1) != word(e, 1)) | (word(c, 2) != word(e, 2))
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_t") - 1)), lambda k: (high(F.get("_t", k)) == high(F.get("_t", k - 1))) & unlike(F.get("_t", k), F.get("_t", k - 1)))
    triple = lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), F.get("w", i + 2).alias("c"), i.cast("long").alias("i"))
    like = lambda c, e: (c["a"] == e["a"]) & (c["b"] == e["b"]) & (c["c"] == e["c"])
    by_words = F.transform(F.array(F.array_sort(F.transform(span, triple))), lambda p: F.transform(F.filter(p, lambda c, k: F.coalesce(like(c, F.get(p, k - 1)), F.lit(False)) | F.coalesce(like(c, F.get(p, k + 1)), F.lit(False))), lambda c: c["i"]))[0]
    by_hash = F.transform("_t", lambda c: c.bitwiseAND(low))
    d = d.withColumn("_at", F.sort_array(F.when(F.coalesce(clash, F.lit(False)), by_words).otherwise(by_hash)))
    return d.withColumn("n_repeat_words", _covered(F.col("_at"))).drop("_b", "_p", "_t", "_at")


def _text(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def base_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, th (hash of the text), source and the base counts."""
    d = docs.select("doc_id", "source", _text(docs).alias("text"))
    d = d.select("doc_id", "source", "text", words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    d = with_repeat_words(d.withColumn("lines", lines))
    counted = d.select(
        "doc_id", F.xxhash64("text").alias("th"), "source", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with a word: doc_id, th, source, pos, h (two 64-bit hashes of the normalised line with different seeds, as equal ones remove it), n (its words).

    A line counts lower-cased, with any digit as 0, white space runs as one space, and trimmed.
    """
    d = docs.select("doc_id", "source", _text(docs).alias("text"))
    # The text is normalised before it is cut, step by step, and a step is taken only where it has something to do.
    d = d.select("doc_id", F.xxhash64("text").alias("th"), "source", F.lower("text").alias("t"))
    d = d.withColumn("t", F.when(F.col("t").rlike("[1-9]"), F.regexp_replace("t", "[1-9]", "0")).otherwise(F.col("t")))
    d = d.withColumn("t", F.when(F.col("t").rlike(r"[\x09\x0B-\x0D]|  "), F.regexp_replace("t", r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(F.col("t")))
    d = d.select("doc_id", "th", "source", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line != ''")
    return d.select("doc_id", "th", "source", "pos", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("h"), (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n"))


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """source, h, n_docs of the lines that reach the limit in their host; ``rows`` are those of line_rows.

    A document is counted once per line, whatever the line's repeats and the document's. Counting is by partial
    aggregations, so a hot line or host never gathers in one task.
    """
    held = rows.select("source", "h", "doc_id", "th").distinct()
    return held.groupBy("source", "h").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def removed_lines(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, th, pos, n of every line that is removed, once for repeated rows."""
    rows = scratch.settle(line_rows(docs), "lines")  # hashes and counts only; read twice below
    frequent = frequent_lines(rows, min_docs).select("source", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # The salt splits a hot line over several tasks; only the few frequent lines are repeated for it.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int"))
    on = rows["source"].eqNullSafe(frequent["source"]) & (rows["h"] == frequent["h"]) & (rows["salt"] == frequent["salt"])
    return rows.join(frequent, on).select(rows["doc_id"], rows["th"], rows["pos"], rows["n"]).dropDuplicates(["doc_id", "th", "pos"])


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """Base counts, n_removed_words (words in removed lines), base_failed and kept of every document.

    Null text counts as empty, a null source is a host of its own. Repeated rows are one document for the
    line counts and get the same answer. Empty texts fail the base rules (fewer than 50 words). Extra columns are
    ignored; an empty table gives an empty result.
    """
    with Scratch(docs.sparkSession, "line_quality") as scratch:
        removed = removed_lines(docs, scratch, min_docs).groupBy("doc_id", "th").agg(F.sum("n").alias("removed"))
        removed = scratch.settle(removed.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "removed"), "removed", keep=True)
    base = base_rules(docs)
    joined = base.join(removed, base["doc_id"].eqNullSafe(removed["d"]) & (base["th"] == removed["t"]), "left")
    joined = joined.withColumn("n_removed_words", F.coalesce("removed", F.lit(0).cast("long")))
    keeps = (F.col("n_words") - F.col("n_removed_words")) >= min_left * F.col("n_words")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", (~F.col("base_failed") & keeps).alias("kept"))


def clean(docs: DataFrame, **limits) -> DataFrame:
    """doc_id and the text without its frequent lines: the operator's cleaned output.

    Null text gives an empty one; repeated rows are cleaned alike and all returned; an empty table gives an empty result;
    other columns are ignored.
    """
    with Scratch(docs.sparkSession, "line_quality") as scratch:
        gone = removed_lines(docs, scratch, **limits).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
        gone = scratch.settle(gone.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "gone"), "gone", keep=True)  # the lines of one document
    d = docs.select("doc_id", _text(docs).alias("text"))
    d = d.join(gone, d["doc_id"].eqNullSafe(gone["d"]) & (F.xxhash64(d["text"]) == gone["t"]), "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    return d.select("doc_id", F.array_join(left, "\n").alias("text"))
