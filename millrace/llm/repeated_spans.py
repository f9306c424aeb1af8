"""Removal of long byte strings that occur more than once, by a trigger-based (prefix-free) parse of the corpus.

A rolling hash over the bytes before every place sets phrase ends: a phrase ends wherever this trigger's hash is the least
of some window of LENGTH bytes, so equal strings are parsed alike wherever they stand. Every window belongs to the
phrase end that is its least, and the windows of one phrase end are neighbours. In place of a suffix array's order, which
serves here only to bring equal strings together, equal strings meet by hash, so the work is plain counting:

1. the trigger strings (the core of all windows of a phrase end) - a document without a repeated one holds no repeat;
2. the bytes that a phrase end's windows cover together - where these repeat, all its windows do;
3. the same for pieces of PIECE windows, and then for single windows, of the few phrase ends whose covers differ though
   their cores are equal, at the ends of repeated passages.

Step 1 runs over strings of PASSAGE bytes and finds the few documents that go through the other steps at all; it also leads
to passages of over PASSAGE_WORDS words that other documents hold too, which may be shorter than LENGTH bytes and are
told, not removed.

Step 1 only leaves text out, so a 64-bit hash does. What steps 2 and 3 call equal is removed: they compare two hashes, the
second a pair modulo a prime, in which two strings of 400 bytes, whatever they are, collide for less than 10**-13 of its
bases; strings not made to defeat the first share both by chance in 2**-125 of all pairs.

Counts are pre-aggregated and hot keys are taken out of the shuffles, so neither a passage that a third of the
corpus shares nor a group of copies lands in one task. The texts of documents without a repeated core are never
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_hash
from .common import Scratch, hot_freq, lookup_join, ragged, steps, tidy

LENGTH, PIECE = 400, 16
#: Bytes, and words, from which a string that other documents hold too is told as a passage.
PASSAGE, PASSAGE_WORDS = 300, 50
#: Ids of documents with a repeated core are broadcast to the scan up to this many; beyond it they are shuffled.
BROADCAST_ROWS = 200_000
#: Bytes of text that are hashed together, so that the arrays stay in a processor's cache.
CHUNK = 1 << 18

_PLACE = np.uint64((1 << 32) - 1)


def trigger(length: int) -> int:
    """Bytes of the trigger strings that parse windows of this length: longer ones leave fewer documents, but more rows."""
    return max(length // 3, 1)


class Texts:
    """The texts of a batch, joined: ``data``, and where each starts and ends in it."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        held = column.buffers()[2]
        self.data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held else np.empty(0, np.uint8)
        self.start, self.end = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
        self.sums = text_hash.prefix(self.data)

    def keys(self, low: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the byte ranges [low, end)."""
        return text_hash.ranges(self.sums, low, end), text_hash.prime_ranges(text_hash.prime_prefix(self.data), low, end)


def phrases(texts: Texts, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high, at): of each phrase end its text, its first and last window, and where its trigger string starts.

    Every window of a text belongs to one phrase end: the leftmost of those whose trigger hash is the least in the window.
    """
    k, n = trigger(length), len(texts.data)
    if n < length:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    rolled = text_hash.mix((texts.sums[k:] - texts.sums[: n + 1 - k]) * text_hash.inverses(n + 1)[: n + 1 - k])
    # The place in the low bits makes the order strict, and alike in equal windows.
    least = (rolled & ~_PLACE) | np.arange(len(rolled), dtype=np.uint64)
    wide, whole = 1, length - k + 1
    while wide < whole:
        step = min(wide, whole - wide)
        least = np.minimum(least[:-step], least[step:])
        wide += step
    inside = np.flatnonzero(np.arange(len(least)) <= np.repeat(texts.end - length, texts.end - texts.start)[: len(least)])
    if not len(inside):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    least = least[inside]
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    low, high = inside[first], inside[np.append(first[1:], len(inside)) - 1]
    return np.searchsorted(texts.end, low, "right"), low, high, (least[first] & _PLACE).astype(np.int64)


def _pieces(low: np.ndarray, high: np.ndarray, at: np.ndarray, size: int, length: int) -> tuple[np.ndarray, ...]:
    """(unit, low, high, core's start, core's end) of the units' windows by ``size`` neighbours, counted from the trigger."""
    first = (at - high) // size
    count = (at - low) // size - first + 1
    unit = np.repeat(np.arange(len(low)), count)
    top = at[unit] - ragged(first, count) * size
    bottom = np.maximum(top - size + 1, at[unit] + trigger(length) - length)
    return unit, np.maximum(bottom, low[unit]), np.minimum(top, high[unit]), top, bottom + length


def _rows(piece: pa.RecordBatch, row: np.ndarray, **numbers: np.ndarray) -> pa.RecordBatch:
    """A row per number, with the id of its text."""
    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in numbers.values()]
    return pa.record_batch([piece.column("rid").take(pa.array(row)), *arrays], ["rid", *numbers])


def _units(piece: pa.RecordBatch, texts: Texts) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The column ``units``: the text of each, and its fields, as places in the joined texts."""
    column = piece.column("units")
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    return row, {f.name: flat.field(i).to_numpy(zero_copy_only=False) + texts.start[row] for i, f in enumerate(flat.type)}


def _per_chunk(rows_of: Callable[[pa.RecordBatch, Texts], pa.RecordBatch]):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch, "text", most=CHUNK):
                yield rows_of(piece, Texts(piece.column("text")))

    return run


def _cores(length: int):
    """Trigger strings of all windows."""

    def rows_of(piece: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        row, _, _, at = phrases(texts, length)
        return _rows(piece, row, at=at - texts.start[row], core=text_hash.ranges(texts.sums, at, at + trigger(length)))

    return _per_chunk(rows_of)


def _covers(length: int, size: int = 0):
    """Keys of what the windows of each phrase end cover, or of each of its pieces in the column ``units``."""

    def rows_of(piece: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        if size:
            row, units = _units(piece, texts)
            unit, low, high, core, core_end = _pieces(units["low"], units["high"], units["at"], size, length)
            row, at = row[unit], units["at"][unit]
        else:
            row, low, high, at = phrases(texts, length)
            core, core_end = at, at + trigger(length)
        start = texts.start[row]
        key, other = texts.keys(low, high + length)
        return _rows(piece, row, low=low - start, high=high - start, at=at - start, core=text_hash.ranges(texts.sums, core, core_end), key=key, other=other)

    return _per_chunk(rows_of)


def _passages(length: int, words: int):
    """Keys of the strings of ``words`` + 1 words around the middle of each trigger string in the column ``units``."""

    def rows_of(piece: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        row, units = _units(piece, texts)
        # A word ends where its text does: words are cut in a copy with a space after each text.
        gaps = np.arange(len(texts.start))
        apart = np.full(len(texts.data) + len(gaps), 32, np.uint8)
        apart[np.arange(len(texts.data)) + np.repeat(gaps, texts.end - texts.start)] = texts.data
        start, end = text_hash.word_bounds(apart)
        own = np.searchsorted(texts.end + gaps, start, "right")
        start, end = start - own, end - own
        middle = np.searchsorted(start, units["at"] + trigger(length) // 2, "right") - 1
        inside = np.flatnonzero(middle >= 0)
        inside = inside[own[middle[inside]] == row[inside]]
        first = np.unique(middle[inside, None] - np.arange(words + 1))
        first = first[(first >= 0) & (first + words < len(start))]
        first = first[own[first] == own[first + words]]
        key, other = texts.keys(start[first], end[first + words])
        return _rows(piece, own[first], key=key, other=other)

    return _per_chunk(rows_of)


UNIT = ("low", "high", "at")


def _gathered(units: DataFrame, *fields: str) -> DataFrame:
    """rid, units: the units of a document in one row."""
    return units.groupBy("rid").agg(F.collect_set(F.struct(*fields)).alias("units"))


def _total(counted: DataFrame) -> int:
    return counted.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]


def _lists(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The rows of a column of arrays of structs, each as one numpy array per field; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    end = np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    for a, b in zip(np.concatenate([[0], end[:-1]]), end, strict=True):
        yield {k: v[a:b] for k, v in fields.items()}


def _data(piece: pa.RecordBatch) -> list[bytes]:
    return piece.column("text").cast(pa.large_binary()).to_pylist()


def _cut(length: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch, "text"):
                spans, kept, sizes = [], [], []
                for text, units in zip(_data(piece), _lists(piece.column("units")), strict=True):
                    order = np.argsort(units["low"], kind="stable")
                    low, end = units["low"][order], np.maximum.accumulate(units["high"][order] + length)
                    opens = np.flatnonzero(np.concatenate([[True], low[1:] > end[:-1]])) if len(low) else np.empty(0, np.int64)
                    starts, stops = low[opens].tolist(), end[np.append(opens[1:] - 1, -1)].tolist() if len(low) else []
                    kept.append(b"".join(text[a:b] for a, b in zip([0, *stops], [*starts, len(text)], strict=True)))
                    spans.append([{"start": a, "end": b} for a, b in zip(starts, stops, strict=True)])
                    sizes.append(len(text))
                yield pa.record_batch([piece.column("rid"), piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["rid", "doc_id", "n_bytes", "spans", "kept"])

    return run


SPANS = "array<struct<start: long, end: long>>"


def cut_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges), kept (the remaining bytes) and has_passage of every document.

    A byte goes where a ``length``-byte string that covers it starts at another place too, in this document or
    another; spans are judged on the input and overlap freely. ``has_passage`` tells that something was removed, or that
    another document holds a string of more than ``words`` words too (all of ``passage`` bytes or more are found). Null
    text is empty. Repeated rows are documents of their own, so each repeats the other. An empty table gives an empty
    result; other columns are ignored; doc_id keeps its type.
    """
    with Scratch(docs.sparkSession, "repeats") as scratch:
        return _cut_repeats(docs, length, min(passage, length), words, scratch)


def _told_apart(rows: DataFrame, scratch: Scratch, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Of covers: (rid, low, high) of those that occur twice or more, and the units (rid and UNIT) that finer pieces settle.

    A cover that occurs once is settled unless another cover has its core too. All covers of such a core go on, one unit
    of each: the windows of one that repeats may be those that another holds.
    """
    rows = scratch.settle(rows, "covers")
    # Numbers of one row each: ``first`` takes them from the same row, and they need no sorting as a struct would.
    per = rows.groupBy("key", "other").agg(F.count("*").alias("freq"), *(F.first(c).alias(c) for c in ("rid", *UNIT, "core")))
    per = scratch.settle(per, "per_cover")
    twice = per.filter("freq >= 2").select("key", "other", "freq")
    whole = lookup_join(rows.select("rid", "low", "high", "key", "other"), twice, ["key", "other"], _total(twice)).select("rid", "low", "high")
    if last:
        return whole, None
    total = per.count()
    classes = per.groupBy("core").agg(F.count("*").alias("n"), (F.min("freq") == 1).alias("wanted"))
    classes = classes.filter((F.col("wanted") & (F.col("n") >= 2)) | (F.col("n") >= hot_freq(total)))
    classes = scratch.settle(classes.withColumnRenamed("n", "freq"), "classes")
    rest = lookup_join(per.select("rid", *UNIT, "core"), classes, "core", total).filter("wanted").select("rid", *UNIT)
    return whole, scratch.settle(rest, "rest")


def _cut_repeats(docs: DataFrame, length: int, passage: int, words: int, scratch: Scratch) -> DataFrame:
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    unique = own.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 OR doc_id IS NULL").isEmpty()
    # doc_id names a row where it is unique; else doc_id and text do, and rows equal in both share their fate.
    own = own.withColumn("rid", F.col("doc_id") if unique else F.concat_ws(":", F.md5(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("string")))
    kind = own.schema["rid"].dataType.simpleString()
    keyed = f"rid {kind}, low long, high long, at long, core long, key long, other long"

    cores = scratch.settle(own.select("rid", "text").mapInArrow(_cores(passage), f"rid {kind}, at long, core long"), "cores")
    found = scratch.settle(cores.groupBy("core").agg(F.count("*").alias("freq")).filter("freq >= 2"), "repeated")
    wide_total = _total(found)
    wide = scratch.settle(lookup_join(cores, found, "core", wide_total), "units")
    scratch.drop(cores, found)
    ids = scratch.settle(wide.select("rid").distinct(), "ids", keep=True)
    few = ids.count() <= BROADCAST_ROWS
    hot = scratch.settle(own.join(F.broadcast(ids) if few else ids, "rid", "left_semi"), "hot")
    texts = hot.select("rid", "text")

    finer = lambda rest, size: texts.join(_gathered(rest, *UNIT), "rid").mapInArrow(_covers(length, size), keyed)
    by_phrase, rest = _told_apart(texts.mapInArrow(_covers(length), keyed), scratch)
    by_piece, rest = _told_apart(finer(rest, PIECE), scratch)
    by_window, _ = _told_apart(finer(rest, 1), scratch, last=True)
    gone = by_phrase.unionByName(by_piece).unionByName(by_window)
    gone = gone if unique else gone.distinct()
    gone = scratch.settle(gone.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("units")), "gone")

    # Shorter passages: documents with nothing to remove, and all that share a core with them.
    left = wide.join(gone.select("rid", F.lit(True).alias("goes")), "rid", "left")
    left = left.groupBy("core").agg(F.first("freq").alias("freq"), F.bool_or(F.col("goes").isNull()).alias("wanted"))
    # Cores that nobody wants are looked up too where they are hot: their rows would meet in one task.
    left = left.filter(F.col("wanted") | (F.col("freq") >= hot_freq(wide_total)))
    shared = lookup_join(wide.drop("freq"), left, "core", wide_total).filter("wanted").select("rid", "at")
    strings = texts.join(_gathered(shared, "at"), "rid").mapInArrow(_passages(passage, words), f"rid {kind}, key long, other long")
    strings = scratch.settle(strings, "strings")
    found = strings.groupBy("key", "other").agg(F.count("*").alias("freq"), F.min("rid").alias("a"), F.max("rid").alias("b")).filter("a < b")
    found = scratch.settle(found.drop("a", "b"), "repeated")
    told = lookup_join(strings, found, ["key", "other"], _total(found)).select("rid").distinct().withColumn("told", F.lit(True))

    schema = f"rid {kind}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans {SPANS}, kept binary"
    changed = hot.join(gone, "rid", "left").select("rid", "doc_id", "text", "units").mapInArrow(_cut(length), schema).join(told, "rid", "left")
    has = (F.size("spans") > 0) | F.coalesce("told", F.lit(False))
    changed = scratch.settle(changed.select("doc_id", "n_bytes", "spans", "kept", has.alias("has_passage")), "changed", keep=True)
    data = F.encode("text", "UTF-8")
    same = own.join(F.broadcast(ids) if few else ids, "rid", "left_anti")
    same = same.select("doc_id", F.length(data).cast("long").alias("n_bytes"), F.array().cast(SPANS).alias("spans"), data.alias("kept"), F.lit(False).alias("has_passage"))
    return changed.unionByName(same)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_passage of every document."""
    cut = cut_repeats(docs, length)
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "has_passage")
