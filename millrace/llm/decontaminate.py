"""Benchmark decontamination by template windows.

Numbers, units and names become typed placeholders; the windows of the resulting templates are hash-joined between
benchmark and corpus, and a match stands only if its slots are filled consistently: every value of the item is
replaced by one value throughout. A question whose names and numbers were changed is caught as well as a copy.

Each text is read twice: word by word, and with every run of like slots as one slot, so that "Anna" may become "Mary
Ann". Items without a window of enough literal words are found as verbatim copies, by windows of their words; items of
fewer than SHORT words only where a document holds nothing else, as such words are in many texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text_hash
from .common import Scratch, lookup_join, own_names, quoted, steps, tidy

#: Template tokens in a window; the literal words it needs at least; tokens of an item that must match (or all).
WINDOW, LITERALS, MATCHED = 8, 4, 13
#: Tokens of an item from which its words are looked for inside texts.
SHORT = 3
#: Benchmark windows that one scan of the corpus looks for (8 bytes each in every worker); more take more scans.
WINDOWS_AT_ONCE, BROADCAST_ROWS = 2_000_000, 200_000
#: Bytes whose words are found in one step.
PIECE = 1 << 18

# Words that are numbers, and units of measure.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars cent cents euro euros percent degrees celsius fahrenheit kmh mph meter meters metre metres".split()
_NUMBER = re.compile(rb"[+-]?[$\xe2\x82\xac\xc2\xa3]*\d[\d.,:/]*%?(?:st|nd|rd|th)?")
_IS_NUMBER, _IS_UNIT, _CAPITAL, _ENDS, _EMPTY = 1, 2, 4, 8, 16
_SLOTS = text_hash.mix(np.arange(1, 4, dtype=np.uint64))
_PLACES = np.random.default_rng(23).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


_SPACE, _CLOSER, _END = text_hash.SPACE, text_hash.byte_set(b"\"')]}"), text_hash.byte_set(b".!?:")
_BARE = ~(_SPACE | text_hash.byte_set(b".,;:!?\"'()[]{}<>*_`~-"))
_LOWER_CASE = text_hash.byte_set(b"abcdefghijklmnopqrstuvwxyz")
_MAY_BE_NUMBER = text_hash.byte_set(b"+$0123456789\xe2\xc2")
_NUMBERS = {w.encode() for w in NUMBER_WORDS}


def _hashes(known: list[str]) -> np.ndarray:
    data = [np.frombuffer(w.encode(), np.uint8) for w in known]
    return np.sort(np.concatenate([text_hash.ranges(text_hash.prefix(d), np.array([0]), np.array([len(d)])) for d in data]))


_NUMBER_HASHES, _UNIT_HASHES = _hashes(NUMBER_WORDS), _hashes(UNITS)


def _words(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(piece, np.uint8)
    start, end = text_hash.word_bounds(a)
    bare, open_ = np.flatnonzero(_BARE[a]), np.flatnonzero(~(_SPACE | _CLOSER)[a])
    hashes, flags = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
    # The last byte before closing quotes and brackets.
    last = np.searchsorted(open_, end) - 1
    held = last >= 0
    held[held] = open_[last[held]] >= start[held]
    flags[held] |= np.where(_END[a[open_[last[held]]]], _ENDS, 0)
    # A word without the punctuation at its edges.
    first, final = np.searchsorted(bare, start), np.searchsorted(bare, end) - 1
    some = first <= final
    flags[~some] |= _EMPTY
    first, final = bare[first[some]], bare[final[some]] + 1
    h = text_hash.ranges(text_hash.prefix(text_hash.LOWER[a]), first, final)
    own = np.where(text_hash.UPPER[a[first]] & (final - first > 1) & _LOWER_CASE[a[np.minimum(first + 1, len(a) - 1)]], _CAPITAL, 0)
    own |= np.where(np.isin(h, _NUMBER_HASHES), _IS_NUMBER, 0) | np.where(np.isin(h, _UNIT_HASHES), _IS_UNIT, 0)
    for i in np.flatnonzero(_MAY_BE_NUMBER[a[first]]):
        if _NUMBER.fullmatch(piece, first[i], final[i]):
            own[i] |= _IS_NUMBER
    hyphens = np.searchsorted(first, np.flatnonzero(a == 45), "right") - 1
    for i in np.unique(hyphens[hyphens >= 0]):
        if all(x in _NUMBERS for x in piece[first[i] : final[i]].lower().split(b"-")):
            own[i] |= _IS_NUMBER
    hashes[some], flags[some] = h, flags[some] | own
    return start, hashes, flags


@dataclass
class Reading:
    """Texts as tokens, one after the other: hash of the template token, of the value, whether it is a slot, and the
    number of the text that holds it."""

    tokens: np.ndarray
    values: np.ndarray
    slot: np.ndarray
    owner: np.ndarray


def template(texts: list[bytes]) -> Reading:
    """Words of punctuation only are dropped; a name is a capitalised word that does not begin a sentence; a unit
    follows a number."""
    data = b"\n".join(texts)
    parts, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        start, h, f = _words(data[at:end])
        parts.append((start + at, h, f))
        at = end
    start, h, f = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
    owner = text_hash.owners(texts, start)
    opens = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)]
    begins = opens | np.concatenate([[True], (f[:-1] & _ENDS) > 0])[: len(f)]
    keep = (f & _EMPTY) == 0
    h, f, begins, owner = h[keep], f[keep], begins[keep], owner[keep]
    number = (f & _IS_NUMBER) > 0
    follows = np.concatenate([[False], number[:-1] & (owner[1:] == owner[:-1])])[: len(f)]
    unit = ((f & _IS_UNIT) > 0) & follows & ~number
    name = ((f & _CAPITAL) > 0) & ~begins & ~number & ~unit
    out = np.where(number, _SLOTS[0], np.where(unit, _SLOTS[1], np.where(name, _SLOTS[2], h)))
    return Reading(out, h, number | unit | name, owner)


def collapsed(r: Reading) -> Reading:
    """The same with each run of like slots as one slot, whose value is that of all the run."""
    again = r.slot[1:] & (r.tokens[1:] == r.tokens[:-1]) & (r.owner[1:] == r.owner[:-1])
    if not again.any():
        return r
    start = np.flatnonzero(np.concatenate([[True], ~again]))
    length = np.diff(np.append(start, len(r.tokens)))
    place = np.arange(len(r.tokens)) - np.repeat(start, length)
    joined = np.add.reduceat(text_hash.mix(r.values + place.astype(np.uint64)), start)
    return Reading(r.tokens[start], np.where(length > 1, joined, r.values[start]), r.slot[start], r.owner[start])


def windows(tokens: np.ndarray, slot: np.ndarray, owner: np.ndarray, size: int, literals: int = LITERALS) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows of ``size`` template tokens of one text with enough literal words."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h += tokens[j : j + n] * _PLACES[j]
    literal = np.concatenate([[0], np.cumsum(~slot)])
    ok = np.flatnonzero((literal[size:] - literal[:-size] >= literals) & (owner[:n] == owner[size - 1 :]))
    return ok, text_hash.mix(h[ok] ^ np.uint64(size))


def sizes_of(n_tokens: int) -> int:
    """Window size for an item: WINDOW, or all tokens of a shorter item."""
    return min(WINDOW, n_tokens)


#: Readings of a text: word by word, runs of like slots as one, its words as they are, and these as the whole text.
PLAIN, RUNS, VERBATIM, WHOLE = 0, 1, 2, 3
#: Alignments of one document and item whose shifts follow each other within this many tokens count together.
NEAR_SHIFTS = 3
_COLUMNS = "th long, kind int, pos int, size int, h long, n_windows int, slots array<bigint>"
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]


def _verbatim(r: Reading, size: int, kind: int = VERBATIM) -> tuple[np.ndarray, np.ndarray]:
    at, h = windows(r.values, np.zeros(len(r.values), bool), r.owner, size, 0)
    return at, text_hash.mix(h ^ np.uint64(kind << 32))


def _batch(piece: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    """``rows``: number of the text in ``piece``, kind, position, size, hash, windows, slots."""
    owner, *rest = zip(*rows, strict=True) if rows else [[]] * 7
    texts = pa.array(owner, pa.int64())
    own = [piece.column("id").take(texts), piece.column("th").take(texts)]
    return pa.record_batch([*own, *(pa.array(list(c), k) for c, k in zip(rest, _KINDS, strict=True))], ["id", "th", "kind", "pos", "size", "h", "n_windows", "slots"])


def _texts(piece: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in piece.column("text").cast(pa.large_binary()).to_pylist()]


@tidy
def _item_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in steps(batch, "text"):
            rows = []
            for k, text in enumerate(_texts(piece)):
                plain = template([text])
                if len(plain.tokens) < LITERALS:
                    size = len(plain.tokens)
                    kind = VERBATIM if size >= SHORT else WHOLE
                    rows += [(k, kind, 0, size, x, 1, []) for x in _verbatim(plain, size, kind)[1].view(np.int64)] if size else []
                    continue
                for kind, r in ((PLAIN, plain), (RUNS, collapsed(plain))):
                    size = sizes_of(len(r.tokens))
                    at, h = windows(r.tokens, r.slot, r.owner, size)
                    rows += [(k, kind, p, size, x, len(at), np.where(r.slot[p : p + size], r.values[p : p + size].view(np.int64), 0)) for p, x in zip(at, h.view(np.int64), strict=True)]
                    if kind == PLAIN and not len(at):
                        at, h = _verbatim(plain, size)
                        rows += [(k, VERBATIM, p, size, x, len(at), []) for p, x in zip(at, h.view(np.int64), strict=True)]
            yield _batch(piece, rows)


def _doc_rows(sizes: list[int], verbatim: list[int], whole: list[int], known):
    """The corpus windows of these sizes (``verbatim``: of its words, ``whole``: of all its words) whose hash is among ``known``, sorted."""
    bits: list[np.ndarray] = []

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = known.value
        if not bits:
            bits.append(np.zeros(1 << 22, bool))
            bits[0][some >> np.uint64(42)] = True

        def shared(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near = np.flatnonzero(bits[0][h >> np.uint64(42)])
            if len(some):
                near = near[some[np.minimum(np.searchsorted(some, h[near]), len(some) - 1)] == h[near]]
            return at[near], h[near]

        for batch in batches:
            for piece in steps(batch, "text", most=PIECE):
                plain, rows = template(_texts(piece)), []
                runs = collapsed(plain)
                for kind, r in ((PLAIN, plain), (RUNS, runs)):
                    first = np.searchsorted(r.owner, np.arange(piece.num_rows))
                    for size in sizes:
                        at, h = shared(*windows(r.tokens, r.slot, r.owner, size))
                        rows += [(o, kind, p - first[o], size, x, 0, np.where(r.slot[p : p + size], r.values[p : p + size].view(np.int64), 0)) for o, p, x in zip(r.owner[at], at, h.view(np.int64), strict=True)]
                    for size in verbatim if kind == PLAIN else ():
                        at, h = shared(*_verbatim(r, size))
                        rows += [(o, VERBATIM, p - first[o], size, x, 0, []) for o, p, x in zip(r.owner[at], at, h.view(np.int64), strict=True)]
                first, count = np.searchsorted(plain.owner, np.arange(piece.num_rows)), np.bincount(plain.owner, minlength=piece.num_rows)
                for size in whole if (count <= max(whole, default=0)).any() else ():
                    at, h = shared(*_verbatim(plain, size, WHOLE))
                    rows += [(o, WHOLE, 0, size, x, 0, []) for o, p, x in zip(plain.owner[at], at, h.view(np.int64), strict=True) if count[o] == size]
                yield _batch(piece, rows)

    return run


def _keyed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    own = df.select(F.col(quoted(key)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return own, f"id {own.schema['id'].dataType.simpleString()}, {_COLUMNS}"


def matches(docs: DataFrame, benchmark: DataFrame, matched: int = MATCHED) -> DataFrame:
    """doc_id, item_id, n_windows, n_item_windows, exact: the pairs whose documents leak an item.

    A pair leaks if one alignment, or several whose shifts are near, matches windows over ``matched`` tokens of the
    item (over all of a shorter one, or of one without a window of enough literals) and its slots are consistent;
    ``exact`` tells whether all slots keep the item's values. Items of fewer than LITERALS tokens match as they are; null
    and empty texts match nothing. Ids keep their type; null ids are ids. Repeated rows give a pair once; empty tables give
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    with Scratch(spark, "decontaminate") as scratch:
        own, schema = _keyed(benchmark, "item_id")
        items = scratch.settle(own.mapInArrow(_item_rows, schema), "items")
        sent: list = []
        leaks = scratch.settle(_leaks(docs, items, matched, scratch, sent), "leaks", keep=True)
        for known in sent:
            known.destroy()
    return leaks


def _leaks(docs: DataFrame, items: DataFrame, matched: int, scratch: Scratch, sent: list) -> DataFrame:
    """``sent`` gets the broadcast that the returned plan still needs, one at most; others are destroyed here."""
    spark = docs.sparkSession
    held = sorted(tuple(r) for r in items.select("size", F.greatest("kind", F.lit(RUNS)).alias("kind")).distinct().collect())  # at most WINDOW numbers, thrice
    sizes, verbatim, whole = ([x for x, kind in held if kind == of] for of in (RUNS, VERBATIM, WHOLE))
    hashes = scratch.settle(items.select("h").distinct(), "hashes")
    scans = max(1, -(-hashes.count() // WINDOWS_AT_ONCE))
    own, schema = _keyed(docs, "doc_id")
    found = None
    for k in range(scans):
        some = hashes.filter(F.pmod(F.col("h"), F.lit(scans)) == k).toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64)  # about WINDOWS_AT_ONCE
        known = spark.sparkContext.broadcast(np.sort(some))
        hits = own.mapInArrow(_doc_rows(sizes, verbatim, whole, known), schema)
        if scans > 1:
            hits = scratch.settle(hits, "hits")
            known.destroy()
        else:
            sent.append(known)
        found = hits if found is None else found.unionByName(hits)
    d = found.select(F.col("id").alias("doc_id"), "th", "kind", F.col("pos").alias("dp"), "size", "h", F.col("slots").alias("ds"))
    i = items.select(F.col("id").alias("item_id"), F.col("th").alias("ith"), "kind", F.col("pos").alias("ip"), "size", "h", F.col("n_windows").alias("n_item"), F.col("slots").alias("vs"))
    if items.count() <= BROADCAST_ROWS:
        met = d.join(F.broadcast(i), ["h", "size", "kind"])  # a row is under 150 bytes
    else:  # a window that very many documents hold is no hot key
        d = scratch.settle(d, "hits")
        often = d.groupBy("h").agg(F.count("*").alias("freq"))
        met = lookup_join(d, i.join(often, "h"), ["h", "size", "kind"], d.count())
    pair = ["doc_id", "th", "item_id", "ith", "kind", "size", "n_item"]
    pairs = F.filter(F.arrays_zip(F.col("vs"), F.col("ds")), lambda x: x["vs"] != 0)
    # One alignment of one document and one item: at most the item's windows.
    met = met.select(*pair, (F.col("dp") - F.col("ip")).alias("shift"), "ip", pairs.alias("pairs")).groupBy(*pair, "shift").agg(F.collect_set("ip").alias("ips"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    # A slot that changed its number of words moves what follows: near alignments of a pair are also judged together.
    met = scratch.settle(met, "alignments")  # read twice below
    order = Window.partitionBy(*pair).orderBy("shift")
    fresh = F.coalesce(F.col("shift") - F.lag("shift").over(order) > NEAR_SHIFTS, F.lit(True)).cast("int")
    grouped = met.filter(F.col("kind") < VERBATIM).withColumn("fresh", fresh).withColumn("group", F.sum("fresh").over(order)).groupBy(*pair, "group").agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_list("ips"))).alias("ips"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    met = met.select(*pair, "ips", "pairs").unionByName(grouped.filter("n > 1").select(*pair, "ips", "pairs")).withColumn("n_windows", F.size("ips"))
    one_way = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["vs"])))
    exact = F.forall("pairs", lambda x: x["vs"] == x["ds"])
    # A passage that opens in mid-sentence may turn its first word into a name: one window less is enough.
    needed = F.greatest(F.lit(1), F.least(F.lit(matched + 1) - F.col("size"), F.col("n_item") - 1))
    needed = F.when(F.col("kind") >= VERBATIM, F.col("n_item")).otherwise(needed)
    leaks = met.filter(one_way & (F.col("n_windows") >= needed)).withColumn("exact", exact)
    best = F.max(F.struct("n_windows", F.col("n_item").alias("n_item_windows"), "exact"))
    return leaks.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns, whatever their names.

    Rows that share a doc_id share their fate; a null doc_id is an id. An empty benchmark keeps all rows.
    """
    (gone,) = own_names(1)
    leaks = matches(docs, benchmark).select(F.col("doc_id").alias(gone)).distinct()
    leaks = F.broadcast(leaks) if leaks.count() <= BROADCAST_ROWS else leaks
    return docs.join(leaks, docs["doc_id"].eqNullSafe(F.col(gone)), "left_anti")
