"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

1. Each text becomes its set of 5-word shingles and a signature of K minima; texts with equal sets form a class,
   so exact copies cost one row from here on.
2. Every class is posted under each (coordinate, value) pair. A pair at the threshold agrees in at least T of K
   coordinates but for a chance below MISS (T follows from the threshold, ``agreements``), so it must share a pair
   among the K - T + 1 rarest of either side: only these prefixes are merged, and the long lists of common values are
   skipped.
3. First each prefix list links its members to its most central member (a star: no pairs within a list), then
   pairs that still lie in different components meet, restricted by exact bounds on their similarity.
4. Candidates are probed on all K coordinates (collision count >= T) and confirmed on their full shingle sets.
   Components of the confirmed links give the answer.

A set holds 64-bit hashes of its shingles, made of cryptographic hashes of their words, so that texts cannot be made to
collide as with a polynomial hash. Two shingles of one pair of documents of n shingles each meet by chance with
n * n / 2**64, and a link changes only if that pair stands right at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_hash
from .common import Scratch, lookup_join, own_names, steps, tidy

#: Coordinates of a signature, and the chance that a pair at the threshold agrees in too few of them.
K, MISS = 64, 1e-8
#: Percent: documents are linked where 100 * intersection >= THRESHOLD * union.
THRESHOLD, SHINGLE = 85, 5
#: Candidates (24 bytes each) and ids that go are broadcast to the scan up to this many rows; beyond it they are shuffled.
BROADCAST_ROWS = 200_000
#: Longest difference from a list's most central member that is carried along.
DIFFERENCE = 200
#: Sizes within this factor share a band; a pair at the threshold spans few bands.
BAND = 1.02

_RNG = np.random.default_rng(11)
_XOR = _RNG.integers(0, 1 << 64, 256, np.uint64)
_MUL = _RNG.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)


def agreements(threshold: int, k: int = K, miss: float = MISS) -> int:
    """The most coordinates that a pair at the threshold (percent) agrees in but for the chance ``miss``."""
    s, below = threshold / 100, 0.0
    for t in range(k + 1):
        below += comb(k, t) * s**t * (1 - s) ** (k - t)  # fewer than t + 1 agree
        if below > miss:
            break
    if not t:
        raise ValueError(f"{k} coordinates cannot find pairs of {threshold} % at this chance to miss one")
    return t


def signature(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """k minima, each mixed with the number of its coordinate, so that a value names its coordinate as well."""
    low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[None, at : at + 4096] ^ _XOR[:k, None]
        low = np.minimum(low, (part * _MUL[:k, None]).min(axis=1))
    return text_hash.mix(low + _XOR[:k])


def _digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


@tidy
def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in steps(batch, "text"):
            sizes, digests, sigs = [], [], []
            for text in piece.column("text").cast(pa.large_binary()).to_pylist():
                s = text_hash.shingles(text or b"", SHINGLE)
                sizes.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                sigs.append(signature(s).view(np.int64) if len(s) else None)
            yield pa.record_batch([piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "cid", "sig"])


@tidy
def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in steps(batch, "text"):
            cids, sets, sigs = [], [], []
            for text, cid in zip(piece.column("text").cast(pa.large_binary()).to_pylist(), piece.column("cid").to_pylist(), strict=True):
                s = text_hash.shingles(text or b"", SHINGLE)
                if len(s) and _digest(s) == cid:
                    cids.append(cid)
                    sets.append(s.view(np.int64))
                    sigs.append(signature(s).view(np.int64))
            yield pa.record_batch([pa.array(cids, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], ["cid", "shingles", "sig"])


def similar(inter: Column, a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    return 100 * inter >= threshold * (a + b - inter)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, label of every endpoint of ``edges`` (a, b): the smallest id of its component.

    Labels spread to neighbours and then jump to the label of their label; each round is written out, so neither
    the lineage nor a driver-side structure grows, and the round before it is deleted.
    """
    both = scratch.settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        least = labels.join(near, "id").select("id", F.least("label", "m").alias("low"), "label")
        up = labels.select(F.col("id").alias("low"), F.col("label").alias("up"))
        new = scratch.settle(least.join(up, "low").select("id", F.least("low", "up").alias("label"), F.col("label").alias("was")), "labels")
        scratch.drop(labels)
        labels = new
        if new.filter("label != was").isEmpty():
            scratch.drop(both)
            return labels


def _confirmed(pairs: DataFrame, profiles: DataFrame, threshold: int) -> DataFrame:
    """The candidate pairs (a, b) that agree in enough coordinates and pass the threshold on their full sets."""
    left = profiles.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"), F.col("sig").alias("ga"))
    right = profiles.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"), F.col("sig").alias("gb"))
    met = pairs.join(left, "a").join(right, "b").filter(F.size(F.array_intersect("ga", "gb")) >= agreements(threshold))
    return met.filter(similar(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), threshold)).select("a", "b")


def links(docs: DataFrame, threshold: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, cid) of every document, and (id, label): the component of each linked class."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    least = agreements(threshold)
    features = scratch.settle(docs.select("doc_id", "text").mapInArrow(_features, f"doc_id {kind}, n_shingles long, cid binary, sig array<bigint>"), "features")
    classes = features.filter("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.settle(classes, "classes")
    rows = scratch.settle(features.select("doc_id", "n_shingles", "cid"), "rows")
    scratch.drop(features)
    total = classes.count() * K
    posted = classes.select("cid", "n", F.explode("sig").alias("token"))
    freq = posted.groupBy("token").agg(F.count("*").alias("freq")).filter("freq >= 2")
    shared = lookup_join(posted.select("cid", "token"), freq, "token", total)
    # Frequent values last: the prefix of a class is what its agreements cannot avoid.
    lists = shared.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("tokens"), F.sum("freq").alias("weight")).filter(F.size("tokens") >= least)
    lists = lists.select("cid", "weight", F.slice("tokens", 1, F.size("tokens") - least + 1).alias("tokens"))
    near = scratch.settle(classes.select("cid", "rep", "n").join(lists, "cid"), "near")
    scratch.drop(classes)
    prefix = near.select("cid", "n", "weight", F.inline("tokens"))

    wanted = near.select("cid", F.col("rep").alias("_rep"))
    if near.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep"))).select("text", "cid")
    profiles = texts.mapInArrow(_sets, "cid binary, shingles array<bigint>, sig array<bigint>").dropDuplicates(["cid"])
    profiles = scratch.settle(profiles, "profiles")

    hub = prefix.groupBy("token").agg(F.max(F.struct("weight", "cid", "n")).alias("hub"), F.first("freq").alias("freq"))
    star = lookup_join(prefix.drop("freq"), hub, "token", total)
    fits = 100 * F.least("n", "hub.n") >= threshold * F.greatest("n", "hub.n")
    star = star.filter((F.col("cid") != F.col("hub.cid")) & fits).select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")).distinct()
    first = scratch.settle(_confirmed(star, profiles, threshold), "links")
    labels = components(first, scratch)

    # Second round: lists that still join different components.
    open_ = prefix.join(labels.select(F.col("id").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = open_.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("freq").alias("freq")).filter("lo != hi").select("token", "freq")
    open_ = scratch.settle(lookup_join(open_.drop("freq", "weight"), mixed, "token", total).select("cid", "n", "token", "label"), "open")
    # Shingles that no other open class holds bound the similarity of their owner from above.
    members = open_.select("cid").distinct()
    held = profiles.join(members, "cid").select(F.xxhash64("cid").alias("own"), F.explode("shingles").alias("s"))
    alone = held.groupBy("s").agg(F.count("*").alias("c"), F.first("own").alias("own")).filter("c = 1").groupBy("own").agg(F.count("*").alias("alone"))
    bound = members.withColumn("own", F.xxhash64("cid")).join(alone, "own", "left").select("cid", F.coalesce("alone", F.lit(0)).alias("alone"))
    able = open_.join(bound, "cid").withColumn("can", F.col("n") - F.col("alone")).filter(100 * F.col("can") >= threshold * F.col("n")).drop("alone")
    able = scratch.settle(able.join(_differences(prefix, hub, members, profiles, total), "cid", "left"), "able")
    scratch.drop(open_)
    second = scratch.settle(_confirmed(_open_pairs(able, threshold), profiles, threshold), "links")
    scratch.drop(able, near, profiles, labels)
    return rows, components(first.unionByName(second), scratch)


def _differences(prefix: DataFrame, hub: DataFrame, members: DataFrame, profiles: DataFrame, total: int) -> DataFrame:
    """cid, ref and diff: the most central member of its lists, and the shingles that only one of the two holds.

    Against one reference, two documents differ where their differences do, so short arrays give their exact
    similarity. Differences of more than DIFFERENCE shingles are left out.
    """
    refs = lookup_join(prefix.select("cid", "token").join(members, "cid"), hub, "token", total).groupBy("cid").agg(F.max("hub").alias("hub")).select("cid", F.col("hub.cid").alias("ref"))
    own = refs.join(profiles.select("cid", F.col("shingles").alias("own")), "cid")
    both = own.join(profiles.select(F.col("cid").alias("ref"), F.col("shingles").alias("of")), "ref")
    diff = F.concat(F.array_except("own", "of"), F.array_except("of", "own"))
    return both.select("cid", "ref", diff.alias("diff")).filter(F.size("diff") <= DIFFERENCE)


def _open_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """Pairs in different components that share a prefix token and may still reach the threshold.

    With ``can`` shingles that others hold, a document's partner has at most can * (1 + 100 / threshold) - n
    shingles. The larger side looks only at the size bands that this leaves open, and where both sides have the
    same reference their differences from it settle the similarity within the join.
    """
    band = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(BAND))).cast("int")
    most = F.least(F.col("n").cast("double"), F.floor(F.col("can") * (1 + 100 / threshold) - F.col("n") + 1e-6))
    least = F.ceil(F.col("n") * threshold / 100 - 1e-6)
    large = rows.withColumn("most", most).withColumn("least", least).filter("most >= least")
    large = large.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("can").alias("ca"), F.col("label").alias("la"), F.col("ref").alias("ra"), F.col("diff").alias("da"), "token", F.explode(F.sequence(band(F.col("least")), band(F.col("most")))).alias("band"))
    small = rows.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("can").alias("cb"), F.col("label").alias("lb"), F.col("ref").alias("rb"), F.col("diff").alias("db"), "token", band(F.col("n")).alias("band"))
    both = large.join(small, ["token", "band"])
    ordered = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    may = similar(F.least("ca", "cb", "nb"), F.col("na"), F.col("nb"), threshold)
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    exact = (100 - threshold) * (F.col("na") + F.col("nb")) >= (100 + threshold) * apart
    does = F.when(F.col("ra") == F.col("rb"), exact).otherwise(F.lit(True))
    return both.filter((F.col("la") != F.col("lb")) & ordered & may & does).select("a", "b").distinct()


def cluster(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    component_id is the smallest doc_id reachable over links. Null and empty texts have no shingles and stand
    alone; repeated rows are all returned, in one component; an empty table gives an empty result; other columns
    are ignored. A null doc_id counts only where a component has no other. doc_id keeps its type.
    """
    with Scratch(docs.sparkSession, "near_dedup") as scratch:
        rows, labels = links(docs, threshold, scratch)
        classes = rows.filter("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("rep"))
        grouped = classes.join(labels, classes["cid"] == labels["id"], "left").select("cid", "rep", F.coalesce("label", "cid").alias("label"))
        least = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
        named = grouped.join(least, "label").select("cid", "component_id")
        out = rows.join(named, "cid", "left")
        whole = F.coalesce("component_id", "doc_id")
        out = out.select("doc_id", "n_shingles", whole.alias("component_id"), F.col("doc_id").eqNullSafe(whole).alias("kept"))
        return scratch.settle(out, "clusters", keep=True)


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest doc_id, once.

    doc_id identifies a document: rows that repeat it are one. Null and empty texts stand alone and stay; an empty
    table stays empty; other columns pass through, whatever their names.
    """
    key, several = own_names(2)
    found = cluster(docs, threshold)
    # A document goes where none of its rows is kept; most stay, so the rest is what is joined.
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select(F.col("doc_id").alias(key))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    left = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(key)), "left_anti")
    twice = found.filter("kept").groupBy("doc_id").agg(F.count("*").alias(several)).filter(F.col(several) > 1).select(F.col("doc_id").alias(key))
    if twice.isEmpty():
        return left
    repeated = left.join(twice, left["doc_id"].eqNullSafe(F.col(key)), "left_semi").dropDuplicates(["doc_id"])
    return left.join(twice, left["doc_id"].eqNullSafe(F.col(key)), "left_anti").unionByName(repeated)
