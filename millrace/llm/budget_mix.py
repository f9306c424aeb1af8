"""Mixing sources to target weights by fitting each source's word budget as a subset sum.

Documents are counted by exact length; per source the target is met by whole passes over the source plus a
remaining budget, which is spread over the lengths in proportion, then closed exactly by bounded-knapsack dynamic
programming over the lengths that are left. Which documents of a length are taken is settled by a seeded hash.
Only histograms (source, length, count) reach the knapsack; a source's histogram has at most about
sqrt(2 x its words) rows, however many documents it has. The choice comes down to a cutoff of the hash per source and
length, so documents are taken where they lie: their texts are not shuffled while the cutoffs fit a broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lookup_join, own_names, running, word_count

WEIGHTS = (1, 2, 3)
#: No source's target, and no document's taken words, exceeds this many times its size.
MAX_REPEATS = 3
SEED = 20240
#: Words left for the knapsack, at most about twice this; parameter of the exact part, not of the corpus.
KNAPSACK_WORDS = 32_768
#: Hash buckets that split a group of equal lengths, so that no group is ranked in one task.
BUCKETS = 256
#: Cutoffs (source, length and six numbers) are broadcast up to this many; beyond it rows are shuffled to meet them.
BROADCAST_ROWS = 200_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: words in the text, 0 for null."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, freq (documents), source_size, weight, target.

    Sources in code-point order, null last, get the weights in turn. The words of all sources are shared by
    weight; a source whose share exceeds ``max_repeats`` times its size stops there and the excess is shared among
    the others, until none is above. Sources may be hosts, so they are ranked over many partitions.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("freq"), F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    named = running(per, [by_name], scratch).select("source", "freq", "source_size", weight.alias("weight"))
    # By falling cap per weight, the first k sources capped and the rest uncapped: one level fits.
    named = named.withColumn("ratio", (F.col("source_size") * max_repeats) / F.col("weight"))
    filled = running(named, [F.col("ratio").asc(), by_name], scratch, ("source_size", "weight"))
    whole = F.broadcast(named.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight")))  # one row
    level = (F.col("all_words") - F.col("source_size_before") * max_repeats) / (F.col("all_weight") - F.col("weight_before"))
    filled = scratch.settle(filled.crossJoin(whole).withColumn("level", level), "levels")
    # The first source, by rising ratio, that stays below its cap sets the level of all after it.
    final = F.broadcast(filled.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).alias("first")).select(F.col("first.level").alias("final")))  # one row
    cap = (F.col("source_size") * max_repeats).cast("double")
    target = F.when(F.col("final").isNull(), cap).otherwise(F.least(cap, F.col("final") * F.col("weight")))
    return filled.crossJoin(final).select("source", "freq", "source_size", "weight", target.alias("target"))


def fit_counts(lengths: list[int], counts: list[int], budget: int, knapsack: int = KNAPSACK_WORDS) -> list[int]:
    """How many documents of each length to take so that the lengths sum to ``budget``, or as near as can be.

    Lengths are distinct and positive. The bulk is taken in proportion to the counts, until a part of about
    ``knapsack`` words is open; dynamic programming closes that part from what is left.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    bulk = max(0, budget - knapsack)
    take = [c * bulk // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:  # rounding down left more open than asked for
        if left <= 2 * knapsack:
            break
        k = min(counts[i] - take[i], (left - knapsack) // lengths[i])
        take[i] += max(0, k)
        left -= max(0, k) * lengths[i]
    # Reachable sums as bits; a length with c copies left is added as 1, 2, 4, ... of them.
    room = left + max(lengths)
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for i in sorted(order, key=lambda i: (lengths[i] > room, i)):
        spare, piece = min(counts[i] - take[i], room // lengths[i]), 1
        while spare > 0 and not reach >> left & 1:
            piece = min(piece, spare)
            steps.append((i, piece, reach))
            reach |= reach << piece * lengths[i] & mask
            spare, piece = spare - piece, piece * 2
    low = (reach & (1 << (left + 1)) - 1).bit_length() - 1
    above = reach >> (left + 1)
    high = left + (above & -above).bit_length() if above else None
    goal = high if high is not None and high - left < left - low else low
    for i, piece, before in reversed(steps):
        if not before >> goal & 1:
            take[i] += piece
            goal -= piece * lengths[i]
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    total = int(pdf["source_size"].iloc[0])
    budget = round(float(pdf["target"].iloc[0]))
    passes = budget // total if total else 0
    out = pdf[["source", "size", "copies"]].copy()
    out["passes"] = passes
    out["extra"] = fit_counts(pdf["size"].tolist(), pdf["copies"].tolist(), budget - passes * total) if total else 0
    return out


def plan(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """source, size, copies, passes (whole passes over the source), extra (documents of this length once more)."""
    hist = sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("copies"))
    both = hist.alias("h").join(goal.alias("g"), F.col("h.source").eqNullSafe(F.col("g.source"))).select("h.source", "size", "copies", "source_size", "target")
    return both.groupBy("source").applyInPandas(_fit_source, "source string, size long, copies long, passes long, extra long")


def _draw(seed: int, doc_id) -> tuple[Column, Column]:
    """The seeded hash of a document, and its bucket; documents of a length are taken by bucket, then by hash."""
    draw = F.xxhash64(F.lit(seed), doc_id)
    return draw, F.pmod(draw, F.lit(BUCKETS)).cast("int")


def cutoffs(sizes: DataFrame, goal: DataFrame, seed: int = SEED) -> DataFrame:
    """source, size, passes, full, open, cutoff, take, tied: which documents of a length are taken once more.

    Those of the buckets up to ``full``, and those of the bucket ``open`` whose hash is below the cutoff, and ``take``
    of the ``tied`` rows that have the cutoff itself (rows of one doc_id). Ranking is left to the one open bucket.
    """
    draw, bucket = _draw(seed, F.col("doc_id"))
    drawn = sizes.filter("size > 0").select("doc_id", "source", "size", draw.alias("draw"), bucket.alias("bucket"))
    per = drawn.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    fitted = plan(sizes, goal)
    quota = per.alias("b").join(fitted.alias("f"), F.col("b.source").eqNullSafe(F.col("f.source")) & (F.col("b.size") == F.col("f.size")))
    quota = quota.select("b.source", "b.size", "bucket", "passes", "n", F.least(F.col("n"), F.greatest(F.lit(0), F.col("extra") - F.col("below"))).alias("quota"))
    part = F.when((F.col("quota") > 0) & (F.col("quota") < F.col("n")), F.struct("bucket", "quota"))
    lengths = quota.groupBy("source", "size").agg(F.first("passes").alias("passes"), F.coalesce(F.max(F.when(F.col("quota") == F.col("n"), F.col("bucket"))), F.lit(-1)).alias("full"), F.max(part).alias("part"))
    lengths = lengths.select("source", "size", "passes", "full", F.col("part.bucket").alias("open"), F.col("part.quota").alias("quota"))
    some = lengths.filter("open IS NOT NULL")
    inside = drawn.alias("d").join(some.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.size") == F.col("s.size")) & (F.col("d.bucket") == F.col("s.open")))
    group = Window.partitionBy("source", "size")
    ranked = inside.select("d.source", "d.size", "draw", "quota", F.row_number().over(Window.partitionBy("d.source", "d.size").orderBy("draw", "doc_id")).alias("rank"))
    ranked = ranked.withColumn("cutoff", F.max(F.when(F.col("rank") <= F.col("quota"), F.col("draw"))).over(group)).filter("draw = cutoff")
    cut = ranked.groupBy("source", "size").agg(F.first("cutoff").alias("cutoff"), F.count_if(F.col("rank") <= F.col("quota")).alias("take"), F.count("*").alias("tied"))
    return lengths.alias("l").join(cut.alias("c"), F.col("l.source").eqNullSafe(F.col("c.source")) & (F.col("l.size") == F.col("c.size")), "left").select("l.source", "l.size", "passes", "full", "open", "cutoff", "take", "tied")


def _once_more(cut: dict[str, Column], draw: Column, bucket: Column, rank: Column) -> Column:
    """Whether a document is taken once more; ``rank`` counts from 1 where only some of the tied rows are, else it is 0."""
    tied = draw == cut["cutoff"]
    inside = (bucket == cut["open"]) & ((draw < cut["cutoff"]) | tied & (rank <= cut["take"]))
    return (bucket <= cut["full"]) | F.coalesce(inside, F.lit(False))


def _copies(rows: DataFrame, cut: DataFrame, source: Column, size: Column, doc_id: Column, seed: int, order: Column) -> tuple[DataFrame, Column]:
    """``rows`` of documents with words, and how often each is taken; ``order`` settles tied rows."""
    draw, bucket = _draw(seed, doc_id)
    names = own_names(len(cut.columns))
    theirs = dict(zip(cut.columns, map(F.col, names), strict=True))
    whole = cut.filter("take < tied").isEmpty()
    cut = cut.toDF(*names)
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut
    met = rows.join(cut, source.eqNullSafe(theirs["source"]) & (size == theirs["size"]))
    if whole:  # as a rule
        return met, theirs["passes"] + _once_more(theirs, draw, bucket, F.lit(0)).cast("long")
    # Rows of one doc_id of which only some are taken: very few, and ranked by themselves in another reading.
    at = (bucket == theirs["open"]) & (draw == theirs["cutoff"])
    torn = F.coalesce(at & (theirs["take"] < theirs["tied"]), F.lit(False))
    (rank,) = own_names(1)
    ranked = met.filter(torn).withColumn(rank, F.row_number().over(Window.partitionBy(theirs["source"], theirs["size"]).orderBy(order)))
    met = met.filter(~torn).withColumn(rank, F.lit(0)).unionByName(ranked)
    return met, theirs["passes"] + _once_more(theirs, draw, bucket, F.col(rank)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document.

    ``taken`` is a whole number of copies times the size: repeats are whole documents. Ties within a length go by
    a seeded hash of doc_id, so reruns agree; repeated rows are documents of their own. A null text has size 0 and
    takes 0; null sources form one source, the last; an empty table gives an empty result. Extra columns are ignored.
    """
    with Scratch(docs.sparkSession, "mix") as scratch:
        sizes = scratch.settle(sized(docs), "sizes")  # the texts are read once; the rest is numbers
        goal = scratch.settle(targets(sizes, scratch, weights, max_repeats), "targets")
        cut = scratch.settle(cutoffs(sizes, goal, seed), "cutoffs")
        met, copies = _copies(sizes.filter("size > 0"), cut, F.col("source"), F.col("size"), F.col("doc_id"), seed, F.col("doc_id"))
        taken = met.select("doc_id", "source", "size", (F.col("size") * copies).alias("taken"))
        taken = taken.unionByName(sizes.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
        # A source may hold a third of all documents: its row is broadcast.
        (key,) = own_names(1)
        named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
        facts = goal.select(named.alias(key), "freq", "source_size", "target")
        full = lookup_join(taken.withColumn(key, named), facts, key, sizes.count())
        return scratch.settle(full.select("doc_id", "source", "size", "source_size", "target", "taken"), "mix", keep=True)


def apply(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document's row as often as the mix takes it (documents of size 0: never).

    Rows with a null doc_id or source are taken like any other; an empty table stays empty; other columns pass through,
    whatever their names.
    """
    with Scratch(docs.sparkSession, "mix") as scratch:
        sizes = scratch.settle(sized(docs), "sizes")
        goal = scratch.settle(targets(sizes, scratch, weights, max_repeats), "targets")
        cut = scratch.settle(cutoffs(sizes, goal, seed), "cutoffs", keep=True)
    row, size, k, i = own_names(4)
    # The row travels as one struct, so no name of its columns can meet one of ours.
    own = docs.select(F.struct("*").alias(row), word_count(F.col("text")).alias(size)).filter(F.col(size) > 0)
    at = F.col(row)
    met, copies = _copies(own, cut, at["source"], F.col(size), at["doc_id"], seed, at["text"])
    taken = met.select(row, copies.cast("int").alias(k)).filter(F.col(k) > 0)
    return taken.select(row, F.explode(F.sequence(F.lit(1), F.col(k))).alias(i)).select(f"{row}.*")
