"""Normalisation of raw messages and removal of repeats within a conversation.

A message repeats an earlier *kept* one if it has its id or its fingerprint. Where one of both keys decides, that is
a running window over the conversation; only rows whose id occurs with several fingerprints, or the reverse, depend
on each other's fate. These are folded in order, row by row, by a task that remembers the keys of one conversation at a
time; or, for conversations beyond a task (``rounds``), settled in rounds over all rows at once: a row that is the first
of its id and of its fingerprint among those not yet decided is kept, and those that share a key with it go. Rows equal
in both keys collapse before, in a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clean_code, clean_text, fingerprint, stable_hash, trim
from .schema import complete
from .shared import rank_in, settled

#: Names that stand for a role.
USER_NAMES = ("user", "human", "me", "you", "prompt")
ASSISTANT_NAMES = ("assistant", "chatgpt", "ai", "bot", "model")


def role_of(c: Column) -> Column:
    name = F.lower(trim(c))
    return F.when(name.isin(*USER_NAMES), "user").when(name.isin(*ASSISTANT_NAMES), "assistant").when(name.isin("system", "tool"), name).otherwise("other")


def author_label(label: Column, role: Column) -> Column:
    return F.coalesce(blank_to_null(label), F.initcap(role))


def _with(x: Column, fields) -> Column:
    for name, how in fields.items():
        x = x.withField(name, how(x))
    return x


def _of(name: str):
    return lambda x: clean_text(x[name])


def clean_messages(raw: DataFrame) -> DataFrame:
    """Raw rows (conv_id, idx, any message columns) with roles, labels and texts cleaned; empty texts go."""
    df = complete(raw)
    df = df.withColumns({"role": role_of(F.col("role")), "text": clean_text(F.coalesce("text", "markdown", F.lit("")))}).filter(F.length("text") > 0)
    return df.withColumns(
        {
            "id": blank_to_null(F.col("id")),
            "author_label": author_label(F.col("author_label"), F.col("role")),
            "participant": blank_to_null(F.col("participant")),
            "markdown": clean_text(F.col("markdown")),
            "code_blocks": F.coalesce(F.transform("code_blocks", lambda x: x.withField("code", clean_code(x["code"]))), F.expr("cast(array() as array<struct<language:string,code:string>>)")),
            "sources": F.transform("sources", lambda x: _with(x, {n: _of(n) for n in ("id", "title", "url", "snippet")})),
            "thinking_blocks": F.filter(F.transform("thinking_blocks", lambda x: _with(x, {n: _of(n) for n in ("title", "text")})), lambda x: F.length(x["text"]) > 0),
            "canvas": F.transform("canvas", lambda x: _with(x, {n: _of(n) for n in ("title", "text", "url", "warning")})),
            "metadata": F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")),
        }
    )


def _folded(tangled: DataFrame) -> DataFrame:
    """conv_id, idx kept of ``tangled`` (conv_id, idx, id, fp): none shares a key with a row kept before it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, marks = object(), set(), set()
        for batch in batches:
            stays = []
            for conv, ident, mark in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "id", "fp")), strict=True):
                if conv != of:
                    of, ids, marks = conv, set(), set()
                stays.append(ident not in ids and mark not in marks)
                if stays[-1]:
                    marks.add(mark)
                    if ident is not None:
                        ids.add(ident)
            yield batch.select(["conv_id", "idx"]).filter(pa.array(stays, pa.bool_()))

    ordered = tangled.select("conv_id", F.col("idx").cast("long").alias("idx"), "id", "fp").repartition("conv_id").sortWithinPartitions("conv_id", "idx")
    return ordered.mapInArrow(run, f"conv_id {tangled.schema['conv_id'].dataType.simpleString()}, idx long")


#: Rows that one task folds in the end; the rounds before leave no more.
FOLD_ROWS = 1_000_000


def _in_rounds(tangled: DataFrame) -> DataFrame:
    """As ``_folded``, in rounds of joins and aggregates; no conversation has to fit a task.

    Every round decides the first row of each conversation at least, and of rows in no particular order a large part.
    What is left once FOLD_ROWS or fewer rows are open is folded.
    """
    todo, found = settled(tangled.select("conv_id", F.col("idx").cast("long").alias("idx"), "id", "fp")), []
    while todo.count() > FOLD_ROWS:
        of_fp = todo.groupBy("conv_id", "fp").agg(F.min(F.struct("idx", "id")).alias("first")).select("conv_id", "fp", "first.*")
        of_id = todo.filter("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min("idx").alias("idx")).select("conv_id", "idx", F.lit(True).alias("leads"))
        kept = settled(of_fp.join(of_id, ["conv_id", "idx"], "left").filter("id IS NULL OR leads").select("conv_id", "idx", "id", "fp"))
        found.append(kept.select("conv_id", "idx"))
        left = todo.join(kept.select("conv_id", "fp"), ["conv_id", "fp"], "left_anti").select(*todo.columns)
        todo = settled(left.join(kept.filter("id IS NOT NULL").select("conv_id", "id"), ["conv_id", "id"], "left_anti").select(*todo.columns))
    return reduce(DataFrame.unionByName, found, _folded(todo))


def first_rows(keyed: DataFrame, rounds: bool = False) -> DataFrame:
    """conv_id, idx of the kept rows of ``keyed`` (conv_id, idx, id, fp), where id may be null and idx is unique.

    A derived id counts as absent here: it is a hash of the fingerprint and so never decides alone. With ``rounds`` the
    rows are settled while this is called, without a task that takes a conversation whole.
    """
    pairs = keyed.groupBy("conv_id", "id", "fp").agg(F.min("idx").cast("long").alias("idx"))
    if rounds:
        return _in_rounds(pairs)
    # The leading (conv_id) hash partitioning serves every window below and the fold: one shuffle.
    pairs = pairs.repartition("conv_id")
    by_id, by_fp = Window.partitionBy("conv_id", "id"), Window.partitionBy("conv_id", "fp")
    marked = pairs.withColumns({"of_id": F.when(F.col("id").isNull(), 1).otherwise(F.count("*").over(by_id)), "of_fp": F.count("*").over(by_fp)})
    # Rows whose keys nobody else has are kept; the others are folded, conversation by conversation.
    lone = (F.col("of_id") == 1) & (F.col("of_fp") == 1)
    return marked.filter(lone).select("conv_id", "idx").unionByName(_folded(marked.filter(~lone)))


def dedupe(messages: DataFrame, order: str = "idx", rounds: bool = False) -> DataFrame:
    """Cleaned messages without repeats, renumbered from 0 by ``order``; rows without an id get one.

    Adds ``duplicate_count``, the rows its conversation lost. ``order`` must be unique within a conversation. ``rounds``:
    for conversations beyond a task, which are then numbered by ranges of ``order`` too.
    """
    keyed = messages.withColumn("_fp", fingerprint(F.col("role"), F.col("text")))
    if rounds:  # read several times from here on
        keyed = settled(keyed)
    kept = first_rows(keyed.select("conv_id", F.col(order).alias("idx"), "id", F.col("_fp").alias("fp")), rounds).select("conv_id", F.col("idx").alias(order), F.lit(True).alias("_kept"))
    of_conv = Window.partitionBy("conv_id")
    rows = keyed.join(kept, ["conv_id", order], "left")
    if rounds:
        lost = rows.groupBy("conv_id").agg(F.count_if(F.col("_kept").isNull()).alias("duplicate_count"))
        numbered = rank_in(rows.filter("_kept"), "conv_id", order, "_n").join(lost, "conv_id")
    else:
        rows = rows.withColumn("duplicate_count", F.count_if(F.col("_kept").isNull()).over(of_conv)).filter("_kept")
        numbered = rows.withColumn("_n", F.row_number().over(of_conv.orderBy(order)) - 1)
    derived = F.concat(F.lit("msg-"), stable_hash(F.concat("_fp", F.lit(":"), F.col("_n").cast("string"))))
    return numbered.withColumns({"id": F.coalesce("id", derived), "idx": F.col("_n").cast("int")}).drop("_fp", "_kept", "_n")


def normalize(raw: DataFrame, order: str = "idx", rounds: bool = False) -> DataFrame:
    """Raw messages to the messages of clean conversations; ``rounds`` as in ``dedupe``."""
    return dedupe(clean_messages(raw), order, rounds)
