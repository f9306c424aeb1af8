"""Which messages of a conversation are exported: by role, by mark or by range of positions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint

SCOPES = ("all", "selected", "user_only", "assistant_only", "range")
#: Selections up to this many keys are broadcast; larger ones are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def select_by_keys(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """Mark the messages that ``keys`` (key) names by id, by fingerprint or by ``role:text``.

    A mark is only ever set, in ``metadata['selected']``. Repeated and null keys change nothing.
    """
    named = keys.select(F.col("key").alias("_key")).filter("_key is not null").distinct()
    if named.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        named = F.broadcast(named)
    each = messages.withColumn("_row", F.struct("conv_id", "idx"))
    asked = each.select("_row", F.explode(F.array("id", fingerprint(F.col("role"), F.col("text")), F.concat_ws(":", "role", "text"))).alias("_key"))
    hit = asked.join(named, "_key").select("_row").distinct().withColumn("_hit", F.lit(True))
    base = F.coalesce("metadata", F.expr("cast(map() as map<string,string>)"))
    rest = F.map_filter(base, lambda k, _: k != "selected")
    marked = F.when(F.col("_hit"), F.map_concat(rest, F.create_map(F.lit("selected"), F.lit("true")))).otherwise(F.col("metadata"))
    return each.join(hit, "_row", "left").withColumn("metadata", marked).drop("_row", "_hit")


def select_messages(messages: DataFrame, ids: Iterable[str] = (), fingerprints: Iterable[str] = ()) -> DataFrame:
    """The same for short lists that come with the request; they become literals of the plan."""
    ids, marks = list(ids), list(fingerprints)
    hit = F.lit(False)
    if ids:
        hit = hit | F.col("id").isin(*ids)
    if marks:
        hit = hit | fingerprint(F.col("role"), F.col("text")).isin(*marks) | F.concat(F.col("role"), F.lit(":"), F.col("text")).isin(*marks)
    rest = F.map_filter(F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")), lambda k, _: k != "selected")
    return messages.withColumn("metadata", F.when(hit, F.map_concat(rest, F.create_map(F.lit("selected"), F.lit("true")))).otherwise(F.col("metadata")))


def range_error(start: Column, end: Column, count: Column) -> Column:
    """What is wrong with an inclusive range of positions; null where it is right. The first rule that fails counts."""

    def whole(c: Column) -> Column:
        return c.isNotNull() & (c >= 0) & (F.floor(c) == c)

    return (
        F.when(start.isNull() & end.isNull(), "Range start and end are required.")
        .when(~whole(start), "Range start must be zero or greater.")
        .when(~whole(end), "Range end must be zero or greater.")
        .when(start > end, "Range start must be less than or equal to range end.")
        .when(start >= count, "Range start is outside the available message count.")
        .when(end >= count, "Range end is outside the available message count.")
    )


def filter_scope(messages: DataFrame, scope: str = "all", start: float | None = None, end: float | None = None) -> DataFrame:
    """The messages of a scope, renumbered from 0. An invalid range leaves a conversation nothing."""
    order = Window.partitionBy("conv_id").orderBy("idx")
    if scope == "user_only":
        messages = messages.filter(F.col("role") == "user")
    elif scope == "assistant_only":
        messages = messages.filter(F.col("role") == "assistant")
    elif scope == "selected":
        messages = messages.filter(F.try_element_at("metadata", F.lit("selected")) == "true")
    elif scope == "range":
        low, high = F.lit(start).cast("double"), F.lit(end).cast("double")
        at = messages.withColumns({"_at": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy("conv_id"))})
        messages = at.filter(range_error(low, high, F.col("_n")).isNull() & F.col("_at").between(low, high)).drop("_at", "_n")
    return messages.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))


def exported_count(messages: DataFrame, scope: str = "all", start: float | None = None, end: float | None = None) -> DataFrame:
    """conv_id, exported: messages of each conversation in scope."""
    return filter_scope(messages, scope, start, end).groupBy("conv_id").agg(F.count("*").alias("exported"))
