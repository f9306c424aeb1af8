"""Checks: the shape of conversations, and what must not be in rendered output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import PLATFORM_NAMES, ROLES, SOURCE_KINDS, STATUSES

#: Traces of embedded images and of page markup in outputs.
HYGIENE = {"data_image": "data:image", "base64": "base64,", "png_payload": "iVBOR", "author_role": "data-message-author-role", "turn_marker": "conversation-turn-"}


def _bad(ok: Column, message: str | Column) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), message if isinstance(message, Column) else F.lit(message))


def validate(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, errors: everything wrong with a conversation, in a fixed order with paths; an empty list if nothing.

    ``conversations`` has schema_version, platform, platform_label, source_url, exported_at, message_count and status.
    """

    def at(field: str) -> Column:
        return F.concat(F.lit("messages["), F.col("idx").cast("string"), F.lit(f"].{field}"))

    each = F.array_compact(
        F.array(
            _bad(F.col("id").isNotNull(), F.concat(at("id"), F.lit(" must be a string"))),
            _bad(F.col("role").isin(*ROLES), F.concat(at("role"), F.lit(" must be a supported chat role"))),
            _bad(F.col("author_label").isNotNull(), F.concat(at("authorLabel"), F.lit(" must be a string"))),
            _bad(F.col("text").isNotNull(), F.concat(at("text"), F.lit(" must be a string"))),
        )
    )
    kinds = F.filter(
        F.transform(F.coalesce("sources", F.expr("cast(array() as array<struct<kind:string>>)")) if "sources" not in messages.columns else F.col("sources"),
                    lambda x, i: F.when(~F.coalesce(x["kind"].isin(*SOURCE_KINDS), F.lit(False)), F.concat(at("sources["), i.cast("string"), F.lit("].kind must be a supported source kind")))),
        lambda e: e.isNotNull(),
    ) if "sources" in messages.columns else F.expr("cast(array() as array<string>)")
    rows = messages.select("conv_id", F.struct("idx", F.concat(each, F.coalesce(kinds, F.expr("cast(array() as array<string>)"))).alias("errors")).alias("row"))
    inner = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("row.errors") > 0, F.col("row")))), lambda r: r["errors"])).alias("inner"))
    count = F.col("message_count")
    before = F.array(
        _bad(F.col("schema_version") == "1.0", 'schemaVersion must be "1.0"'), _bad(F.col("platform").isin(*PLATFORM_NAMES), "platform must be a supported chat platform"),
        _bad(F.col("platform_label").isNotNull(), "platformLabel must be a string"), _bad(F.col("source_url").isNotNull(), "sourceUrl must be a string"),
        _bad(F.col("exported_at").isNotNull(), "exportedAt must be a string"), _bad(count >= 0, "messageCount must be a non-negative integer"),
    )
    after = F.array(F.when(count.isNotNull() & (count != F.coalesce("n", F.lit(0))), "messageCount must match messages.length"), _bad(F.col("status").isin(*STATUSES), "completeness.status must be a supported completeness status"))
    return conversations.join(inner, "conv_id", "left").select("conv_id", F.array_compact(F.concat(before, F.coalesce("inner", F.expr("cast(array() as array<string>)")), after)).alias("errors"))


def hygiene(df: DataFrame, column: str = "text") -> DataFrame:
    """One row: how many values of a column hold each forbidden trace, and how many hold any."""
    found = {name: F.coalesce(F.contains(F.col(column), F.lit(trace)), F.lit(False)) for name, trace in HYGIENE.items()}
    any_of = F.lit(False)
    for hit in found.values():
        any_of = any_of | hit
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(hit).alias(name) for name, hit in found.items()], F.count_if(any_of).alias("n_flagged"))
