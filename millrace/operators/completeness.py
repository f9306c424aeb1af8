"""How complete the capture of a conversation is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_preview, text_preview

TOP = "Scanner did not confirm the top of the conversation."
BOTTOM = "Scanner did not confirm the bottom of the conversation."
VIRTUAL = "Platform virtualization may hide unloaded messages."
PREVIEW_ROWS = 6


def status(count: Column, top: Column, bottom: Column, virtualized: Column, warnings: Column) -> Column:
    return (
        F.when(count == 0, "unknown")
        .when(~top | ~bottom, "partial")
        .when(virtualized | (F.size(warnings) > 0), "probably_complete")
        .otherwise("complete")
    )


def report(messages: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """One row per conversation: counts, previews, warnings and the status.

    ``scans`` (conv_id, reached_top, reached_bottom, scroll_steps, duplicate_count, scan_warnings, platform_warnings,
    virtualized) says how each was captured; conversations it names without messages get a report too. Without it
    every conversation counts as captured from top to bottom.
    """
    ends = messages.groupBy("conv_id").agg(
        F.count("*").alias("message_count"), F.min_by("text", "idx").alias("first_text"), F.max_by("text", "idx").alias("last_text")
    )
    none = F.expr("cast(array() as array<string>)")
    if scans is None:
        facts = ends.withColumns(
            {"reached_top": F.lit(True), "reached_bottom": F.lit(True), "scroll_steps": F.lit(0), "duplicate_count": F.lit(0).cast("long"), "scan_warnings": none, "platform_warnings": none, "virtualized": F.lit(False)}
        )
    else:
        facts = scans.join(ends, "conv_id", "left").withColumns(
            {
                "message_count": F.coalesce("message_count", F.lit(0).cast("long")),
                **{c: F.coalesce(c, F.lit(False)) for c in ("reached_top", "reached_bottom", "virtualized")},
                **{c: F.coalesce(c, none) for c in ("scan_warnings", "platform_warnings")},
            }
        )
    return judged(facts)


def judged(facts: DataFrame) -> DataFrame:
    """Reports of captures: ``facts`` holds per conversation what ``report`` gathers, with first_text and last_text."""
    found = F.array_compact(
        F.array(F.when(~F.col("reached_top"), TOP), F.when(~F.col("reached_bottom"), BOTTOM), F.when(F.col("virtualized"), VIRTUAL))
    )
    facts = facts.withColumn("warnings", F.array_distinct(F.concat("scan_warnings", found)))
    return facts.select(
        "conv_id",
        status(F.col("message_count"), F.col("reached_top"), F.col("reached_bottom"), F.col("virtualized"), F.col("warnings")).alias("status"),
        "warnings",
        "message_count",
        text_preview(F.col("first_text")).alias("first_message_preview"),
        text_preview(F.col("last_text")).alias("last_message_preview"),
        "reached_top",
        "reached_bottom",
        "scroll_steps",
        "duplicate_count",
        "platform_warnings",
    )


def scan_summary(messages: DataFrame) -> DataFrame:
    """conv_id, message and selected counts, and the first rows as previews."""
    row = F.struct("idx", "role", "author_label", text_preview(F.col("text")).alias("preview"))
    selected = F.count_if(F.coalesce(F.try_element_at("metadata", F.lit("selected")) == "true", F.lit(False)))
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("message_count"),
        selected.alias("selected_count"),
        F.array_sort(F.collect_list(F.when(F.col("idx") < PREVIEW_ROWS, row))).alias("preview"),
    )


def rescope(messages: DataFrame, reports: DataFrame) -> DataFrame:
    """``reports`` with the counts and previews of the messages left after a scope filter."""
    left = messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("text", "idx").alias("a"), F.max_by("text", "idx").alias("b"))
    joined = reports.drop("message_count", "first_message_preview", "last_message_preview").join(left, "conv_id", "left")
    return joined.withColumns(
        {"message_count": F.coalesce("n", F.lit(0).cast("long")), "first_message_preview": short_preview(F.col("a")), "last_message_preview": short_preview(F.col("b"))}
    ).drop("n", "a", "b")
