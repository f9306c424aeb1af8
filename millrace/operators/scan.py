"""Replay of a stepwise capture: the union of snapshots, and when the loop would have ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .normalize import dedupe

MAX_STEPS, MAX_STALLS = 1500, 8
STALLED = "Scan stalled before reaching the bottom."
STEP_LIMIT = "Scan reached the maximum scroll step limit."


def stalls(steps: DataFrame) -> DataFrame:
    """``steps`` (conv_id, step, new_messages, at_bottom) with the run of steps without progress that each ends."""
    order = Window.partitionBy("conv_id").orderBy("step")
    moved = (F.coalesce("new_messages", F.lit(0)) > 0).cast("int")
    island = steps.withColumn("_island", F.sum(moved).over(order))
    run = F.sum(1 - moved).over(Window.partitionBy("conv_id", "_island").orderBy("step"))
    return island.withColumn("stalls", run).drop("_island")


def replay(steps: DataFrame, max_steps: int = MAX_STEPS, max_stalls: int = MAX_STALLS) -> DataFrame:
    """conv_id, scroll_steps, reached_bottom, scan_warnings: where the first of three ends stops each capture."""
    end = F.when(F.col("at_bottom"), "bottom").when(F.col("stalls") >= max_stalls, "stalled").when(F.col("step") >= max_steps, "limit")
    ends = stalls(steps).withColumn("end", end)
    last = ends.groupBy("conv_id").agg(
        F.min_by(F.struct("step", "end"), F.when(F.col("end").isNotNull(), F.col("step"))).alias("stop"), F.max("step").alias("last")
    )
    warning = F.when(F.col("stop.end") == "stalled", F.array(F.lit(STALLED))).when(F.col("stop.end") == "limit", F.array(F.lit(STEP_LIMIT)))
    return last.select(
        "conv_id",
        F.coalesce("stop.step", "last").alias("scroll_steps"),
        F.coalesce(F.col("stop.end") == "bottom", F.lit(False)).alias("reached_bottom"),
        F.coalesce(warning, F.expr("cast(array() as array<string>)")).alias("scan_warnings"),
    )


def merge_snapshots(windows: DataFrame) -> DataFrame:
    """Visible windows (conv_id, step, idx, message columns) to one list: first sight counts, by id or fingerprint."""
    order = F.struct("step", "idx")
    at = windows.withColumn("_at", F.row_number().over(Window.partitionBy("conv_id").orderBy(order)).cast("long"))
    return dedupe(at, "_at").drop("_at")


def cache_state(snapshots: DataFrame, now: DataFrame) -> DataFrame:
    """page_id, scan_id, state of every page of ``now`` (page_id, url): whether its last snapshot may be used again.

    ``snapshots`` has page_id, source_url, scan_id and saved_at. A page without a snapshot is missing, one that has moved
    to another address since is stale.
    """
    last = snapshots.groupBy("page_id").agg(F.max_by(F.struct("source_url", "scan_id"), "saved_at").alias("last"))
    state = F.when(F.col("last").isNull() | F.col("last.scan_id").isNull(), "missing").when(F.col("last.source_url") != F.col("url"), "stale").otherwise("ready")
    return now.join(last, "page_id", "left").select("page_id", F.when(state == "ready", F.col("last.scan_id")).alias("scan_id"), state.alias("state"))
