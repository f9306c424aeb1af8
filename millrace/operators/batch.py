"""Batch export: which tabs qualify, what their entries are called, and the manifest of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, slugify
from ..functions.urls import host, platform_hosts


def candidates(tabs: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """tab_id, platform, platform_label, title, url, origin of ``tabs`` (tab_id, title, url) on a known host."""
    hosts = F.broadcast(hosts if hosts is not None else platform_hosts(tabs.sparkSession))  # one row per known host
    named = tabs.filter("tab_id is not null").withColumn("host", host(F.col("url"))).join(hosts, "host")
    return named.select("tab_id", "platform", "platform_label", F.coalesce(blank_to_null(F.col("title")), F.lit("Untitled chat")).alias("title"), "url", "origin")


def requested(found: DataFrame, asked: DataFrame) -> DataFrame:
    return found.join(asked.select("tab_id"), "tab_id", "left_semi")


def stale(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Requested tabs that are no longer there."""
    return asked.select("tab_id").distinct().join(found, "tab_id", "left_anti")


def root_directory(exported_at: Column, prefix: str = "millrace") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(exported_at, 1, 10))


def entry_names(found: DataFrame, batch: str, order: str = "tab_id") -> DataFrame:
    """``found`` with ``entry``: platform, slug and number in its batch (the column ``batch``), by ``order``."""
    number = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    return found.withColumn("entry", F.concat_ws("-", "platform", slugify(F.col("title")), number.cast("string")))


def display_names(found: DataFrame) -> DataFrame:
    """``found`` with ``title_count`` and ``display``: the host, with the path where a title occurs twice.

    Titles are counted by a partial aggregation and joined on, so that a title of very many tabs is no single task.
    """
    key = F.lower(F.trim("title"))
    counts = found.groupBy(key.alias("_title")).agg(F.count("*").alias("title_count"))
    path = F.regexp_replace(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), "/$", "")
    counted = found.join(counts, key == F.col("_title")).drop("_title")
    return counted.withColumn("display", F.concat(F.coalesce(host(F.col("url")), F.lit("")), F.when(F.col("title_count") > 1, path).otherwise("")))


def manifest(results: DataFrame) -> DataFrame:
    """batch_id, counts and the manifest rows of ``results`` (batch_id, entry_no, tab_id, platform, title, url, error,
    message_count, files, warnings): a result with an error failed, and lists neither files nor a count."""
    ok = F.col("error").isNull()
    row = F.struct(
        "entry_no", F.when(ok, "success").otherwise("failed").alias("status"), F.col("tab_id").alias("tabId"), "platform", "title", "url", "error",
        F.when(ok, F.col("message_count")).alias("messageCount"), F.when(ok, F.col("files")).alias("files"), F.coalesce("warnings", F.expr("cast(array() as array<string>)")).alias("warnings"),
    )
    return results.groupBy("batch_id").agg(
        F.count("*").alias("result_count"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failed_count"),
        F.bool_or(ok & F.coalesce(F.size("files") > 0, F.lit(False))).alias("has_files"),
        F.array_sort(F.collect_list(row)).alias("results"),
    )


def manifest_json(results: DataFrame, exported_at: str) -> DataFrame:
    """batch_id, text: the manifest as JSON."""
    rows = F.transform("results", lambda r: r.dropFields("entry_no"))
    body = F.struct(F.lit(exported_at).alias("exportedAt"), F.lit("millrace").alias("generatedBy"), F.col("result_count").alias("resultCount"), root_directory(F.lit(exported_at)).alias("rootDirectory"), rows.alias("results"))
    return manifest(results).select("batch_id", F.to_json(body).alias("text"))
