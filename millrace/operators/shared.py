"""Tables settled in the folder that driver and executors share, and places in an order that needs no single task."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch on its way to Python, and bytes of rows that Python gathers before it hands them on.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
HELD_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCHES, for queries whose rows are whole pages or files."""
    for key, most in BATCHES.items():
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def pieces(batches: Iterable[pa.RecordBatch], size: Callable[[dict], int], make: Callable[[dict], Iterable], pack: Callable[[list], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pack`` of what ``make`` gives for the rows of a task, a row at a time and about HELD_BYTES of rows together.

    ``size`` tells the bytes that a made row holds. A worker outlives its task, so it hands back unused memory.
    """
    held, bytes_held = [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            for made in make(batch.slice(at, 1).to_pylist()[0]):
                held.append(made)
                bytes_held += size(made)
                if bytes_held >= HELD_BYTES:
                    yield pack(held)
                    held, bytes_held = [], 0
    if held:
        yield pack(held)
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # of the C library on Linux
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on one machine, where none is named, one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and a lost executor costs a re-read."""
    path = new_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rank_in(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``df`` with the place of each row in its group by ``order``, from 0, where a group may be larger than a task.

    Rows are sorted by ranges of (group, order) over all partitions; a partition numbers the rows it has of a group, and
    the counts of (partition, group), few rows for a group each, say how many come before.
    """
    part = F.shiftrightunsigned(F.col("_at"), 33)
    placed = settled(df.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", part)
    sizes = placed.groupBy(group, "_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    joined = placed.join(sizes, placed[group].eqNullSafe(sizes["_group"]) & (placed["_part"] == sizes["_of"]))
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_group", "_of", "_first", "_before")
