"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words everywhere in this package: space and the ASCII controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters for ``translate``.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """The number of words of a text, 0 for null; no word is made a string of its own."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def quoted(name: str) -> str:
    """A column's name so that Spark takes it whole, dots and backquotes included."""
    return "`" + name.replace("`", "``") + "`"


def own_names(count: int) -> list[str]:
    """Column names that no table of a user has."""
    stem = uuid.uuid4().hex
    return [f"_{stem}_{i}" for i in range(count)]


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions of the runs that begin at ``first`` and are ``count`` long, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


#: Rows and bytes of text that a Python worker takes from an Arrow batch at a time.
STEP_ROWS, STEP_BYTES = 256, 4 << 20


def steps(batch: pa.RecordBatch, column: str, rows: int = STEP_ROWS, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with ``rows`` rows and about ``most`` bytes in ``column`` at most; a longer value comes alone."""
    sizes = batch.column(column).cast(pa.large_binary())
    ends = np.cumsum(np.fromiter((len(v.as_buffer()) if v.is_valid else 0 for v in sizes), np.int64, len(sizes)))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, end - at)
        at = end


def tidy(run: Callable) -> Callable:
    """For functions that go over a task's batches: a Python worker outlives its task, so it hands back unused memory."""

    @wraps(run)
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # of the C library on Linux
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (as in tests) uses a folder below its warehouse; on a cluster nothing
    tells which folder all executors see, so the cluster must name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows and bytes of an Arrow batch while texts go through Python: a task holds a batch or two at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> dict[str, str]:
    """Lower the session's Arrow batches to BATCHES; returns what was set before.

    For applications, as the registered queries and the pipeline: operators that run while they are called do so for
    that time only, those that return a lazy plan leave the session as it is.
    """
    before = {}
    for key, most in BATCHES.items():
        before[key] = spark.conf.get(key)
        now = int(before[key].removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    return before


#: The paths that the innermost ``owned`` block of this thread is to delete.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """On leaving, deletes the tables that operators called inside left for their results (``Scratch.settle`` with ``keep``).

    Whoever calls operators and is done with their results once these are written calls them in such a block.
    """
    paths: list[str] = []
    before = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(before)
        for path in paths:
            delete(spark, path)


def left_behind(path: str) -> None:
    """Tells the ``owned`` block around the caller, if there is one, of a folder that a result is read from."""
    if (paths := _OWNED.get()) is not None:
        paths.append(path)


class Scratch:
    """Tables that an operator writes to the shared folder on its way.

    ``settle`` writes a table and reads it back, which cuts its lineage: a lost executor then costs a re-read, not a
    recomputation, and the files are whole or absent. ``drop`` deletes tables that nothing reads any more; leaving the
    ``with`` block deletes all but those settled with ``keep``, which the operator's result still reads and an ``owned``
    block around it deletes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.count = 0

    def __enter__(self) -> Scratch:
        self.before = small_batches(self.spark)
        return self

    def __exit__(self, *_) -> None:
        for key, value in self.before.items():
            self.spark.conf.set(key, value)
        for _, path in self.paths.values():
            delete(self.spark, path)
        self.paths.clear()

    def settle(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}-{name}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        if keep:
            left_behind(path)
        else:
            self.paths[id(back)] = back, path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if id(df) in self.paths:
                delete(self.spark, self.paths.pop(id(df))[1])


def hot_freq(total: int, bound: int = 20_000) -> int:
    """The frequency from which ``lookup_join`` takes a key out of the shuffle."""
    return max(2, -(-total // bound))


def lookup_join(rows: DataFrame, counted: DataFrame, key: str | list[str], total: int, bound: int = 20_000) -> DataFrame:
    """Inner join of ``rows`` with per-key facts that hold each key's frequency in ``freq``.

    The frequencies sum to ``total`` at most, so at most ``bound`` keys can have ``total / bound`` rows or
    more: that many are broadcast, and their rows are spread by a hash in the shuffle join that all other rows need.
    All other keys are too rare to fill a partition, if ``counted`` holds all keys from ``hot_freq`` on. ``rows`` is read once.
    """
    keys = [key] if isinstance(key, str) else key
    facts = [c for c in counted.columns if c not in keys]
    at, hot_facts, cold_facts, *theirs = own_names(3 + len(keys))
    limit = hot_freq(total, bound)
    hot = counted.filter(F.col("freq") >= limit).select(*keys, F.struct(*facts).alias(hot_facts))
    cold = counted.filter(F.col("freq") < limit).select(*(F.col(k).alias(t) for k, t in zip(keys, theirs, strict=True)), F.struct(*facts).alias(cold_facts))
    is_hot = F.col(hot_facts).isNotNull()
    marked = rows.join(F.broadcast(hot), keys, "left")
    marked = marked.withColumn(at, F.when(is_hot, F.xxhash64(*rows.columns).cast(rows.schema[keys[0]].dataType)).otherwise(F.col(keys[0])))
    on = (F.col(at) == F.col(theirs[0])) & ~is_hot
    for k, t in zip(keys[1:], theirs[1:], strict=True):
        on = on & (F.col(k) == F.col(t))
    both = marked.join(cold, on, "left").withColumn(at, F.coalesce(hot_facts, cold_facts)).filter(F.col(at).isNotNull())
    return both.select(*rows.columns, *(F.col(at)[c].alias(c) for c in facts))


def running(df: DataFrame, order: list[Column], scratch: Scratch, sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``order``) and ``<name>_before``, the sum of each of ``sums`` over the rows before.

    Rows are sorted by range over many partitions and written, so that their places are fixed; only the partitions' own
    counts and sums meet in one window, a row per partition.
    """
    at, part, first = own_names(3)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = scratch.settle(placed, "placed").withColumn(part, F.shiftrightunsigned(at, 33))  # the partition's number; the rest counts its rows
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    per = placed.groupBy(part).agg(F.count("*").alias(first), *(F.sum(c).alias(c) for c in sums))
    per = per.select(part, before(first, upto).alias(first), *(before(c, upto).alias(f"{first}{c}") for c in sums))
    inside = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.select("*", *(before(c, inside).alias(f"{at}{c}") for c in sums)).join(F.broadcast(per), part)
    rank = F.col(first) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return inner.select(*df.columns, rank.alias("rank"), *((F.col(f"{first}{c}") + F.col(f"{at}{c}")).alias(f"{c}_before") for c in sums))
