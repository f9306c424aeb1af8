"""Sharding by a permutation-filled lookup table.

Every shard walks its own permutation of the slots of a prime-sized table; the shards take turns, each claiming
the next slot on its list that is still free. A key hashes to a slot and the slot names the shard, so placing a
row is one probe of a broadcast table whose size is a parameter and never depends on the data. Removing or adding
a shard re-fills the table and moves few keys beyond those of that shard.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, quoted

#: Production parameters of the registered query.
SHARDS = 64
SLOTS_PER_SHARD = 64
MAX_SLOTS = 1_000_000


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's walk over the slots; both from the md5 of its name."""
    digest = md5(shard.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def fill(shards: list[str], slots: int) -> list[int]:
    """slot -> index of the shard that claimed it. Needs as many slots as shards; ``slots`` must be prime."""
    if not shards or slots < len(shards) or slots > MAX_SLOTS or next_prime(slots) != slots:
        raise ValueError("the table needs at least one shard and a prime number of slots, as many as shards at least")
    walks = [preference(s, slots) for s in shards]
    at, owner, free = [0] * len(shards), [-1] * slots, slots
    while True:
        for i, (offset, skip) in enumerate(walks):
            while owner[slot := (offset + at[i] * skip) % slots] >= 0:
                at[i] += 1
            owner[slot] = i
            at[i] += 1
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: the first 60 bits of its md5, modulo the table's size. A null key counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """The filled table as rows (slot, shard)."""
    owners = "".join(f"{i:06x}" for i in fill(shards, slots))
    names = F.array(*[F.lit(s) for s in shards])
    index = F.conv(F.hex(F.expr(f"substring(X'{owners}', cast(slot * 3 + 1 as int), 3)")), 16, 10).cast("int")
    return spark.range(slots).select(F.col("id").alias("slot")).select("slot", F.element_at(names, index + 1).alias("shard"))


def place(df: DataFrame, key: str, shards: list[str] | None = None, slots: int | None = None) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard``; columns of these names, in any case, are replaced, after the key is read.

    Nulls: a null key is placed as the empty string. Repeated and tied keys go to the same shard. An empty table
    stays empty; other columns, whatever their names, pass through.
    """
    shards = shards or [f"shard-{i:03d}" for i in range(SHARDS)]
    slots = slots or next_prime(len(shards) * SLOTS_PER_SHARD)
    at, slot, shard = own_names(3)
    table = lookup_table(df.sparkSession, shards, slots).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    marked = df.withColumn(at, slot_of(F.col(quoted(key)), slots))
    placed = marked.join(F.broadcast(table), F.col(at) == F.col(slot))  # slots rows: a parameter, MAX_SLOTS at most
    return placed.select(*(quoted(c) for c in df.columns if c.lower() not in ("slot", "shard")), F.col(at).alias("slot"), F.col(shard).alias("shard"))


def write_sharded(df: DataFrame, key: str, path: str, parts_per_shard: int = 4, **table) -> None:
    """One folder ``shard=...`` per shard. A salt spreads each shard over several tasks and files.

    Rows as in ``place``; an empty table writes no shard.
    """
    placed = place(df, key, **table)
    salt = F.pmod(F.xxhash64(*(quoted(c) for c in placed.columns)), F.lit(parts_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
