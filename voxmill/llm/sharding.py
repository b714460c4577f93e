"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table, given by an
offset and a skip. Shards take turns; in its turn a shard claims the first slot of its
permutation that is still free. Shares differ by one slot at most, and a change of the
shard list moves few slots. The table has a size fixed by parameters, whatever the
input, so it is filled once and broadcast; a key's shard is one hash lookup.

Only DataFrame functions touch the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.common import fresh

#: Largest table: bounds what is broadcast to about 16 MB.
MOST_SLOTS = 1 << 20
SLOTS_PER_SHARD = 100


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def digest(text: str) -> int:
    """First 60 bits of the MD5, as the key hash of documents has them."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup(shards: Sequence[str], slots: int) -> list[int]:
    """Shard number of each slot. ``slots`` must be prime, so every skip visits all slots."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if slots > MOST_SLOTS or slots < len(shards) or next_prime(slots) != slots:
        raise ValueError(f"slots must be a prime from {len(shards)} to {MOST_SLOTS}")
    at = [digest(f"offset:{s}") % slots for s in shards]
    skip = [digest(f"skip:{s}") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def assign(docs: DataFrame, shards: Sequence[str], slots: int | None = None, key: Column | None = None, shard_column: str = "shard", slot_column: str = "slot") -> DataFrame:
    """``docs`` with slot and shard number of each row.

    The key is the doc_id as text; a row without one goes by its text, and a row without
    either by the empty text, so a group of null ids spreads. Equal keys share a shard.
    Columns of ``docs`` with the names of the new ones are replaced.
    """
    spark: SparkSession = docs.sparkSession
    size = slots or next_prime(SLOTS_PER_SHARD * len(shards))
    table = spark.createDataFrame(list(enumerate(lookup(shards, size))), "_slot int, _shard int")
    by = key if key is not None else F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit(""))
    slot = fresh(docs, "_slot_of")
    placed = docs.withColumn(slot, slot_of(by, size))
    kept = [c for c in docs.columns if c.lower() not in (shard_column.lower(), slot_column.lower())]
    joined = placed.join(F.broadcast(table), placed[slot] == table["_slot"])
    return joined.select(*[placed[c] for c in kept], table["_slot"].alias(slot_column), table["_shard"].alias(shard_column))


def write(docs: DataFrame, path: str, shards: Sequence[str], slots: int | None = None, files_per_shard: int = 8) -> None:
    """Write one folder per shard, each by several tasks so that no shard waits for one."""
    placed = assign(docs, shards, slots)
    spread = F.pmod(F.xxhash64(*[c for c in ("doc_id", "text") if c in placed.columns]), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", spread).write.partitionBy("shard").parquet(path)
