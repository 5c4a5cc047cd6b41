"""Shard placement through a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, given by a start and a step
from its name. The shards take turns, each claiming the first slot of its permutation that is still
free, until the table is full; so all shards hold almost equally many slots, and when a shard comes
or goes few other slots change hands. The table is of a fixed size, so it travels with the plan, and
placing a row is a hash and one lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65537
MAX_SLOTS = 1 << 20


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The number, in ``shards``, of the shard that owns each slot.

    Names must differ, and there may be at most as many as slots; ``slots`` must be a prime, so that
    every step visits all of them.
    """
    if not 1 < slots <= MAX_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime up to {MAX_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("give different shard names, no more than slots")
    marks = [int(hashlib.md5(name.encode()).hexdigest(), 16) for name in shards]
    turn = [(m % slots, 1 + (m >> 64) % (slots - 1)) for m in marks]
    owner, left = np.full(slots, -1, np.int32), slots
    at = [start for start, _ in turn]
    while left:
        for shard, (_, step) in enumerate(turn):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + step) % slots
            owner[slot], at[shard] = shard, (slot + step) % slots
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, spread: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the number of slots. A null key has
    no place of its own and is spread by ``spread``, so that null keys do not meet in one shard."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.concat(F.lit("n"), F.coalesce(spread.cast("string"), F.lit(""))))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, shards: Sequence[str], key: str = "doc_id", spread: str = "text", slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row; columns of these names are replaced.

    Equal keys share a shard. Rows are neither moved nor changed, and an empty table stays empty.
    """
    spark = df.sparkSession
    table = _table(spark, shards, slots)
    slotted = df.withColumn("slot", slot_of(F.col(key), F.col(spread), slots))
    return slotted.withColumn("_owners", table.scalar()).withColumn("shard", F.get("_owners", F.col("slot"))).drop("_owners")


def _table(spark, shards: Sequence[str], slots: int) -> DataFrame:
    owners = [(i, shards[s]) for i, s in enumerate(fill_table(shards, slots).tolist())]
    rows = spark.createDataFrame(owners, "slot int, shard string")
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "shard"))), lambda r: r["shard"]).alias("t"))


def write_shards(df: DataFrame, path: str, files_per_shard: int = 8, key: str = "doc_id", spread: str = "text") -> None:
    """Write placed rows as Parquet, one folder for each shard, each from several tasks so that a heavy
    shard is not one task's work."""
    part = F.pmod(F.xxhash64(key, spread), F.lit(files_per_shard))
    df.repartition("shard", part).write.partitionBy("shard").parquet(path)
