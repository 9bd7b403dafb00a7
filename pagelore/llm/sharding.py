"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table, a permutation from an offset and a step that its name
gives. Shards take turns to claim the next slot that they prefer and that is free, until none is. A row's key gives its slot, the
slot its shard: one broadcast join against a table of ``slots`` rows, whose size is a parameter and does not grow with the data. A
shard that leaves gives up its own slots and moves few others.

Defined cases: a null key is placed like an empty text; repeated keys share a shard; an empty table gives an empty result; a column of
the input named like an added one is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime over a hundred times the shards keeps shards within about one per cent of each other.
SLOTS, SHARDS = 2039, 16
MOST_SLOTS = 1_000_003


def names(count: int = SHARDS) -> list[str]:
    return [f"shard-{k:03d}" for k in range(count)]


def digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index for each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not len(shards) <= slots <= MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    offset = [digest(f"offset/{s}") % slots for s in shards]
    step = [digest(f"step/{s}") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner, at = [-1] * slots, list(offset)
    for turn in range(slots):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % slots
        owner[at[k]] = k
    return owner


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: one row for each slot."""
    owners, labels = (F.split(F.lit("\n".join(x)), "\n") for x in (map(str, fill(shards, slots)), shards))
    return spark.range(1).select(F.posexplode(owners).alias("slot", "k")).select("slot", labels[F.col("k").cast("int")].alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's digest, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def assign(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with columns slot and shard. No row is moved: the only exchange is the broadcast of the table."""
    found = lookup(df.sparkSession, shards or names(), slots)
    df = df.drop("slot", "shard")
    return df.withColumn("slot", slot_of(df[key], slots)).join(F.broadcast(found), "slot").select(*df.columns, "slot", "shard")


def write(df: DataFrame, path: str, **how) -> None:
    """A folder for each shard."""
    assign(df, **how).write.partitionBy("shard").parquet(path)
