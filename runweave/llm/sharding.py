"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own. Shards take turns claiming their
next free slot until none is free, so they own nearly equal numbers of slots, and a shard that joins or
leaves moves few of the others'. The table (its size is a parameter) is broadcast; a row's place is the slot
that its key's hash falls on: constant time, no shuffle. The hash is that of the key as text.

Null keys go where the empty text goes. Repeated rows get equal places; hot keys stay on one shard by design.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A prime over 100 slots for each of the shards, so that shares differ by under a hundredth.
SLOTS, SHARDS = 65_537, 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot. slots: a prime, at least the number of shards."""
    if not shards or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime and at least the number of shards, of which one is needed")
    # shards take turns in the order of their names, so that the list's order doesn't matter
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = [_number("offset:" + s) % slots for s in shards]
    skip = [_number("skip:" + s) % max(1, slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in turns:
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def place(df: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with `slot` and `shard`, which replace columns of these names, in capitals or not."""
    own, of_table, owner = (common.free_name(df, c) for c in ("key_slot", "table_slot", "table_shard"))
    table = df.sparkSession.createDataFrame([(k, shards[i]) for k, i in enumerate(lookup_table(shards, slots))], f"{of_table} long, {owner} string")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.withColumn(own, slot).join(F.broadcast(table), F.col(own) == F.col(of_table), "left")
    return placed.select(*kept, F.col(own).alias("slot"), F.col(owner).alias("shard"))


def op3_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars")
    return place(docs, "doc_id", [f"shard-{i:03d}" for i in range(SHARDS)])
