"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by its own permutation; shards take turns in claiming
the first slot of their order that is still free until the table is full. A key goes to the shard that owns
slot hash(key) mod size. All shards own almost equally many slots, and when a shard leaves, few keys of
the others move.

Defined results: a null key hashes as the empty text; repeated keys go to the same shard; an empty table
gives an empty result; shard names must be different, and there must be at least one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadencia.llm import common

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _numbers(name: str) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:16], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Number of the owning shard for each slot. Its size is a parameter and does not grow with data."""
    if not shards or len(set(shards)) != len(shards) or not _is_prime(size) or size < len(shards):
        raise ValueError("different shard names and a prime table size of at least their number are needed")
    offset = np.array([_numbers(s)[0] % size for s in shards])
    skip = np.array([_numbers(s)[1] % (size - 1) + 1 for s in shards])
    table, turn = np.full(size, -1, np.int32), np.zeros(len(shards), np.int64)
    left = size
    while True:
        for s in range(len(shards)):
            while table[at := (offset[s] + turn[s] * skip[s]) % size] >= 0:
                turn[s] += 1
            table[at] = s
            left -= 1
            if not left:
                return table


def assign_shards(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """df with slot (int) and shard (string); columns with these names are replaced.

    The broadcast side always has `size` rows.
    """
    spark = df.sparkSession
    table = fill_table(shards, size)
    lookup = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "slot int, shard string")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(size)).cast("int")
    return df.select(*kept, hashed.alias("slot")).join(F.broadcast(lookup), "slot").select(*kept, "slot", "shard")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(common.read_table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")
