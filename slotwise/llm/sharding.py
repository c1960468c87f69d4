"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the table's slots (an offset and a step; the table's size is prime, so each
step visits all slots). Shards take turns; at its turn a shard claims the first free slot of its permutation, until
the table is full, so shards differ by one slot at most (by weight, where weights are given). A row's key is hashed
to a slot and the slot names its shard: one array access, and few rows move when a shard joins or leaves.

The table has `size` entries whatever the number of rows, so it is broadcast. Rows of equal key go to the
same shard; placing by doc_id keeps a source or text that holds a third of all rows from filling one shard. A null
key has its own fixed hash. Empty tables give empty results; extra columns are kept unless they are named like the
new ones, which replace them.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], weights: Sequence[int] | None = None, size: int = SIZE) -> np.ndarray:
    """The index of the shard of each slot; a shard of weight w takes w turns for each of a shard of weight 1."""
    if not is_prime(size):
        raise ValueError("the table's size must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must have different names, one at least and no more than slots")
    weights = [1] * len(shards) if weights is None else list(weights)
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("weights must be whole numbers, one for each shard and not all zero")
    starts = [zlib.crc32(f"offset:{s}".encode()) % size for s in shards]
    steps = [zlib.crc32(f"skip:{s}".encode()) % (size - 1) + 1 for s in shards]
    table, tries, filled = np.full(size, -1, np.int64), [0] * len(shards), 0
    while filled < size:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                if filled == size:
                    break
                while table[slot := (starts[i] + tries[i] * steps[i]) % size] >= 0:
                    tries[i] += 1
                table[slot] = i
                tries[i] += 1
                filled += 1
    return table


def place(df: DataFrame, key: str, shards: Sequence[str], weights: Sequence[int] | None = None, size: int = SIZE) -> DataFrame:
    """df with `slot` (int) and `shard` (the shard's name)."""
    table = lookup_table(shards, weights, size)
    slot = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\x00null")).cast("binary")), 1, 12), 16, 10).cast("bigint"), F.lit(size)).cast("int")
    rows = pd.DataFrame({"slot": np.arange(size, dtype=np.int32), "shard": np.array(shards, object)[table]})
    slots = df.sparkSession.createDataFrame(rows, "slot int, shard string")
    return df.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(slots), "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """The placed rows as Parquet, a folder for each shard."""
    df.write.partitionBy("shard").parquet(path)
