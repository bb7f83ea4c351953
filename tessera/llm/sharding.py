"""Sharding by jump consistent hashing.

A key and the number of shards decide the shard; there is no ring table, and
when one shard is appended only the fraction 1/(n+1) of the rows moves, all of
it into the new shard (Lamping and Veach, 2014).

Slots number the rows of each shard without gaps. A shard is dealt over many
lanes, so that no task numbers a whole shard: counts by (shard, lane) give
each lane its first slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

LAW = "key"
MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shards 0 to ``n_shards - 1`` of 64-bit integer keys."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    state = np.ascontiguousarray(keys, dtype=np.int64).view(np.uint64).copy()
    shard = np.full(len(state), -1, dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    todo = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(todo):
            shard[todo] = ahead[todo]
            state[todo] = state[todo] * MULTIPLIER + np.uint64(1)
            draw = ((state[todo] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            ahead[todo] = ((shard[todo] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            todo = todo[ahead[todo] < n_shards]
    return shard


def shard_rows(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", lanes: int = 256) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1 (null text: 1, and a crc of 0 as for
    the empty text). A null key is placed as key 0. Repeated rows keep one
    output row each, in the same shard at different slots. ``lanes`` bounds
    nothing but the size of a task: a shard's rows are numbered in so many
    independent groups.
    """
    small = df.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )

    def place(batches):
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(jump_hash(keys, n_shards).astype(np.int32)), pa.array(jump_hash(keys, n_shards + 1).astype(np.int32))],
                names=["doc_id", "size", "text_crc32", "shard", "grown_shard"],
            )

    placed = small.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    placed = cut(placed.withColumn("row__", F.monotonically_increasing_id()))
    placed = placed.withColumn("lane__", F.pmod(F.xxhash64("row__"), F.lit(lanes)).cast("int"))
    before = Window.partitionBy("shard").orderBy("lane__").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        placed.groupBy("shard", "lane__")
        .agg(F.count("*").alias("n__"))
        .select("shard", "lane__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("first__"))
    )  # at most n_shards * lanes rows
    rank = F.row_number().over(Window.partitionBy("shard", "lane__").orderBy("row__")) - 1
    return (
        placed.withColumn("rank__", rank)
        .join(F.broadcast(firsts), ["shard", "lane__"])
        .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("first__") + F.col("rank__")).cast("long").alias("slot"), "grown_shard")
    )
