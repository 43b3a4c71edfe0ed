"""Sharding by jump consistent hashing.

The shard of a key follows from the key and the number of shards alone, without
a table of ranges; with one shard more, only keys that move into it move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablequill.session import settle

SHARDS = 24


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards 0..shards-1 of 64-bit keys: each key jumps ahead until it leaves the range."""
    state = keys.astype(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        at[moving] = ahead[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        scale = (1 << 31) / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1)
        ahead[moving] = np.minimum((at[moving] + 1) * scale, shards).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a stable key of any type; it goes by its text, NULL by the empty text."""

    def jumped(hashes: pa.Array) -> pa.Array:
        return pa.array(jump(hashes.to_numpy().view(np.uint64), shards), pa.int32())

    return F.arrow_udf(jumped, "int")(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))))


def deal(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes (none for NULL) plus 8, ``text_crc32`` of
    a NULL text that of the empty one, ``grown_shard`` the shard with one shard
    more. Slots of a shard are numbered from 0: rows are counted per shard and
    task of the first pass, so no shard is sorted in one place and a key that
    repeats (a NULL id too) does no harm.
    """
    rows = settle(docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).alias("text_crc32"),
        shard_of(F.col(id_col), shards).alias("shard"),
        shard_of(F.col(id_col), shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    ), "dealt")
    # a task's row numbers share their upper bits
    part = F.shiftright("row", 33)
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return (
        rows.withColumn("inside", inside).join(before, ["shard", "part"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("before") + F.col("inside")).alias("slot"), "grown_shard")
    )


def op7_rows(docs: DataFrame) -> DataFrame:
    return deal(docs)
