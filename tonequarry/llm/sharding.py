"""Sharding by jump consistent hashing.

A stable 64-bit key of each row walks through jumps to its shard: no ring table, and one more shard
takes rows only into itself. Rows with a null id share one fixed key. Repeated ids go to one shard
together, repeated rows too, each with a slot of its own. Ties in the order of slots go by the text's crc32, then its
size; rows equal in all three are alike in the result. Null texts have size 1; texts of any length are only measured
and hashed. An empty table gives no rows; extra columns, whatever their names, are ignored by ``shard_plan`` and kept
by ``write_shards``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.llm.common import n_parts, table, written

SHARDS = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys: all keys walk at once, each until its next jump leaves the shards."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    landing = np.zeros(len(state), np.int64)
    walking = np.arange(len(state))
    step = np.uint64(2862933555777941757)
    while walking.size:
        shard[walking] = landing[walking]
        with np.errstate(over="ignore"):
            state[walking] = state[walking] * step + np.uint64(1)
        draw = ((state[walking] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        landing[walking] = ((shard[walking] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        walking = walking[landing[walking] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column: its XXH64 walks by ``jump_hash``."""

    @F.pandas_udf("int")
    def jumped(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(h.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jumped(F.xxhash64(key))


def shard_plan(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of each row; slots run gapless from 0 within a shard, by key.

    Only numbers are shuffled. Slots are counted within ranges of the key, then raised by what earlier ranges hold:
    no shard is gathered in one task.
    """
    n = n_parts(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plan = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    plan = plan.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
    plan = plan.repartitionByRange(n, "doc_id", "text_crc32").withColumn("range", F.spark_partition_id())
    # the range is the partition: a window over it and the shard needs no row from elsewhere, but Spark can't know
    plan = written(plan, "sharded")
    local = written(plan.withColumn("local", F.row_number().over(Window.partitionBy("range", "shard").orderBy("doc_id", "text_crc32", "size")) - 1), "slots")
    counts = local.groupBy("range", "shard").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = local.join(before.select("range", "shard", "before"), ["range", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("local") + F.col("before")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", files: int = 8) -> None:
    """Write all columns of ``docs`` under ``path``, a folder per shard and about ``files`` files in each, dealt by a salt of the key."""
    salt = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(files))
    docs.withColumn("shard", shard_of(F.col(key).cast("long"), shards)).repartition("shard", salt).write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_plan(table(spark, sf_dir, "documents"))
