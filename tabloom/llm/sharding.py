"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, partitions, written


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: no ring table, and a new last shard takes keys only into itself."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = keys.astype(np.int64).view(np.uint64).copy()
    bucket, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    while (open_ := ahead < shards).any():
        bucket[open_] = ahead[open_]
        key[open_] = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[open_] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[open_] = ((bucket[open_] + 1) * step).astype(np.int64)
    return bucket


def assign(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """df with the shard of each key, in one pass without a shuffle. Equal keys, nulls included, share a shard."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    return df.withColumn(out, of(F.xxhash64(F.col(key))))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot and grown_shard.

    Only the key and the shard count decide the shard. Slots number each shard's rows from 0 in order of key, without
    a gap and without bringing a shard into one task: rows are ranged over tasks by (shard, key), each task numbers its
    own, and the counts of the tasks before it, one row per task and shard, are added.
    A null text has size 1 and the CRC of no bytes; null keys count as one key, whose rows
    come first in slot order; very long texts count whole; repeated rows get slots of their own; other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    sized = assign(assign(sized, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "sharded")
    order = ["shard", "doc_id", "text_crc32", "row"]
    ranged = sized.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = written(
        ranged.withColumns({"task": F.shiftright(at, 33).cast("int"), "at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ranged"
    )
    discard(spark, sized)
    runs = ranged.groupBy("shard", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most one row per task and shard boundary: tasks + shards rows
    runs = runs.select("shard", "task", (before - F.col("first")).alias("shift"))
    return ranged.join(F.broadcast(runs), ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("at") + F.col("shift")).alias("slot"), "grown_shard",
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
