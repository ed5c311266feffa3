"""What the operators for training data share: the scratch folder, written cuts of the lineage, words and digests."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import ROW_GROUP_BYTES, discard, qualified, release, scratch, written  # noqa: F401

#: Letters A-Z become lower case, digits, a-z and every byte of a non-ASCII character stay, all else separates words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
U64 = np.uint64


#: Counted rows and array entries up to which a written table of ids is broadcast; some 100 bytes each.
BROADCAST_ROWS = 200_000


def counted(table: DataFrame, entries: Column | None = None) -> DataFrame:
    """A written table, to be broadcast if its counted rows, and entries in them, are few; otherwise it is joined by
    shuffling."""
    size = table.agg(F.count("*") + (F.coalesce(F.sum(entries), F.lit(0)) if entries is not None else F.lit(0))).first()[0]
    return F.broadcast(table) if size <= BROADCAST_ROWS else table


#: Bytes of one Arrow batch between the JVM and Python.
BATCH_BYTES = 2 << 20
#: Rows of one batch of the Parquet reader: it holds all texts of a batch.
READ_ROWS = 1024


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds what a Python worker is handed and what a scan holds at once, where the session allows more: rows may be
    long texts. Both settings stay with the session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if now == "-1" or int(now.rstrip("bB") if now.rstrip("bB").lstrip("-").isdigit() else 1 << 62) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > READ_ROWS:
        spark.conf.set(name, str(READ_ROWS))
    return spark


def give_back() -> None:
    """Hands freed memory back to the system: a Python worker outlives its task, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """What mapInArrow calls: `run`, and once its task ends, the worker keeps none of the task's memory."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles while millions of plain strings come and go that are in none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs as one struct column `row` beside the given ones, so that no name of theirs can clash; unboxed by row.*"""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    """Words of a whole text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the constants are those of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x
