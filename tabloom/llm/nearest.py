"""Approximate nearest neighbours by multi-index hashing (Norouzi, Punjani and Fleet, 2012) of learned binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, partitions, tidied, written

#: Neighbours returned; bits of a code at least; bits of a substring; rows and rounds that the rotation is learned from.
K, BITS, PART, SAMPLE, ROUNDS = 20, 128, 16, 8192, 20
#: Queries whose true neighbours set the radius, and the share of these neighbours that it must cover.
PROBES, COVER = 128, 0.985
#: Bytes of the vectors of one piece of the index, about; queries that a piece answers at a time.
PIECE_BYTES, BLOCK = 64 << 20, 1 << 13
INDEX, QUERY = 0, 1  # kinds of rows


@dataclass
class Coder:
    """Codes: the signs of the centred vector under learned rotations, one after the other, cut into substrings."""

    mean: np.ndarray
    rotation: np.ndarray  # (dimension, bits)

    @staticmethod
    def learn(rows: np.ndarray, bits: int = BITS, seed: int = 5) -> Coder:
        """Rotations that bring the vectors close to the corners of a cube (iterative quantisation)."""
        dim = rows.shape[1]
        mean = rows.mean(axis=0)
        centred, out = rows - mean, []
        for i in range(-(-bits // dim)):
            turn = np.linalg.qr(np.random.default_rng(seed + i).normal(size=(dim, dim)))[0]
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.where(centred @ turn > 0, 1.0, -1.0).T @ centred)
                turn = (u @ v).T
            out.append(turn)
        return Coder(mean, np.concatenate(out, axis=1)[:, :bits])

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """(rows, substrings) of PART bits."""
        packed = np.packbits((rows - self.mean) @ self.rotation > 0, axis=1)
        return packed.view(np.uint16)


class Piece:
    """One piece of the index: for each substring a directory of its values and the rows of each value."""

    def __init__(self, coder: Coder, rows: np.ndarray):
        self.rows, self.codes = rows, coder.parts(rows)
        self.tables = []
        for column in self.codes.T:
            order = np.argsort(column, kind="stable").astype(np.int32)
            values, first = np.unique(column[order], return_index=True)
            self.tables.append((values, np.append(first, len(column)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from `code` in at most `radius` bits. Pigeonhole: such a row differs by
        radius // substrings or less in one of the first radius % substrings + 1, or by one less in one of the rest."""
        low, rest = divmod(radius, len(self.tables))
        hit = np.zeros(len(self.rows), bool)
        for j, (values, first, order) in enumerate(self.tables):
            most = low if j <= rest else low - 1
            if most < 0:
                continue
            if most >= PART:
                hit[:] = True
                break
            at = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= most)
            if len(at) == len(values):
                hit[:] = True
                break
            size = first[at + 1] - first[at]
            begun = np.repeat(first[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(at) else np.zeros(0, np.int64)
            hit[order[begun + np.arange(len(begun))]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1) <= radius]


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order."""
    return (rows * query).sum(axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(piece, kind, rows) of batches sorted by the two."""
    for batch in batches:
        piece, kind = (batch.column(c).to_numpy() for c in ("piece", "kind"))
        cuts = np.flatnonzero((np.diff(piece) != 0) | (np.diff(kind) != 0)) + 1
        for i, j in pairwise([0, *cuts.tolist(), len(piece)]):
            if j > i:
                yield int(piece[i]), int(kind[i]), batch.slice(i, j - i)


FOUND = "qid long, score double, differ int, vid long, ids array<long>"


def _search(index: DataFrame, pieces: int, coder: Broadcast, queries: DataFrame, radius: int | None, most: int) -> DataFrame:
    """The `most` nearest vectors that each query (qid, vector) finds in each piece of the index, with the bits in which
    their codes differ. radius None: all vectors are looked at.

    Each piece goes to the task of its number, and so does every query: a task builds its piece's tables once, then
    answers the queries as they stream past. Neither vectors nor queries go through the driver."""
    rows = index.select("piece", F.lit(INDEX).alias("kind"), F.col("vid").alias("num"), "vector", "ids")
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), F.lit(QUERY).alias("kind"), F.col("qid").alias("num"), "vector")
    both = rows.unionByName(asks.withColumn("ids", F.lit(None).cast("array<long>")))

    def answer(piece: Piece, vids: pa.Array, ids: pa.Array, block: pa.RecordBatch) -> pa.RecordBatch:
        vectors = _vectors(block.column("vector"))
        out: list[list] = [[], [], [], []]
        for qid, query, code in zip(block.column("num").to_pylist(), vectors, coder.value.parts(vectors), strict=True):
            at = np.arange(len(piece.rows)) if radius is None else piece.within(code, radius)
            score = products(piece.rows[at], query)
            if len(at) > most:
                best = np.partition(score, len(score) - most)[len(score) - most]
                at, score = at[score >= best], score[score >= best]
            out[0].append(np.full(len(at), qid))
            out[1].append(score)
            out[2].append(np.bitwise_count(piece.codes[at] ^ code).sum(axis=1).astype(np.int32))
            out[3].append(at)
        flat = [np.concatenate(x) for x in out]
        take = pa.array(flat[3])
        return pa.RecordBatch.from_arrays(
            [pa.array(flat[0], pa.int64()), pa.array(flat[1]), pa.array(flat[2], pa.int32()), vids.take(take), ids.take(take)],
            ["qid", "score", "differ", "vid", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        piece, number = None, -1
        for at, kind, part in _runs(batches):
            if kind == INDEX:
                if at != number:
                    held, piece, number = [], None, at
                held.append(part)
            elif at == number:
                if piece is None:
                    whole = pa.concat_batches(held)
                    piece, vids, ids, held = Piece(coder.value, _vectors(whole.column("vector"))), whole.column("num"), whole.column("ids"), []
                for i in range(0, part.num_rows, BLOCK):
                    yield answer(piece, vids, ids, part.slice(i, BLOCK))

    return both.repartitionById(pieces, F.col("piece")).sortWithinPartitions("piece", "kind").mapInArrow(tidied(run), FOUND)


def _nearest(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("ids")[0], "vid")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part, each pair once."""
    v = F.col(vector)
    fine = v.isNotNull() & F.col(vec_id).isNotNull() & F.exists(v, lambda x: x != 0)
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), v.alias("vector"))
    return rows.groupBy("id", "vector").agg(F.lit(1).alias("one")).drop("one")


def search(vectors: DataFrame, every: int, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows of the largest inner
    product that it finds, its own id left out; ties to the smaller id; all of them where there are fewer than k.

    1. Equal vectors become one, with its k + 1 smallest ids (no other can be among k nearest: they tie), so that a
       vector which a third of all rows hold is one entry of the index.
    2. Rotations are learned from SAMPLE vectors, and the radius is set so that it covers COVER of the true neighbours
       of PROBES queries, found by looking at all rows; both samples are the smallest hashes of the vectors.
    3. The index is cut into pieces by a hash of the vectors, one for each task and for each PIECE_BYTES at least, each
       with its own tables; it holds every row. Every piece answers every query.
    4. A query that finds fewer than k + 1 vectors within the radius looks at all rows.

    A null id, a vector that is null, zero, or holds a null or non-finite component, or that has not the commonest
    length, takes no part. Repeated rows count once; a query never finds its own id, even with another vector.
    Other columns are ignored; an empty table gives no row.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    rows = written(usable(vectors, vec_id, vector).withColumn("length", F.size("vector")), "vectors")
    lengths = rows.groupBy("length").count().orderBy(F.desc("count"), "length").first()
    out = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.col("length") == lengths["length"]).drop("length")
    smallest = Window.partitionBy("vector").orderBy("id")
    groups = rows.withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    size = rows.count() * max(1, lengths["length"]) * 8
    pieces = max(partitions(spark), -(-size // PIECE_BYTES))
    piece = F.pmod(F.xxhash64("vector"), F.lit(pieces)).cast("int")
    index = written(groups.select(F.monotonically_increasing_id().alias("vid"), piece.alias("piece"), "vector", "ids"), "index")
    asked = rows.where(F.col("id") % every == 0)
    queries = written(asked.groupBy("vector").agg(F.lit(1).alias("one")).select("vector", F.monotonically_increasing_id().alias("qid")), "asked")

    by_hash = lambda df, n: df.orderBy(F.xxhash64("vector")).limit(n)
    sample = np.array([r[0] for r in by_hash(index.select("vector"), SAMPLE).collect()], np.float64)
    coder = Coder.learn(sample, max(PART, BITS // PART * PART))
    shared = sc.broadcast(coder)
    probes = by_hash(queries, PROBES)
    true = _nearest(_search(index, pieces, shared, probes, None, k + 1), k + 1).where("at > 1").select("differ").collect()
    radius = int(np.quantile([r["differ"] for r in true], COVER, method="higher")) if true else BITS

    found = written(_nearest(_search(index, pieces, shared, queries, radius, k + 1), k + 1), "found")
    few = queries.join(found.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") > k), "qid", "left_anti")
    few = written(few, "few")
    if not few.isEmpty():
        whole = written(_nearest(_search(index, pieces, shared, few, None, k + 1), k + 1), "found")
        found = found.join(few.select("qid"), "qid", "left_anti").unionByName(whole)
    discard(spark, index)
    entry = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("down"), i.alias("vec_id"), F.col("score").alias("score")))
    lists = found.groupBy("qid").agg(F.array_sort(F.flatten(F.collect_list(entry))).alias("near"))  # at most (k + 1) squared
    named = asked.join(queries, "vector").select("qid", F.col("id").alias("query_id")).join(lists, "qid")
    near = F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(near).alias("at", "e")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score"
    )


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20)
