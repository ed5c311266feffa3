"""N-gram Jaccard self-join by chosen paths (Christiani, Pagh and Sivertsen, 2018)."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import U64, boxed, counted, discard, mix, partitions, release, small_batches, tidied, written
from .shingles import shingle_sets

log = logging.getLogger(__name__)
WIDTH, SIMILARITY = 5, 0.8
#: Coordinates of a sketch, levels of splitting below the first, and the bucket size that isn't split.
TOKENS, LEVELS, SMALL = 128, 3, 512
#: Runs before recall is measured, runs that are added until it reaches TARGET, and the most runs.
RUNS, MORE, MOST, TARGET = 16, 4, 40, 0.999
#: Distinct texts whose links to all documents are found exactly, to measure recall by, and their characters in all.
PROBES, PROBE_CHARS = 256, 8 << 20
#: Shingles that one part of a bucket holds, about.
PART_SHINGLES = 1 << 21
#: The share of its members from which a child shows that a bucket consists of near copies, which no split parts.
WHOLE = 0.3
#: The least number of equal bits of two sketches that are compared further: over five deviations below that of the threshold.
LEAST_BITS = 96
RNG = np.random.default_rng(20180611)
FACTOR = RNG.integers(1, 1 << 63, TOKENS, np.uint64) * U64(2) + U64(1)
OFFSET = RNG.integers(0, 1 << 63, TOKENS, np.uint64)
ROOTS = mix(np.arange(1, MOST + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
BLOCK_CHARS = 1 << 20


def sketch(found: np.ndarray) -> np.ndarray:
    """Minhash values: sets agree in a coordinate with a probability of their Jaccard similarity."""
    with np.errstate(over="ignore"):
        low = np.full(TOKENS, np.iinfo(U64).max, U64)
        for i in range(0, len(found), 1024):
            low = np.minimum(low, (found[i : i + 1024, None] * FACTOR + OFFSET).min(axis=0))
    return (low >> U64(32)).astype(np.uint32)


def bits(sketches: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, packed: TOKENS / 64 words per row."""
    one = (mix(sketches.astype(U64)) & U64(1)).astype(np.uint8)
    return np.packbits(one, axis=1).view(U64)


def chosen(nodes: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for every token that row's node samples: one in `SIMILARITY * TOKENS` tokens, the same ones for all
    sets in the node, so that a set has 1 / SIMILARITY children on average."""
    with np.errstate(over="ignore"):
        token = mix(sketches.astype(U64) + (np.arange(TOKENS).astype(U64) << U64(32)) + U64(1))
        draw = mix(token ^ nodes[:, None])
        row, at = np.nonzero(draw < U64(int(2**64 / (SIMILARITY * TOKENS))))
        return row, mix(draw[row, at] + nodes[row])


def _identity(found: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        a = mix(found).sum(dtype=U64) + U64(len(found))
        b = mix(found ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    return a.tobytes() + b.tobytes()


def _blocks(column: pa.Array) -> Iterator[tuple[int, list]]:
    block, held, begun = [], 0, 0
    for i, cell in enumerate(column):
        block.append(content := cell.as_py())
        held += len(content or "")
        if held >= BLOCK_CHARS or i + 1 == len(column):
            yield begun, block
            block, held, begun = [], 0, i + 1


@dataclass
class Probes:
    """Shingle sets of some texts, by shingle: shingle u is in the sets owners[first[u]:first[u + 1]]."""

    names: list[bytes]
    sizes: np.ndarray
    shingles: np.ndarray
    owners: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Probes:
        sets = {_identity(s): s for s in shingle_sets(texts, WIDTH) if len(s)}
        flat = np.concatenate([np.zeros(0, U64), *sets.values()])
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets.values()])
        order = np.argsort(flat, kind="stable")
        shingles, first = np.unique(flat[order], return_index=True)
        return Probes(list(sets), np.array([len(x) for x in sets.values()], np.int64), shingles, owner[order], np.append(first, len(flat)))

    def linked(self, found: np.ndarray) -> list[bytes]:
        """The sets whose similarity to `found` is SIMILARITY or more, without `found` itself."""
        if not len(self.shingles) or not len(found):
            return []
        at = np.minimum(np.searchsorted(self.shingles, found), len(self.shingles) - 1)
        at = at[self.shingles[at] == found]
        if not len(at):
            return []
        n = self.first[at + 1] - self.first[at]
        owners = self.owners[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        common = np.bincount(owners, minlength=len(self.sizes))
        near = np.flatnonzero(common * (1 + SIMILARITY) >= SIMILARITY * (self.sizes + len(found)) - 1e-9)
        own = _identity(found) if len(near) else b""
        return [self.names[i] for i in near.tolist() if self.names[i] != own]


def _probes(docs: DataFrame) -> Probes:
    """PROBES distinct texts of the rows with the smallest hashes, as far as PROBE_CHARS goes."""
    key = F.xxhash64("text")
    rows = docs.select("doc_id", key.alias("key"), F.coalesce(F.length("text"), F.lit(0)).alias("size")).where("size > 0")
    seen: dict[int, int] = {}
    held = 0
    for r in rows.orderBy(F.xxhash64("key", "doc_id"), "key").limit(8 * PROBES).collect():
        if r["key"] not in seen and len(seen) < PROBES and held + r["size"] <= PROBE_CHARS:
            seen[r["key"]] = r["size"]
            held += r["size"]
    if not seen:
        return Probes.of([])
    texts = docs.where(key.isin(list(seen))).select(key.alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    return Probes.of([r["text"] for r in texts.collect()])


def _sign(docs: DataFrame) -> DataFrame:
    """(doc_id, key, class, size, sketch) of each document, size 0 without words; and the classes of probes it is linked to."""
    kept = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(_probes(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = shared.value
        for batch in batches:
            names, sizes, sketches, near = [], [], [], []
            for _, block in _blocks(batch.column("text")):
                for found in shingle_sets(block, WIDTH):
                    names.append(_identity(found))
                    sizes.append(len(found))
                    sketches.append(sketch(found).tobytes())
                    near.append(probes.linked(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(near, pa.list_(pa.binary()))],
                ["doc_id", "key", "class", "size", "sketch", "near"],
            )

    schema = T.StructType([*kept.schema.fields[:2], *T._parse_datatype_string("class binary, size int, sketch binary, near array<binary>")])
    return kept.mapInArrow(tidied(run), schema)


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _split(members: DataFrame, roots: np.ndarray | None) -> DataFrame:
    """(node, class, size, parent) of the children of each member's node; of the given roots at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, size, sketches = batch.column("class"), batch.column("size"), _matrix(batch.column("sketch"), np.uint32, TOKENS)
            if not len(names):
                continue
            for start in [None] if roots is None else roots:
                own = batch.column("node").to_numpy(zero_copy_only=False).view(U64) if start is None else np.full(len(names), start)
                row, child = chosen(own, sketches)
                pairs = np.unique(np.stack([row.astype(U64), child], 1), axis=0)
                at = pairs[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 1].view(np.int64)), names.take(pa.array(at)), size.take(pa.array(at)), pa.array(own.view(np.int64)[at])], ["node", "class", "size", "parent"]
                )

    columns = ["class", "size", "sketch"] if roots is not None else ["node", "class", "size", "sketch"]
    return members.select(*columns).mapInArrow(tidied(run), "node long, class binary, size int, parent long")


def _leaves(classes: DataFrame, roots: np.ndarray) -> DataFrame:
    """(node, class, n, weight) of the runs from the given roots: the buckets of two sets or more, after splitting the
    large ones level by level; weight is the number of shingles in all sets of a bucket.

    A bucket stays whole where it is small, on the last level, or where a child of it keeps WHOLE of its members."""
    spark = classes.sparkSession
    done, now, tables = [], _split(classes, roots), []
    for level in range(LEVELS + 1):
        now = written(now, "paths") if not level else now
        tables.append(now)
        sizes = now.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.first("parent").alias("parent")).where("n > 1")
        if level:
            sizes = sizes.join(whole, sizes["parent"] == whole["whole"], "left_anti")  # noqa: F821
        sizes = sizes.drop("parent")
        if level == LEVELS:
            done.append(now.drop("parent", "size").join(sizes, "node"))
            break
        small, large = sizes.where(F.col("n") <= SMALL), written(sizes.where(F.col("n") > SMALL), "large")
        tables.append(large)
        done.append(now.drop("parent", "size").join(small, "node"))
        if large.isEmpty():
            break
        parents = now.drop("parent").join(large, "node")
        children = written(_split(parents.join(classes.select("class", "sketch"), "class"), None), "children")
        heavy = children.groupBy("parent", "node").agg(F.count("*").alias("m")).groupBy("parent").agg(F.max("m").alias("m"))
        whole = written(heavy.join(large.withColumnRenamed("node", "parent"), "parent").where(F.col("m") >= WHOLE * F.col("n")).select(F.col("parent").alias("whole")), "whole")
        tables.append(whole)
        done.append(parents.join(whole, parents["node"] == whole["whole"], "left_semi").drop("size"))
        now = children
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    leaves = written(out, "leaves")
    discard(spark, *tables)
    return leaves


def _spread(leaves: DataFrame) -> DataFrame:
    """The leaves with a part and a pair of parts: members of a leaf of more than SMALL sets, or of more than PART_SHINGLES
    shingles, are dealt into parts, and each pair of parts is a task's work of its own, so that none holds more than two
    parts."""
    parts = F.least("n", F.ceil(F.greatest(F.col("n") / F.lit(SMALL), F.col("weight") / F.lit(PART_SHINGLES)))).cast("int")
    part = F.pmod(F.xxhash64("class"), parts).cast("int")
    each = leaves.withColumn("parts", parts).withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return each.withColumn("other", other).select(
        "node", "class", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), *[c for c in leaves.columns if c not in ("node", "class", "n", "weight")]
    )


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by key."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows == 0:
            continue
        cells = [rest.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cells], axis=0)) + 1
        if not len(change):
            continue
        begun = 0
        for stop in change.tolist():
            yield rest.slice(begun, stop - begun)
            begun = stop
        rest = rest.slice(begun).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _pairs(table: pa.Table, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that this task compares: their sketches agree well enough, and this leaf is the first of all
    that both sets are in."""
    part, low, high = (table.column(c).to_numpy() for c in ("part", "low", "high"))
    node = table.column("node")[0].as_py()
    lists = [np.array(x, np.int64) for x in table.column("nodes").to_pylist()]
    a, b = np.flatnonzero(part == low[0]), np.flatnonzero(part == high[0])
    left, right = [], []
    for i in a.tolist():
        j = b[b > i] if low[0] == high[0] else b
        if not len(j):
            continue
        differ = np.bitwise_count(packed[i] ^ packed[j]).sum(axis=1)
        j = j[differ <= TOKENS - LEAST_BITS]
        left.append(np.full(len(j), i))
        right.append(j)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    if len(i):
        # earlier leaves that several members share, as bits
        before = [x[x < node] for x in lists]
        shared, count = np.unique(np.concatenate(before), return_counts=True) if before else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        shared = shared[count > 1]
        if len(shared):
            mask = np.zeros((len(lists), (len(shared) + 63) // 64), U64)
            for r, x in enumerate(before):
                at = np.searchsorted(shared, x)
                at = at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == x)]
                np.bitwise_or.at(mask, (r, at >> 6), U64(1) << (at & 63).astype(U64))
            met = np.zeros(len(i), bool)
            for word in range(mask.shape[1]):
                met |= (mask[i, word] & mask[j, word]) != 0
            i, j = i[~met], j[~met]
    return i, j


def _linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs have a Jaccard similarity of SIMILARITY or more, exactly."""
    size = np.array([len(s) for s in sets], np.int64)
    common = np.zeros(len(i), np.int64)
    if len(i) < 4 * len(sets):
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            if min(size[a], size[b]) >= SIMILARITY * max(size[a], size[b]):
                common[k] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:  # many pairs of few sets: a product of 0-1 matrices, some shingles at a time
        values, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        keep = count[which] > 1
        dense = np.cumsum(count > 1) - 1
        row, column = row[keep], dense[which[keep]]
        total = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            x, y = np.searchsorted(column, [start, start + 4096])
            cells = np.zeros((len(sets), 4096), np.float32)
            cells[row[x:y], column[x:y] - start] = 1
            total += cells @ cells.T
        common = total[i, j].astype(np.int64)
    return common * (1 + SIMILARITY) >= SIMILARITY * (size[i] + size[j]) - 1e-9


def _needed(spread: DataFrame) -> DataFrame:
    """The rows of the spread leaves that have a pair to compare there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["node", "low", "high"]):
            i, j = _pairs(table, _matrix(table.column("bits"), U64, TOKENS // 64))
            rows = np.unique(np.concatenate([i, j]))
            if len(rows):
                yield from table.take(pa.array(rows)).combine_chunks().to_batches()

    return _gathered(spread).mapInArrow(tidied(run), spread.schema)


def _gathered(spread: DataFrame) -> DataFrame:
    return spread.repartition(partitions(spread.sparkSession), "node", "low", "high").sortWithinPartitions("node", "low", "high", "class")


def _with_sets(needed: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The needed rows with the whole shingle set of their class, from the text of its first document."""
    at = needed.groupBy("class").agg(F.collect_list(F.struct("node", "part", "low", "high", "bits", "nodes")).alias("at"))
    at = at.join(classes.select("class", "first", "first_key", "copies"), "class")
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    met = texts.join(at, texts["doc_id"].eqNullSafe(at["first"]) & (texts["key"] == at["first_key"])).select("class", "copies", "at", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, block in _blocks(batch.column("text")):
                part = batch.slice(begun, len(block))
                sets = pa.array([s.tobytes() for s in shingle_sets(block, WIDTH)], pa.binary())
                lists = part.column("at")
                row = pa.array(np.repeat(np.arange(len(block)), lists.value_lengths().to_numpy()))
                fields = lists.flatten()
                yield pa.RecordBatch.from_arrays(
                    [*(fields.field(c) for c in ("node", "part", "low", "high", "bits", "nodes")), part.column("class").take(row), part.column("copies").take(row), sets.take(row)],
                    ["node", "part", "low", "high", "bits", "nodes", "class", "copies", "set"],
                )

    return met.mapInArrow(tidied(run), "node long, part int, low int, high int, bits binary, nodes array<long>, class binary, copies long, set binary")


LINKS = "class binary, other binary, links long, documents long"


def _links(members: DataFrame) -> DataFrame:
    """Per class and task its number of linked classes and of their documents, and edges that hold each task's linked
    classes together: one less than there are, not all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["node", "low", "high"]):
            table = table.take(pa.array(np.unique(np.array(table.column("class").to_pylist(), object), return_index=True)[1]))
            i, j = _pairs(table, _matrix(table.column("bits"), U64, TOKENS // 64))
            sets = [np.frombuffer(s, U64) for s in table.column("set").to_pylist()]
            keep = _linked(sets, i, j)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            n, copies, names = len(sets), table.column("copies").to_numpy(), table.column("class").to_pylist()
            links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            documents = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
            root = np.arange(n)
            while True:  # the smallest label on either side of a pair, until none changes
                low = np.minimum(root[i], root[j])
                new = root.copy()
                np.minimum.at(new, i, low)
                np.minimum.at(new, j, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            rows = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[r] for r in rows], pa.binary()), pa.array([names[root[r]] for r in rows], pa.binary()), pa.array(links[rows], pa.int64()), pa.array(documents[rows].astype(np.int64))],
                ["class", "other", "links", "documents"],
            )

    return _gathered(members).mapInArrow(tidied(run), LINKS)


def _sign_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their class, and classes (equal shingle sets) with their first document, copies and sketch."""
    signed = written(_sign(docs), "signed")
    worded = signed.where("size > 0")
    far = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")
    classes = worded.groupBy("class").agg(F.min(far).alias("f"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    return signed, written(classes.select("class", F.col("f.doc_id").alias("first"), F.col("f.key").alias("first_key"), "copies", "size", "sketch"), "classes")


@F.pandas_udf(T.BinaryType())
def _packed(sketches: pd.Series) -> pd.Series:
    if not len(sketches):
        return pd.Series([], dtype=object)
    return pd.Series([row.tobytes() for row in bits(np.frombuffer(b"".join(sketches), np.uint32).reshape(len(sketches), TOKENS))])


@F.pandas_udf(T.IntegerType())
def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """The number of equal bits of two packed sketches."""
    return pd.Series([TOKENS - int(np.bitwise_count(np.frombuffer(x, U64) ^ np.frombuffer(y, U64)).sum()) for x, y in zip(a, b, strict=True)], dtype="int32")


def _with_bits(leaves: DataFrame, classes: DataFrame) -> DataFrame:
    """Leaves with the packed bits and the sorted list of all leaves of each class."""
    lists = leaves.groupBy("class").agg(F.array_sort(F.collect_set("node")).alias("nodes"))  # some 1.25 a run and level
    lists = lists.join(classes.select("class", "sketch"), "class").select("class", "nodes", _packed("sketch").alias("bits"))
    return leaves.join(lists, "class")


def _recall(leaves: DataFrame, classes: DataFrame, pairs: DataFrame) -> float:
    """The share of the pairs of linked classes that meet in a leaf and pass the comparison of bits; 1 without pairs."""
    asked = pairs.select("class").unionByName(pairs.select(F.col("probe").alias("class"))).distinct()
    asked = counted(written(asked, "asked"))
    lists = leaves.join(asked, "class", "left_semi").groupBy("class").agg(F.collect_set("node").alias("nodes"))
    lists = classes.join(asked, "class", "left_semi").join(lists, "class", "left")
    lists = written(lists.select("class", F.coalesce("nodes", F.array().cast("array<long>")).alias("nodes"), _packed("sketch").alias("bits")), "lists")
    other = lists.select(F.col("class").alias("probe"), F.col("nodes").alias("others"), F.col("bits").alias("other_bits"))
    met = F.arrays_overlap("nodes", "others") & (_agreeing("bits", "other_bits") >= LEAST_BITS)
    share = pairs.join(lists, "class").join(other, "probe").agg(F.avg(met.cast("double"))).first()[0]
    discard(leaves.sparkSession, asked, lists)
    return 1.0 if share is None else share


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed documents, classes, links) of the self-join of docs by word shingles.

    1. Documents of equal shingle sets are one class, kept by its first document. On the way, the exact links of PROBES
       texts to all documents are found by an inverted index of the probes' shingles.
    2. In each run every class goes to the buckets of the tokens that it shares with others by a common sample; buckets
       of more than SMALL sets are split again by samples of their own. Two sets of similarity SIMILARITY meet in a run
       with a probability of 0.63 on the first level, 0.47 after one split, 0.31 after three. Runs are repeated until
       the share of the probes' links that meet somewhere is TARGET; if MOST runs don't reach it, that is logged.
    3. In each bucket sketches of TOKENS bits rule out pairs; a pair counts in the first bucket only that both are in.
    4. The shingle sets of those that remain, of whole texts, are brought to their buckets and compared exactly.
    """
    spark = small_batches(docs.sparkSession)
    signed, classes = _sign_classes(docs)
    pairs = signed.where("size > 0").select("class", F.explode("near").alias("probe")).distinct()
    pairs = written(pairs, "pairs")
    parts, runs, recall = [], 0, 0.0
    while recall < TARGET and runs < MOST:
        step = MORE if runs else RUNS
        parts.append(_leaves(classes, ROOTS[runs : runs + step]))
        runs += step
        leaves = parts[0]
        for other in parts[1:]:
            leaves = leaves.unionByName(other)
        recall = _recall(leaves, classes, pairs)
    log.log(logging.INFO if recall >= TARGET else logging.WARNING, "%d runs, recall of the probes' links %.4f", runs, recall)
    release(spark)
    needed = written(_needed(_spread(_with_bits(leaves, classes))), "needed")
    discard(spark, *parts, pairs)
    release(spark)
    links = written(_links(_with_sets(needed, classes, docs)), "links")
    discard(spark, needed)
    return signed.drop("near"), classes.drop("sketch", "size"), links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, copy_of, n_copies, n_links, and key (xxhash64 of the text).

    class_id is the smallest doc_id of all documents that links join, directly or in a chain; copy_of that of the
    documents with an equal shingle set, n_copies their number; n_links is the number of other documents with a
    similarity of SIMILARITY or more, copies included. A text without words (null too) has no shingle, no link and a
    class of its own; so has a null doc_id among them. Repeated rows are copies of each other. Other columns are
    ignored; an empty table gives no row.
    """
    return _near(docs)[0]


def _near(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """near_duplicates, and the written tables that it reads."""
    signed, classes, links = join(docs)
    tables = [signed, classes, links]
    totals = links.groupBy("class").agg(F.sum("documents").alias("documents"))
    roots = components(links.select(F.hex("class").alias("a"), F.hex("other").alias("b")))
    named = classes.join(totals, "class", "left").withColumn("name", F.hex("class"))
    named = named.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    lowest = named.groupBy("root").agg(F.min("first").alias("class_id"))
    named = named.join(lowest, "root").select(
        "class", "class_id", F.col("first").alias("copy_of"), F.col("copies").alias("n_copies"),
        (F.col("copies") - 1 + F.coalesce("documents", F.lit(0))).cast("long").alias("n_links"),
    )
    met = signed.where("size > 0").drop("sketch").join(named, "class")
    alone = signed.where("size = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), "key"
    )
    return met.select(*alone.columns).unionByName(alone), tables


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, whole and with all its columns: that of the smallest doc_id, of these the smallest
    hash of the text. Documents without words all stay."""
    near, tables = _near(docs)
    found = written(near.where("n_links > 0"), "near")
    discard(docs.sparkSession, *tables)
    release(docs.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")
    first = found.groupBy("class_id").agg(F.min(order).alias("f")).select("class_id", F.col("f.doc_id").alias("first"), F.col("f.key").alias("first_key"))
    met = found.join(first, found["class_id"].eqNullSafe(first["class_id"]))
    is_first = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("key") == F.col("first_key"))
    gone = met.where(~is_first).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_gone")).distinct()
    gone = counted(written(gone, "gone"))
    twice = met.where(is_first).groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_gone")).count().where("count > 1").drop("count")
    box = boxed(docs, doc=F.col("doc_id"), key=F.xxhash64("text"))
    same = lambda other: box["doc"].eqNullSafe(other["_doc"]) & (box["key"] == other["_gone"])
    kept = box.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return kept.select("row.*")
    twice = written(twice, "twice")  # rows that repeat, with the same id and text: of these one
    one = box.join(twice, same(twice), "left_semi").dropDuplicates(["doc", "key"])
    return kept.join(twice, same(twice), "left_anti").select("row.*").unionByName(one.select("row.*"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")
