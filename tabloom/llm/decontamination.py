"""Benchmark decontamination with a positional inverted index of the training documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import U64, boxed, counted, discard, small_batches, tidied, written
from .shingles import word_hashes

#: Words of a window; words of one segment of the index; characters of benchmark text that one broadcast holds.
WINDOW, SEGMENT_WORDS, BLOCK_CHARS = 10, 1 << 16, 8 << 20
#: Words from a window's rarest term within which a proximity match has all others; postings that one step follows.
SLOP, STEP = 20, 1 << 20
#: Characters of the texts that are hashed at a time.
TEXT_CHARS = 1 << 20
CELLS = ("bounds", "terms", "counts", "places")


#: A term is the 64-bit hash of a word; this one is no term.
NO_TERM = U64(0)


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of texts, one after the other, and the number of each."""
    terms, counts = word_hashes(texts)
    return np.where(terms == NO_TERM, U64(1), terms), counts


@dataclass
class Phrases:
    """Distinct windows over numbered terms: `terms` has a row per window, filled up with -1, `sizes` its length; window w
    belongs to the items owners[first[w]:first[w + 1]]."""

    vocabulary: np.ndarray
    terms: np.ndarray
    sizes: np.ndarray
    owners: np.ndarray
    first: np.ndarray
    items: list[str]

    def named(self, windows: np.ndarray) -> list[str]:
        """The items of the windows."""
        owners = {int(o) for w in np.unique(windows) for o in self.owners[self.first[w] : self.first[w + 1]]}
        return sorted(self.items[o] for o in owners)


def phrases(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    rows, owner = [np.zeros((0, window), U64)], [np.zeros(0, np.int64)]
    for name, text in items:
        terms, _ = hashed([text])
        if len(terms):
            filled = np.append(terms, np.full(max(0, window - len(terms)), NO_TERM))
            rows.append(np.lib.stride_tricks.sliding_window_view(filled, window))
            owner.append(np.full(len(rows[-1]), number[name]))
    terms, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner)], 1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    vocabulary, number_of = np.unique(terms, return_inverse=True)  # NO_TERM is the smallest
    numbered = number_of.reshape(terms.shape).astype(np.int32)
    if len(vocabulary) and vocabulary[0] == NO_TERM:
        vocabulary, numbered = vocabulary[1:], numbered - 1
    return Phrases(vocabulary, numbered, (numbered >= 0).sum(1), pairs[:, 1].astype(np.int32), first, names)


def blocks_of(benchmark: DataFrame, item: str, text: str, most: int, window: int = WINDOW) -> Iterator[Phrases]:
    """The benchmark in blocks of at most `most` characters (or one item) each, so that no broadcast grows with it."""
    items, held = [], 0
    for name, content in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text)).toLocalIterator():
        if items and held + len(content or "") > most:
            yield phrases(items, window)
            items, held = [], 0
        items.append((name, content))
        held += len(content or "")
    yield phrases(items, window)


def index(docs: DataFrame, keep: list[str], text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The positional index, partitioned by documents: a row is a segment of documents with, for each term that it holds,
    the ascending places of the term. Places run on over the segment; documents lie a word apart. It holds all terms, so
    that any test text can be looked up in it. No shuffle."""
    kept = docs.select(*keep, F.col(text).alias("_text"))
    fields = T.StructType(kept.schema.fields[:-1])
    key = pa.struct(to_arrow_schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, keys = [], [], []

        def close() -> pa.RecordBatch:
            flat, words_of = np.concatenate(ids), np.concatenate(sizes)
            place = np.arange(len(flat), dtype=np.int32) + np.repeat(np.arange(len(words_of), dtype=np.int32), words_of)
            order = np.argsort(flat, kind="stable")
            terms, counts = np.unique(flat, return_counts=True)
            cells = [np.cumsum(words_of + 1).astype(np.int32), terms, counts.astype(np.int32), place[order]]
            rows = pa.concat_arrays(keys)
            listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([listed, *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["keys", *CELLS])

        held = 0
        for batch in batches:
            rows = pa.StructArray.from_arrays([batch.column(i).cast(f.type) for i, f in enumerate(key)], fields=list(key))
            begun, block, chars = 0, [], 0
            for i, content in enumerate(batch.column("_text")):
                block.append(content.as_py())
                chars += len(block[-1] or "")
                if chars >= TEXT_CHARS or i + 1 == batch.num_rows:
                    terms, counts = hashed(block)
                    ids.append(terms)
                    sizes.append(counts)
                    keys.append(rows.slice(begun, i + 1 - begun))
                    held += len(terms)
                    begun, block, chars = i + 1, [], 0
                    if held >= segment_words:
                        yield close()
                        ids, sizes, keys, held = [], [], [], 0
        if keys:
            yield close()

    schema = T.StructType([T.StructField("keys", T.ArrayType(fields))] + [T.StructField(c, T.BinaryType()) for c in CELLS])
    return kept.mapInArrow(tidied(run), schema)


class Segment:
    """One segment of the index, opened: the posting lists of its terms, one after the other."""

    def __init__(self, row: dict):
        self.ends = np.frombuffer(row["bounds"], np.int32)
        self.terms, counts = np.frombuffer(row["terms"], U64), np.frombuffer(row["counts"], np.int32)
        self.places = np.frombuffer(row["places"], np.int32)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.span = int(self.ends[-1]) + 1
        # the lists as one ascending list: a place in any of them is found by halving
        self.keys = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * self.span + self.places

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term's list, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, term: int) -> np.ndarray:
        slot = int(self.slots(np.array([term], U64))[0])
        return self.places[:0] if slot < 0 else self.places[self.first[slot] : self.first[slot + 1]]

    def between(self, slots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each list has a place from low to high."""
        low, high = np.clip(low, 0, self.span), np.minimum(high, self.span - 1)
        at = np.searchsorted(self.keys, slots * self.span + low)
        return (low <= high) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= slots * self.span + high)

    def rarest(self, found: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, place, lists, offsets): places of the rarest term of each window whose terms are all there, some windows
        at a time, and the lists of the window's terms and their offsets, rarest first; -1 is no list."""
        slots = np.append(self.slots(found.vocabulary), -1)
        size = np.append(np.where(slots[:-1] < 0, 0, np.diff(self.first, append=0)[slots[:-1]]), np.iinfo(np.int64).max)
        of = size[found.terms]  # of -1 the last
        window = np.flatnonzero(of.min(axis=1) > 0) if len(of) else np.zeros(0, np.int64)
        order = np.argsort(of[window], axis=1, kind="stable")
        lists = np.take_along_axis(slots[found.terms[window]], order, 1)
        rare = lists[:, 0] if len(window) else np.zeros(0, np.int64)
        n = self.first[rare + 1] - self.first[rare]
        step = (np.cumsum(n) - n) // STEP
        for i, j in pairwise([*np.flatnonzero(np.diff(step, prepend=-1)).tolist(), len(window)]):
            row = np.repeat(np.arange(i, j), n[i:j])
            begun = np.repeat(self.first[rare[i:j]] - (np.cumsum(n[i:j]) - n[i:j]), n[i:j])
            yield window[row], self.places[begun + np.arange(len(begun))].astype(np.int64), lists[row], order[row]

    def exact(self, found: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of each occurrence. A window's candidates are the list of its rarest term, moved back by the
        term's offset; it is intersected with the moved lists of the other terms, rarest first."""
        windows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for window, place, lists, offsets in self.rarest(found):
            start = place - offsets[:, 0]
            for k in range(1, found.terms.shape[1]):
                at = start + offsets[:, k]
                fits = (lists[:, k] < 0) | self.between(lists[:, k], at, at)
                window, start, lists, offsets = window[fits], start[fits], lists[fits], offsets[fits]
            windows.append(window)
            starts.append(start)
        return np.concatenate(windows), np.concatenate(starts)

    def near(self, found: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its rarest term) where every other term of the window is at most `slop` words away, in the
        same document and any order."""
        windows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for window, place, lists, _ in self.rarest(found):
            doc = np.searchsorted(self.ends, place, side="right")
            low = np.maximum(place - slop, np.where(doc > 0, self.ends[doc - 1], 0))
            high = np.minimum(place + slop, self.ends[doc] - 2)
            for k in range(1, found.terms.shape[1]):
                fits = (lists[:, k] < 0) | self.between(lists[:, k], low, high)
                window, place, lists, low, high = window[fits], place[fits], lists[fits], low[fits], high[fits]
            windows.append(window)
            places.append(place)
        return np.concatenate(windows), np.concatenate(places)


SPANS = "array<struct<start:int,stop:int>>"


def search(postings: DataFrame, found: Broadcast, slop: int = SLOP) -> DataFrame:
    """Per document of the index its kept columns, n_words, the merged spans of hit words, the items that occur, and
    those that have a proximity match."""
    fields = postings.schema["keys"].dataType.elementType
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrase = found.value
        for batch in batches:
            for r in range(batch.num_rows):
                segment = Segment({c: batch.column(c)[r].as_py() for c in CELLS})
                keys = batch.column("keys")[r].values
                window, start = segment.exact(phrase)
                doc = np.searchsorted(segment.ends, start, side="right")
                order = np.lexsort((start, doc))
                window, start, doc = window[order], start[order], doc[order]
                stop = start + phrase.sizes[window]
                begin = np.concatenate([[0], segment.ends[:-1]])
                all_spans: list[list] = [[] for _ in range(len(keys))]
                all_items: list[list] = [[] for _ in range(len(keys))]
                edges = np.flatnonzero(np.diff(doc, prepend=-1))
                for i, j in pairwise([*edges.tolist(), len(doc)]):
                    d = int(doc[i])
                    spans, last = all_spans[d], -1
                    for a, b in zip((start[i:j] - begin[d]).tolist(), (stop[i:j] - begin[d]).tolist(), strict=True):
                        if a <= last:
                            spans[-1]["stop"] = last = max(last, b)
                        else:
                            last = b
                            spans.append({"start": a, "stop": b})
                    all_items[d] = phrase.named(window[i:j])
                near_window, place = segment.near(phrase, slop)
                doc = np.searchsorted(segment.ends, place, side="right")
                order = np.argsort(doc, kind="stable")
                near_window, doc = near_window[order], doc[order]
                all_near: list[list] = [[] for _ in range(len(keys))]
                for i, j in pairwise([*np.flatnonzero(np.diff(doc, prepend=-1)).tolist(), len(doc)]):
                    all_near[int(doc[i])] = phrase.named(near_window[i:j])
                done = [summed(s, i) for s, i in zip(all_spans, all_items, strict=True)]
                cells = [pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
                arrays = [*keys.flatten(), pa.array(segment.ends - begin - 1, pa.int64()), *cells, pa.array(all_spans, spans_type), *(pa.array(x, pa.list_(pa.string())) for x in (all_items, all_near))]
                yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in fields), *extra.names])

    extra = T._parse_datatype_string(f"n_words long, n_hit long, n_items long, items_sha256 string, spans {SPANS}, items array<string>, near array<string>")
    return postings.mapInArrow(tidied(run), T.StructType([*fields, *extra]))


def summed(spans: list, items: list) -> tuple[int, int, str]:
    """Hit words of the union of the spans, and count and digest of the items."""
    hit, last = 0, 0
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        hit += max(0, stop - max(start, last))
        last = max(last, stop)
    names = sorted(set(items))
    return hit, len(names), hashlib.sha256(",".join(names).encode("utf-8", "surrogatepass")).hexdigest()


def _summed(spans: pd.Series, items: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([summed(s, i) for s, i in zip(spans, items, strict=True)], columns=["n_hit", "n_items", "items_sha256"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS, slop: int = SLOP,
) -> DataFrame:
    """One row per document: the columns `keep`, n_words, n_hit, n_items, items_sha256, contaminated, spans (of hit words,
    by number in the document), items, n_near and near: the items with a window whose words all stand, in any order, at
    most `slop` words from the rarest of them. An exact match is a near one too if slop >= window - 1.

    A first pass stores the index of all words as a table in the shared folder; a second reads it and searches each
    segment for all windows of the benchmark, a block of bounded size after the other. Neither shuffles texts or
    postings, and no term or document gathers in one task. Words are told apart by hashes of 64 bits. Null or empty texts have no words and no hit; items without words have no window;
    a null item id is the empty string; repeated items count once, repeated rows each; an empty benchmark hits nothing;
    other columns are ignored.
    """
    return _decontaminate(docs, benchmark, keep, text, item, item_text, window, block_chars, slop)[0]


def _decontaminate(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS, slop: int = SLOP,
) -> tuple[DataFrame, list[DataFrame]]:
    """decontaminate, and the written tables that it reads."""
    spark = small_batches(docs.sparkSession)
    postings = written(index(docs.withColumn("_row", F.monotonically_increasing_id()), [*keep, "_row"], text), "postings")
    blocks, hits, tables = blocks_of(benchmark, item, item_text, block_chars, window), [], [postings]
    block, more = next(blocks), True
    while more:
        found = search(postings, spark.sparkContext.broadcast(block), slop)
        more = (block := next(blocks, None)) is not None
        if more or hits:
            found = written(found, "hits")
            tables.append(found)
        hits.append(found)
    found = hits[0]
    if len(hits) > 1:
        for other in hits[1:]:
            found = found.unionByName(other)
        found = found.groupBy("_row").agg(
            *(F.first(c).alias(c) for c in [*keep, "n_words"]), *(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near"))
        )
        found = found.withColumn("_done", F.pandas_udf("n_hit long, n_items long, items_sha256 string")(_summed)("spans", "items")).select("*", "_done.*")
    out = found.select(
        *keep, "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans", "items",
        F.size(F.array_distinct("near")).cast("long").alias("n_near"), F.array_sort(F.array_distinct("near")).alias("near"),
    )
    return out, tables


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, whole and with all their columns."""
    box = boxed(docs, doc=F.col("doc_id"), key=F.xxhash64("text"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    judged, tables = _decontaminate(keyed, benchmark, ["doc_id", "key"])
    hit = written(judged.where("contaminated").select(F.col("doc_id").alias("hit_doc"), F.col("key").alias("hit_key")).distinct(), "contaminated")
    hit = counted(hit)
    discard(docs.sparkSession, *tables)
    return box.join(hit, box["doc"].eqNullSafe(hit["hit_doc"]) & (box["key"] == hit["hit_key"]), "left_anti").select("row.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, benchmark, ["doc_id"]).drop("spans", "items", "near")
