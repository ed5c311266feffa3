"""Removal of repeated byte strings: distributed suffix sorting by difference covers over the texts that may repeat.

Sorting all suffixes of a corpus would shuffle many times its size. A string can only repeat where its anchor does: the
32 bytes of lowest hash among all that lie in it, which equal strings share at the same place. So

1. each text's anchors are found, with a hash of the whole surroundings (all strings that hold the anchor);
2. anchors are dealt by hash, those of equal surroundings pre-aggregated in each task. Surroundings that were there
   before are repeated whole, the first of their kind remain, and an anchor of one kind only is dropped;
3. the texts around the remaining anchors are dealt by anchor, and each group's suffixes are sorted by the difference
   cover: triples at two thirds of all places, recursion on their names, merge of the rest, comparison of neighbours;
4. the repeated places of each document are brought to its text, and the bytes that they cover are left out.

Anchors choose where to look; whether a string repeats is told by the sorted suffixes and, for whole surroundings, by
128 bits of two hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import U64, mix, partitions, release, small_batches, tidied, written
from .suffixes import window_classes

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # bytes before an anchor that a string with it may begin
#: Bytes of texts that one step looks at, and of one slice of a very long text; characters that are sorted together.
BLOCK, SLICE, SORTED = 2 << 20, 4 << 20, 1 << 20
#: Kinds of surroundings of one anchor from which its strings are dealt to the sort one by one, by their own hash.
MANY = 5000
NULL = np.iinfo(np.int64).max
TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
BASE, SECOND = U64(0xD1342543DE82EF95), U64(0x9E3779B97F4A7C15)
#: Columns of packed rows. An occurrence: hashes of the anchor and of its surroundings, document, place, first and last
#: start of the strings that it is the anchor of, and how far its surroundings go to either side.
SEEN = [("anchor", "u8"), ("around", "u8"), ("check", "u8"), ("doc", "i8"), ("text", "i8"), ("at", "i4"), ("low", "u1"), ("high", "u1"), ("left", "u1"), ("right", "u1")]
AROUND = [("anchor", "u8"), ("doc", "i8"), ("text", "i8"), ("start", "i4"), ("size", "i4")]
RANGE = [("doc", "i8"), ("text", "i8"), ("start", "i4"), ("stop", "i4")]
REST = [("anchor", "u8"), ("doc", "i8"), ("text", "i8"), ("at", "i4"), ("low", "u1"), ("high", "u1"), ("many", "u1")]
ROW = "bucket int, kind int, n int, data binary"
FIRST, AGAIN = 0, 1  # kinds of packed rows


def pack(columns: dict, fields: list) -> bytes:
    return b"".join(np.ascontiguousarray(columns[name], dtype).tobytes() for name, dtype in fields)


def unpack(rows: list[tuple[int, bytes]], fields: list) -> dict:
    """The columns of several packed rows, one after the other."""
    out: dict = {name: [] for name, _ in fields}
    for n, data in rows:
        at = 0
        for name, dtype in fields:
            size = n * np.dtype(dtype).itemsize
            out[name].append(np.frombuffer(data[at : at + size], dtype))
            at += size
    return {name: np.concatenate(out[name]) if out[name] else np.zeros(0, dtype) for name, dtype in fields}


def take(columns: dict, at: np.ndarray) -> dict:
    return {name: c[at] for name, c in columns.items()}


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on: a polynomial of random byte values, mixed."""
    with np.errstate(over="ignore"):
        out, width, factor = TABLE[data], 1, BASE
        while width < GRAM:
            longer = out[:-width] * factor
            longer += out[width:]
            out, width, factor = longer, width * 2, factor * factor
        return mix(out)


def _slices(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes, int, int]]]:
    """Blocks of (document, offset, bytes, first start, end of starts): whole texts, or slices of a very long one with
    the bytes around that strings and surroundings of its starts may touch."""
    block, held = [], 0
    for d, text in enumerate(texts):
        starts = len(text) - LENGTH + 1
        for begun in range(0, max(starts, 0), SLICE):
            end = min(starts, begun + SLICE)
            low, high = (0, len(text)) if starts <= SLICE else (max(0, begun - 2 * LENGTH), min(len(text), end + 3 * LENGTH))
            block.append((d, low, text[low:high], begun - low, end - low))
            held += high - low
            if held >= BLOCK:
                yield block
                block, held = [], 0
    if block:
        yield block


def occurrences(texts: list[bytes], docs: np.ndarray, keys: np.ndarray) -> dict:
    """The anchors of all strings of LENGTH bytes in the texts."""
    parts = []
    for block in _slices(texts):
        data = np.frombuffer(b"".join(b[2] for b in block), np.uint8)
        sizes = np.array([len(b[2]) for b in block], np.int64)
        end = np.cumsum(sizes)
        begin = end - sizes
        hashes = grams(data)
        bits = U64(int(len(hashes)).bit_length())
        low = hashes & ~((U64(1) << bits) - U64(1))
        low |= np.arange(len(hashes), dtype=U64)  # lowest hash, then leftmost
        width = 1
        while width * 2 <= REACH + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (REACH + 1 - width)], low[REACH + 1 - width :])
        low &= (U64(1) << bits) - U64(1)
        # the starts of one anchor are neighbours; only the starts of this block's slices count
        valid = np.zeros(len(low), bool)
        for b, s in zip(begin.tolist(), block, strict=True):
            valid[b + s[3] : b + s[4]] = True
        change = valid.copy()
        change[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        first = np.flatnonzero(change)
        ends = valid.copy()
        ends[:-1] &= change[1:] | ~valid[1:]
        last = np.flatnonzero(ends)
        at = low[first].astype(np.int64)
        row = np.searchsorted(end, at, side="right")
        offset = np.array([b[1] for b in block], np.int64)[row]
        size = np.array([len(texts[b[0]]) for b in block], np.int64)[row]
        left = np.minimum(at - begin[row] + offset, REACH)
        right = np.minimum(size - (at - begin[row] + offset), LENGTH)
        # the surroundings are GRAM bytes after GRAM bytes, up to their end
        around = [left.astype(U64) * U64(257) + right.astype(U64), right.astype(U64) * U64(263) + left.astype(U64)]
        with np.errstate(over="ignore"):
            for reach in (*range(-REACH, LENGTH - GRAM, GRAM), LENGTH - GRAM):
                piece = hashes[np.minimum(np.maximum(at + reach, at - left), at + right - GRAM)]
                around = [mix(around[0] * BASE + piece), mix(around[1] * SECOND ^ piece)]
        d = np.array([b[0] for b in block], np.int64)[row]
        parts.append({
            "anchor": hashes[at], "around": around[0], "check": around[1], "doc": docs[d], "text": keys[d], "at": at - begin[row] + offset,
            "low": at - first, "high": at - last, "left": left, "right": right,
        })
    return {name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, dtype) for name, dtype in SEEN}


def firsts(seen: dict) -> tuple[dict, np.ndarray]:
    """The occurrences, those of shared anchors sorted by anchor, surroundings and order of documents before all others,
    and which of them come first: they have the smallest doc, and in a document of it (told apart by its text) the
    smallest place."""
    order = np.argsort(seen["anchor"], kind="stable")
    anchor = seen["anchor"][order]
    equal = np.concatenate([anchor[1:] == anchor[:-1], [False]]) if len(order) else np.zeros(0, bool)
    equal[1:] |= equal[:-1].copy()
    alone, order = order[~equal], order[equal]
    order = order[np.lexsort(tuple(seen[c][order] for c in ("at", "text", "doc", "check", "around", "anchor")))]
    many = take(seen, order)
    alone = take(seen, alone)
    if not len(order):
        return alone, np.ones(len(alone["at"]), bool)
    step = lambda *names: np.concatenate([[True], np.any([many[c][1:] != many[c][:-1] for c in names], axis=0)])
    kind = step("anchor", "around", "check")
    lowest = many["doc"][kind][np.cumsum(kind) - 1]
    first = (kind | step("doc", "text")) & (many["doc"] == lowest)
    keep = kind | step("doc", "text", "at")  # a row that is there twice is one; rows of two slices have its starts between them
    begun = np.flatnonzero(keep)
    merged = take(many, begun) | {"low": np.maximum.reduceat(many["low"], begun), "high": np.minimum.reduceat(many["high"], begun)}
    together = {name: np.concatenate([merged[name], alone[name]]) for name in many}
    return together, np.concatenate([first[keep], np.ones(len(alone["at"]), bool)])


def _again(seen: dict) -> dict:
    return {"doc": seen["doc"], "text": seen["text"], "start": seen["at"] - seen["left"], "stop": seen["at"].astype(np.int64) + seen["right"]}


def _deal(columns: dict, fields: list, by: np.ndarray, buckets: int, kind: int) -> Iterator[tuple]:
    bucket = (mix(by.view(U64)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = take(columns, order[cuts[b] : cuts[b + 1]])
        yield b, kind, int(cuts[b + 1] - cuts[b]), pack(part, fields)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cells = list(zip(*rows, strict=True)) or [()] * 4
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], ["bucket", "kind", "n", "data"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Groups of texts of a BLOCK or so, with document and text key."""
    for batch in batches:
        docs, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
        begun, held = 0, 0
        block: list[bytes] = []
        for i, cell in enumerate(batch.column("text")):
            block.append((cell.as_py() or "").encode("utf-8", "surrogatepass"))
            held += len(block[-1])
            if held >= BLOCK or i + 1 == batch.num_rows:
                yield block, docs[begun : i + 1], keys[begun : i + 1]
                begun, held, block = i + 1, 0, []


def _rows(batches: Iterator[pa.RecordBatch], kind: int) -> list[tuple[int, bytes]]:
    return [(n, data) for k, n, data in batches if k == kind]


def _packed(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, int, bytes]]:
    out = []
    for batch in batches:
        out += zip(*(batch.column(c).to_pylist() for c in ("kind", "n", "data")), strict=True)
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "bucket")


def _anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed occurrences by anchor; those that a task knows to be repeated already come as ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, keys in _texts(batches):
            seen, first = firsts(occurrences(block, ids, keys))
            rows = list(_deal(take(seen, first), SEEN, seen["anchor"][first], buckets, FIRST))
            again = _again(take(seen, ~first))
            rows += _deal(again, RANGE, again["doc"], buckets, AGAIN)
            yield _batch(rows)

    return docs.mapInArrow(tidied(run), ROW)


def _kinds(anchors: DataFrame, buckets: int) -> DataFrame:
    """Per document bucket: ranges of repeated surroundings, and the anchors that have surroundings of several kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _packed(batches)
        seen = unpack(_rows(packed, FIRST), SEEN)
        order = np.argsort(seen["anchor"])
        anchor = seen["anchor"][order]
        alone = np.ones(len(anchor), bool)
        if len(anchor) > 1:
            equal = anchor[1:] == anchor[:-1]
            alone[1:] &= ~equal
            alone[:-1] &= ~equal
        seen, first = firsts(take(seen, order[~alone]))
        again = _again(take(seen, ~first))
        known = unpack(_rows(packed, AGAIN), RANGE)
        again = {name: np.concatenate([again[name], known[name]]) for name, _ in RANGE}
        rows = list(_deal(again, RANGE, again["doc"], buckets, AGAIN))
        kinds = np.ones(len(seen["anchor"]), bool)
        kinds[1:] = (seen["anchor"][1:] != seen["anchor"][:-1]) | (seen["around"][1:] != seen["around"][:-1]) | (seen["check"][1:] != seen["check"][:-1])
        _, group = np.unique(seen["anchor"], return_inverse=True)
        many = np.bincount(group, kinds)[group] if len(group) else np.zeros(0)
        rest = take(seen, first & (many > 1))
        rest["many"] = many[first & (many > 1)] > MANY
        rows += _deal(rest, REST, rest["doc"], buckets, FIRST)
        yield _batch(rows)

    return _dealt(anchors).mapInArrow(tidied(run), ROW)


def _beside(docs: DataFrame, rows: DataFrame, kinds: list[int], buckets: int) -> DataFrame:
    """The texts and the packed rows of each document bucket, in one task. Null texts are left out."""
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)

    @F.pandas_udf("int")
    def bucket(doc: pd.Series) -> pd.Series:
        return pd.Series((mix(doc.to_numpy().astype(np.int64).view(U64)) % U64(buckets)).astype(np.int32))

    texts = docs.withColumn("bucket", bucket("doc"))
    texts = texts.select("bucket", null("kind", "int"), null("n", "int"), null("data", "binary"), "doc", "key", "text")
    packed = rows.where(F.col("kind").isin(kinds)).select("bucket", "kind", "n", "data", null("doc", "long"), null("key", "long"), null("text", "string"))
    return _dealt(texts.unionByName(packed))


def _apart(batches: Iterator[pa.RecordBatch]) -> tuple[list, list[pa.RecordBatch]]:
    """Packed rows, and the batches with the texts."""
    packed, texts = [], []
    for batch in batches:
        is_text = batch.column("kind").is_null()
        rows = batch.filter(pc.invert(is_text))
        packed += zip(*(rows.column(c).to_pylist() for c in ("kind", "n", "data")), strict=True)
        texts.append(batch.filter(is_text))
    return packed, texts


class _ByText:
    """Rows of columns by (doc, text)."""

    def __init__(self, columns: dict):
        order = np.lexsort((columns["text"], columns["doc"]))
        self.columns = take(columns, order)
        self.doc, self.text = self.columns["doc"], self.columns["text"]

    def of(self, doc: int, text: int) -> slice:
        a, b = np.searchsorted(self.doc, doc, "left"), np.searchsorted(self.doc, doc, "right")
        return slice(a + np.searchsorted(self.text[a:b], text, "left"), a + np.searchsorted(self.text[a:b], text, "right"))


def _surroundings(beside: DataFrame, buckets: int) -> DataFrame:
    """Packed rows with the strings of each remaining anchor: neighbouring starts in one piece of text, by anchor. The
    strings of an anchor of very many kinds, which no task could hold, are pieces of their own, by a hash of the string;
    equal ones in a block go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, texts = _apart(batches)
        rest = _ByText(unpack(_rows(packed, FIRST), REST))
        del packed
        for block, ids, keys in _texts(iter(texts)):
            rows, pieces = {name: [] for name, _ in AROUND}, []
            lone, code = {name: [] for name, _ in SEEN}, {}
            done = set()
            for text, doc, key in zip(block, ids.tolist(), keys.tolist(), strict=True):
                if (doc, key) in done:
                    continue
                done.add((doc, key))
                own = take(rest.columns, rest.of(doc, key))
                first, last = own["at"] - own["low"], own["at"] - own["high"].astype(np.int32) + LENGTH
                for anchor, a, b, many in zip(own["anchor"].tolist(), first.tolist(), last.tolist(), own["many"].tolist(), strict=True):
                    if many:
                        for s in range(a, b - LENGTH + 1):
                            string = text[s : s + LENGTH]
                            if string not in code:
                                code[string] = (len(code), int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little"))
                            for name, value in zip(lone, (code[string][1], code[string][0], 0, doc, key, s, 0, 0, 0, LENGTH), strict=True):
                                lone[name].append(value)
                    else:
                        pieces.append(text[a:b])
                        for name, value in zip(rows, (anchor, doc, key, a, b - a), strict=True):
                            rows[name].append(value)
            out = []
            if code:
                strings = list(code)
                seen, first = firsts({name: np.array(lone[name], dtype) for name, dtype in SEEN})
                again = _again(take(seen, ~first))
                out += _deal(again, RANGE, again["doc"], buckets, AGAIN)
                kept = take(seen, first)
                for anchor, which, doc, key, s in zip(*(kept[c].tolist() for c in ("anchor", "around", "doc", "text", "at")), strict=True):
                    pieces.append(strings[which])
                    for name, value in zip(rows, (anchor, doc, key, s, LENGTH), strict=True):
                        rows[name].append(value)
            columns = {name: np.array(rows[name], dtype) for name, dtype in AROUND}
            bucket = (mix(columns["anchor"]) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[b] : cuts[b + 1]]
                out.append((b, FIRST, len(at), pack(take(columns, at), AROUND) + b"".join([pieces[i] for i in at.tolist()])))
            yield _batch(out)

    return beside.mapInArrow(tidied(run), ROW)


def _merged(found: dict) -> dict:
    """The ranges with those of a document that overlap or touch made one."""
    order = np.lexsort((found["start"], found["text"], found["doc"]))
    found = take(found, order)
    if not len(order):
        return found
    new = np.concatenate([[True], (found["doc"][1:] != found["doc"][:-1]) | (found["text"][1:] != found["text"][:-1])])
    group = np.cumsum(new) - 1
    shift = group * (int(found["stop"].max()) + 2)
    reach = np.maximum.accumulate(found["stop"] + shift)
    head = new | np.concatenate([[True], found["start"][1:] + shift[1:] > reach[:-1]])
    first = np.flatnonzero(head)
    stop = (reach - shift)[np.append(first[1:], len(head)) - 1]
    return take(found, first) | {"stop": stop}


def _sorted_groups(rows: dict, pieces: np.ndarray) -> Iterator[dict]:
    """Ranges of the repeated strings, from groups of anchors whose texts are sorted together."""
    order = np.argsort(rows["anchor"], kind="stable")
    begin = np.cumsum(rows["size"]) - rows["size"]
    rows, begin = take(rows, order), begin[order]
    anchor = np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]]) if len(order) else np.zeros(0, bool)
    cuts, held = [0], 0
    heads = np.append(np.flatnonzero(anchor), len(order))
    total = np.concatenate([[0], np.cumsum(rows["size"] + 1)])
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        size = int(total[b] - total[a])
        if held and held + size > SORTED:
            cuts.append(a)
            held = 0
        held += size
    cuts.append(len(order))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = take(rows, slice(a, b))
        if not len(part["size"]):
            continue
        sizes = part["size"].astype(np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        # bytes count from 1 on; a 0 ends each piece
        text = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[np.repeat(first, sizes) + inside] = pieces[np.repeat(begin[a:b], sizes) + inside].astype(np.uint16) + 1
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        valid = np.arange(len(text)) - first[owner] + LENGTH <= sizes[owner]
        # eight-byte words are compared as bytes: 255 + 1 wraps to 0, which no valid string holds otherwise
        place, kind = window_classes(text, valid, LENGTH)
        own = owner[place]
        doc, key, start = part["doc"][own], part["text"][own], part["start"][own] + (place - first[own])
        order = np.lexsort((start, key, doc, kind))
        kind, doc, key, start = kind[order], doc[order], key[order], start[order]
        new = np.concatenate([[True], kind[1:] != kind[:-1]])
        lowest = doc[new][np.cumsum(new) - 1]
        earliest = np.concatenate([[True], (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        head = start[np.flatnonzero(earliest)[np.cumsum(earliest) - 1]]
        again = (doc > lowest) | (start > head)
        yield {"doc": doc[again], "text": key[again], "start": start[again].astype(np.int64), "stop": start[again].astype(np.int64) + LENGTH}


def _repeated(surroundings: DataFrame, buckets: int) -> DataFrame:
    """Per document bucket the ranges of repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _packed(batches)
        width = sum(np.dtype(dtype).itemsize for _, dtype in AROUND)
        found = [unpack(_rows(packed, AGAIN), RANGE)]
        around = _rows(packed, FIRST)
        rows = unpack([(n, data[: n * width]) for n, data in around], AROUND)
        pieces = np.frombuffer(b"".join([data[n * width :] for n, data in around]), np.uint8)
        del packed, around
        for part in _sorted_groups(rows, pieces):
            found.append(_merged(part))
        every = _merged({name: np.concatenate([f[name] for f in found]).astype(np.int64) for name, _ in RANGE})
        yield _batch(list(_deal(every, RANGE, every["doc"], buckets, AGAIN)))

    return _dealt(surroundings).mapInArrow(tidied(run), ROW)


OUT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(beside: DataFrame, with_text: bool) -> DataFrame:
    schema = OUT + (", kept binary, removed array<struct<start:int,stop:int>>" if with_text else "")
    names = [x.split()[0] for x in OUT.split(", ")] + (["kept", "removed"] if with_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, texts = _apart(batches)
        found = _ByText(_merged({n: c.astype(np.int64) for n, c in unpack(_rows(packed, AGAIN), RANGE).items()}))
        del packed
        for block, ids, keys in _texts(iter(texts)):
            rows = []
            for text, doc, key in zip(block, ids.tolist(), keys.tolist(), strict=True):
                own = take(found.columns, found.of(doc, key))
                spans = list(zip(own["start"].tolist(), own["stop"].tolist(), strict=True))
                parts, at = [], 0
                for start, stop in spans:
                    parts.append(text[at:start])
                    at = stop
                kept = b"".join([*parts, text[at:]])
                row = (None if doc == NULL else doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept, [{"start": a, "stop": b} for a, b in spans]) if with_text else row)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))][: 3 if with_text else 1]
            cells = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names)

    return beside.mapInArrow(tidied(run), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and if asked the bytes kept and the spans.

    A byte goes if a string of LENGTH bytes covers it that also begins earlier: in a document of a smaller id, or
    earlier in its own. Strings never cross documents and are judged on the texts as given. A null text is empty; a null
    id counts as larger than all others; documents of one id (nulls, too) don't remove from each other, and rows that
    repeat in full give equal rows; other columns are ignored; an empty table gives no row.
    Texts are shuffled twice, by document; anchors once, as packed rows; no group of equal strings gathers in a task,
    since each task sends one of a kind.
    """
    spark = small_batches(docs.sparkSession)
    buckets = 4 * partitions(spark)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL)).alias("doc"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    kinds = written(_kinds(_anchors(base, buckets), buckets), "kinds")
    release(spark)
    sorted_ = written(_repeated(_surroundings(_beside(base, kinds, [FIRST], buckets), buckets), buckets), "repeated")
    release(spark)
    ranges = kinds.where(F.col("kind") == AGAIN).unionByName(sorted_)
    out = _removed(_beside(base, ranges, [AGAIN], buckets), with_text)
    return out.withColumnRenamed("doc", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
