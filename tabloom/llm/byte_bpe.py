"""Byte-level BPE encoding and decoding by replaying the merges over all words of a block at once."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import small_batches, tidied, uncollected

#: Positions of a merge up to which they are joined one by one.
FEW = 16
#: Bytes of distinct words whose merges one replay holds in memory, and distinct words of one generation (a task
#: remembers two, and the words of the block at hand).
REPLAY_BYTES = 1 << 18
REMEMBERED = 60_000
#: Characters from which a text is encoded by itself, so many words of it at a time.
LONG, RUN = 1 << 20, 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one rank file. Words are encoded in sets: `replay` merges all new words of a block together."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        made = {}  # every pair of tokens that makes a token
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    made[left << 32 | right] = rank
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        pairs = np.array(sorted(made), np.int64)
        self._open(pattern, tokens, pairs, np.array([made[k] for k in pairs.tolist()], np.int64), made)

    def _open(self, pattern: str, tokens: list[bytes], pairs: np.ndarray, merged: np.ndarray, made: dict[int, int]) -> None:
        self.pattern, self.tokens, self.pairs, self.merged, self.made = pattern, tokens, pairs, merged, made
        compiled = regex.compile(pattern)
        self.split, self.matches = compiled.findall, compiled.finditer
        number = {token: i for i, token in enumerate(tokens) if len(token) == 1}
        self.byte = np.array([number[bytes([b])] for b in range(256)], np.int64)
        self.first = self.rank(np.repeat(self.byte, 256), np.tile(self.byte, 256))  # by pair of bytes
        self.decimal = [str(i) for i in range(len(tokens))]
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.older: dict[str, bytes] = {}

    def __getstate__(self) -> tuple:
        return self.pattern, self.tokens, self.pairs, self.merged

    def __setstate__(self, state: tuple) -> None:
        self._open(*state, dict(zip(state[2].tolist(), state[3].tolist(), strict=True)))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair of tokens makes, or -1."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int64)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word.

        The words lie one after the other. `places` is the inverted index: for each merge, the positions of the pairs
        that it joins. The merges are applied in rank order, each at all its positions; only the pairs that touch one
        are looked up again and indexed anew. Where that makes a pair of lower rank than the merge at hand, which no
        order over all words settles, the word is merged by itself.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        octets = np.frombuffer(b"".join(words), np.uint8)
        token = self.byte[octets]
        n = len(token)
        ends = np.cumsum(sizes)
        first, last = (ends - sizes)[sizes > 0], ends[sizes > 0] - 1
        word_of = np.repeat(np.arange(len(words)), sizes)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        before[first], after[last] = -1, -1
        made = np.full(n, -1, np.int64)
        pair = np.flatnonzero(after >= 0)
        made[pair] = self.first[octets[pair].astype(np.int64) << 8 | octets[pair + 1]]
        pair = pair[made[pair] >= 0]
        pair = pair[np.argsort(made[pair], kind="stable")]
        values, cuts = np.unique(made[pair], return_index=True)
        places = {r: pair[a:b].tolist() for r, (a, b) in zip(values.tolist(), pairwise([*cuts.tolist(), len(pair)]), strict=True)}
        queue, alone = values.tolist(), set()
        token_, before_, after_, made_, word_ = map(memoryview, (token, before, after, made, word_of))
        while queue:
            rank = heappop(queue)
            held = places.pop(rank)
            if len(held) <= FEW:
                for p in sorted(held):
                    if made_[p] == rank:
                        self._merge(rank, p, token_, before_, after_, made_, word_, places, queue, alone)
                continue
            i = np.array(held, np.int64)
            i = np.unique(i[made[i] == rank])
            if not len(i):
                continue
            j = after[i]
            if (made[j] == rank).any():  # a pair of equal tokens may overlap itself: every second one of a run
                keep, taken = [], -1
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if x != taken:
                        keep.append(x)
                        taken = y
                i = np.array(keep, np.int64)
                j = after[i]
            k = after[j]
            token[i], token[j], made[i], made[j], after[i] = rank, -1, -1, -1, k
            right = k >= 0
            before[k[right]] = i[right]
            h = before[i]
            left = h >= 0
            touched = np.concatenate([i[right], h[left]])
            new = self.rank(token[touched], token[after[touched]])
            made[touched] = new
            for p, r in zip(touched.tolist(), new.tolist(), strict=True):
                if r >= 0:
                    if r <= rank:
                        alone.add(int(word_of[p]))
                    elif r in places:
                        places[r].append(p)
                    else:
                        places[r] = [p]
                        heappush(queue, r)
        alive = token >= 0
        cuts = np.cumsum(np.bincount(word_of[alive], minlength=len(words)))[:-1]
        out = [x.tolist() for x in np.split(token[alive], cuts)] if words else []
        for w in alone:
            out[w] = self.merge_alone(words[w])
        return out

    def _merge(self, rank, i, token, before, after, made, word_of, places, queue, alone) -> None:
        """The merge of one pair: what `replay` does for many."""
        j = after[i]
        k = after[j]
        token[i], token[j], made[i], made[j], after[i] = rank, -1, -1, -1, k
        if k >= 0:
            before[k] = i
        h = before[i]
        for p in (i if k >= 0 else -1, h):
            if p >= 0:
                new = made[p] = self.made.get(token[p] << 32 | token[after[p]], -1)
                if new >= 0:
                    if new <= rank:
                        alone.add(word_of[p])
                    elif new in places:
                        places[new].append(p)
                    else:
                        places[new] = [p]
                        heappush(queue, new)

    def merge_alone(self, word: bytes) -> list[int]:
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        while len(ids) > 1:
            ranks = [self.made.get(a << 32 | b, 1 << 62) for a, b in pairwise(ids)]
            low = min(ranks)
            if low == 1 << 62:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [low]
        return ids

    def learn(self, words: set[str]) -> None:
        """Encodes the words that aren't known yet, a bounded number of bytes at a time. Of those known, the ones that
        came up since the last change of generation stay at the next."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, fresh = self.known, self.older, []
        for w in words:
            if w not in known:
                if (ids := older.get(w)) is None:
                    fresh.append(w)
                else:
                    known[w] = ids
        block, held = [], 0
        for w in [*fresh, None]:
            if block and (w is None or held >= REPLAY_BYTES):
                for word, ids in zip(block, self.replay([b.encode("utf-8") for b in block]), strict=True):
                    known[word] = np.array(ids, np.uint32).tobytes()
                block, held = [], 0
            if w is not None:
                block.append(w)
                held += len(w)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def decimals(self, ids: list[int]) -> str:
        return " ".join([self.decimal[i] for i in ids])

    def _blocks(self, texts: list[str | None], most: int) -> Iterator[list[str]]:
        block, held = [], 0
        for text in [*(t or "" for t in texts), None]:
            if block and (text is None or held >= most or len(text) >= LONG):
                yield block
                block, held = [], 0
            if text is not None:
                block.append(text)
                held += len(text)
                if len(text) >= LONG:
                    yield block
                    block, held = [], 0

    def encode_all(self, texts: list[str | None], most: int = 2 << 20) -> Iterator[Iterator[list[int]]]:
        """For each text its ids in order, in lists of a bounded length; to be read before the next text's."""
        for block in self._blocks(texts, most):
            if len(block[0]) >= LONG:
                yield self._long(block[0])
                continue
            cut = [self.split(text) for text in block]
            self.learn(set().union(*cut))
            known = self.known
            for words in cut:
                yield iter([np.frombuffer(b"".join([known[w] for w in words]), np.uint32).tolist()])

    def _long(self, text: str) -> Iterator[list[int]]:
        found = (m[0] for m in self.matches(text))
        while words := list(islice(found, RUN)):
            self.learn(set(words))
            yield np.frombuffer(b"".join([self.known[w] for w in words]), np.uint32).tolist()


def _whole(codec: Codec, parts: Iterator[list[int]]) -> tuple:
    ids = [i for part in parts for i in part]
    return ids, codec.decode(ids).decode("utf-8", "replace")


def _digest(codec: Codec, parts: Iterator[list[int]]) -> tuple:
    """Number of ids, digests of the ids and of the bytes that they decode to."""
    n, named, decoded = 0, hashlib.sha256(), hashlib.sha256()
    for ids in parts:
        if ids:
            named.update(((" " if n else "") + codec.decimals(ids)).encode())
            decoded.update(codec.decode(ids))
            n += len(ids)
    return n, named.hexdigest(), decoded.hexdigest()


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text",
    row: Callable[[Codec, Iterator[list[int]]], tuple] = _whole, schema: str = "ids array<int>, decoded string",
) -> DataFrame:
    """The columns `keep` of every document, and what `row` makes of its ids: by default the ids, and the text that is
    decoded from them.

    The corpus is encoded where it lies, without a shuffle: each task takes its documents in blocks, replays the
    merges over the block's distinct new words, and remembers a bounded number of words. Texts are encoded whole, very
    long ones in parts. A null or empty text has no ids; repeated rows are encoded each; columns not in `keep` are
    left out. The driver reads the rank file; its tables, whose size is fixed, are broadcast.
    """
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern).__getstate__())
    kept = docs.select(*keep, F.col(text).alias("_text"))
    extra = T._parse_datatype_string(schema)
    types = [f.type for f in to_arrow_schema(extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.__new__(Codec)
        codec.__setstate__(shared.value)
        for batch in batches:
            with uncollected():
                made = [row(codec, parts) for parts in codec.encode_all(batch.column("_text").to_pylist())]
            arrays = [pa.array(c, t) for c, t in zip(list(zip(*made, strict=True)) or [()] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*keep, *extra.names])

    return kept.mapInArrow(tidied(run), T.StructType([*kept.schema.fields[:-1], *extra]))


def decode_ids(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each array of ids; null ids give a null text."""
    shared = df.sparkSession.sparkContext.broadcast(Codec(read_ranks(ranks_path), "").tokens)

    @F.pandas_udf("string")
    def text(arrays: pd.Series) -> pd.Series:
        tokens = shared.value
        return arrays.map(lambda a: None if a is None else b"".join([tokens[i] for i in a]).decode("utf-8", "replace"))

    return df.withColumn(out, text(F.col(ids)))


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"],
        row=_digest, schema="n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
