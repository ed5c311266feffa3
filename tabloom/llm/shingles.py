"""Sets of hashed word shingles, made for whole blocks of texts at once."""

from __future__ import annotations

import numpy as np

from .shared import U64, WORD_BYTES, mix

BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = U64(0xD6E8FEB86659FD93)


#: Bytes of text that are hashed at a time; of a longer word all.
CHUNK = 1 << 20


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the place of every word in bytes where only spaces part words. A hash is a polynomial in the word's
    bytes, taken as a difference of running sums, so that no word is a Python object."""
    inside = np.concatenate([[False], data != 0x20, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        power = np.full(len(data), BASE)
        power[:1] = 1
        power = np.cumprod(power, dtype=U64)
        back = np.full(len(data), INVERSE)
        back[:1] = 1
        back = np.cumprod(back, dtype=U64)
        total = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * power, dtype=U64)])
        return mix((total[stop] - total[start]) * back[start] + (stop - start).astype(U64)), start


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, one text after the other, and the number of words of each text."""
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES) for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data = b" ".join([*parts, b""])
    hashes, starts, at = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        cut = len(data) if at + CHUNK >= len(data) else data.find(b" ", at + CHUNK)
        cut = len(data) if cut < 0 else cut
        found, start = _hashed(np.frombuffer(data, np.uint8)[at:cut])
        hashes.append(found)
        starts.append(start + at)
        at = cut
    return np.concatenate(hashes), np.diff(np.concatenate([[0], np.searchsorted(np.concatenate(starts), ends)]))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: `width` consecutive words, or all words of a text of fewer. A text
    without words has none."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    out, ends = [], np.cumsum(counts)
    with np.errstate(over="ignore"):
        rolled = hashes.copy()
        for k in range(1, min(width, n)):
            rolled[: n - k] = rolled[: n - k] * STEP + hashes[k:]
        rolled = mix(rolled)
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            if count >= width:
                out.append(np.unique(rolled[end - count : end - width + 1]))
            elif count:
                value = U64(count)
                for h in hashes[end - count : end]:
                    value = value * STEP + h
                out.append(mix(np.array([value], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out
