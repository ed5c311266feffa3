"""Suffix sorting by difference covers (Karkkainen and Sanders, 2003), with numpy, down to a given depth."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int, span: int = 1) -> np.ndarray:
    """The suffixes of `text` (whole numbers from 0 up to len(text), or bytes) in the order of their first `depth`
    characters at least, where a symbol of `text` stands for `span` characters. Texts of up to a million symbols.

    The triples at two thirds of all places, those with i % 3 of 1 or 2, are sorted and named. Unless the names differ
    all or cover the depth, the text of the names is sorted by the same rule. The remaining suffixes are a symbol and
    a suffix that has a rank by then; they are sorted by these two and merged with the others.
    """
    n = len(text)
    bits = int(text.max() + 1).bit_length() if n else 1
    if n < 4 or 3 * bits > 63:
        if n >= 4:
            raise ValueError("the text has too many symbols")
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    at = np.concatenate([text.astype(np.int64) + 1, np.zeros(3, np.int64)])  # 0 is past the end
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    places = np.concatenate([one, two])
    key = (at[places] << (2 * bits)) | (at[places + 1] << bits) | at[places + 2]
    order = np.argsort(key)
    key = key[order]
    name = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
    rank = np.zeros(n + 3, np.int64)
    if name[-1] == len(places) or 3 * span >= depth:
        sampled = places[order]
        rank[sampled] = name
    else:
        named = np.empty(len(places), np.int64)
        named[order] = name
        below = suffix_order(np.concatenate([named[: len(one)], [0], named[len(one) :]]), depth, 3 * span)
        below = below[below != len(one)]
        sampled = places[np.where(below > len(one), below - 1, below)]
        rank[sampled] = np.arange(1, len(sampled) + 1)
    width = int(len(places) + 1).bit_length()
    rest = np.arange(0, n, 3)
    key = (at[rest] << width) | rank[rest + 1]
    order = np.argsort(key)
    rest, key = rest[order], key[order]
    residue = sampled % 3
    first, second = sampled[residue == 1], sampled[residue == 2]
    # names that cover the depth leave ties, whose order may differ from one key to the next: a later key doesn't step back
    level = np.maximum.accumulate
    two_of = lambda i: (((at[i] << bits) | at[i + 1]) << width) | rank[i + 2]
    ahead = np.searchsorted(level((at[first] << width) | rank[first + 1]), key)
    ahead += level(np.searchsorted(level(two_of(second)), two_of(rest)))
    out, spot = np.empty(n, np.int64), np.arange(len(rest)) + ahead
    taken = np.zeros(n, bool)
    taken[spot] = True
    out[spot], out[~taken] = rest, sampled
    return out


def window_classes(text: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, class of each) of the valid windows of `length` bytes: neighbours in suffix order whose first `length`
    bytes are equal share a class. Classes are numbered in suffix order."""
    order = suffix_order(text, length)
    order = order[valid[order]]
    if not len(order):
        return order, order
    wide = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):  # eight bytes from each place on
        wide = wide[:-k] | (wide[k:] << np.uint64(8 * k))
    same, left, right = np.zeros(len(order), bool), order[:-1], order[1:]
    alive = np.arange(len(left))
    for offset in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        equal = wide[left + offset] == wide[right + offset]
        alive, left, right = alive[equal], left[equal], right[equal]
    same[alive + 1] = True
    return order, np.cumsum(~same) - 1
