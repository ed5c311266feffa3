"""Exact nearest neighbours of points in the plane, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows cut at medians of the wider side, again and again, into parts of `most` rows or fewer."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        of = todo.pop()
        if len(of) <= most:
            out.append(of)
            continue
        side = int(np.argmax(np.ptp(points[of], axis=0)))
        of = of[np.argpartition(points[of, side], len(of) // 2)]
        todo += [of[len(of) // 2 :], of[: len(of) // 2]]
    return out


def _around(points: np.ndarray, k: int, of_these: np.ndarray | None = None) -> Iterator[tuple]:
    """By leaf: the rows (of_these, or all), their distances to the k + 1 nearest, themselves among them, and the rows of
    other leaves within reach. Distances are the larger of the coordinates'. A leaf's own points bound the distances, and
    only leaves whose boxes lie within the bound are looked at; boxes of many leaves come before single ones."""
    leaves, many, wide = _leaves(points, max(64, 4 * (k + 1))), 128, 1 << 14
    low, high = (np.array([f(points[of], axis=0) for of in leaves]) for f in (np.min, np.max))
    group = np.arange(0, len(leaves), many)
    group_low, group_high = np.minimum.reduceat(low, group), np.maximum.reduceat(high, group)
    asked = np.ones(len(points), bool)
    if of_these is not None:
        asked[:] = False
        asked[of_these] = True
    for leaf, of in enumerate(leaves):
        rows = of[asked[of]]
        if not len(rows):
            continue
        p = points[rows]
        best = np.partition(_apart(p, points[of]), min(k, len(of) - 1), axis=1)[:, : k + 1]
        bound = best.max() if len(of) > k else np.inf
        floor, top = p.min(0) - bound, p.max(0) + bound
        near = np.flatnonzero(((group_low <= top) & (group_high >= floor)).all(1))
        near = (near[:, None] * many + np.arange(many)).ravel()
        near = near[near < len(leaves)]
        near = near[((low[near] <= top) & (high[near] >= floor)).all(1) & (near != leaf)]
        others = np.concatenate([leaves[i] for i in near]) if len(near) else np.zeros(0, np.int64)
        others = others[((points[others] <= top) & (points[others] >= floor)).all(1)]
        for i in range(0, len(others), wide):
            both = np.concatenate([best, _apart(p, points[others[i : i + wide]])], 1)
            best = np.partition(both, min(k, both.shape[1] - 1), axis=1)[:, : k + 1]
        yield rows, best, of, others


def _apart(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.abs(p[:, None, 0] - c[:, 0]), np.abs(p[:, None, 1] - c[:, 1]))


def _reach(points: np.ndarray, k: int) -> np.ndarray:
    """Exact distance of each point to its k-th nearest, by the larger of the coordinates' distances."""
    out = np.empty(len(points))
    for rows, best, *_ in _around(points, k):
        out[rows] = best.max(1)
    return out


def shells(points: np.ndarray, k: int, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the points at `rows`: the distance to the k-th nearest (infinite, if there are fewer); which of those at this
    distance the k-th is (from 1, in any order); and by coordinate, how many are at it along this one, and the coordinates
    at this distance below and above, exactly those of the points there."""
    n = len(rows)
    place = np.full(len(points), -1)
    place[rows] = np.arange(n)
    r, at, some = np.full(n, np.inf), np.ones(n, np.int64), np.zeros((n, 2), np.int64)
    low, high, wide = np.full((n, 2), -np.inf), np.full((n, 2), np.inf), 1 << 14
    for of, best, own, others in _around(points, k, rows) if n else ():
        if best.shape[1] <= k:
            continue
        p, to, radius = points[of], place[of], best.max(1)
        r[to], at[to] = radius, k + 1 - (best < radius[:, None]).sum(1)
        all_ = np.concatenate([own, others])
        low[to], high[to] = p - radius[:, None], p + radius[:, None]
        for i in range(0, len(all_), wide):
            c = points[all_[i : i + wide]]
            row, col = np.nonzero(_apart(p, c) == radius[:, None])
            for side in (0, 1):
                here = np.abs(p[row, side] - c[col, side]) == radius[row]
                a, v = to[row[here]], c[col[here], side]
                np.add.at(some[:, side], a, 1)
                under = v < points[rows[a], side]
                low[a[under], side], high[a[~under], side] = v[under], v[~under]
    return r, at, some, low, high
