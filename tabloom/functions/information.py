"""Mutual information with a continuous side over whole tables, by nearest neighbours (Kraskov et al., 2004; Ross, 2014).

These estimators break ties by noise too small to change any other order. None is drawn here: distinct values with their
counts stand for the rows, and where equal values decide, the mean over such noise is taken. With more than k rows at one
place, that mean needs only counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import one_row, quoted
from .neighbours import shells
from .special import digamma
from .stats import WINDOW_ROWS, WINDOWS, running

#: Distinct values of a side up to which every task gets them all (16 bytes each); more are cut into slabs of about
#: SLAB_VALUES. Distinct pairs that one task's cell holds.
SENT_VALUES, SLAB_VALUES, CELL_PAIRS = 1_000_000, 200_000, 100_000


def psi(n: np.ndarray) -> np.ndarray:
    """The digamma function of numbers of 1 or more."""
    x, out = np.array(n, float), np.zeros(np.shape(n))
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def psi_of(n: Column | str) -> Column:
    """psi in a plan, of whole numbers."""
    x = (F.col(n) if isinstance(n, str) else n).cast("double") + 6
    f = 1 / (x * x)
    far = F.ln(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
    return far - sum((1 / (x - i) for i in range(2, 7)), 1 / (x - 1))


def _place(inside: int, tied: int, some: int, at: int) -> float:
    """mean_psi of one place, as a sum over the places J."""
    total, seen, t, log_p = 0.0, 0.0, at, 0.0
    log_p = float(np.log(np.arange(some - at + 1, some + 1) / np.arange(tied - at + 1, tied + 1)).sum())  # of J = at
    last, many = tied - some + at, 1 << 16
    while t <= last and seen < 1 - 1e-13:
        j = np.arange(t, min(last, t + many - 1) + 1, dtype=float)
        steps = np.log(np.maximum(j[:-1] * (tied - some - (j[:-1] - at)), 1e-300) / ((j[:-1] + 1 - at) * (tied - j[:-1])))
        p = np.exp(log_p + np.concatenate([[0.0], np.cumsum(steps)]))
        total, seen = total + float((p * psi(inside + j - 1)).sum()), seen + float(p.sum())
        e = j[-1]
        if e < last:
            log_p = float(np.log(p[-1]) + np.log(e * (tied - some - (e - at)) / ((e + 1 - at) * (tied - e)))) if p[-1] > 0 else -np.inf
        t += many
    return total / seen if seen else float(psi(np.array([inside]))[0])


def mean_psi(inside: np.ndarray, tied: np.ndarray, some: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The mean of psi(inside + J - 1), J being the place, among `tied` rows in random order, of the at-th of `some` of them."""
    inside, tied, some, at = (np.asarray(a, np.int64) for a in (inside, tied, some, at))
    inside, some = np.maximum(inside, 1), np.minimum(some, tied)
    at = np.clip(at, 1, np.maximum(some, 1))
    out = psi(np.where(some > 0, inside + at - 1, inside))
    odd = (some > 0) & (some < tied)
    if (one := odd & (some == 1)).any():
        i, t = inside[one].astype(float), tied[one].astype(float)
        out[one] = ((i + t - 1) * (psi(i + t) - 1) - (i - 1) * (psi(i) - 1)) / t
    if (first := odd & (some > 1) & (inside == 1)).any():
        out[first] = psi(at[first]) + psi(tied[first] + 1) - psi(some[first] + 1)
    if (rest := odd & (some > 1) & (inside > 1)).any():
        kinds, of = np.unique(np.stack([a[rest] for a in (inside, tied, some, at)], 1), axis=0, return_inverse=True)
        out[rest] = np.array([_place(*map(int, kind)) for kind in kinds])[of.ravel()]
    return out


def _psi_sum(table: DataFrame, of: str | Column, weight: str) -> float:
    """Sum of weight * psi(of). Counts of parts of a table of n rows take less than sqrt(2 n) different values."""
    rows = table.groupBy((quoted(of) if isinstance(of, str) else of).alias("_n")).agg(F.sum(weight).alias("_w")).where("_n > 0 and _w > 0").collect()
    return float((psi(np.array([r[0] for r in rows])) * np.array([r[1] for r in rows], float)).sum()) if rows else 0.0


def _arrays(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy() for n in names]


QUERIES = "lo double, hi double, w long, s long, j int"


class Ranks:
    """Numbers of rows below and up to a value, from sorted distinct values and their rows."""

    def __init__(self, values: np.ndarray, rows: np.ndarray):
        order = np.argsort(values)
        self.values, self.before = values[order], np.concatenate([[0], np.cumsum(rows[order])]).astype(np.int64)

    def below(self, q: np.ndarray) -> np.ndarray:
        return self.before[np.searchsorted(self.values, q, "left")]

    def upto(self, q: np.ndarray) -> np.ndarray:
        return self.before[np.searchsorted(self.values, q, "right")]

    def sum(self, lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray, j: np.ndarray) -> float:
        """Sum of w times mean psi of the rows between lo and hi; those at lo and hi are tied."""
        return _weighted(self.below(lo), self.upto(lo), self.below(hi), self.upto(hi), w, s, j)


def _weighted(lo_below, lo_upto, hi_below, hi_upto, w, s, j) -> float:
    inside = hi_below - lo_upto
    return float((w * mean_psi(inside, hi_upto - lo_below - inside, s, j)).sum())


def ranks_of(values: DataFrame) -> Ranks:
    table = values.select("a", "n").toArrow()
    return Ranks(*_arrays(table, "a", "n"))


def psi_between(values: DataFrame, distinct: int, queries: DataFrame, sent: int = SENT_VALUES, slab: int = SLAB_VALUES) -> float:
    """Ranks.sum of queries (QUERIES) against `distinct` values (a, n). Few values go to all tasks. Otherwise both are
    cut into slabs; a query's ends in different slabs are counted apart and meet by its own values."""
    if distinct <= sent:
        ranks = values.sparkSession.sparkContext.broadcast(ranks_of(values))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_pydict({"v": [ranks.value.sum(*_arrays(b, "lo", "hi", "w", "s", "j"))]})

        return queries.select("lo", "hi", "w", "s", "j").mapInArrow(summed, "v double").agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]

    parts = min(WINDOWS, -(-distinct // slab))
    picked = sorted(r[0] for r in values.where(F.pmod(F.xxhash64("a"), F.lit(max(1, distinct // (20 * parts)))) == 0).select("a").collect())
    cuts = np.unique([picked[len(picked) * i // parts] for i in range(1, parts)]) if picked else np.zeros(0)

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, n = _arrays(b, "a", "n")
            yield pa.RecordBatch.from_pydict({"slab": np.searchsorted(cuts, a, "right").astype(np.int32), "a": a, "n": n})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi, w, s, j = _arrays(b, "lo", "hi", "w", "s", "j")
            first, last = (np.searchsorted(cuts, q, "right").astype(np.int32) for q in (lo, hi))
            apart = np.flatnonzero(first != last)
            of = np.concatenate([np.arange(len(lo)), apart])
            end = np.where(first == last, 2, 0).astype(np.int32)  # 0: rank of lo, 1: of hi, 2: both
            cols = {"slab": np.concatenate([first, last[apart]]), "end": np.concatenate([end, np.ones(len(apart), np.int32)])}
            yield pa.RecordBatch.from_pydict(cols | {n: a[of] for n, a in (("lo", lo), ("hi", hi), ("w", w), ("s", s), ("j", j))})

    placed = values.mapInArrow(slabs, "slab int, a double, n long")
    rows = np.zeros(len(cuts) + 1, np.int64)
    for part, n in placed.groupBy("slab").agg(F.sum("n")).collect():
        rows[part] = n
    starts = np.cumsum(rows) - rows

    def counted(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ranks = Ranks(*_arrays(left, "a", "n"))
        lo, hi, w, s, j, end = _arrays(right, "lo", "hi", "w", "s", "j", "end")
        both, half = end == 2, end != 2
        q, start = np.where(end == 0, lo, hi)[half], starts[key[0].as_py()]
        cols = {n: a[half] for n, a in (("lo", lo), ("hi", hi), ("w", w), ("s", s), ("j", j), ("end", end))}
        cols |= {"below": ranks.below(q) + start, "upto": ranks.upto(q) + start, "total": np.zeros(len(q))}
        kinds = pa.schema([("lo", pa.float64()), ("hi", pa.float64()), ("w", pa.int64()), ("s", pa.int64()), ("j", pa.int32()), ("end", pa.int32()), ("below", pa.int64()), ("upto", pa.int64()), ("total", pa.float64())])
        sums = {n: np.zeros(1) for n in kinds.names} | {"end": np.full(1, 2), "total": np.array([ranks.sum(*(a[both] for a in (lo, hi, w, s, j)))])}
        return pa.table({n: pa.array(np.concatenate([cols[n], sums[n]]), kinds.field(n).type, safe=False) for n in kinds.names}, schema=kinds)

    found = placed.groupBy("slab").cogroup(queries.mapInArrow(dealt, f"slab int, end int, {QUERIES}").groupBy("slab"))
    found = found.applyInArrow(counted, f"{QUERIES}, end int, below long, upto long, total double").persist()
    total = found.agg(F.coalesce(F.sum("total"), F.lit(0.0))).first()[0]
    rank = lambda end, c: F.max(F.when(F.col("end") == end, F.col(c))).alias(f"{c}{end}")
    met = found.where("end < 2").groupBy("lo", "hi", "s", "j").agg(F.sum(F.when(F.col("end") == 0, F.col("w"))).alias("w"), *[rank(e, c) for e in (0, 1) for c in ("below", "upto")])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"v": [_weighted(*_arrays(b, "below0", "upto0", "below1", "upto1", "w", "s", "j"))]})

    total += met.mapInArrow(joined, "v double").agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]
    found.unpersist()
    return total


# ---- a continuous side and a discrete one ----


def _neighbours(cells: DataFrame, k: int, rows: int, window_rows: int) -> DataFrame:
    """cells (v, c, n, kk) with near: an array of (d, v, n) of the k distinct values of the same class on either side.
    Large classes are cut into ranges, which also get the k values at the ends of the ranges beside them."""
    parts = min(WINDOWS, -(-rows // window_rows))
    cells = cells.select("v", "c", "n", "kk", F.lit(0).alias("_r"), F.lit(False).alias("_lent"))
    if parts > 1:
        cuts = cells.groupBy("c").agg(F.count("*").alias("_d"), F.percentile_approx("v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts)).alias("_cuts"))
        cuts = cuts.where(F.col("_d") > max(window_rows, 4 * k * parts)).select("c", "_cuts")
        cells = cells.join(cuts, "c", "left").withColumn("_r", F.coalesce(F.size(F.filter("_cuts", lambda x: x < F.col("v"))), F.lit(0))).drop("_cuts")
        own = Window.partitionBy("c", "_r")
        ends = cells.withColumns({"_first": F.row_number().over(own.orderBy("v")), "_last": F.row_number().over(own.orderBy(F.desc("v")))})
        lent = [ends.where(F.col(e) <= k).withColumns({"_r": F.col("_r") + by, "_lent": F.lit(True)}).select(cells.columns) for e, by in (("_first", -1), ("_last", 1))]
        cells = cells.unionByName(lent[0]).unionByName(lent[1])
    over = Window.partitionBy("c", "_r").orderBy("v")
    row = F.struct("v", "n")
    near = [F.lag(row, i).over(over) for i in range(1, k + 1)] + [F.lead(row, i).over(over) for i in range(1, k + 1)]
    near = F.transform(F.filter(F.array(*near), lambda x: x.isNotNull()), lambda x: F.struct(F.abs(x["v"] - F.col("v")).alias("d"), x["v"].alias("v"), x["n"].alias("n")))
    return cells.withColumn("near", F.sort_array(near)).where(~F.col("_lent")).drop("_r", "_lent")


def mixed_information(df: DataFrame, x: str, label: str, k: int = 3, window_rows: int = WINDOW_ROWS, sent: int = SENT_VALUES, slab: int = SLAB_VALUES) -> float:
    """Of a number and a class, in nats. A class of one row is left out."""
    return mixed_informations(df, [(x, label)], k, window_rows, sent, slab)[0]


def mixed_informations(df: DataFrame, sides: Sequence[tuple[str, str]], k: int = 3, window_rows: int = WINDOW_ROWS, sent: int = SENT_VALUES, slab: int = SLAB_VALUES) -> list[float]:
    """mixed_information of each (number, class); the classes have one type. All sides are counted by the same few jobs,
    of which the driver gets a row for each side."""
    each = [df.groupBy(quoted(x).alias("v"), quoted(label).alias("c")).agg(F.count("*").alias("n")).withColumn("f", F.lit(i)) for i, (x, label) in enumerate(sides)]
    cells = reduce(DataFrame.unionByName, each)
    sizes = cells.groupBy("f", "c").agg(F.sum("n").alias("nc")).where("nc > 1")
    cells = cells.join(sizes, ["f", "c"]).withColumn("kk", F.least(F.lit(k), F.col("nc") - 1).cast("int")).persist()
    n, tied = F.col("n"), F.col("n") > F.col("kk")
    known = n * (F.when(tied, psi_of(n)).otherwise(psi_of("kk")) - psi_of("nc"))
    seen = cells.groupBy("f").agg(F.sum("n").alias("rows"), F.count("*").alias("cells"), F.count_if(~tied).alias("hard"), F.sum(known).alias("total"))
    seen = {r["f"]: r for r in seen.collect()}
    values = cells.groupBy("f", "v").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(tied, F.col("n"))), F.lit(0)).alias("w"))
    shared = {r["f"]: r for r in values.groupBy("f").agg(F.sum(F.col("w") * psi_of("n")).alias("total"), F.count("*").alias("distinct")).collect()}
    out = []
    for i in range(len(sides)):
        if i not in seen:
            out.append(0.0)
            continue
        total = seen[i]["total"] - shared[i]["total"]
        if seen[i]["hard"]:
            at = F.col("f") == i
            total -= _hard_cells(cells.where(at), values.where(at), k, seen[i]["cells"], shared[i]["distinct"], window_rows, sent, slab)
        out.append(max(0.0, digamma(float(seen[i]["rows"])) + total / seen[i]["rows"]))
    cells.unpersist()
    return out


def _hard_cells(cells: DataFrame, values: DataFrame, k: int, many: int, distinct: int, window_rows: int, sent: int, slab: int) -> float:
    """The sum over rows of the cells of kk rows or fewer of mean psi along the number."""
    hard = _neighbours(cells, k, many, window_rows).where(F.col("n") <= F.col("kk"))
    need = (F.col("kk") - (F.col("n") - 1)).cast("long")
    reach = F.aggregate("near", F.struct(F.lit(0).cast("long").alias("s"), F.lit(None).cast("double").alias("d")), lambda a, y: F.when(a["s"] >= F.col("need"), a).otherwise(F.struct((a["s"] + y["n"]).alias("s"), y["d"].alias("d"))))
    hard = hard.withColumn("need", need).withColumn("r", reach["d"])
    rows = lambda f: F.aggregate(F.filter("near", f), F.lit(0).cast("long"), lambda a, y: a + y["n"])
    at = lambda f: F.filter("near", lambda y: (y["d"] == F.col("r")) & f(y))
    hard = hard.select(
        F.coalesce(F.get(at(lambda y: y["v"] < F.col("v")), F.lit(0))["v"], F.col("v") - F.col("r")).alias("lo"), F.coalesce(F.get(at(lambda y: y["v"] > F.col("v")), F.lit(0))["v"], F.col("v") + F.col("r")).alias("hi"),
        F.col("n").alias("w"), rows(lambda y: y["d"] == F.col("r")).alias("s"), (F.col("need") - rows(lambda y: y["d"] < F.col("r"))).cast("int").alias("j"),
    )
    return psi_between(values.select(F.col("v").alias("a"), "n"), distinct, hard, sent, slab)


# ---- two continuous sides ----


class Cells:
    """The plane cut at medians of a sample's wider side, again and again; the cells' boxes are half open."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.boxes: list[np.ndarray] = []
        whole = np.array([[-np.inf, -np.inf], [np.inf, np.inf]])
        self.tree = self._cut(sample, parts, whole)

    def _cut(self, points: np.ndarray, parts: int, box: np.ndarray):
        for side in np.argsort(-np.ptp(points, axis=0)) if parts > 1 and len(points) > 1 else ():
            cut = np.sort(points[:, side])[len(points) // 2]
            left = points[:, side] < cut
            if not left.any():  # the median is the least value
                over = points[:, side] > cut
                if not over.any():
                    continue
                cut = points[over, side].min()
                left = points[:, side] < cut
            low, high = box.copy(), box.copy()
            low[1, side] = high[0, side] = cut
            few = max(1, min(parts - 1, round(parts * left.mean())))
            return int(side), float(cut), self._cut(points[left], few, low), self._cut(points[~left], parts - few, high)
        self.boxes.append(box)
        return len(self.boxes) - 1

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int32)
        todo = [(self.tree, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                left = points[rows, node[0]] < node[1]
                todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


def pair_information(df: DataFrame, x: str, y: str, k: int = 3, cell_pairs: int = CELL_PAIRS, sent: int = SENT_VALUES, slab: int = SLAB_VALUES) -> float:
    """Of two numbers, in nats; distances are the larger of the two coordinates', each scaled by its deviation.

    Distinct pairs are dealt to cells. Neighbours within a cell bound those of its pairs; a second pass lends each cell
    the pairs of others that lie within these bounds, so that its neighbours are exact."""
    scale = one_row(df, {"x": F.stddev_pop(quoted(x)), "y": F.stddev_pop(quoted(y))})
    scaled = [(quoted(c) / F.lit(scale[n] or 1.0)).alias(n) for c, n in ((x, "x"), (y, "y"))]
    pairs = df.select(*scaled).groupBy("x", "y").agg(F.count("*").alias("n")).persist()
    tied = F.col("n") > k
    seen = one_row(pairs, {"rows": F.coalesce(F.sum("n"), F.lit(0)), "pairs": F.count("*"), "hard": F.coalesce(F.sum(F.when(~tied, F.col("n"))), F.lit(0))})
    if seen["rows"] <= k + 1:
        pairs.unpersist()
        return 0.0
    total = _psi_sum(pairs.where(tied), "n", "n") + seen["hard"] * digamma(float(k))
    sides = [pairs.groupBy(F.col(c).alias("a")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(tied, F.col("n"))), F.lit(0)).alias("w")).persist() for c in ("x", "y")]
    total -= sum(_psi_sum(side, "n", "w") for side in sides)
    if seen["hard"]:
        total -= _hard_pairs(pairs, seen["pairs"], sides, k, cell_pairs, sent, slab)
    for table in (pairs, *sides):
        table.unpersist()
    return max(0.0, digamma(float(seen["rows"])) + total / seen["rows"])


def _hard_pairs(pairs: DataFrame, many: int, sides: list[DataFrame], k: int, cell_pairs: int, sent: int, slab: int) -> float:
    """The sum over rows of the pairs of k rows or fewer of mean psi along both sides."""
    parts = min(WINDOWS, -(-many // cell_pairs))
    picked = pairs.where(F.pmod(F.xxhash64("x", "y"), F.lit(max(1, many // (100 * parts)))) == 0).select("x", "y") if parts > 1 else None
    cells = Cells(np.stack(_arrays(picked.orderBy("x", "y").toArrow(), "x", "y"), 1) if picked is not None else np.zeros((0, 2)), parts)
    boxes = np.stack(cells.boxes)
    sizes = [side.count() for side in sides]
    ranks = [pairs.sparkSession.sparkContext.broadcast(ranks_of(side)) if n <= sent else None for side, n in zip(sides, sizes, strict=True)]

    def points(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.stack(_arrays(table, "x", "y"), 1), *_arrays(table, "n")

    def dealt(lent: dict[int, list]) -> Callable:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p, n = points(b)
                cell = cells.of(p)
                to, rows = [cell], [np.arange(len(p))]
                for t in np.unique(cell) if lent else ():
                    inside = np.flatnonzero(cell == t)
                    for other, low, high in lent.get(int(t), ()):
                        met = inside[((p[inside] >= low) & (p[inside] <= high)).all(1)]
                        to.append(np.full(len(met), other, np.int32))
                        rows.append(met)
                rows, to = np.concatenate(rows), np.concatenate(to)
                yield pa.RecordBatch.from_pydict({"cell": to.astype(np.int32), "own": np.arange(len(rows)) < len(p), "x": p[rows, 0], "y": p[rows, 1], "n": n[rows]})

        return deal

    def nearest(table: pa.Table, own: np.ndarray) -> tuple:
        """The own pairs of few rows, and their shells among all; no more than k + 1 rows of a pair count."""
        p, n = points(table)
        hard = np.flatnonzero(own & (n <= k))
        copies = np.minimum(n, k + 1)
        first = np.cumsum(copies) - copies
        return p[hard], n[hard], shells(np.repeat(p, copies, 0), k, first[hard])

    def bounded(key: tuple, table: pa.Table) -> pa.Table:
        p, _, (r, *_rest) = nearest(table, np.ones(table.num_rows, bool))
        own, r = key[0].as_py(), r * (1 + 1e-12)
        low, high = p - r[:, None], p + r[:, None]
        out = []
        apart = np.flatnonzero(((low < boxes[own, 0]) | (high >= boxes[own, 1])).any(1))
        for t in range(len(boxes)) if len(apart) else ():
            met = apart[((low[apart] < boxes[t, 1]) & (high[apart] >= boxes[t, 0])).all(1)] if t != own else ()
            if len(met):
                a, b = np.maximum(low[met].min(0), boxes[t, 0]), np.minimum(high[met].max(0), boxes[t, 1])
                out.append((t, own, *a, *b))
        cols = np.array(out, float).reshape(-1, 6)
        return pa.table({n: cols[:, i] for i, n in enumerate(("lender", "borrower", "x0", "y0", "x1", "y1"))})

    def final(table: pa.Table) -> pa.Table:
        p, n, (r, at, some, low, high) = nearest(table, _arrays(table, "own")[0].astype(bool))
        known, out = 0.0, []
        for i, rank in enumerate(ranks):
            given = [low[:, i], high[:, i], n, some[:, i], at]
            if rank is not None:
                known += rank.value.sum(*given)
            else:
                out.append([np.full(len(n), i, np.int32), *given])
        out.append([np.array([2], np.int32), np.array([known]), *[np.zeros(1, np.int64)] * 4])
        kinds = {"side": pa.int32(), "lo": pa.float64(), "hi": pa.float64(), "w": pa.int64(), "s": pa.int64(), "j": pa.int32()}
        return pa.table({name: pa.array(np.concatenate([o[c] for o in out]), kind, safe=False) for c, (name, kind) in enumerate(kinds.items())})

    kind = "cell int, own boolean, x double, y double, n long"
    lent: dict[int, list] = {}
    if len(boxes) > 1:
        found = pairs.mapInArrow(dealt({}), kind).groupBy("cell").applyInArrow(bounded, "lender double, borrower double, x0 double, y0 double, x1 double, y1 double")
        for t, own, x0, y0, x1, y1 in found.collect():
            lent.setdefault(int(t), []).append((int(own), np.array([x0, y0]), np.array([x1, y1])))
    queries = pairs.mapInArrow(dealt(lent), kind).groupBy("cell").applyInArrow(final, f"side int, {QUERIES}").persist()
    total = queries.where("side = 2").agg(F.coalesce(F.sum("lo"), F.lit(0.0))).first()[0]
    for i, (side, n) in enumerate(zip(sides, sizes, strict=True)):
        if ranks[i] is None:
            total += psi_between(side.select("a", "n"), n, queries.where(F.col("side") == i).drop("side"), sent, slab)
    queries.unpersist()
    return total
