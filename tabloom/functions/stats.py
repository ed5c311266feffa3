"""Moments, quantiles, contingency and rank statistics as Spark aggregates."""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import number, one_row, quoted, value

#: Non-null values up to which an exact percentile aggregate holds a column at once, and values that the aggregates of
#: one job hold together; more are bracketed by sketches of this accuracy first.
EXACT_VALUES, HELD_VALUES, ACCURACY = 50_000, 2_000_000, 10_000


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def sample_skewness(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6))


def distinct_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, n_unique): exact numbers of distinct values, nulls apart. Each column is grouped by itself, so that a
    scan reads it once and only its own values are shuffled, after partial grouping; no row is expanded."""
    parts = [
        df.select(value(df, n).alias("v")).where("v is not null").distinct().agg(F.count("*").alias("n_unique")).select(F.lit(n).alias("feature"), "n_unique") for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


def n_distinct(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    return {r["feature"]: r["n_unique"] for r in distinct_counts(df, names).collect()} if names else {}


def quantiles(df: DataFrame, names: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of each column."""
    return quantiles_of(df, {n: number(df, n) for n in names}, probabilities)


@dataclass
class _Rank:
    """A place in a column's order, from 0, that lies among the `inside` values strictly between low and high; `below`
    values are smaller."""

    label: Hashable
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None

    def between(self, c: Column) -> Column:
        c_low = F.lit(True) if self.low is None else c > F.lit(self.low)
        return c.isNotNull() & c_low & (F.lit(True) if self.high is None else c < F.lit(self.high))

    def share(self) -> float:
        return (self.rank - self.below) / max(self.inside - 1, 1)


def quantiles_of(
    df: DataFrame, columns: dict[Hashable, Column], probabilities: Sequence[float], exact: int = EXACT_VALUES, held: int = HELD_VALUES, accuracy: int = ACCURACY
) -> dict[Hashable, list[float | None]]:
    """Exact quantiles with linear interpolation of each expression; null where it has no value.

    A percentile aggregate keeps every distinct value in one task, so it only sees a bounded number: sketches of all
    columns bracket each place, the values up to and inside the bracket are counted, and brackets narrow again until the
    values inside are few. That takes three jobs for all columns together, two more for each factor of some thousands."""
    doubles = {label: c.cast("double") for label, c in columns.items()}
    counts = one_row(df, {label: F.count(c) for label, c in doubles.items()})
    places = {(label, k) for label, n in counts.items() for p in probabilities if n for k in (floor(p * (n - 1)), ceil(p * (n - 1)))}
    todo = [_Rank(label, k, counts[label]) for label, k in sorted(places, key=str)]
    found: dict[tuple, float] = {}
    most = exact
    while todo:
        found |= _exact(df, doubles, [r for r in todo if r.inside <= most], held)
        todo = [r for r in todo if r.inside > most]
        if todo:
            found |= _narrow(df, doubles, todo, accuracy)
            todo = [r for r in todo if (r.label, r.rank) not in found]
        most = max(exact, held // 2)

    def at(label: Hashable, p: float) -> float | None:
        if not counts[label]:
            return None
        position = p * (counts[label] - 1)
        a, b = found[label, floor(position)], found[label, ceil(position)]
        return a if a == b else a + (b - a) * (position - floor(position))

    return {label: [at(label, p) for p in probabilities] for label in doubles}


def _exact(df: DataFrame, columns: dict, ranks: list[_Rank], held: int) -> dict[tuple, float]:
    """The values at places among few, some brackets at a time."""
    groups: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        groups.setdefault((r.label, r.low, r.high), []).append(r)
    out: dict[tuple, float] = {}
    job: dict[tuple, Column] = {}
    size = 0
    for i, (key, some) in enumerate(groups.items()):
        c = columns[key[0]]
        job[key] = F.percentile(F.when(some[0].between(c), c), F.array(*[F.lit(r.share()) for r in some]))
        size += some[0].inside
        if size >= held or i + 1 == len(groups):
            for k, values in one_row(df, job).items():
                out |= {(r.label, r.rank): v for r, v in zip(groups[k], values, strict=True)}
            job, size = {}, 0
    return out


def _narrow(df: DataFrame, columns: dict, ranks: list[_Rank], accuracy: int) -> dict[tuple, float]:
    """Narrower brackets, from a job of sketches and one of counts; the values of the places at a bracket's ends."""
    groups: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        groups.setdefault((r.label, r.low, r.high), []).append(r)
    slack = 2 / accuracy
    asked = {}
    for key, some in groups.items():
        c, ends = columns[key[0]], [x for r in some for x in (max(0.0, r.share() - slack), min(1.0, r.share() + slack))]
        asked[key] = F.percentile_approx(F.when(some[0].between(c), c), F.array(*[F.lit(x) for x in ends]), F.lit(accuracy))
    ends = {id(r): tuple(values[2 * i : 2 * i + 2]) for key, values in one_row(df, asked).items() for i, r in enumerate(groups[key])}
    number_of = {}
    for r in ranks:
        c, (low, high) = columns[r.label], ends[id(r)]
        number_of[r.label, "<", low] = F.count_if(c < F.lit(low))
        number_of[r.label, "=", low] = F.count_if(c == F.lit(low))
        number_of[r.label, "=", high] = F.count_if(c == F.lit(high))
        number_of[r.label, low, high] = F.count_if((c > F.lit(low)) & (c < F.lit(high)))
    n = one_row(df, number_of)
    found = {}
    for r in ranks:
        low, high = ends[id(r)]
        start = n[r.label, "<", low]
        inner = start + n[r.label, "=", low]
        outer = inner + n[r.label, low, high]
        stop = outer + n[r.label, "=", high] if high > low else inner
        if start <= r.rank < inner:
            found[r.label, r.rank] = low
        elif inner <= r.rank < outer:
            r.low, r.high, r.below, r.inside = low, high, inner, outer - inner
        elif outer <= r.rank < stop:
            found[r.label, r.rank] = high
        elif r.rank < start:  # the sketch was off: what lies before the bracket is left, or what lies after it
            r.high, r.inside = low, start - r.below
        else:
            r.low, r.inside, r.below = high, r.below + r.inside - stop, stop
    return found


def contingency(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(a, b, n) of the rows where both are there."""
    return df.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


def with_margins(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A contingency table (keys..., a, b, n) with row, column and total sums."""
    over = lambda *c: Window.partitionBy(*keys, *c)
    return table.withColumns({"ra": F.sum("n").over(over("a")), "cb": F.sum("n").over(over("b")), "t": F.sum("n").over(over())})


def association(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: total, categories of a and b, chi2 (Yates' correction in 2 x 2), Cramer's V, Theil's U of b given a."""
    t = with_margins(table, keys)
    n, ra, cb, total = (F.col(c).cast("double") for c in ("n", "ra", "cb", "t"))
    expected = ra * cb / total
    sums = t.groupBy(*keys).agg(
        F.max("t").alias("t"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"),
        (F.sum(n * n / (ra * cb))).alias("share"),
        F.sum(F.pow(F.greatest(F.abs(n - expected) - 0.5, F.lit(0.0)), 2) / expected).alias("yates_seen"),
        F.sum(-n / total * F.ln(n / ra)).alias("conditional"),
        F.min(F.abs(n - expected)).alias("least"), F.max("ra").alias("ra"), F.max("cb").alias("cb"), F.count("*").alias("cells"),
    )
    entropy = t.select(*keys, "b", "cb", "t").distinct().groupBy(*keys).agg(F.sum(-F.col("cb") / F.col("t") * F.ln(F.col("cb") / F.col("t"))).alias("entropy"))
    both = sums.join(entropy, list(keys)) if keys else sums.crossJoin(F.broadcast(entropy))
    chi2 = F.col("t") * (F.col("share") - 1)
    # in a 2 x 2 table all four cells differ from their expectation by the same amount, empty cells too
    r, c, s = F.col("ra").cast("double"), F.col("cb").cast("double"), F.col("t").cast("double")
    weight = s * s * s / F.nullif(r * (s - r) * c * (s - c), F.lit(0.0))
    diff = F.col("least") - F.least(F.lit(0.5), F.col("least"))
    yates = diff * diff * weight / s * s / s
    two = (F.col("ka") == 2) & (F.col("kb") == 2)
    k = F.least("ka", "kb") - 1
    return both.select(
        *keys, F.col("t").alias("total"), "ka", "kb", F.when(two, yates).otherwise(chi2).alias("chi2"),
        F.sqrt(div(F.greatest(F.when(two, yates).otherwise(chi2), F.lit(0.0)), s * k)).alias("v"),
        F.when(F.col("entropy") > 0, (F.col("entropy") - F.col("conditional")) / F.col("entropy")).otherwise(1.0).alias("u"),
        chi2.alias("plain_chi2"),
    )


#: Rows of a key that one window orders; a key of more is cut into ranges of about as many, WINDOWS at most.
WINDOW_ROWS, WINDOWS = 4_000_000, 1000


def running(table: DataFrame, keys: Sequence[str], by: str, sums: Sequence[str], rows: int, window_rows: int | None = None) -> DataFrame:
    """table (one row for each key and value of the number `by`) with before_<s> for each s of sums: the sum of s over
    the smaller values of the key. `rows` bounds the rows of a key.

    A key of many values isn't ordered in one task: approximate quantiles cut it into ranges, each range has a window of
    its own, and the sums of the ranges before it, one row for each, are added."""
    parts = min(WINDOWS, -(-rows // (window_rows or WINDOW_ROWS)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    if parts <= 1:
        over = before(Window.partitionBy(*keys).orderBy(by))
        return table.withColumns({f"before_{s}": zero(F.sum(s).over(over)) for s in sums})
    cuts = F.percentile_approx(by, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts)).alias("_cuts")
    cuts = table.groupBy(*keys).agg(cuts)
    met = table.join(F.broadcast(cuts), list(keys)) if keys else table.crossJoin(F.broadcast(cuts))  # one row
    met = met.withColumn("_range", F.size(F.filter("_cuts", lambda x: x < quoted(by)))).drop("_cuts")
    inside = before(Window.partitionBy(*keys, "_range").orderBy(by))
    whole = met.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    earlier = before(Window.partitionBy(*keys).orderBy("_range"))
    whole = whole.select(*keys, "_range", *[zero(F.sum(f"_s_{s}").over(earlier)).alias(f"_b_{s}") for s in sums])
    out = met.withColumns({f"before_{s}": zero(F.sum(s).over(inside)) for s in sums}).join(F.broadcast(whole), [*keys, "_range"])
    return out.select(*[quoted(c) for c in table.columns], *[(F.col(f"before_{s}") + F.col(f"_b_{s}")).alias(f"before_{s}") for s in sums])


def average_ranks(counts: DataFrame, keys: Sequence[str], rows: int, by: str = "value", n: str = "n") -> DataFrame:
    """Counts by value with the average rank of each value; windows run over ranges of values, not over rows."""
    return running(counts, keys, by, [n], rows).withColumn("rank", F.col(f"before_{n}") + (F.col(n) + 1) / 2).drop(f"before_{n}")


def before_all(table: DataFrame, by: Sequence[str], rows: int, n: str | None = None, window_rows: int | None = None) -> DataFrame:
    """table, of about `rows` rows that differ in `by`, with before: the sum of n (or the number) of the rows that come
    first in order of `by`, nulls first. `by` may be of any types that have an order.

    Many rows aren't ordered in one task: some of their own places, picked by a hash, cut them into ranges, which each
    have a window of their own; the sums of the ranges before, one row for each, are added."""
    size = quoted(n) if n else F.lit(1)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    parts = min(WINDOWS, -(-rows // (window_rows or WINDOW_ROWS)))
    if parts <= 1:
        return table.withColumn("before", total(size, before(Window.orderBy(*by))))
    place = F.struct(*[quoted(c) for c in by])
    picked = table.where(F.pmod(F.xxhash64(*[quoted(c) for c in by]), F.lit(max(1, rows // (20 * parts)))) == 0)
    picked = picked.agg(F.sort_array(F.collect_list(place)).alias("_p"))  # some 20 for each range
    steps = F.sequence(F.lit(1), F.lit(parts - 1))
    cuts = picked.select(F.when(F.size("_p") > 0, F.transform(steps, lambda i: F.element_at("_p", F.ceil(i * F.size("_p") / parts).cast("int")))).alias("_cuts"))
    met = table.crossJoin(F.broadcast(cuts))  # one row
    met = met.withColumn("_range", F.size(F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda x: x < place))).drop("_cuts")
    met = met.withColumn("_inside", total(size, before(Window.partitionBy("_range").orderBy(*by))))
    whole = met.groupBy("_range").agg(F.sum(size).alias("_s"))
    whole = whole.select("_range", total("_s", before(Window.orderBy("_range"))).alias("_b"))  # a row for each range
    out = met.join(F.broadcast(whole), "_range")
    return out.select(*[quoted(c) for c in table.columns], (F.col("_inside") + F.col("_b")).alias("before"))


def medians(rows: DataFrame, keys: Sequence[str], of: str, held: int = HELD_VALUES, window_rows: int | None = None) -> DataFrame:
    """(keys..., median, n): exact medians of the non-null number `of` by key. Where keys have few values in all, one
    aggregate holds them; otherwise the counts by key and value are ordered as one, in ranges, so that no key's values
    are held together."""
    counts = rows.groupBy(*keys, of).agg(F.count("*").alias("n"))
    pairs = counts.count()
    if pairs <= held:
        return counts.groupBy(*keys).agg(F.percentile(of, F.lit(0.5), F.col("n")).alias("median"), F.sum("n").alias("n"))
    placed = before_all(counts, [*keys, of], pairs, "n", window_rows)
    ends = placed.groupBy(*keys).agg(F.min("before").alias("_start"), F.sum("n").alias("_total"))
    met = placed.join(ends, list(keys))
    at = F.col("before") - F.col("_start")
    holds = lambda k: (at <= k) & (k < at + F.col("n"))
    low, high = (F.floor((F.col("_total") - 1 + up) / 2) for up in (0, 1))
    found = met.where(holds(low) | holds(high)).groupBy(*keys)
    values = [F.max(F.when(holds(k), quoted(of))) for k in (low, high)]
    return found.agg(((values[0] + values[1]) / 2).alias("median"), F.max("_total").alias("n"))
