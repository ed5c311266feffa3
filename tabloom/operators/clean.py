"""Finding and removing columns that carry nothing new."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import one_row, quoted, require, unpivot, value
from ..functions.stats import n_distinct


def drop_highly_skewed_categorical_features(df: DataFrame, features: Sequence[str], threshold: float = 0.99) -> tuple[DataFrame, list[str]]:
    """df without the columns in which one value, null being one, has a share over the threshold."""
    require(df, features)
    top = top_shares(df, features).where(F.col("share") > threshold)
    gone = sorted(r["feature"] for r in top.collect())
    return df.drop(*gone), gone


def top_shares(df: DataFrame, features: Sequence[str]) -> DataFrame:
    counts = unpivot(df, features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("share"))


def categorize_categorical_features_by_missing(df: DataFrame, features: Sequence[str]) -> dict[str, list[str]]:
    """Columns with up to a tenth missing, with more, with any, and with none; the first three by their share."""
    require(df, features)
    share = one_row(df, {f: F.coalesce(F.avg(value(df, f).isNull().cast("double")), F.lit(0.0)) for f in features})
    by = sorted(features, key=lambda f: share[f])
    return {
        "low_missing": [f for f in by if 0 < share[f] <= 0.1], "high_missing": [f for f in by if share[f] > 0.1],
        "any_missing": [f for f in by if share[f] > 0], "no_missing": [f for f in features if share[f] == 0],
    }


def _equal_pairs(df: DataFrame, groups: list[list[str]]) -> set[tuple[str, str]]:
    pairs = [p for g in groups for p in combinations(g, 2)]
    same = one_row(df, {p: F.coalesce(F.bool_and(value(df, p[0]).eqNullSafe(value(df, p[1]))), F.lit(True)) for p in pairs})
    return {p for p, s in same.items() if s}


def duplicate_columns(df: DataFrame, id_col: str | None = None) -> list[str]:
    """Every column that equals an earlier one. One pass gives each column a fingerprint; only equal ones are compared."""
    names = [c for c in df.columns if c != id_col]
    where = quoted(id_col) if id_col else F.struct(*[F.xxhash64(value(df, c)) for c in names])
    mark = {c: F.sum(F.xxhash64(where, value(df, c)).cast("decimal(38,0)")) for c in names}
    marks, groups = one_row(df, mark, 100), defaultdict(list)
    for c in names:
        groups[df.schema[c].dataType.simpleString(), marks[c]].append(c)
    same, gone = _equal_pairs(df, [g for g in groups.values() if len(g) > 1]), []
    for a, b in sorted(same, key=lambda p: (names.index(p[0]), names.index(p[1]))):
        if a not in gone and b not in gone:
            gone.append(b)
    return gone


def _distinct_and_null(df: DataFrame) -> dict[tuple[str, str], int]:
    nulls = one_row(df, {("null", c): F.count_if(value(df, c).isNull()) for c in df.columns} | {("rows", ""): F.count("*")})
    return nulls | {("n", c): n for c, n in n_distinct(df, df.columns).items()}


def remove_bijective_features(df: DataFrame, max_unique: int = 1000) -> tuple[DataFrame, list[str]]:
    """df without the columns that map one to one to an earlier one. Candidates have 2 to `max_unique` values, fewer
    than there are rows, and no null; only columns of as many values are paired, all pairs in one job."""
    stats = _distinct_and_null(df)
    groups = defaultdict(list)
    for c in df.columns:
        n = stats["n", c]
        if not stats["null", c] and 1 < n <= max_unique and n < stats["rows", ""]:
            groups[n].append(c)
    pairs = [p for g in groups.values() for p in combinations(g, 2)]
    both = n_distinct(df.select(*[F.struct(quoted(a), quoted(b)).alias(str(i)) for i, (a, b) in enumerate(pairs)]), [str(i) for i in range(len(pairs))])
    gone: list[str] = []
    for i, (a, b) in enumerate(pairs):
        if both[str(i)] == stats["n", a] and a not in gone and b not in gone:
            gone.append(b)
    return df.drop(*gone), gone


def initial_features_removal(df: DataFrame, id_col: str | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """df without constant columns (null is a value), empty ones, duplicates and one-to-one copies, in this order."""
    stats = _distinct_and_null(df)
    total = stats["rows", ""]
    empty = [c for c in df.columns if total and stats["null", c] == total]
    constant = [c for c in df.columns if stats["n", c] + (stats["null", c] > 0) == 1 and c not in empty]
    df = df.drop(*constant, *empty)
    twice = duplicate_columns(df, id_col)
    df, copies = remove_bijective_features(df.drop(*twice))
    return df, {"constant": constant, "empty": empty, "duplicate": twice, "bijective": copies}


def encode_target_feature(df: DataFrame, target: str) -> tuple[DataFrame, dict[int, str]]:
    """df with the target as codes 0, 1, ... of its sorted text values, and the value of each code."""
    require(df, [target])
    text = F.coalesce(value(df, target).cast("string"), F.lit("null"))
    labels = sorted(r[0] for r in df.select(text.alias("v")).distinct().collect())
    codes = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))]) if labels else None
    return df.withColumn(target, F.element_at(codes, text) if labels else F.lit(None).cast("int")), dict(enumerate(labels))
