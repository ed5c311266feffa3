"""Dataset profiling: base information, feature statistics, and statistics against a target."""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import is_numeric, number, numeric_columns, one_row, quoted, require, string_columns, unpivot, value
from ..functions.special import chi2_tail
from ..functions.stats import association, average_ranks, distinct_counts, div, n_distinct, quantiles, quantiles_of, running, sample_kurtosis, sample_skewness

#: Calendar parts by frequency name.
PARTS = {"YE": F.year, "ME": F.month, "W": F.weekofyear, "D": F.dayofmonth, "H": F.hour}


def base_information(df: DataFrame) -> DataFrame:
    """Per column its type, missing values, distinct values and count: one pass, and each column's own grouping."""
    total = F.count("*")
    rows = []
    for i, f in enumerate(df.schema):
        c = value(df, f.name)
        rows.append(
            F.struct(
                F.lit(i).alias("at"), F.lit(f.name).alias("feature"), F.lit(f.dataType.simpleString()).alias("dtype"), (total - F.count(c)).alias("n_missing"),
                F.coalesce(div((total - F.count(c)) * 100, total), F.lit(0.0)).alias("pct_missing"), F.count(c).alias("n"),
            )
        )
    base = df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    found = base.join(F.broadcast(distinct_counts(df, df.columns)), "feature")  # a row for each column
    return found.orderBy("at").select("feature", "dtype", "n_missing", "pct_missing", "n_unique", "n")


def get_categorical_features(df: DataFrame, unique_threshold: int = 100, any_binary: bool = True) -> list[str]:
    """String columns of fewer than `unique_threshold` values, and columns of exactly two; sorted."""
    strings = set(string_columns(df))
    found = n_distinct(df, df.columns if any_binary else sorted(strings))
    return sorted(c for c, n in found.items() if (c in strings and n < unique_threshold) or (any_binary and n == 2))


def extract_unique_items(c: Column) -> Column:
    """The distinct trimmed items, in lower case, of a list in a string; anything else gives an empty list."""

    @F.pandas_udf("array<string>")
    def items(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            try:
                found = ast.literal_eval(text)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return []
            return sorted({str(x).strip().lower() for x in found}) if isinstance(found, list) else []

        return texts.map(one)

    return items(c)


#: Quantiles of a summary.
CUTS = {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}


def _summary(c: Column) -> dict[str, Column]:
    total = F.count("*")
    return {
        "count": F.count(c), "mean": F.avg(c), "std": F.stddev(c), "min": F.min(c), "max": F.max(c), "variance": F.variance(c),
        "skewness": sample_skewness(c), "kurtosis": sample_kurtosis(c),
        "missing": total - F.count(c), "missing_pct": F.coalesce(div((total - F.count(c)) * 100, total), F.lit(0.0)),
    }


def describe_numerical_feature(df: DataFrame, feature: str) -> DataFrame:
    require(df, [feature])
    cuts = quantiles(df, [feature], list(CUTS.values()))[feature]
    found = df.agg(*[c.alias(n) for n, c in _summary(number(df, feature)).items()])
    order = ["count", "mean", "std", "min", *CUTS, "max", "variance", "skewness", "kurtosis", "missing", "missing_pct"]
    return found.withColumns({n: F.lit(q).cast("double") for n, q in zip(CUTS, cuts, strict=True)}).select(*order)


def _top(counts: DataFrame, top_n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Value counts with the place of each value; those past top_n share the label Other (k)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.col("category").asc_nulls_last())
    ranked = counts.withColumn("at", F.row_number().over(order))
    k = F.sum((F.col("at") > top_n).cast("int")).over(Window.partitionBy(*keys))
    tail = F.col("at") > top_n
    return ranked.withColumns({"label": F.when(tail, F.concat(F.lit("Other ("), k.cast("string"), F.lit(")"))).otherwise(F.coalesce("category", F.lit("Missing"))), "place": F.least("at", F.lit(top_n + 1))})


def describe_categorical_feature(df: DataFrame, feature: str, top_n: int = 10, show_null: bool = True) -> DataFrame:
    """category, n and pct (of all rows, two decimals) of the top_n values; the others together come last."""
    require(df, [feature])
    c = value(df, feature).cast("string").alias("category")
    counts = df.groupBy(c).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    counts = counts.withColumn("total", F.sum("n").over(total))  # a window over values, not rows
    counts = counts if show_null else counts.where("category is not null")
    return (
        _top(counts, top_n).groupBy("place", "label").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
        .select("place", F.col("label").alias("category"), "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("pct")).orderBy("place").drop("place")
    )


def describe_time_series_feature(df: DataFrame, feature: str, agg_freq: str = "ME") -> DataFrame:
    """Rows by calendar part (YE year, ME month, W ISO week, D day of the month, H hour), then Unknown for nulls."""
    require(df, [feature])
    if agg_freq not in PARTS:
        raise ValueError(f"agg_freq must be one of {', '.join(PARTS)}")
    part = PARTS[agg_freq](quoted(feature))
    found = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    return found.orderBy(F.col("part").asc_nulls_last()).select(F.coalesce(F.col("part").cast("string"), F.lit("Unknown")).alias("period"), "n")


def numerical_feature_statistics(
    df: DataFrame, features: Sequence[str] | None = None, skew_threshold: float = 1, kurtosis_threshold: float = 3, zero_pct_threshold: float = 5
) -> DataFrame:
    """Per column its moments, the rows outside 1.5 interquartile ranges, and flags. Two passes for all columns."""
    features = list(features or numeric_columns(df))
    require(df, features)
    cuts = quantiles(df, features, [0.25, 0.5, 0.75])
    rows = []
    for f in features:
        c, (q1, median, q3) = number(df, f), cuts[f]
        low, high = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if q1 is not None else (None, None)
        total, skew, kurt = F.count("*"), sample_skewness(c), sample_kurtosis(c)
        out = F.count_if((c < F.lit(low)) | (c > F.lit(high))) if low is not None else F.lit(0).cast("long")
        zero = div(F.count_if(c == 0) * 100, total)
        flags = F.array_join(
            F.array_compact(
                F.array(
                    F.when(skew > skew_threshold, "HIGH RIGHT SKEW"), F.when(skew < -skew_threshold, "HIGH LEFT SKEW"),
                    F.when(zero > zero_pct_threshold, "ZERO-INFLATED"), F.when(kurt > kurtosis_threshold, "HEAVY TAILS"),
                )
            ), "; ",
        )
        rows.append(
            F.struct(
                F.lit(f).alias("feature"), F.min(c).alias("min"), F.avg(c).alias("mean"), F.lit(median).cast("double").alias("median"), F.max(c).alias("max"),
                F.stddev(c).alias("std"), skew.alias("skewness"), kurt.alias("kurtosis"), out.alias("n_outliers"), div(out * 100, total).alias("pct_outliers"), flags.alias("flags"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def bin_regression_target(df: DataFrame, target: str, n_quantiles: int = 4, id_col: str | None = None) -> DataFrame:
    """df with target_band: equal bands by rank, labelled Qi [min, max]. Ties go by id_col.

    Ranks come from counts by value and a place among equal values, so that no window holds all rows."""
    require(df, [target])
    c = number(df, target)
    counts = df.where(c.isNotNull()).groupBy(c.alias("_v")).agg(F.count("*").alias("_c"))
    total = df.agg(F.count(c)).first()[0]
    places = running(counts, [], "_v", ["_c"], total).select("_v", F.col("before__c").alias("_before"), F.lit(total).alias("_n"))
    tie = quoted(id_col) if id_col else F.monotonically_increasing_id()
    ranked = df.withColumn("_v", c).join(places, "_v", "left")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_v").orderBy(tie)) - 1
    band = F.when(F.col("_n") <= 1, 0).otherwise(F.greatest(F.ceil(rank * n_quantiles / F.nullif(F.col("_n") - 1, F.lit(0))) - 1, F.lit(0)))
    ranked = ranked.withColumn("_band", F.when(F.col("_v").isNotNull(), band).cast("int"))
    ends = ranked.where("_band is not null").groupBy("_band").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    label = F.format_string("Q%d [%.3f, %.3f]", F.col("_band") + 1, F.col("_lo"), F.col("_hi"))
    return ranked.join(F.broadcast(ends), "_band", "left").select(*[quoted(x) for x in df.columns], F.when(F.col("_band").isNotNull(), label).alias("target_band"))


def _by_target(df: DataFrame, target: str, problem_type: str, n_quantiles: int, id_col: str | None = None) -> tuple[DataFrame, str]:
    require(df, [target])
    if problem_type not in ("classification", "regression"):
        raise ValueError("problem_type must be classification or regression")
    if problem_type == "classification":
        return df.withColumn("target_class", quoted(target).cast("string")), "target_class"
    return bin_regression_target(df, target, n_quantiles, id_col), "target_band"


def describe_feature_by_target(df: DataFrame, feature: str, target: str, problem_type: str = "classification", n_quantiles: int = 4, id_col: str | None = None) -> DataFrame:
    """Statistics of a numeric column for each class or band of the target, and Overall for all rows."""
    require(df, [feature])
    grouped, by = _by_target(df, target, problem_type, n_quantiles, id_col)
    keep = ("count", "mean", "std", "min", "q1", "median", "q3", "max", "skewness", "missing_pct")
    x = F.col("_x")
    rows = grouped.select(quoted(by).alias("group"), number(df, feature).alias("_x"))
    aggs = [c.alias(n) for n, c in _summary(x).items() if n in keep]
    found = rows.where("group is not null").groupBy("group").agg(*aggs).unionByName(rows.agg(*aggs).withColumn("group", F.lit("Overall")))
    groups = [r[0] for r in rows.where("group is not null").select("group").distinct().collect()]
    own = {g: F.when(F.col("group") == F.lit(g), x) for g in groups}
    cuts = quantiles_of(rows, own | {"Overall": x}, [0.25, 0.5, 0.75])
    table = df.sparkSession.createDataFrame([(g, *q) for g, q in cuts.items()], "group string, q1 double, median double, q3 double")
    return found.join(F.broadcast(table), "group").select("group", *keep)


def numerical_target_association(
    df: DataFrame, features: Sequence[str], target: str, problem_type: str = "classification", n_quantiles: int = 4, id_col: str | None = None
) -> DataFrame:
    """Per column: eta squared, Kruskal's H, epsilon squared and p-value, median range over interquartile range, and
    the median and interquartile range of each class; by eta squared, falling. All columns share their jobs."""
    require(df, features)
    grouped, by = _by_target(df, target, problem_type, n_quantiles, id_col)
    long = unpivot(grouped, features, "double", [by]).where(f"value is not null and `{by}` is not null").withColumnRenamed(by, "cls")
    counts = long.groupBy("feature", "cls", "value").agg(F.count("*").alias("n")).persist()
    n_rows = counts.groupBy("feature").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    each = counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    ties = each.groupBy("feature").agg(F.sum(F.pow("n", 3) - F.col("n")).alias("ties"))
    ranks = counts.join(average_ranks(each, ["feature"], n_rows).select("feature", "value", "rank"), ["feature", "value"])
    moments = long.groupBy("feature", "cls").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    groups = ranks.groupBy("feature", "cls").agg(F.sum(F.col("n") * F.col("rank")).alias("r")).join(moments, ["feature", "cls"])
    found: dict[str, list] = {}
    for r in groups.collect():
        found.setdefault(r["feature"], []).append(r)
    tied = {r["feature"]: r["ties"] for r in ties.collect()}
    counts.unpersist()
    one = grouped.where(quoted(by).isNotNull()).select(quoted(by).alias("_cls"), *[number(df, f).alias(f) for f in features])
    cuts = quantiles_of(one, {(f, r["cls"]): F.when(F.col("_cls") == F.lit(r["cls"]), quoted(f)) for f in found for r in found[f]}, [0.25, 0.5, 0.75])
    whole = quantiles_of(one, {f: quoted(f) for f in found}, [0.25, 0.75])
    out = []
    for feature, rows in found.items():
        n, k = sum(r["n"] for r in rows), len(rows)
        # sums about the means, so that large values don't cancel
        mean = rows[0]["mean"] + sum(r["n"] * (r["mean"] - rows[0]["mean"]) for r in rows) / n
        between = sum(r["n"] * (r["mean"] - mean) ** 2 for r in rows)
        total = between + sum(r["n"] * r["var"] for r in rows)
        eta = between / total if total > 0 else None
        h = p = eps = None
        if k > 1 and n > 1:
            tie = 1 - tied[feature] / (n**3 - n)
            if tie > 0:
                h = (12 / (n * (n + 1)) * sum(r["r"] ** 2 / r["n"] for r in rows) - 3 * (n + 1)) / tie
                p, eps = chi2_tail(h, k - 1), (h - k + 1) / (n - k) if n > k else None
        classes = sorted((r["cls"], cuts[feature, r["cls"]][1], cuts[feature, r["cls"]][2] - cuts[feature, r["cls"]][0]) for r in rows)
        medians, iqr = [m for _, m, _ in classes], whole[feature][1] - whole[feature][0]
        out.append((feature, eta, eps, h, p, (max(medians) - min(medians)) / iqr if iqr else None, classes))
    out.sort(key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    schema = "feature string, eta_squared double, epsilon_squared double, h double, p_value double, median_range_iqr double, classes array<struct<cls:string,median:double,iqr:double>>"
    return df.sparkSession.createDataFrame(out, schema)


def categorical_feature_statistics(df: DataFrame, features: Sequence[str] | None = None, rare_threshold: float = 5.0) -> DataFrame:
    """Per column: distinct values, mode and its share, share of the three commonest, normalised entropy, rare values,
    missing share. One grouping for all columns."""
    features = list(features or string_columns(df))
    require(df, features)
    counts = unpivot(df, features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    per = Window.partitionBy("feature")
    there = F.col("value").isNotNull()
    order = per.orderBy(there.desc(), F.desc("n"), "value")
    c = counts.withColumns({"total": F.sum("n").over(per), "known": F.sum(F.when(there, F.col("n"))).over(per), "at": F.row_number().over(order)})
    share, p = 100 * F.col("n") / F.col("total"), F.col("n") / F.col("known")
    k = F.count("value")
    return c.groupBy("feature").agg(
        k.alias("n_unique"), F.max(F.when(there & (F.col("at") == 1), F.substring("value", 1, 25))).alias("mode"),
        F.max(F.when(there & (F.col("at") == 1), share)).alias("mode_pct"), F.sum(F.when(there & (F.col("at") <= 3), share)).alias("top3_pct"),
        F.when(k > 1, F.sum(F.when(there, -p * F.ln(p))) / F.nullif(F.ln(k), F.lit(0.0))).otherwise(0.0).alias("entropy"),
        F.count_if(there & (share < rare_threshold)).alias("n_rare"), F.coalesce(F.sum(F.when(~there, share)), F.lit(0.0)).alias("missing_pct"),
    ).orderBy("n_unique", "feature")


def describe_categorical_by_target(
    df: DataFrame, feature: str, target: str, problem_type: str = "classification", n_quantiles: int = 4, top_n: int = 15, id_col: str | None = None
) -> DataFrame:
    """Cross table: category, n, pct, and per class its count and row share; the tail as Other (k), then Total."""
    require(df, [feature])
    grouped, by = _by_target(df, target, problem_type, n_quantiles, id_col)
    cells = grouped.where(quoted(by).isNotNull()).groupBy(value(df, feature).cast("string").alias("category"), quoted(by).alias("cls")).agg(F.count("*").alias("c"))
    cells = cells.where("category is not null").persist()
    classes = sorted(r[0] for r in cells.select("cls").distinct().collect())
    wide = cells.groupBy("category").pivot("cls", classes).agg(F.sum("c")).na.fill(0)
    wide = wide.withColumn("n", sum((quoted(c) for c in classes), F.lit(0)))
    sums = [F.sum(quoted(c)).alias(c) for c in [*classes, "n"]]
    rows = _top(wide, top_n).groupBy("place", "label").agg(*sums).unionByName(wide.agg(*sums).withColumns({"place": F.lit(1 << 30), "label": F.lit("Total")}))
    total = F.max("n").over(Window.partitionBy())
    return rows.select(
        "place", F.col("label").alias("category"), "n", F.round(100 * F.col("n") / total, 2).alias("pct"), *[quoted(c).cast("long").alias(f"{c}_n") for c in classes],
        *[F.round(div(100 * quoted(c), F.col("n")), 2).alias(f"{c}_pct") for c in classes],
    ).orderBy("place").drop("place")


def categorical_target_association(df: DataFrame, features: Sequence[str], target: str, problem_type: str = "classification", n_quantiles: int = 4, id_col: str | None = None) -> DataFrame:
    """Per column of two values or more: distinct values, Cramer's V (not bias-corrected), Theil's U of the target given
    the column, chi2 and p-value; by V, falling."""
    require(df, features)
    grouped, by = _by_target(df, target, problem_type, n_quantiles, id_col)
    table = unpivot(grouped, features, "string", [by]).where(f"value is not null and `{by}` is not null")
    table = table.groupBy("feature", F.col("value").alias("a"), quoted(by).alias("b")).agg(F.count("*").alias("n"))
    found = association(table, ["feature"]).where("ka >= 2")
    freedom = (F.col("ka") - 1) * (F.col("kb") - 1)
    tail = F.udf(lambda x, d: None if x is None else chi2_tail(x, d), "double")  # on one row for each feature
    return found.select("feature", F.col("ka").alias("n_unique"), F.col("v").alias("cramers_v"), F.col("u").alias("theils_u"), "chi2", tail("chi2", freedom.cast("double")).alias("p_value")).orderBy(
        F.desc("cramers_v"), "feature"
    )


def mutual_information_scores(df: DataFrame, features: Sequence[str], target: str, problem_type: str = "classification", n_neighbors: int = 3, seed: int = 17) -> dict[str, float]:
    """Mutual information of each column with the target, in nats, falling. Discrete pairs are exact and native; a
    continuous side uses nearest neighbours among all rows that have every number, found in tasks. No noise is drawn, so
    nothing depends on the seed."""
    from ..functions.information import mixed_informations, pair_information

    require(df, [*features, target])
    discrete = [f for f in features if not is_numeric(df.schema[f].dataType)]
    scores: dict[str, float] = {}
    if discrete and problem_type == "classification":
        table = unpivot(df, discrete, "string", [target]).where("value is not null").groupBy("feature", F.col("value").alias("a"), quoted(target).cast("string").alias("b")).agg(F.count("*").alias("n"))
        per = lambda *c: Window.partitionBy("feature", *c)
        n = F.col("n")
        t = table.where("b is not null").withColumns({"ra": F.sum("n").over(per("a")), "cb": F.sum("n").over(per("b")), "t": F.sum("n").over(per())})
        mi = F.sum(n / F.col("t") * F.ln(n.cast("double") * F.col("t") / (F.col("ra").cast("double") * F.col("cb"))))
        scores |= {r["feature"]: max(0.0, r["mi"]) for r in t.groupBy("feature").agg(mi.alias("mi")).collect()}
    rest = [f for f in features if f not in discrete or problem_type == "regression"]
    if rest:
        cols = [number(df, f).alias(f) if f not in discrete else F.xxhash64(quoted(f)).alias(f) for f in rest]
        y = number(df, target) if problem_type == "regression" else F.xxhash64(quoted(target).cast("string"))
        picked = df.select(*cols, y.alias("_y")).dropna()
        classes = problem_type == "classification"
        if mixed := [f for f in rest if classes or f in discrete]:
            scores |= dict(zip(mixed, mixed_informations(picked, [(f, "_y") if classes else ("_y", f) for f in mixed], n_neighbors), strict=True))
        scores |= {f: pair_information(picked, f, "_y", n_neighbors) for f in rest if f not in mixed}
    return dict(sorted(((f, scores.get(f, 0.0)) for f in features), key=lambda x: (-x[1], x[0])))


def order_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns that a model expects, in its order; names match after trimming and with spaces as underscores.
    Where one can't be matched, df stays as it is."""
    plain = {c.strip().replace(" ", "_"): c for c in df.columns}
    found = [n if n in df.columns else plain.get(n.strip().replace(" ", "_")) for n in names]
    return df if None in found else df.select(*[quoted(c).alias(n) for c, n in zip(found, names, strict=True)])


