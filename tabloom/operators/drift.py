"""Drift between two DataFrames. All columns share their jobs; the driver sees one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import distinct_edges, left_closed
from ..functions.core import is_numeric, number, numeric_columns, one_row, require, unpivot
from ..functions.special import chi2_tail, kolmogorov_tail
from ..functions.stats import quantiles, running

FLOOR = 1e-6
DRIFT = "feature string, ks double, ks_p_value double, wasserstein double, smd double, psi double, mean_change_pct double, std_ratio double, flag string"


def _psi(p: Column, q: Column) -> Column:
    p, q = F.greatest(p, F.lit(FLOOR)), F.greatest(q, F.lit(FLOOR))
    return (q - p) * F.ln(q / p)


def _sides(train: DataFrame, test: DataFrame, names: Sequence[str], kind: str) -> DataFrame:
    """(feature, value, a, b): how often each value is in either frame."""
    long = unpivot(train, names, kind).withColumn("side", F.lit(0)).unionByName(unpivot(test, names, kind).withColumn("side", F.lit(1)))
    return long.where("value is not null").groupBy("feature", "value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))


def numerical_psi(train: DataFrame, test: DataFrame, feature: str, n_bins: int = 10) -> float | None:
    """Population stability over the train quantiles; null with fewer than three distinct quantiles or an empty side."""
    return _psi_of(train, test, [feature], n_bins).get(feature)


def _psi_of(train: DataFrame, test: DataFrame, names: Sequence[str], n_bins: int) -> dict[str, float | None]:
    cuts = {f: distinct_edges(v) for f, v in quantiles(train, names, [i / n_bins for i in range(n_bins + 1)]).items()}
    some = [f for f in names if len(cuts[f]) >= 3]
    if not some:
        return {}

    def shares(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("feature"), left_closed(number(df, f), cuts[f]).alias("bin")) for f in some])
        n = df.select(F.explode(pairs).alias("p")).select("p.*").where("bin is not null").groupBy("feature", "bin").agg(F.count("*").alias("n"))
        return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).drop("n")

    a, b = shares(train).withColumnRenamed("share", "p"), shares(test).withColumnRenamed("share", "q")
    spark = train.sparkSession
    bins = spark.createDataFrame([(f, i) for f in some for i in range(len(cuts[f]) - 1)], "feature string, bin int")
    both = bins.join(a, ["feature", "bin"], "left").join(b, ["feature", "bin"], "left").na.fill(0.0)
    rows = both.groupBy("feature").agg(F.sum(_psi(F.col("p"), F.col("q"))).alias("psi"), F.sum("p").alias("p"), F.sum("q").alias("q")).collect()
    return {r["feature"]: r["psi"] if r["p"] and r["q"] else None for r in rows}


def numerical_drift_analysis(train: DataFrame, test: DataFrame, features: Sequence[str] | None = None, n_bins: int = 10) -> DataFrame:
    """Per shared numeric column: KS statistic and p-value, Wasserstein distance, standardised mean difference, PSI,
    mean change, ratio of deviations, flag; by KS, falling. Columns with fewer than two rows on a side are left out."""
    features = list(features or [c for c in numeric_columns(train) if c in test.columns and is_numeric(test.schema[c].dataType)])
    require(train, features)
    require(test, features)
    moments = [one_row(df, {(k, f): a(number(df, f)) for f in features for k, a in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))}) for df in (train, test)]
    features = [f for f in features if min(m["n", f] for m in moments) >= 2]
    if not features:
        return train.sparkSession.createDataFrame([], DRIFT)
    rows = max(moments[0]["n", f] + moments[1]["n", f] for f in features)
    t = running(_sides(train, test, features, "double"), ["feature"], "value", ["a", "b"], rows)
    size = lambda m: F.element_at(F.create_map(*[x for f in features for x in (F.lit(f), F.lit(m["n", f]))]), F.col("feature"))
    gap = lambda a, b: F.abs(a / size(moments[0]) - b / size(moments[1]))
    # the distance between the distributions at a value, and from there to the next one
    here = gap(F.col("before_a") + F.col("a"), F.col("before_b") + F.col("b"))
    # a sum over the gaps between neighbours: each value closes the gap that the one before it opened
    centre = F.element_at(F.create_map(*[x for f in features for x in (F.lit(f), F.lit(moments[0]["mean", f]))]), F.col("feature"))
    step = (gap(F.col("before_a"), F.col("before_b")) - here) * (F.col("value") - centre)
    found = {r["feature"]: r for r in t.groupBy("feature").agg(F.max(here).alias("ks"), F.sum(step).alias("w")).collect()}
    psi, out = _psi_of(train, test, features, n_bins), []
    for f in features:
        (na, ma, va), (nb, mb, vb) = ((m["n", f], m["mean", f], m["var", f]) for m in moments)
        sa, sb, pooled, ks, p = va**0.5, vb**0.5, ((va + vb) / 2) ** 0.5, found[f]["ks"], psi.get(f)
        out.append((
            f, ks, kolmogorov_tail(ks, na, nb), max(found[f]["w"], 0.0), (mb - ma) / pooled if pooled else 0.0, p,
            100 * (mb - ma) / abs(ma) if ma else None, sb / sa if sa else None, drift_flag(ks, (0.05, 0.10, 0.20), p),
        ))
    out.sort(key=lambda r: (-r[1], r[0]))
    return train.sparkSession.createDataFrame(out, DRIFT)


def drift_flag(distance: float, limits: Sequence[float], psi: float | None) -> str:
    """None, low, moderate or high: the worse of the two measures."""
    level = max(sum(distance >= x for x in limits), sum((psi or 0.0) >= x for x in (0.10, 0.20, 0.25)))
    return ("NONE", "LOW", "MODERATE", "HIGH")[level]


def categorical_drift_analysis(train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per column: Jensen-Shannon distance, PSI, p-value of chi2 over shared categories (null with fewer than two), new
    and missing categories, flag; by distance, falling."""
    require(train, features)
    require(test, features)
    per = Window.partitionBy("feature")
    t = _sides(train, test, features, "string").withColumns({"na": F.sum("a").over(per), "nb": F.sum("b").over(per)})
    p, q = F.col("a") / F.nullif(F.col("na"), F.lit(0)), F.col("b") / F.nullif(F.col("nb"), F.lit(0))
    both = (F.col("a") > 0) & (F.col("b") > 0)
    t = t.withColumns({"p": F.coalesce(p, F.lit(0.0)), "q": F.coalesce(q, F.lit(0.0)), "sa": F.sum(F.when(both, F.col("a"))).over(per), "sb": F.sum(F.when(both, F.col("b"))).over(per)})
    half = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / half)).otherwise(0.0)
    n = (F.col("a") + F.col("b")).cast("double")
    total = (F.col("sa") + F.col("sb")).cast("double")
    cell = lambda c, s: F.pow(F.col(c) - n * F.col(s) / total, 2) / (n * F.col(s) / total)
    rows = t.groupBy("feature").agg(
        F.sqrt(F.greatest(F.sum((part("p") + part("q")) / 2), F.lit(0.0))).alias("js"), F.sum(_psi(F.col("p"), F.col("q"))).alias("psi"),
        F.sum(F.when(both, cell("a", "sa") + cell("b", "sb"))).alias("chi2"), F.count_if(both).alias("shared"),
        F.count_if(F.col("a") == 0).alias("new"), F.count_if(F.col("b") == 0).alias("missing"),
    ).collect()
    out = [
        (r["feature"], r["js"], r["psi"], chi2_tail(r["chi2"], r["shared"] - 1) if r["shared"] >= 2 else None, r["new"], r["missing"], drift_flag(r["js"], (0.05, 0.10, 0.20), r["psi"]))
        for r in rows
    ]
    out.sort(key=lambda r: (-r[1], r[0]))
    return train.sparkSession.createDataFrame(out, "feature string, js_distance double, psi double, chi2_p_value double, new_categories long, missing_categories long, flag string")


def ks_test(df: DataFrame, original: str, imputed: str) -> tuple[float, float]:
    """Kolmogorov-Smirnov between the non-null values of two columns: statistic and p-value."""
    a = df.select(number(df, original).alias("x"))
    b = df.select(number(df, imputed).alias("x"))
    r = numerical_drift_analysis(a, b, ["x"]).first()
    return (r["ks"], r["ks_p_value"]) if r else (0.0, 1.0)

