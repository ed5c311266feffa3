"""Imputation by joint distributions and by statistical association."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import distinct_edges, right_closed
from ..functions.core import BROADCAST_ROWS, Operator, is_numeric, number, one_row, quoted, require, string_columns, value
from ..functions.stats import association, contingency, quantiles


def impute_missing_values(df: DataFrame, to_impute: Sequence[str], by: Sequence[str], threshold_num_observation: int = 10) -> DataFrame:
    """Fills nulls of a column where a value of another occurs with one value of it only, in enough rows.

    Pairs go in order and see what earlier ones filled."""
    require(df, [*to_impute, *by])
    for a in to_impute:
        for b in by:
            found = df.where(value(df, a).isNotNull() & value(df, b).isNotNull()).groupBy(value(df, b).alias("_by"))
            found = found.agg(F.count_distinct(quoted(a)).alias("k"), F.count("*").alias("n"), F.min(quoted(a)).alias("_fill"))
            found = found.where((F.col("k") == 1) & (F.col("n") >= threshold_num_observation)).select("_by", "_fill")
            names = df.columns
            met = df.join(found, value(df, b) == F.col("_by"), "left")
            df = met.select(*[F.coalesce(quoted(c), F.col("_fill")).alias(c) if c == a else quoted(c) for c in names])
    return df


impute_with_joint_distribution = impute_missing_values


def cramers_v(df: DataFrame, x: str, y: str, corrected: bool = True) -> float:
    """Cramer's V of two columns, with the bias correction of Bergsma; 0 where it is not defined."""
    r = association(contingency(df, value(df, x), value(df, y)), []).first()
    if r is None or r["total"] is None or r["total"] < 2:
        return 0.0
    n, k, m = r["total"], r["ka"], r["kb"]
    if not corrected:
        return r["v"] or 0.0
    phi = max(0.0, (r["chi2"] or 0.0) / n - (k - 1) * (m - 1) / (n - 1))
    least = min(k - (k - 1) ** 2 / (n - 1), m - (m - 1) ** 2 / (n - 1)) - 1
    return (phi / least) ** 0.5 if least > 0 else 0.0


def theils_u(df: DataFrame, x: str, y: str) -> float:
    """The share of y's entropy that x explains; 0 where y has none."""
    r = association(contingency(df, value(df, x), value(df, y)), []).first()
    return 0.0 if r is None or r["total"] is None or r["kb"] < 2 else max(0.0, r["u"])


class StatisticalAssociationImputer(Operator):
    """Fills each column from the group means or modes of the columns that it is most associated with.

    Numeric columns are cut at their deciles. For each column with nulls the others are ranked by Cramer's V, mutual
    information and Theil's U; the `top_n` of the best summed rank form the groups (a null is a group of its own). Nulls
    get the group's mode (text) or mean (numbers), or the overall one where the group has none.
    """

    METRICS = ("cramers_v", "mutual_info", "theils_u")

    def __init__(self, metrics: Sequence[str] = METRICS, top_n: int = 2, features: Sequence[str] | None = None):
        if unknown := set(metrics) - set(self.METRICS):
            raise ValueError(f"unknown metrics: {sorted(unknown)}")
        self.metrics, self.top_n, self.features = list(metrics), top_n, features

    def _code(self, df: DataFrame, name: str) -> Column:
        if name in self.edges_:
            e = self.edges_[name]
            return right_closed(number(df, name), [float("-inf"), *e[1:-1], float("inf")]).cast("string") if len(e) > 2 else F.when(value(df, name).isNotNull(), "0")
        return value(df, name).cast("string")

    def fit(self, df: DataFrame) -> StatisticalAssociationImputer:
        names = list(self.features or [f.name for f in df.schema if is_numeric(f.dataType) or f.name in string_columns(df)])
        require(df, names)
        numeric = [n for n in names if is_numeric(df.schema[n].dataType)]
        self.edges_ = {n: distinct_edges(v) for n, v in quantiles(df, numeric, [i / 10 for i in range(11)]).items()} if numeric else {}
        nulls = one_row(df, {n: F.count_if(value(df, n).isNull()) for n in names})
        self.incomplete_ = [n for n in names if nulls[n]]
        self.groups_, self.state_, self.overall_ = {}, {}, {}
        codes = df.select(*[self._code(df, n).alias(n) for n in names]).persist()
        for n in self.incomplete_:
            ranks = self.rank(codes, n, [m for m in names if m != n])
            self.groups_[n] = by = [m for m, _ in ranks[: self.top_n]]
            is_number = n in numeric
            v = number(df, n) if is_number else quoted(n)
            stat = F.avg(v) if is_number else F.mode(v, True)
            self.overall_[n] = df.agg(stat).first()[0]
            state = df.where(value(df, n).isNotNull()).groupBy(*[self._code(df, m).alias(f"_g{i}") for i, m in enumerate(by)]).agg(stat.alias("_fill")).persist()
            self.state_[n] = F.broadcast(state) if state.count() <= BROADCAST_ROWS else state
        codes.unpersist()
        self._fitted = True
        return self

    def rank(self, codes: DataFrame, name: str, others: Sequence[str]) -> list[tuple[str, float]]:
        """The other columns by their summed rank, best first. One grouping gives all contingency tables."""
        pairs = F.array(*[F.struct(F.lit(o).alias("feature"), quoted(o).alias("a")) for o in others])
        table = codes.select(quoted(name).alias("b"), F.explode(pairs).alias("p")).select("b", "p.feature", "p.a").where("a is not null and b is not null")
        found = association(table.groupBy("feature", "a", "b").agg(F.count("*").alias("n")), ["feature"])
        entropy = table.groupBy("feature", "b").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("feature")))
        entropy = {r[0]: r[1] for r in entropy.groupBy("feature").agg(F.sum(-F.col("p") * F.ln("p"))).collect()}
        score: dict[str, dict[str, float]] = {m: {} for m in self.METRICS}
        for r in found.collect():
            n, k, m = r["total"], r["ka"], r["kb"]
            phi = max(0.0, r["chi2"] / n - (k - 1) * (m - 1) / (n - 1)) if n > 1 and r["chi2"] is not None else 0.0
            least = min(k - (k - 1) ** 2 / (n - 1), m - (m - 1) ** 2 / (n - 1)) - 1 if n > 1 else 0
            score["cramers_v"][r["feature"]] = (phi / least) ** 0.5 if least > 0 else 0.0
            score["theils_u"][r["feature"]] = r["u"] if m > 1 else 0.0
            score["mutual_info"][r["feature"]] = r["u"] * entropy[r["feature"]] if m > 1 else 0.0
        total = dict.fromkeys(others, 0.0)
        for metric in self.metrics:
            values = [score[metric].get(o, 0.0) for o in others]
            for o, v in zip(others, values, strict=True):
                total[o] += sum(x > v for x in values) + (sum(x == v for x in values) + 1) / 2
        return sorted(total.items(), key=lambda x: (x[1], others.index(x[0])))

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        names, kinds = df.columns, {f.name: f.dataType for f in df.schema}
        for n in self.incomplete_:
            coded = df.withColumns({f"_c{i}": self._code(df, m) for i, m in enumerate(self.groups_[n])})
            state = self.state_[n]
            on = [coded[f"_c{i}"].eqNullSafe(state[f"_g{i}"]) for i in range(len(self.groups_[n]))]
            met = coded.join(state, on, "left")
            fill = F.coalesce(value(df, n), F.col("_fill"), F.lit(self.overall_[n])).cast(kinds[n] if not is_numeric(kinds[n]) else "double")
            df = met.select(*[fill.alias(c) if c == n else quoted(c) for c in names])
        return df

