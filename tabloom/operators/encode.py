"""Feature generators: counts, crosses, digits and target statistics, and the pipeline that runs them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations
from math import floor, inf, log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import equal_width, right_closed
from ..functions.core import Lookup, Operator, counts_of, is_float, is_numeric, number, one_row, quoted, require, string_columns, value
from ..functions.stats import before_all, medians, quantiles, quantiles_of


class CountEncodingFeatureGenerator(Operator):
    """CE_{f}: how often the value was seen at fit; null and unseen values get fill_value."""

    def __init__(self, features_names: Sequence[str] | None = None, fill_value: int = 0):
        self.features_names, self.fill_value = features_names, fill_value

    def fit(self, df: DataFrame) -> CountEncodingFeatureGenerator:
        self.features_ = list(self.features_names or df.columns)
        require(df, self.features_)
        self.maps_ = {f: Lookup(counts_of(df, f).withColumn("n", F.col("n").cast("int"))) for f in self.features_}
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        for f in self.features_:
            df = self.maps_[f].add(df, value(df, f), {"n": f"CE_{f}"}, {"n": self.fill_value})
        return df

    def get_feature_names(self) -> list[str]:
        return [f"CE_{f}" for f in self.features_]


CountEncoder = CountEncodingFeatureGenerator


class CrossFeatureGenerator(Operator):
    """Combinations of columns, in name order: products of numbers (nulls left out) as float, otherwise codes of the
    joined texts seen at fit, in sorted order; unseen ones -1."""

    def __init__(self, features_names: Sequence[str] | None = None, degree: int = 2, separator: str = "_"):
        if degree < 2:
            raise ValueError("degree must be 2 or more")
        self.features_names, self.degree, self.separator = features_names, degree, separator

    def fit(self, df: DataFrame) -> CrossFeatureGenerator:
        names = sorted(self.features_names or df.columns)
        require(df, names)
        if len(names) < self.degree:
            raise ValueError("there are fewer columns than the degree")
        self.combinations_ = list(combinations(names, self.degree))
        self.numeric_ = {c: all(is_numeric(df.schema[n].dataType) for n in c) for c in self.combinations_}
        self.codes_ = {}
        for c in (c for c in self.combinations_ if not self.numeric_[c]):
            seen = df.select(self._text(df, c).alias("key")).distinct().persist()
            self.codes_[c] = Lookup(before_all(seen, ["key"], seen.count()).select("key", F.col("before").cast("int").alias("code")))
            seen.unpersist()
        self._fitted = True
        return self

    def _text(self, df: DataFrame, names: Sequence[str]) -> Column:
        return F.concat_ws(self.separator, *[F.coalesce(value(df, n).cast("string"), F.lit("<NA>")) for n in names])

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        for c in self.combinations_:
            name = self.separator.join(c)
            if self.numeric_[c]:
                product = F.lit(1.0)
                for n in c:
                    product = product * F.coalesce(number(df, n), F.lit(1.0))
                df = df.withColumn(name, product.cast("float"))
            else:
                df = self.codes_[c].add(df, self._text(df, c), {"code": name}, {"code": -1})
        return df

    def get_feature_names(self) -> list[str]:
        return [self.separator.join(c) for c in self.combinations_]


class DigitsEncodingFeatureGenerator(Operator):
    """{f}_d{k}: the decimal digit of 10**k of the absolute value; nulls get fill_value. The digits taken run from the
    longest printed fraction to the largest power, within digit_limits."""

    def __init__(self, features_names: Sequence[str] | None = None, fill_value: int = -1, dtype: str = "tinyint", digit_limits: tuple[int, int] = (2, 6)):
        if not 1 <= digit_limits[0] <= digit_limits[1]:
            raise ValueError("digit_limits must be rising and positive")
        self.features_names, self.fill_value, self.dtype, self.digit_limits = features_names, fill_value, dtype, digit_limits

    def fit(self, df: DataFrame) -> DigitsEncodingFeatureGenerator:
        names = list(self.features_names or [f.name for f in df.schema if is_numeric(f.dataType)])
        require(df, names)
        if wrong := [n for n in names if not is_numeric(df.schema[n].dataType)]:
            raise ValueError(f"not numeric: {wrong}")
        places = lambda n: F.length(F.rtrim(F.split_part(F.abs(value(df, n)).cast("decimal(38,10)").cast("string"), F.lit("."), F.lit(2)), F.lit("0")))
        found = one_row(df, {(k, n): a for n in names for k, a in (("top", F.max(F.abs(number(df, n)))), ("places", F.max(places(n))))})
        self.ranges_ = {n: self._range(found["top", n], found["places", n]) for n in names}
        self._fitted = True
        return self

    def _range(self, top: float | None, places: int | None) -> tuple[int, int]:
        if top is None:
            return -1, 1
        least, most = self.digit_limits
        high = floor(log10(top)) + 1 if top > 0 else 1
        start, end = max(-(places or 0), (-most) // 2), min(high, most // 2)
        while end - start < least:  # wider round the centre, the lower end first
            start, end = (start - 1, end) if -start <= end else (start, end + 1)
        return start, min(end, start + most)

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        digits = {}
        for n, (start, end) in self.ranges_.items():
            c = F.abs(number(df, n))
            for k in range(start, end):
                digit = F.floor((c * F.lit(float(10.0**-k))) % 10)
                digits[f"{n}_d{k}"] = F.coalesce(digit, F.lit(self.fill_value)).cast(self.dtype)
        return df.withColumns(digits)

    def get_feature_names_out(self) -> list[str]:
        return [f"{n}_d{k}" for n, (a, b) in self.ranges_.items() for k in range(a, b)]


class TargetEncodingFeatureGenerator(Operator):
    """TE_{AGG}_{f}: a smoothed statistic of the target by value of the column.

    mean and median: (stat * n + global * smooth) / (n + smooth); nunique: distinct targets over n. Unseen and null
    values get the global statistic. Float columns are cut into n_bins equal-width bins first, whose null is a group.
    With folds, fit_transform gives each row a statistic from the other folds; means by subtraction in one pass.
    """

    AGGREGATIONS = ("mean", "median", "nunique")

    def __init__(
        self, features_names: Sequence[str], target: str, aggregation: str = "mean", smooth: float = 10, folds: int = 5, id_col: str | None = None,
        n_bins: int = 10, is_continuous_target: bool = False, target_bins: int = 4, random_state: int = 17,
    ):
        if aggregation not in self.AGGREGATIONS:
            raise ValueError(f"aggregation must be one of {', '.join(self.AGGREGATIONS)}")
        if smooth < 0 or folds < 0 or n_bins < 1:
            raise ValueError("smooth, folds and n_bins must not be negative")
        self.features_names, self.target, self.aggregation, self.smooth, self.folds = list(features_names), target, aggregation, smooth, folds
        self.id_col, self.n_bins, self.is_continuous_target, self.target_bins, self.random_state = id_col, n_bins, is_continuous_target, target_bins, random_state

    def _name(self, f: str) -> str:
        return f"TE_{self.aggregation.upper()}_{f}"

    def _key(self, df: DataFrame, f: str) -> Column:
        if f in self.edges_:
            return F.coalesce(right_closed(number(df, f), self.edges_[f]).cast("string"), F.lit("nan"))
        return value(df, f).cast("string")

    def _target(self, df: DataFrame) -> Column:
        y = number(df, self.target)
        return right_closed(y, self.target_edges_).cast("double") if self.target_edges_ else y

    def _global(self, df: DataFrame, y: Column) -> float | None:
        if self.aggregation == "median":
            return quantiles_of(df, {"y": y}, [0.5])["y"][0]
        return df.agg((F.avg(y) if self.aggregation == "mean" else F.count_distinct(y)).cast("double")).first()[0]

    def _stats(self, rows: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
        """(keys..., stat, n) of the rows, whose target y is there."""
        if self.aggregation == "median":
            return medians(rows, keys, y).withColumnRenamed("median", "stat")
        stat = F.avg(y) if self.aggregation == "mean" else F.count_distinct(y)
        return rows.groupBy(*keys).agg(stat.cast("double").alias("stat"), F.count("*").alias("n"))

    def _smoothed(self, stat: Column, n: Column) -> Column:
        if self.aggregation == "nunique":
            return F.try_divide(stat, n)
        return F.try_divide(stat * n + F.lit(float(self.global_ or 0.0)) * self.smooth, n + F.lit(float(self.smooth)))

    def fit(self, df: DataFrame) -> TargetEncodingFeatureGenerator:
        require(df, [*self.features_names, self.target])
        floats = [f for f in self.features_names if is_float(df.schema[f].dataType)]
        ends = one_row(df, {(k, f): a for f in floats for k, a in (("low", F.min(number(df, f))), ("high", F.max(number(df, f))))})
        self.edges_ = {}
        for f in floats:
            low, high = ends["low", f], ends["high", f]
            if low is not None:
                inner = equal_width(low, high, self.n_bins)[1:-1] if high > low else []
                self.edges_[f] = [-inf, *inner, inf]
        self.target_edges_ = None
        if self.is_continuous_target and self.aggregation == "nunique":
            q = sorted(set(quantiles(df, [self.target], [i / self.target_bins for i in range(self.target_bins + 1)])[self.target]))
            self.target_edges_ = [-inf, *q[1:-1], inf]
        y = self._target(df)
        self.global_ = self._global(df, y)
        self.maps_ = {}
        for f in self.features_names:
            groups = self._stats(df.select(self._key(df, f).alias("key"), y.alias("y")).where("key is not null and y is not null"), ["key"], "y")
            self.maps_[f] = Lookup(groups.select("key", self._smoothed(F.col("stat"), F.col("n")).cast("float").alias("te"), "n"))
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        for f in self.features_names:
            df = self.maps_[f].add(df, self._key(df, f), {"te": self._name(f)}, {"te": self.global_})
        return df

    def fold(self, df: DataFrame) -> Column:
        """The fold of a row, from its id alone."""
        if self.id_col is None:
            raise ValueError("out-of-fold encoding needs id_col")
        return F.pmod(F.xxhash64(quoted(self.id_col), F.lit(self.random_state)), F.lit(self.folds)).cast("int")

    def fit_transform(self, df: DataFrame, fold: Column | None = None) -> DataFrame:
        self.fit(df)
        if not self.folds:
            return self.transform(df)
        out = df.withColumn("_fold", self.fold(df) if fold is None else fold)
        for f in self.features_names:
            out = self._out_of_fold(out, f)
        return out.drop("_fold")

    def _out_of_fold(self, df: DataFrame, f: str) -> DataFrame:
        keyed = df.withColumns({"_key": self._key(df, f), "_y": self._target(df)})
        rows = keyed.where("_key is not null and _y is not null")
        if self.aggregation == "mean":  # sums of all folds less those of the own one, from one grouping
            cells = rows.groupBy("_key", "_fold").agg(F.sum("_y").alias("s"), F.count("*").alias("n"))
            cells = cells.groupBy("_key").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_fold", F.struct("s", "n").alias("v")))).alias("own"))
            own = F.col("own")[F.col("_fold")]
            s, n = F.col("s") - F.coalesce(own["s"], F.lit(0.0)), F.col("n") - F.coalesce(own["n"], F.lit(0))
            te = F.when(n > 0, self._smoothed(F.try_divide(s, n), n))
            met = keyed.join(cells, "_key", "left")
        else:
            folds = F.explode(F.filter(F.sequence(F.lit(0), F.lit(self.folds - 1)), lambda i: i != F.col("_fold")))
            cells = self._stats(rows.select("_key", "_y", folds.alias("_fold")), ["_key", "_fold"], "_y")
            te = self._smoothed(F.col("stat"), F.col("n"))
            met = keyed.join(cells, ["_key", "_fold"], "left")
        names = [c for c in df.columns if c != self._name(f)]
        return met.select(*[quoted(c) for c in names], F.coalesce(te, F.lit(self.global_)).cast("float").alias(self._name(f)))

    def get_feature_stats(self, f: str) -> DataFrame:
        self._require_fit()
        if f not in self.maps_:
            raise ValueError(f"{f} was not fitted")
        return self.maps_[f].table.select(F.col("key").alias("feature"), F.lit(self.aggregation).alias("aggregation"), F.col("n").alias("count"), F.col("te").alias("te_value"))


Hook = Callable[[DataFrame], DataFrame]


class FeatureGenerationPipeline(Operator):
    """Steps in order, between two hooks: before runs at fit and transform, after at transform only.

    A step whose features_names is empty takes the text columns there are by then; "__NEW__" stands for the columns that
    the last cross step added. final_features is the last projection.
    """

    def __init__(self, preprocessing_steps: Sequence[Operator], before: Hook | None = None, after: Hook | None = None, final_features: Sequence[str] | None = None):
        for step in preprocessing_steps:
            if not hasattr(step, "fit"):
                raise ValueError(f"{type(step).__name__} has no fit")
        self.steps, self.before, self.after, self.final_features = list(preprocessing_steps), before, after, final_features

    def fit(self, df: DataFrame) -> FeatureGenerationPipeline:
        self.fit_transform(df)
        return self

    def _run(self, df: DataFrame, fit: bool) -> DataFrame:
        df = self.before(df) if self.before else df
        new: list[str] = []
        for step in self.steps:
            if fit:
                names = getattr(step, "features_names", None)
                if names == []:
                    step.features_names = string_columns(df)
                elif names is not None and "__NEW__" in names:
                    step.features_names = [*(n for n in names if n != "__NEW__"), *new]
            had = df.columns
            df = step.fit_transform(df) if fit else step.transform(df)
            if isinstance(step, CrossFeatureGenerator):
                new = [c for c in df.columns if c not in had]
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        out = self._run(df, True)
        self._fitted = True
        return self._final(out)

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        out = self._run(df, False)
        return self._final(self.after(out) if self.after else out)

    def _final(self, df: DataFrame) -> DataFrame:
        if self.final_features is None:
            return df
        require(df, self.final_features)
        return df.select(*[quoted(c) for c in self.final_features])

