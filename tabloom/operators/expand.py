"""Encoders, discretisers, outlier and variance-stabilising transforms. Each replaces its columns; its WithOriginal form
appends {column}_{suffix} and keeps them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher
from math import inf, log, pi

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import distinct_edges, equal_width, right_closed
from ..functions.core import Lookup, Operator, counts_of, is_numeric, number, one_row, quoted, require, string_columns, value
from ..functions.stats import quantiles
from . import trees


class Expansion(Operator):
    """The contract of all operators here. learn() finds the state of self.variables_; column() is the derived value of
    one of them, and check() may refuse a frame."""

    suffix = "PREPROCESS"
    kind = "numeric"
    append = False

    def __init__(self, variables: Sequence[str] | None = None):
        self.variables = variables

    def _select(self, df: DataFrame) -> list[str]:
        if self.variables is not None:
            require(df, self.variables)
            if self.kind == "numeric" and (wrong := [v for v in self.variables if not is_numeric(df.schema[v].dataType)]):
                raise TypeError(f"not numeric: {wrong}")
            return list(self.variables)
        target = {getattr(self, "target", None)}
        found = [f.name for f in df.schema if is_numeric(f.dataType)] if self.kind == "numeric" else string_columns(df)
        return [c for c in found if c not in target]

    def fit(self, df: DataFrame) -> Expansion:
        self.variables_ = self._select(df)
        self.learn(df)
        self._fitted = True
        return self

    def learn(self, df: DataFrame) -> None:
        pass

    def derive(self, df: DataFrame, outs: Mapping[str, str]) -> DataFrame:
        return df.withColumns({out: self.column(df, v) for v, out in outs.items()})

    def column(self, df: DataFrame, variable: str) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        require(df, self.variables_)
        outs = {v: f"{v}_{self.suffix}" for v in self.variables_}
        out = self.derive(df, outs)
        if self.append:
            return out
        names = {o: v for v, o in outs.items()}
        return out.select(*[quoted(outs.get(c, c)).alias(c) for c in df.columns], *[quoted(c) for c in out.columns if c not in df.columns and c not in names])

    def get_feature_names_out(self) -> list[str]:
        self._require_fit()
        return [f"{v}_{self.suffix}" for v in self.variables_]


def with_original(kind: type[Expansion]) -> type[Expansion]:
    return type(f"{kind.__name__}WithOriginal", (kind,), {"append": True, "__doc__": f"{kind.__name__}, appending its columns."})


# ---- categories ----


class CountFrequencyEncoder(Expansion):
    """Counts or shares of values. Unseen values are null, or an error; so are nulls at fit unless ignored."""

    suffix, kind = "PREPROCESS_CNT_FREQ", "text"

    def __init__(self, variables=None, encoding_method: str = "count", missing_values: str = "raise", unseen: str = "ignore"):
        super().__init__(variables)
        if encoding_method not in ("count", "frequency"):
            raise ValueError("encoding_method must be count or frequency")
        self.encoding_method, self.missing_values, self.unseen = encoding_method, missing_values, unseen

    def learn(self, df: DataFrame) -> None:
        nulls = one_row(df, {v: F.count_if(value(df, v).isNull()) for v in self.variables_} | {"_n": F.count("*")})
        if self.missing_values == "raise" and any(nulls[v] for v in self.variables_):
            raise ValueError("there are missing values")
        self.maps_ = {}
        for v in self.variables_:
            n = counts_of(df, v)
            n = n.withColumn("key", F.col("key").cast("string"))
            self.maps_[v] = Lookup(n if self.encoding_method == "count" else n.withColumn("n", F.col("n") / (nulls["_n"] - nulls[v])))

    def derive(self, df: DataFrame, outs: Mapping[str, str]) -> DataFrame:
        out = df
        for v, name in outs.items():
            out = self.maps_[v].add(out, value(df, v).cast("string"), {"n": name})
        return refuse_unseen(out, outs, self.unseen)


def refuse_unseen(df: DataFrame, outs: Mapping[str, str], unseen: str) -> DataFrame:
    """Where unseen values are an error, a row with one raises it."""
    if unseen != "raise":
        return df
    fail = lambda v, o: F.when(quoted(o).isNull() & quoted(v).isNotNull(), F.raise_error(F.lit(f"{v} has an unseen value")).cast("double")).otherwise(quoted(o))
    return df.withColumns({o: fail(v, o) for v, o in outs.items()})


class MeanEncoder(Expansion):
    """(n * mean + smoothing * global mean) / (n + smoothing) of the target; unseen values are null."""

    suffix, kind = "PREPROCESS_MEAN_ENC", "text"

    def __init__(self, target: str, variables=None, smoothing: float = 0.0, unseen: str = "ignore"):
        super().__init__(variables)
        self.target, self.smoothing, self.unseen = target, smoothing, unseen

    def learn(self, df: DataFrame) -> None:
        y = number(df, self.target)
        mean = df.agg(F.avg(y)).first()[0]
        self.maps_ = {}
        for v in self.variables_:
            g = df.select(value(df, v).cast("string").alias("key"), y.alias("y")).where("key is not null and y is not null").groupBy("key").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
            self.maps_[v] = Lookup(g.select("key", ((F.col("s") + self.smoothing * mean) / (F.col("n") + F.lit(float(self.smoothing)))).alias("m")))

    def derive(self, df: DataFrame, outs: Mapping[str, str]) -> DataFrame:
        out = df
        for v, name in outs.items():
            out = self.maps_[v].add(out, value(df, v).cast("string"), {"m": name})
        return refuse_unseen(out, outs, self.unseen)


class WoEEncoder(Expansion):
    """ln of the share of positives over the share of negatives. A value without a class is an error, or counts fill_value."""

    suffix, kind = "PREPROCESS_WOE", "text"

    def __init__(self, target: str, variables=None, unseen: str = "ignore", fill_value: float | None = None):
        super().__init__(variables)
        self.target, self.unseen, self.fill_value = target, unseen, fill_value

    def learn(self, df: DataFrame) -> None:
        y = number(df, self.target)
        classes = sorted(r[0] for r in df.select(y.alias("y")).where("y is not null").distinct().limit(3).collect())
        if len(classes) != 2:
            raise ValueError("the target must have two classes")
        self.maps_ = {}
        for v in self.variables_:
            g = df.select(value(df, v).cast("string").alias("key"), (y == classes[1]).alias("y")).where("key is not null and y is not null").groupBy("key")
            g = g.agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("q")).persist()
            pos, neg, lacking = g.agg(F.sum("p"), F.sum("q"), F.count_if((F.col("p") == 0) | (F.col("q") == 0))).first()
            if lacking and self.fill_value is None:
                raise ValueError(f"{v} has values without one of the classes")
            share = lambda c, n: F.when(F.col(c) == 0, F.lit(self.fill_value).cast("double")).otherwise(F.col(c) / n)
            self.maps_[v] = Lookup(g.select("key", F.ln(share("p", pos) / share("q", neg)).alias("w")))
            g.unpersist()

    def derive(self, df: DataFrame, outs: Mapping[str, str]) -> DataFrame:
        out = df
        for v, name in outs.items():
            out = self.maps_[v].add(out, value(df, v).cast("string"), {"w": name})
        return refuse_unseen(out, outs, self.unseen)


class RareLabelEncoder(Expansion):
    """Values of a share below tol become one label; columns of too few values stay. Unseen values are rare."""

    suffix, kind = "PREPROCESS_RARE", "text"

    def __init__(self, variables=None, tol: float = 0.05, n_categories: int = 10, max_n_categories: int | None = None, replace_with: str = "Rare"):
        super().__init__(variables)
        if not 0 <= tol <= 1:
            raise ValueError("tol must be between 0 and 1")
        self.tol, self.n_categories, self.max_n_categories, self.replace_with = tol, n_categories, max_n_categories, replace_with

    def learn(self, df: DataFrame) -> None:
        total = df.count()
        self.frequent_: dict[str, list[str] | None] = {}
        for v in self.variables_:
            n = counts_of(df, v)
            if n.limit(self.n_categories + 1).count() <= self.n_categories:
                self.frequent_[v] = None
                continue
            often = n.where(F.col("n") / total >= self.tol).orderBy(F.desc("n"), "key")  # at most 1 / tol values
            often = often.limit(self.max_n_categories) if self.max_n_categories else often
            self.frequent_[v] = [r["key"] for r in often.collect()]

    def column(self, df: DataFrame, variable: str) -> Column:
        c, often = value(df, variable), self.frequent_[variable]
        return c if often is None else F.when(c.isNull() | c.isin(often), c).otherwise(F.lit(self.replace_with))


class StringSimilarityEncoder(Expansion):
    """{column}_{string}: Gestalt similarity of the value to each string seen at fit (or the keywords, or the top_categories
    commonest). Similarities are computed once for each distinct value."""

    suffix, kind = "PREPROCESS_STR_SIM", "text"

    def __init__(self, variables=None, top_categories: int | None = None, keywords: Mapping[str, Sequence[str]] | None = None, missing_values: str = "impute"):
        super().__init__(variables)
        if missing_values not in ("impute", "ignore", "raise"):
            raise ValueError("missing_values must be impute, ignore or raise")
        self.top_categories, self.keywords, self.missing_values = top_categories, keywords or {}, missing_values

    def _text(self, df: DataFrame, v: str) -> Column:
        c = value(df, v).cast("string")
        return F.coalesce(c, F.lit("")) if self.missing_values == "impute" else c

    def learn(self, df: DataFrame) -> None:
        if self.missing_values == "raise" and any(one_row(df, {v: F.count_if(value(df, v).isNull()) for v in self.variables_}).values()):
            raise ValueError("there are missing values")
        self.strings_ = {}
        for v in self.variables_:
            if v in self.keywords:
                self.strings_[v] = list(self.keywords[v])
                continue
            n = df.select(self._text(df, v).alias("key")).where("key is not null and key <> ''").groupBy("key").count().orderBy(F.desc("count"), "key")
            self.strings_[v] = [r["key"] for r in (n.limit(self.top_categories) if self.top_categories else n).collect()]

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        out = df
        for v in self.variables_:
            strings = self.strings_[v]
            found = df.select(self._text(df, v).alias("_key")).where("_key is not null").distinct()
            found = found.withColumn("_sim", _similarities(strings)(F.col("_key"))) if strings else found.withColumn("_sim", F.array().cast("array<double>"))
            met = out.withColumn("_of", self._text(df, v)).join(found, F.col("_of") == F.col("_key"), "left")
            out = met.select(*[quoted(c) for c in out.columns], *[F.col("_sim")[i].alias(f"{v}_{s}") for i, s in enumerate(strings)])
        return out if self.append else out.drop(*self.variables_)

    def get_feature_names_out(self) -> list[str]:
        self._require_fit()
        return [f"{v}_{s}" for v in self.variables_ for s in self.strings_[v]]


def _similarities(strings: list[str]):
    @F.pandas_udf("array<double>")
    def similar(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [SequenceMatcher(None, t, s).ratio() for s in strings])

    return similar


class DecisionTreeEncoder(Expansion):
    """Predictions of a tree grown on the value's ordinal code; the depth is chosen by cross-validation. Unseen values
    take the prediction for all rows."""

    suffix, kind = "PREPROCESS_DT_ENC", "text"

    def __init__(self, target: str, variables=None, regression: bool = True, cv: int = 3, depths: Sequence[int] = (1, 2, 3, 4), precision: int | None = None, seed: int = 17):
        super().__init__(variables)
        self.target, self.regression, self.cv, self.depths, self.precision, self.seed = target, regression, cv, list(depths), precision, seed

    def learn(self, df: DataFrame) -> None:
        self.maps_, self.rest_ = {}, df.agg(F.avg(number(df, self.target))).first()[0]
        y = number(df, self.target)
        for v in self.variables_:
            # a tree on an ordinal code sees the groups' sums only
            g = df.select(value(df, v).cast("string").alias("key"), y.alias("y")).where("key is not null and y is not null").groupBy("key").agg(F.avg("y").alias("m"), F.count("*").alias("n"))
            order = {r["key"]: i for i, r in enumerate(g.orderBy("m", "key").collect())}
            codes = Lookup(df.sparkSession.createDataFrame(list(order.items()), "key string, code int"))
            tree = trees.best_tree(codes.add(df, value(df, v).cast("string"), {"code": "_x"}).where("_x is not null"), "_x", self.target, self.regression, self.depths, self.cv, self.seed)
            table = df.sparkSession.createDataFrame([(k, float(tree(c))) for k, c in order.items()], "key string, p double")
            self.maps_[v] = Lookup(table if self.precision is None else table.withColumn("p", F.round("p", self.precision)))

    def derive(self, df: DataFrame, outs: Mapping[str, str]) -> DataFrame:
        out = df
        for v, name in outs.items():
            out = self.maps_[v].add(out, value(df, v).cast("string"), {"p": name}, {"p": self.rest_})
        return out


# ---- bins ----


class ArbitraryDiscretiser(Expansion):
    """Codes of given right-closed intervals, the first with its lower end. Values outside are null, or an error."""

    suffix = "PREPROCESS_ARB_DISC"

    def __init__(self, binning_dict: Mapping[str, Sequence[float]], errors: str = "ignore"):
        super().__init__(list(binning_dict))
        if errors not in ("ignore", "raise"):
            raise ValueError("errors must be ignore or raise")
        self.edges_, self.errors = {k: [float(x) for x in v] for k, v in binning_dict.items()}, errors

    def derive(self, df: DataFrame, outs: Mapping[str, str]) -> DataFrame:
        return refuse_unseen(super().derive(df, outs), outs, self.errors)

    def column(self, df: DataFrame, variable: str) -> Column:
        return right_closed(number(df, variable), self.edges_[variable])


class _Edges(Expansion):
    def column(self, df: DataFrame, variable: str) -> Column:
        return right_closed(number(df, variable), [-inf, *self.edges_[variable][1:-1], inf])

    def _ends(self, df: DataFrame) -> dict:
        return one_row(df, {(k, v): a for v in self.variables_ for k, a in (("low", F.min(number(df, v))), ("high", F.max(number(df, v))))})


class EqualFrequencyDiscretiser(_Edges):
    """Codes of q quantile bins; equal edges count once."""

    suffix = "PREPROCESS_EQ_FREQ"

    def __init__(self, variables=None, q: int = 10):
        super().__init__(variables)
        self.q = q

    def learn(self, df: DataFrame) -> None:
        found = quantiles(df, self.variables_, [i / self.q for i in range(self.q + 1)])
        self.edges_ = {v: distinct_edges(e) for v, e in found.items()}


class EqualWidthDiscretiser(_Edges):
    suffix = "PREPROCESS_EQ_WIDTH"

    def __init__(self, variables=None, bins: int = 10):
        super().__init__(variables)
        self.bins = bins

    def learn(self, df: DataFrame) -> None:
        ends = self._ends(df)
        self.edges_ = {v: equal_width(ends["low", v], ends["high", v], self.bins) for v in self.variables_}


class GeometricWidthDiscretiser(_Edges):
    """Inner edges at min + ((max - min) ** (1 / bins)) ** k."""

    suffix = "PREPROCESS_GEO_WIDTH"

    def __init__(self, variables=None, bins: int = 10, precision: int = 7):
        super().__init__(variables)
        self.bins, self.precision = bins, precision

    def learn(self, df: DataFrame) -> None:
        ends, self.edges_ = self._ends(df), {}
        for v in self.variables_:
            low, high = ends["low", v], ends["high", v]
            step = (high - low) ** (1 / self.bins)
            inner = [round(low + step**k, self.precision) for k in range(1, self.bins)]
            if len(set(inner)) < len(inner) or high == low:
                raise ValueError("Bin edges must be unique")
            self.edges_[v] = [low, *sorted(inner), high]


class DecisionTreeDiscretiser(Expansion):
    """The prediction, or the number, of the leaf that holds the value in a tree grown on it alone."""

    suffix = "PREPROCESS_DT_DISC"

    def __init__(self, target: str, variables=None, bin_output: str = "prediction", regression: bool = True, cv: int = 3, depths: Sequence[int] = (1, 2, 3, 4), seed: int = 17):
        super().__init__(variables)
        if bin_output not in ("prediction", "bin_number"):
            raise ValueError("bin_output must be prediction or bin_number")
        self.target, self.bin_output, self.regression, self.cv, self.depths, self.seed = target, bin_output, regression, cv, list(depths), seed

    def learn(self, df: DataFrame) -> None:
        self.trees_ = {v: trees.best_tree(df.withColumn("_x", number(df, v)).where("_x is not null"), "_x", self.target, self.regression, self.depths, self.cv, self.seed) for v in self.variables_}

    def column(self, df: DataFrame, variable: str) -> Column:
        tree = self.trees_[variable]
        code = right_closed(number(df, variable), [-inf, *tree.cuts, inf])
        return code if self.bin_output == "bin_number" else F.get(F.array(*[F.lit(float(p)) for p in tree.values]), code)


# ---- outliers ----


class _Capped(Expansion):
    """Bounds by gaussian (mean and deviations), iqr, mad (median and deviations from it) or quantiles."""

    AUTO = {"gaussian": 3.0, "iqr": 1.5, "mad": 3.29, "quantiles": 0.05}

    def __init__(self, variables=None, capping_method: str = "gaussian", tail: str = "right", fold: float | str = "auto"):
        super().__init__(variables)
        if capping_method not in self.AUTO:
            raise ValueError(f"capping_method must be one of {', '.join(self.AUTO)}")
        if tail not in ("left", "right", "both"):
            raise ValueError("tail must be left, right or both")
        self.capping_method, self.tail, self.fold = capping_method, tail, self.AUTO[capping_method] if fold == "auto" else fold

    def learn(self, df: DataFrame) -> None:
        names, k = self.variables_, self.fold
        if self.capping_method == "gaussian":
            s = one_row(df, {(a, v): f(number(df, v)) for v in names for a, f in (("m", F.avg), ("s", F.stddev))})
            bounds = {v: (s["m", v] - k * (s["s", v] or 0), s["m", v] + k * (s["s", v] or 0)) for v in names}
        elif self.capping_method == "iqr":
            bounds = {v: (a - k * (b - a), b + k * (b - a)) for v, (a, b) in quantiles(df, names, [0.25, 0.75]).items()}
        elif self.capping_method == "mad":
            middle = {v: q[0] for v, q in quantiles(df, names, [0.5]).items()}
            away = quantiles(df.select(*[F.abs(number(df, v) - middle[v]).alias(v) for v in names]), names, [0.5])
            bounds = {v: (middle[v] - k * 1.4826 * away[v][0], middle[v] + k * 1.4826 * away[v][0]) for v in names}
        else:
            bounds = {v: tuple(q) for v, q in quantiles(df, names, [k, 1 - k]).items()}
        left, right = self.tail in ("left", "both"), self.tail in ("right", "both")
        self.bounds_ = {v: (a if left else -inf, b if right else inf) for v, (a, b) in bounds.items()}


class OutlierTrimmer(_Capped):
    """Replacing: drops rows with an outlier. WithOriginal: an outlier in any column nulls all derived ones of its row."""

    suffix = "PREPROCESS_TRIMMED"

    def _inside(self, df: DataFrame) -> Column:
        inside = F.lit(True)
        for v, (low, high) in self.bounds_.items():
            c = number(df, v)
            inside &= c.isNull() | ((c >= F.lit(low)) & (c <= F.lit(high)))
        return inside

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        return super().transform(df) if self.append else df.where(self._inside(df))

    def column(self, df: DataFrame, variable: str) -> Column:
        return F.when(self._inside(df), value(df, variable))


class Winsorizer(_Capped):
    """Values beyond a bound become the bound; nulls stay."""

    suffix = "PREPROCESS_WINSORIZER"

    def __init__(self, variables=None, capping_method: str = "iqr", tail: str = "both", fold: float | str = 3.0):
        super().__init__(variables, capping_method, tail, fold)

    def column(self, df: DataFrame, variable: str) -> Column:
        c, (low, high) = number(df, variable), self.bounds_[variable]
        return F.when(c < F.lit(low), F.lit(low)).when(c > F.lit(high), F.lit(high)).otherwise(c)


# ---- variance-stabilising ----


class _Checked(Expansion):
    """A function of a domain; values outside it are an error at fit, and give null later."""

    domain = "all"

    def learn(self, df: DataFrame) -> None:
        ends = one_row(df, {(k, v): a for v in self.variables_ for k, a in (("low", F.min(number(df, v))), ("high", F.max(number(df, v))), ("zero", F.count_if(number(df, v) == 0)))})
        for v in self.variables_:
            low, high, zero = ends["low", v], ends["high", v], ends["zero", v]
            bad = {"all": False, "positive": low is not None and low <= 0, "unit": low is not None and (low < 0 or high > 1), "nonzero": bool(zero)}[self.domain]
            if bad:
                raise ValueError(f"{v} has values outside the domain: {self.domain}")
        self.state(df, ends)

    def state(self, df: DataFrame, ends: dict) -> None:
        pass


class ArcsinTransformer(_Checked):
    suffix, domain = "PREPROCESS_ARCSIN", "unit"

    def column(self, df: DataFrame, variable: str) -> Column:
        c = number(df, variable)
        return F.when(c.between(0, 1), F.asin(F.sqrt(c)))


class LogTransformer(_Checked):
    suffix, domain = "PREPROCESS_LOG", "positive"

    def __init__(self, variables=None, base: str = "e"):
        super().__init__(variables)
        if base not in ("e", "10"):
            raise ValueError("base must be e or 10")
        self.base = base

    def _log(self, c: Column) -> Column:
        return F.ln(c) if self.base == "e" else F.log10(c)

    def column(self, df: DataFrame, variable: str) -> Column:
        return self._log(number(df, variable))


class LogCpTransformer(LogTransformer):
    """log(x + C); C auto is 0 for positive columns and otherwise |min| + 1."""

    suffix, domain = "PREPROCESS_LOG_CP", "all"

    def __init__(self, variables=None, base: str = "e", C: float | str | Mapping[str, float] = "auto"):
        super().__init__(variables, base)
        self.C = C

    def state(self, df: DataFrame, ends: dict) -> None:
        low = {v: ends["low", v] or 0.0 for v in self.variables_}
        auto = {v: 0.0 if low[v] > 0 else abs(low[v]) + 1 for v in self.variables_}
        self.C_ = auto if self.C == "auto" else dict(self.C) if isinstance(self.C, Mapping) else dict.fromkeys(self.variables_, float(self.C))
        if any(low[v] + self.C_[v] <= 0 for v in self.variables_):
            raise ValueError("C leaves values that are not positive")

    def column(self, df: DataFrame, variable: str) -> Column:
        return self._log(number(df, variable) + F.lit(float(self.C_[variable])))


class PowerTransformer(_Checked):
    suffix = "PREPROCESS_POWER"

    def __init__(self, variables=None, exp: float = 0.5):
        super().__init__(variables)
        self.exp = exp

    def column(self, df: DataFrame, variable: str) -> Column:
        return F.pow(number(df, variable), F.lit(float(self.exp)))


class ReciprocalTransformer(_Checked):
    suffix, domain = "PREPROCESS_RECIPROCAL", "nonzero"

    def column(self, df: DataFrame, variable: str) -> Column:
        return F.try_divide(F.lit(1.0), number(df, variable))


def _box_cox(c: Column, power: float) -> Column:
    return F.ln(c) if abs(power) < 1e-12 else (F.pow(c, F.lit(power)) - 1) / power


def _yeo_johnson(c: Column, power: float) -> Column:
    up = F.log1p(c) if abs(power) < 1e-12 else (F.pow(c + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-c) if abs(power - 2) < 1e-12 else -(F.pow(1 - c, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(c >= 0, up).when(c < 0, down)


class _Likeliest(_Checked):
    """The power of greatest likelihood: a grid, then two finer ones, each a single aggregate for all columns."""

    def state(self, df: DataFrame, ends: dict) -> None:
        grids = {v: [-3 + 0.25 * i for i in range(25)] for v in self.variables_}
        for step in (0.25, 0.025, 0.0025, 0.00025):
            score = self._scores(df, grids)
            best = {v: max(grids[v], key=lambda p, v=v: score[v, p]) for v in self.variables_}
            grids = {v: [best[v] + step * (i - 10) / 10 for i in range(21)] for v in self.variables_}
        self.lambdas_ = best

    def _scores(self, df: DataFrame, grids: dict) -> dict:
        spread = one_row(df, {(v, p): F.var_pop(self.form(number(df, v), p)) for v in grids for p in grids[v]}, 100)
        extra = one_row(df, {v: F.sum(self.log_slope(number(df, v))) for v in grids} | {("n", v): F.count(number(df, v)) for v in grids})
        bad = lambda s: s is None or s != s or s <= 0
        return {(v, p): -inf if bad(spread[v, p]) else -extra["n", v] / 2 * (log(spread[v, p]) + log(2 * pi) + 1) + (p - 1) * (extra[v] or 0.0) for v in grids for p in grids[v]}

    def column(self, df: DataFrame, variable: str) -> Column:
        return self.form(number(df, variable), self.lambdas_[variable])


class BoxCoxTransformer(_Likeliest):
    suffix, domain = "PREPROCESS_BOX_COX", "positive"
    form = staticmethod(_box_cox)
    log_slope = staticmethod(F.ln)


class YeoJohnsonTransformer(_Likeliest):
    suffix = "PREPROCESS_YEO_JOHNSON"
    form = staticmethod(_yeo_johnson)
    log_slope = staticmethod(lambda c: F.signum(c) * F.log1p(F.abs(c)))


PLAIN = (
    CountFrequencyEncoder, MeanEncoder, WoEEncoder, RareLabelEncoder, StringSimilarityEncoder, DecisionTreeEncoder, ArbitraryDiscretiser,
    EqualFrequencyDiscretiser, EqualWidthDiscretiser, GeometricWidthDiscretiser, DecisionTreeDiscretiser, OutlierTrimmer, Winsorizer,
    ArcsinTransformer, BoxCoxTransformer, LogCpTransformer, LogTransformer, PowerTransformer, ReciprocalTransformer, YeoJohnsonTransformer,
)
for _kind in PLAIN:
    globals()[f"{_kind.__name__}WithOriginal"] = with_original(_kind)
