"""Text normalisation, category alignment and type conversion."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import Operator, is_float, is_numeric, one_row, quoted, require, string_columns, value

#: Categories up to which membership is a literal list.
LITERAL_CATEGORIES = 1000


@F.pandas_udf(T.StringType())
def _title(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None else s.title())


@F.pandas_udf(T.StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None else s.casefold())


class CaseNormalizer(Operator):
    """Text columns in lower, upper, title, capitalize or casefold form; nulls and other columns stay."""

    MODES = ("lower", "upper", "title", "capitalize", "casefold")

    def __init__(self, features_names: Sequence[str] | None = None, normalization: str = "lower"):
        if normalization not in self.MODES:
            raise ValueError(f"normalization must be one of {', '.join(self.MODES)}")
        self.features_names, self.normalization = features_names, normalization

    def fit(self, df: DataFrame) -> CaseNormalizer:
        require(df, self.features_names or [])
        self.features_ = list(self.features_names) if self.features_names is not None else string_columns(df)
        self._fitted = True
        return self

    def _form(self, c: Column) -> Column:
        match self.normalization:
            case "lower":
                return F.lower(c)
            case "upper":
                return F.upper(c)
            case "capitalize":
                return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))
            case "title":
                return _title(c)
        return _casefold(c)

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        return df.withColumns({c: self._form(quoted(c)) for c in self.features_ if isinstance(df.schema[c].dataType, T.StringType)})


class CategoricalCleaner(Operator):
    """Values that equal a group's placeholder become null; the columns become text."""

    def __init__(self, feature_groups: Mapping[str, Sequence[str]]):
        self.feature_groups = feature_groups

    def fit(self, df: DataFrame) -> CategoricalCleaner:
        require(df, [c for columns in self.feature_groups.values() for c in columns])
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for placeholder, columns in self.feature_groups.items():
            df = df.withColumns({c: F.nullif(value(df, c).cast("string"), F.lit(placeholder)) for c in columns})
        return df


class CategoricalAligner(Operator):
    """Keeps text columns to the categories seen at fit: nulls and unseen values become the fill value, which is the
    given one or the mode (the smallest of equally frequent values)."""

    def __init__(self, categorical_features: Sequence[str] | None = None, fill_values: Mapping[str, str] | None = None, warn_on_unknown: bool = False):
        self.categorical_features, self.fill_values, self.warn_on_unknown = categorical_features, dict(fill_values or {}), warn_on_unknown

    @staticmethod
    def create_fill_values(df: DataFrame, categorical_features: Sequence[str], custom_fills: Mapping[str, str] | None = None, default_value: str = "mode") -> dict[str, str]:
        """{feature: its custom fill or the default}; the default "mode" stands for each column's mode."""
        fills = {f: (custom_fills or {}).get(f, default_value) for f in categorical_features}
        modes = one_row(df, {f: F.mode(value(df, f).cast("string"), True) for f in fills if fills[f] == "mode"})
        return {f: (modes[f] if modes[f] is not None else "Unknown") if f in modes else v for f, v in fills.items()}

    def fit(self, df: DataFrame) -> CategoricalAligner:
        self.features_ = list(self.categorical_features) if self.categorical_features is not None else string_columns(df)
        require(df, self.features_)
        text = {f: value(df, f).cast("string") for f in self.features_}
        found = one_row(df, {("mode", f): F.mode(c, True) for f, c in text.items()} | {("all", f): F.collect_set(c) for f, c in text.items()})
        self.fills_ = {f: self.fill_values.get(f) or found["mode", f] or "Unknown" for f in self.features_}
        self.categories_ = {f: sorted({*found["all", f], self.fills_[f]}) for f in self.features_}
        self._fitted = True
        return self

    def unknown(self, df: DataFrame) -> dict[str, int]:
        """Rows whose value was not seen at fit, by column."""
        return one_row(df, {f: F.count_if(~value(df, f).cast("string").isin(self.categories_[f])) for f in self.features_})

    def transform(self, df: DataFrame) -> DataFrame:
        if not self._fitted:
            return df
        if self.warn_on_unknown and not df.isStreaming and (found := {f: n for f, n in self.unknown(df).items() if n}):
            warnings.warn(f"unknown categories: {found}", UserWarning, stacklevel=2)
        spark, out = df.sparkSession, df
        for f in self.features_:
            c, fill = value(df, f).cast("string"), F.lit(self.fills_[f])
            if len(self.categories_[f]) <= LITERAL_CATEGORIES:
                out = out.withColumn(f, F.when(c.isin(self.categories_[f]), c).otherwise(fill))
            else:
                known = spark.createDataFrame([(x,) for x in self.categories_[f]], "_known string")
                met = out.join(known, c == F.col("_known"), "left")
                out = met.select(*[F.coalesce("_known", fill).alias(x) if x == f else quoted(x) for x in df.columns])
        return out


class DtypesConverter(Operator):
    """Casts columns to the types learned at fit or given; a column with a value that can't be cast stays, with a warning."""

    def __init__(self, dtype_map: Mapping[str, str] | None = None):
        self.dtype_map = dtype_map

    def fit(self, df: DataFrame) -> DtypesConverter:
        self.types_ = dict(self.dtype_map or {f.name: f.dataType.simpleString() for f in df.schema})
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        moved = {c: t for c, t in self.types_.items() if c in df.columns and df.schema[c].dataType.simpleString() != t}
        if not moved:
            return df
        lost = one_row(df, {c: F.count_if(quoted(c).isNotNull() & quoted(c).try_cast(t).isNull()) for c, t in moved.items()}) if not df.isStreaming else dict.fromkeys(moved, 0)
        for c in (c for c, n in lost.items() if n):
            warnings.warn(f"{c} can't be cast to {moved[c]}", UserWarning, stacklevel=2)
        return df.withColumns({c: quoted(c).try_cast(t) for c, t in moved.items() if not lost[c]})


class NumericalDowncaster(Operator):
    """Whole numbers in the smallest type that holds them (float where there are nulls), floats as float."""

    SIZES = ((127, "tinyint"), (32767, "smallint"), (2**31 - 1, "int"))

    def __init__(self, columns: Sequence[str] | None = None, int_downcast: bool = True, float_downcast: bool = True):
        self.columns, self.int_downcast, self.float_downcast = columns, int_downcast, float_downcast

    def fit(self, df: DataFrame) -> NumericalDowncaster:
        names = list(self.columns) if self.columns is not None else [f.name for f in df.schema if is_numeric(f.dataType)]
        require(df, names)
        whole = [c for c in names if isinstance(df.schema[c].dataType, T.IntegralType)]
        found = one_row(df, {(k, c): a for c in whole for k, a in (("low", F.min(quoted(c))), ("high", F.max(quoted(c))), ("null", F.count_if(quoted(c).isNull())))})
        self.types_ = {c: "float" for c in names if is_float(df.schema[c].dataType)} if self.float_downcast else {}
        for c in whole if self.int_downcast else []:
            low, high = found["low", c], found["high", c]
            if found["null", c]:
                self.types_[c] = "float"
            elif low is not None:
                self.types_[c] = next((t for most, t in self.SIZES if -most - 1 <= low and high <= most), "bigint")
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        return df.withColumns({c: quoted(c).try_cast(t) for c, t in self.types_.items()})


def optimize_memory(df: DataFrame, categorical_features: Sequence[str] | None = None) -> DataFrame:
    """Numbers in smaller types, text columns kept to their categories."""
    return CategoricalAligner(categorical_features).fit_transform(NumericalDowncaster().fit_transform(df))


def label_of(c: Column, id2label: Mapping[int, str]) -> Column:
    """The label of an id; an unknown id stays, as text."""
    pairs = [x for k, v in id2label.items() for x in (F.lit(str(k)), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), c.cast("string")), c.cast("string")) if pairs else c.cast("string")
