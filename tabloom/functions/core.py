"""What all operators share: column types, missing values, fitted state and lookups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a fitted lookup table that may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Entries of a lookup that become a literal in the plan.
LITERAL_ENTRIES = 200


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)


def numeric_columns(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in set(but)]


def string_columns(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in set(but)]


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN as null: there is one notion of a missing value."""
    c = quoted(name)
    return F.nanvl(c, F.lit(None).cast(df.schema[name].dataType)) if is_float(df.schema[name].dataType) else c


def number(df: DataFrame, name: str) -> Column:
    return value(df, name).cast("double")


class Operator:
    """fit learns a small state from a DataFrame in as few jobs as it can; transform stays a lazy plan."""

    _fitted = False

    def fit(self, df: DataFrame) -> Operator:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def _require_fit(self) -> None:
        if not self._fitted:
            raise AttributeError(f"{type(self).__name__} is not fitted")


def chunks(items: Sequence, size: int) -> Iterable[Sequence]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


def one_row(df: DataFrame, exprs: dict[str, Column], size: int = 400) -> dict:
    """The aggregates, in one job for each `size` of them (generated code has its limits)."""
    out: dict = {}
    names = list(exprs)
    for some in chunks(names, size):
        row = df.agg(*[exprs[n].alias(f"a{i}") for i, n in enumerate(some)]).first()
        out |= {n: row[i] for i, n in enumerate(some)}
    return out


def unpivot(df: DataFrame, names: Sequence[str], kind: str = "string", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value): a row for each of the columns, read once for all of them."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), value(df, n).cast(kind).alias("value")) for n in names])
    return df.select(*[quoted(k) for k in keep], F.explode(pairs).alias("p")).select(*[quoted(k) for k in keep], "p.feature", "p.value")


def counts_of(df: DataFrame, name: str, alias: str = "n") -> DataFrame:
    """(key, n) of the non-null values."""
    return df.select(value(df, name).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias(alias))


class Lookup:
    """A fitted table key -> values. Small ones are literals in the plan, middling ones a broadcast join, and those
    whose counted rows are past the bound a shuffled join."""

    def __init__(self, table: DataFrame, key: str = "key"):
        self.key, self.names = key, [c for c in table.columns if c != key]
        self.kinds = {c: table.schema[c].dataType for c in self.names}
        self.table = table.persist()
        self.rows = self.table.count()
        self.entries = None
        if self.rows <= LITERAL_ENTRIES:  # held by the plan; its table isn't read again
            self.entries = {r[key]: tuple(r[c] for c in self.names) for r in self.table.collect()}
            self.table.unpersist()

    def column(self, of: Column, name: str) -> Column:
        """The value as an expression, for a lookup that is small."""
        at = self.names.index(name)
        pairs = [x for k, v in self.entries.items() if k is not None for x in (F.lit(k), F.lit(v[at]).cast(self.kinds[name]))]
        if not pairs:
            return F.lit(None).cast(self.kinds[name])
        return F.element_at(F.create_map(*pairs), of) if len(pairs) > 2 else F.when(of == pairs[0], pairs[1])

    def add(self, df: DataFrame, of: Column, outs: dict[str, str], default: dict | None = None) -> DataFrame:
        """df with column outs[name] for each name; keys that aren't there, and null, get the default."""
        default = default or {}
        fill = lambda c, n: F.coalesce(c, F.lit(default[n]).cast(self.kinds[n])) if default.get(n) is not None else c
        if self.entries is not None:
            return df.withColumns({out: fill(self.column(of, n), n) for n, out in outs.items()})
        table = self.table.select(quoted(self.key).alias("_key"), *[quoted(n).alias(f"_v_{n}") for n in outs])
        table = F.broadcast(table) if self.rows <= BROADCAST_ROWS else table
        kept = df.withColumn("_of", of).join(table, F.col("_of") == F.col("_key"), "left")
        return kept.select(*[quoted(c) for c in df.columns if c not in outs.values()], *[fill(quoted(f"_v_{n}"), n).alias(out) for n, out in outs.items()])
