"""Class-balance sampling. Random choices are hashes of the row's id, so that they are the same on every run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import is_numeric, quoted, require

STRATEGIES = ("none", "random_under", "random_over", "smote")


def random_under(df: DataFrame, target: str, id_col: str, seed: int = 17) -> DataFrame:
    """Every class cut to the size of the smallest: the rows of the lowest hashes.

    Classes are large, so no window holds one: the hash below which a class keeps its rows comes from brackets of
    hashes counted by class, and only the last bracket is ordered."""
    hashed = df.withColumn("_h", F.xxhash64(quoted(id_col), F.lit(seed)))
    least = df.groupBy(quoted(target).alias("_y")).count().agg(F.min("count")).first()[0] or 0
    bits = 16
    bracket = F.shiftrightunsigned(F.col("_h"), 64 - bits)
    n = hashed.groupBy(quoted(target).alias("_y"), bracket.alias("_b")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = n.withColumn("before", before).where(F.col("before") < least)  # at most 2 ** bits rows a class
    met = hashed.withColumns({"_k": quoted(target), "_kb": bracket}).join(F.broadcast(edge), F.col("_k").eqNullSafe(F.col("_y")) & (F.col("_kb") == F.col("_b")))
    whole = met.where(F.col("before") + F.col("n") <= least)
    order = Window.partitionBy("_k", "_b").orderBy("_h", quoted(id_col))
    part = met.where(F.col("before") + F.col("n") > least).withColumn("_at", F.row_number().over(order)).where(F.col("_at") + F.col("before") <= least)
    return whole.select(*[quoted(c) for c in df.columns]).unionByName(part.select(*[quoted(c) for c in df.columns]))


def random_over(df: DataFrame, target: str, id_col: str, seed: int = 17) -> DataFrame:
    """All rows, and draws with replacement until every class is as large as the largest: row i of n stands
    floor(need / n) times more, and the rows of the need % n lowest hashes once more."""
    sizes = df.groupBy(quoted(target).alias("_y")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    sizes = sizes.withColumn("need", F.lit(most) - F.col("n"))
    met = df.withColumn("_k", quoted(target)).join(F.broadcast(sizes), F.col("_k").eqNullSafe(F.col("_y")))
    whole = met.withColumn("_c", F.explode(F.array_repeat(F.lit(1), F.floor(F.col("need") / F.col("n")).cast("int"))))
    names = [quoted(c) for c in df.columns]
    out = df.unionByName(whole.select(*names))
    rest = met.where(F.col("need") % F.col("n") > 0).withColumn("_h", F.xxhash64(quoted(id_col), F.lit(seed)))
    at = F.row_number().over(Window.partitionBy("_k").orderBy("_h", quoted(id_col)))
    return out.unionByName(rest.withColumn("_at", at).where(F.col("_at") <= F.col("need") % F.col("n")).select(*names))


#: Rows of a class that one task compares with as many others.
BLOCK = 5000


def smote(df: DataFrame, target: str, id_col: str, k: int = 5, seed: int = 17) -> DataFrame:
    """All rows, and synthetic ones until every class is as large as the largest. A synthetic row lies between a row
    and one of its k nearest of its class; text columns take the commonest value among the neighbours.

    A class needs some rows, dealt evenly over its own by the hash of their ids. Blocks of those that are to grow are
    compared with every block of their class, and the k nearest of all are kept, so that no task holds a class. Synthetic
    ids are negative."""
    require(df, [target, id_col])
    numeric = [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in (target, id_col)]
    if not numeric:
        raise ValueError("smote needs numeric columns")
    sizes = {r["_y"]: r["n"] for r in df.groupBy(quoted(target).alias("_y")).agg(F.count("*").alias("n")).collect()}
    top = max(sizes.values(), default=0)
    scale = df.agg(*[F.stddev(quoted(c).cast("double")).alias(c) for c in numeric]).first()
    minority = sorted((y for y, n in sizes.items() if n < top and y is not None), key=str)
    if not minority:
        return df
    first = np.cumsum([0, *(top - sizes[y] for y in minority)]).tolist()
    plan = df.sparkSession.createDataFrame([(y, sizes[y], top - sizes[y], i) for y, i in zip(minority, first, strict=False)], T.StructType([T.StructField("_y", df.schema[target].dataType), *T._parse_datatype_string("_n long, _need long, _first long")]))
    whole = {f.name for f in df.schema if f.dataType.typeName() not in ("double", "float")}
    names, scales = df.columns, np.array([float(scale[c] or 1.0) for c in numeric])
    order = Window.partitionBy(quoted(target)).orderBy(F.xxhash64(quoted(id_col), F.lit(seed)), quoted(id_col), *[quoted(c) for c in numeric])
    rows = df.join(F.broadcast(plan), quoted(target) == F.col("_y")).drop("_y").withColumn("_at", F.row_number().over(order) - 1).withColumn("_block", F.floor(F.col("_at") / BLOCK))
    rows = rows.withColumn("_copies", F.floor(F.col("_need") / F.col("_n")) + (F.col("_at") < F.col("_need") % F.col("_n")).cast("long"))
    grown = rows.where("_copies > 0")
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / BLOCK)))
    place = [quoted(target), "_at", *[F.coalesce(quoted(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(numeric)]]
    asked = grown.select(*place, F.col("_block").alias("_qb"), blocks(F.col("_n")).alias("_db"), F.lit(True).alias("_asks"))
    given = rows.select(*place, blocks(F.least("_need", "_n")).alias("_qb"), F.col("_block").alias("_db"), F.lit(False).alias("_asks"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(pdf[[f"_x{i}" for i in range(len(numeric))]].to_numpy(float)) / scales
        asks, at = pdf["_asks"].to_numpy(bool), pdf["_at"].to_numpy()
        q, d, q_at, d_at = x[asks], x[~asks], at[asks], at[~asks]
        kk, out = min(k, len(d)), []
        for i in range(0, len(q), 512):
            far = sum((q[i : i + 512, c, None] - d[:, c]) ** 2 for c in range(len(numeric)))
            far[q_at[i : i + 512, None] == d_at] = np.inf
            near = np.argpartition(far, kk - 1, axis=1)[:, :kk] if kk else np.zeros((len(far), 0), np.int64)
            out.append(pd.DataFrame({"_at": np.repeat(q_at[i : i + 512], kk), "_other": d_at[near].ravel(), "_far": np.take_along_axis(far, near, 1).ravel()}))
        found = pd.concat(out) if out else pd.DataFrame({"_at": [], "_other": [], "_far": []})
        found = found[np.isfinite(found["_far"])]
        return found.assign(**{target: pdf[target].iloc[0]})[[target, "_at", "_other", "_far"]]

    kinds = T.StructType([df.schema[target], *T._parse_datatype_string("_at long, _other long, _far double")])
    met = asked.unionByName(given).groupBy(quoted(target), "_qb", "_db").applyInPandas(nearest, kinds)
    rank = F.row_number().over(Window.partitionBy(quoted(target), "_at").orderBy("_far", "_other"))
    met = met.withColumn("_rank", rank.cast("long")).where(F.col("_rank") <= k).select(quoted(target).alias("_y"), F.col("_at").alias("_base"), "_other", "_rank")
    others = met.join(rows, (F.col("_y") == quoted(target)) & (F.col("_other") == F.col("_at")))
    kept = [*[quoted(c) for c in names], "_base", "_rank", "_copies", "_need", "_n", "_first"]
    pool = grown.withColumns({"_base": F.col("_at").cast("long"), "_rank": F.lit(0).cast("long")}).select(*kept).unionByName(others.select(*kept))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_base", "_rank"]).reset_index(drop=True)
        begun = np.flatnonzero(pdf["_rank"].to_numpy() == 0)
        near, copies, at = np.diff(np.append(begun, len(pdf))) - 1, pdf["_copies"].to_numpy()[begun], pdf["_base"].to_numpy()[begun]
        need, n, start = (int(pdf[c].iloc[0]) for c in ("_need", "_n", "_first"))
        which = np.repeat(np.arange(len(begun)), copies)
        rng = np.random.default_rng([seed, start, int(at[0])])
        base = begun[which]
        other = base + np.where(near[which] > 0, 1 + np.floor(rng.random(len(base)) * near[which]).astype(np.int64), 0)
        gap, out = rng.random(len(base)), pdf.iloc[base].copy()
        for c in numeric:
            a, b = pdf[c].to_numpy(float)[base], pdf[c].to_numpy(float)[other]
            v = a + gap * (b - a)
            out[c] = v if c not in whole else np.rint(np.nan_to_num(v)).astype("int64")
        for c in set(names) - {*numeric, target, id_col}:
            values = pdf[c].to_numpy(object)
            common = [max(sorted(set(v := list(values[b + 1 : b + 1 + m]) or [values[b]]), key=str), key=v.count) for b, m in zip(begun, near, strict=True)]
            out[c] = [common[w] for w in which]
        nth = np.arange(len(base)) - np.repeat(np.cumsum(copies) - copies, copies)
        out[id_col] = -1 - (start + at[which] * (need // n) + np.minimum(at[which], need % n) + nth)
        return out[names]

    made = pool.groupBy(quoted(target), F.floor(F.col("_base") / BLOCK)).applyInPandas(lambda pdf: grow(pdf), df.schema)
    return df.unionByName(made)


class FoldwiseSampler:
    """A strategy of the four, learned on nothing: fit records it, fit_resample applies it; before fit rows pass."""

    def __init__(self, target: str, id_col: str, strategy: str = "none", seed: int = 17):
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
        self.target, self.id_col, self.strategy, self.seed, self._fitted = target, id_col, strategy, seed, False

    def fit(self, df: DataFrame) -> FoldwiseSampler:
        require(df, [self.target, self.id_col])
        self._fitted = True
        return self

    def fit_resample(self, df: DataFrame) -> DataFrame:
        if not self._fitted or self.strategy == "none":
            return df
        return {"random_under": random_under, "random_over": random_over, "smote": smote}[self.strategy](df, self.target, self.id_col, seed=self.seed)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).fit_resample(df)


def hash_sample(df: DataFrame, n: int, id_col: str, seed: int = 17) -> DataFrame:
    """The n rows of the lowest hashes of their ids."""
    return df.orderBy(F.xxhash64(quoted(id_col), F.lit(seed)), quoted(id_col)).limit(n)

