"""Trees on one column, grown by pyspark.ml and read back as cuts and leaf values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import number


@dataclass
class Tree:
    """Leaf i holds the values in (cuts[i - 1], cuts[i]]."""

    cuts: list[float]
    values: list[float]

    def __call__(self, x: float) -> float:
        return self.values[int(np.searchsorted(self.cuts, x, "left"))]


def nodes(model) -> list[dict]:
    """The nodes of an ML tree by their id: feature (-1 for a leaf), threshold or the categories that go left,
    left, right, value (the prediction) and stats (of its rows)."""
    rows = model._java_obj if hasattr(model, "_java_obj") else model
    out: list[dict] = []

    def walk(node) -> int:
        at = len(out)
        out.append({})
        stats = list(node.impurityStats().stats()) if hasattr(node, "impurityStats") else []
        leaf = node.getClass().getSimpleName() == "LeafNode"
        if leaf:
            out[at] = {"feature": -1, "threshold": 0.0, "left": -1, "right": -1, "value": node.prediction(), "stats": stats, "categories": None}
        else:
            split = node.split()
            continuous = split.getClass().getSimpleName() == "ContinuousSplit"
            left, right = walk(node.leftChild()), walk(node.rightChild())
            out[at] = {
                "feature": split.featureIndex(), "threshold": split.threshold() if continuous else 0.0, "left": left, "right": right, "value": node.prediction(), "stats": stats,
                "categories": None if continuous else frozenset(split.leftCategories()),
            }
        return at

    walk(rows.rootNode())
    return out


def _leaves(all_nodes: list[dict], classes: bool) -> Tree:
    cuts, values = [], []

    def walk(i: int) -> None:
        n = all_nodes[i]
        if n["feature"] < 0:
            total = sum(n["stats"])
            values.append(n["stats"][1] / total if classes and len(n["stats"]) > 1 and total else 0.0 if classes else n["value"])
            return
        walk(n["left"])
        cuts.append(n["threshold"])
        walk(n["right"])

    walk(0)
    return Tree(cuts, values)


def best_tree(df: DataFrame, x: str, target: str, regression: bool, depths: Sequence[int], folds: int, seed: int) -> Tree:
    """The tree on x of the depth whose squared error is least over the folds (rows are dealt by a hash of their values)."""
    rows = df.select(number(df, x).alias("x"), number(df, target).alias("label")).where("x is not null and label is not null")
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("x", "label", F.lit(seed)), F.lit(max(folds, 2))).cast("int")).persist()
    kind = DecisionTreeRegressor if regression else DecisionTreeClassifier
    grow = lambda part, depth: _leaves(nodes(kind(maxDepth=depth, seed=seed).fit(part)), not regression)
    errors = {}
    for depth in depths if len(depths) > 1 else []:
        parts = []
        for k in range(max(folds, 2)):
            tree = grow(rows.where(F.col("fold") != k), depth)
            cuts = F.array(*[F.lit(float(c)) for c in tree.cuts]) if tree.cuts else F.array().cast("array<double>")
            guess = F.get(F.array(*[F.lit(float(v)) for v in tree.values]), F.size(F.filter(cuts, lambda c: c < F.col("x"))))
            parts.append(F.when(F.col("fold") == k, F.pow(guess - F.col("label"), 2)))
        errors[depth] = rows.agg(F.avg(F.coalesce(*parts))).first()[0]
    out = grow(rows, min(errors, key=lambda d: (errors[d], d)) if errors else depths[0])
    rows.unpersist()
    return out
