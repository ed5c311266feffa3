"""Tree SHAP values (Lundberg et al., 2018) of pyspark.ml tree models, computed on Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import quoted
from .trees import nodes

#: Estimators of an ensemble, and depth to which ensembles may hold ensembles.
MOST_MODELS, MOST_DEPTH = 50, 10


class Paths:
    """The leaves of a tree: for each the features on its path with the tests that lead there and the share of rows that
    pass them, and the value."""

    def __init__(self, tree: list[dict], classes: int | None):
        self.leaves: list[tuple[dict, np.ndarray]] = []
        self.classes = classes
        self._walk(tree, 0, {})

    def _cover(self, tree: list[dict], i: int) -> float:
        stats = tree[i]["stats"]
        return float(stats[0]) if self.classes is None else float(sum(stats))

    def _walk(self, tree: list[dict], i: int, path: dict) -> None:
        n = tree[i]
        if n["feature"] < 0:
            if self.classes is None:
                value = np.array([n["value"]])
            else:
                stats = np.array(n["stats"], float)
                value = stats / stats.sum() if stats.sum() else np.full(self.classes, 1 / self.classes)
            self.leaves.append((path, value))
            return
        f, whole = n["feature"], self._cover(tree, i)
        tests, share = path.get(f, ((), 1.0))
        condition = n["threshold"] if n["categories"] is None else n["categories"]
        for child, goes_left in ((n["left"], True), (n["right"], False)):
            self._walk(tree, child, path | {f: ((*tests, (condition, goes_left)), share * (self._cover(tree, child) / whole if whole else 0.5))})

    @staticmethod
    def _takes(x: np.ndarray, tests: tuple) -> np.ndarray:
        """Which values pass all tests of a path: at or below a threshold, or among categories, or not so."""
        out = np.ones(len(x), bool)
        for condition, goes_left in tests:
            out &= (np.isin(x, list(condition)) if isinstance(condition, frozenset) else x <= condition) == goes_left
        return out

    def values(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, features, outputs) contributions and the expectation. A leaf's game is a product over its features: one
        if the row takes the path there, the share of rows if not; its Shapley values come from the polynomial of that
        product with one feature left out."""
        outputs = len(self.leaves[0][1])
        phi, base = np.zeros((len(x), x.shape[1], outputs)), np.zeros(outputs)
        for path, value in self.leaves:
            features = list(path)
            d = len(features)
            share = np.array([path[f][1] for f in features])
            base += share.prod() * value
            if not d:
                continue
            takes = np.stack([self._takes(x[:, f], path[f][0]) for f in features], 1).astype(float)
            weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
            for i, f in enumerate(features):
                poly = np.zeros((len(x), d))  # by the number of features that are known
                poly[:, 0] = 1
                for j in range(d):
                    if j != i:
                        poly[:, 1:] = poly[:, 1:] * share[j] + poly[:, :-1] * takes[:, j : j + 1]
                        poly[:, 0] *= share[j]
                phi[:, f] += ((poly @ weight) * (takes[:, i] - share[i]))[:, None] * value
        return phi, base


def tree_paths(model) -> list[tuple[float, Paths]]:
    """(weight, paths) of each tree of a fitted tree, forest or boosted model."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    classes = last.numClasses if hasattr(last, "numClasses") and not type(last).__name__.startswith("GBT") else None
    if hasattr(last, "trees"):
        weights = list(last.treeWeights) if type(last).__name__.startswith("GBT") else [1 / len(last.trees)] * len(last.trees)
        return [(w, Paths(nodes(t), classes)) for w, t in zip(weights, last.trees, strict=True)]
    if not hasattr(last, "_java_obj") or not hasattr(last, "depth"):
        raise TypeError(f"{type(last).__name__} is not a tree model")
    return [(1.0, Paths(nodes(last), classes))]


def compute_shap_values(model, df: DataFrame, features: Sequence[str], depth: int = 0) -> DataFrame:
    """df with shap, an array of (features x outputs) contributions, row by row of features, and shap_base.

    A list of (weight, model) pairs is an ensemble: its values are the weighted sum, weights scaled by their absolute sum."""
    if depth > MOST_DEPTH:
        raise ValueError(f"ensembles are nested more than {MOST_DEPTH} deep")
    flat = _flatten(model, depth)
    if len(flat) > MOST_MODELS:
        raise ValueError(f"there are more than {MOST_MODELS} models")
    pipeline = flat[0][1]
    assembled = df
    for stage in pipeline.stages[:-1]:
        assembled = stage.transform(assembled)
    parts = [(w * tw, p) for w, m in flat for tw, p in tree_paths(m)]
    shared = df.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("shap array<double>, shap_base array<double>")
    def explain(rows: pd.Series) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"shap": [], "shap_base": []})
        x = np.stack(rows.to_numpy())
        total, base = 0.0, 0.0
        for w, p in shared.value:
            phi, b = p.values(x)
            total, base = total + w * phi, base + w * b
        return pd.DataFrame({"shap": list(total.reshape(len(x), -1)), "shap_base": [base] * len(x)})

    out = assembled.withColumn("_shap", explain(vector_to_array("_features")))
    return out.select(*[quoted(c) for c in df.columns], "_shap.shap", "_shap.shap_base")


def _flatten(model, depth: int) -> list[tuple[float, object]]:
    if depth > MOST_DEPTH:
        raise ValueError(f"ensembles are nested more than {MOST_DEPTH} deep")
    if not isinstance(model, list):
        return [(1.0, model)]
    total = sum(abs(w) for w, _ in model)
    if not total:
        raise ValueError("the weights sum to zero")
    return [(w / total * v, m) for w, inner in model for v, m in _flatten(inner, depth + 1)]


def mean_absolute_shap(values: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Each feature's mean absolute contribution, summed over the outputs; one aggregation."""
    n = len(features)
    long = values.select(F.posexplode("shap").alias("i", "v"), (F.size("shap") / n).cast("int").alias("k"))
    rows = long.groupBy(F.floor(F.col("i") / F.col("k")).cast("int").alias("f")).agg((F.sum(F.abs("v"))).alias("s"), F.count("*").alias("n"), F.max("k").alias("k"))
    found = {r["f"]: r["s"] * r["k"] / r["n"] for r in rows.collect()}
    return {f: found.get(i, 0.0) for i, f in enumerate(features)}

