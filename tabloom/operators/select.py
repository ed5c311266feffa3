"""Feature selection: filters and recursive elimination with cross-validated metrics."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import LITERAL_ENTRIES, Operator, quoted, require
from ..functions.stats import before_all
from .profile import mutual_information_scores
from .sample import hash_sample
from .shap import compute_shap_values, mean_absolute_shap
from .train import CrossValidationTrainer, fold_of, importances, score_of

HISTORY = "step int, n_features_removed int, n_features_remaining int, removed_feature_name string, metric_value double, metric_change double, importance_score double"


class MutualInformationFiltering(Operator):
    """Keeps the columns whose mutual information with the target reaches the threshold, or the k best."""

    def __init__(self, target: str, problem_type: str = "classification", threshold: float = 0.1, keep_top_k: int | None = None, features: Sequence[str] | None = None):
        if keep_top_k is not None and keep_top_k <= 0:
            raise ValueError("keep_top_k must be positive")
        self.target, self.problem_type, self.threshold, self.keep_top_k, self.features = target, problem_type, threshold, keep_top_k, features

    def fit(self, df: DataFrame) -> MutualInformationFiltering:
        names = list(self.features or [c for c in df.columns if c != self.target])
        self.scores_ = mutual_information_scores(df, names, self.target, self.problem_type)
        self.selected_ = list(self.scores_)[: self.keep_top_k] if self.keep_top_k else [f for f, s in self.scores_.items() if s >= self.threshold]
        self._fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._require_fit()
        if not self.selected_:
            raise ValueError("no feature was selected")
        gone = set(self.scores_) - set(self.selected_)
        return df.select(*[quoted(c) for c in df.columns if c not in gone])


def compute_removal_schedule(n: int, steps: int, keep: int = 0) -> list[int]:
    """How many of n features go at each step: falling from 1 to 0.2 in proportion, rounded to a sum of n - keep."""
    n -= keep
    if n <= 0 or steps <= 0:
        return []
    share = [1 - 0.8 * i / max(steps - 1, 1) for i in range(steps)]
    out = [round(n * s / sum(share)) for s in share]
    i = 0
    while (rest := n - sum(out)) and i < 10 * steps:
        j = i % steps
        if rest > 0 or out[j]:
            out[j] += 1 if rest > 0 else -1
        i += 1
    while out and not out[-1]:
        out.pop()
    return out


def select_features_weighted_score(history: Sequence[tuple], features: Sequence[str], direction: str, alpha: float = 0.95, protected: Sequence[str] = ()) -> list[str]:
    """The features still there after the step of the best alpha * metric + (1 - alpha) * sparsity, both scaled to 0..1."""
    sign = 1 if direction == "maximize" else -1
    values = [sign * h[4] for h in history]
    low, high = min(values), max(values)
    most = max(h[1] for h in history) or 1
    score = [alpha * ((v - low) / (high - low) if high > low else 1.0) + (1 - alpha) * h[1] / most for v, h in zip(values, history, strict=True)]
    best = max(range(len(history)), key=lambda i: score[i])
    gone = {h[3] for h in history[: best + 1] if h[3]}
    return [f for f in features if f not in gone or f in protected]


class _Elimination:
    """Removes features by a schedule, the least important first, and scores the rest by cross-validation after each step."""

    def __init__(self, estimator, cross_validator: CrossValidationTrainer, steps: int = 5, alpha: float = 0.95, protected_features: Sequence[str] = ()):
        if not 0 <= alpha <= 1:
            raise ValueError("alpha must be between 0 and 1")
        self.estimator, self.cv, self.steps, self.alpha, self.protected = estimator, cross_validator, steps, alpha, list(protected_features)

    def prepare(self, df: DataFrame, features: list[str]) -> None:
        pass

    def scores(self, df: DataFrame, features: list[str]) -> dict[str, float]:
        raise NotImplementedError

    def evaluate(self, df: DataFrame, features: list[str]) -> float:
        self.cv.trainer.features = list(features)
        return sum(found := self.cv.fit(self.estimator, df)[1]) / len(found)

    def run(self, df: DataFrame, features: Sequence[str] | None = None) -> list[str]:
        now = list(features or self.cv.trainer.features)
        require(df, [*now, *self.protected])
        rows, begun = df.persist(), list(now)
        self.prepare(rows, now)
        base = self.evaluate(rows, now)
        self.history_ = [(0, 0, len(now), None, base, 0.0, None)]
        free = [f for f in now if f not in self.protected]
        step = 0
        for n in compute_removal_schedule(len(free), self.steps, keep=0 if self.protected else 1):
            ranked = sorted((f for f in now if f not in self.protected), key=lambda f, s=(scores := self.scores(rows, now)): (s.get(f, 0.0), f))
            gone = ranked[:n]
            now = [f for f in now if f not in gone]
            if not now:
                break
            value = self.evaluate(rows, now)
            step += 1
            for f in gone:
                self.history_.append((step, len(begun) - len(now), len(now), f, value, value - base, scores.get(f)))
        rows.unpersist()
        self.selected_ = select_features_weighted_score(self.history_, begun, self.cv.direction, self.alpha, self.protected)
        self.cv.trainer.features = begun
        return self.selected_

    def history(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history_, HISTORY)


class MutualInformationRecursiveFeatureElimination(_Elimination):
    def prepare(self, df: DataFrame, features: list[str]) -> None:
        self.information_ = mutual_information_scores(df, features, self.cv.target, self.cv.problem_type)

    def scores(self, df: DataFrame, features: list[str]) -> dict[str, float]:
        return self.information_


class ModelImportanceRecursiveFeatureElimination(_Elimination):
    """By the mean importance over the fold models of the last evaluation."""

    def scores(self, df: DataFrame, features: list[str]) -> dict[str, float]:
        each = [importances(m.stages[-1], len(features)) for _, m in self.cv.models_]
        return {f: sum(e[i] for e in each) / len(each) for i, f in enumerate(features)}


class ModelImportanceFiltering(ModelImportanceRecursiveFeatureElimination):
    """Drops every feature whose mean importance is at or below the threshold, again and again until none is."""

    def __init__(self, estimator, cross_validator: CrossValidationTrainer, threshold: float = 0.0, max_steps: int = 10, protected_features: Sequence[str] = ()):
        super().__init__(estimator, cross_validator, max_steps, 1.0, protected_features)
        self.threshold = threshold

    def run(self, df: DataFrame, features: Sequence[str] | None = None) -> list[str]:
        now = list(features or self.cv.trainer.features)
        require(df, now)
        rows, begun = df.persist(), list(now)
        base = self.evaluate(rows, now)
        self.history_ = [(0, 0, len(now), None, base, 0.0, None)]
        for step in range(1, self.steps + 1):
            found = self.scores(rows, now)
            gone = [f for f in now if found[f] <= self.threshold and f not in self.protected]
            if not gone or len(gone) == len(now):
                break
            now = [f for f in now if f not in gone]
            value = self.evaluate(rows, now)
            self.history_ += [(step, len(begun) - len(now), len(now), f, value, value - base, found[f]) for f in gone]
        rows.unpersist()
        self.selected_, self.cv.trainer.features = now, begun
        return now


def dealt(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """df with _at, each row's place from 0 in the order of a hash of its id. Rows are numbered in brackets of the hash
    whose counts are summed, so that no task orders them all; they are shuffled once."""
    h = F.xxhash64(quoted(id_col), F.lit(seed))
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned("_h", 52))
    before = df.select(F.shiftrightunsigned(h, 52).alias("_b")).groupBy("_b").count()
    before = before.select("_b", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    starts = {r["_b"]: r["_before"] for r in before.collect()}  # of 4,096 brackets
    at = F.row_number().over(Window.partitionBy("_b").orderBy("_h", quoted(id_col)))
    start = F.get(F.lit([int(starts.get(i, 0)) for i in range(1 << 12)]), F.col("_b").cast("int"))
    return rows.withColumn("_at", at - 1 + start).drop("_h", "_b")


def _turned(n: int, turn: int) -> Column:
    """_at, or for later turns another place of the same n: no two places become one."""
    if not turn or n < 3:
        return F.col("_at")
    step = next(a for a in range(max(2, int(n * (0.6180339887 * turn % 1))), 2 * n) if gcd(a, n) == 1)
    return ((F.col("_at").cast("decimal(19,0)") * F.lit(step).cast("decimal(19,0)")) % F.lit(n).cast("decimal(19,0)")).cast("long")


def permuted_feature(df: DataFrame, feature: str, n: int, turn: int = 0) -> DataFrame:
    """df, n rows with _at, with the feature's values dealt anew: the row of the i-th place takes the i-th of all values
    in their own order. Few distinct values are cases in the plan; many are joined by their places."""
    counts = df.groupBy(quoted(feature).alias("_v")).agg(F.count("*").alias("_n"))
    few = counts.limit(LITERAL_ENTRIES + 1).collect()
    if len(few) <= LITERAL_ENTRIES:
        kind, ends, end = df.schema[feature].dataType, [], 0
        for v, m in sorted(few, key=lambda r: (r[0] is not None, r[0] != r[0], r[0]) if r[0] is not None else (False,)):
            end += m
            ends.append((end, v))

        def choose(low: int, high: int) -> Column:
            if high - low == 1:
                return F.lit(ends[low][1]).cast(kind)
            mid = (low + high) // 2
            return F.when(F.col("_to") < ends[mid - 1][0], choose(low, mid)).otherwise(choose(mid, high))

        out = df.withColumn("_to", _turned(n, turn)).withColumn("_v", choose(0, len(ends))) if ends else df.withColumn("_v", quoted(feature))
    else:
        placed = before_all(counts, ["_v"], n, "_n")
        values = placed.select("_v", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("_n") - 1)).alias("_to"))
        out = df.withColumn("_to", _turned(n, turn)).join(values, "_to")
    return out.select(*[F.col("_v").alias(c) if c == feature else quoted(c) for c in df.columns if c != "_at"])


def permuted(df: DataFrame, feature: str, id_col: str, seed: int) -> DataFrame:
    """df with the feature's values dealt anew, by a hash of the id."""
    return permuted_feature(dealt(df, id_col, seed), feature, df.count())


class PermutationRecursiveFeatureElimination(_Elimination):
    """By the loss of the metric when a feature's values are dealt anew, over the fold models of the first evaluation."""

    def __init__(self, estimator, cross_validator: CrossValidationTrainer, steps: int = 5, n_repeats: int = 5, alpha: float = 0.95, protected_features: Sequence[str] = ()):
        super().__init__(estimator, cross_validator, steps, alpha, protected_features)
        self.n_repeats, self.importances_ = n_repeats, {}

    def scores(self, df: DataFrame, features: list[str]) -> dict[str, float]:
        if self.importances_:
            return self.importances_
        cv, sign = self.cv, 1 if self.cv.direction == "maximize" else -1
        fold = cv.fold if cv.fold is not None else fold_of(cv.id_col, cv.folds, cv.seed)
        rows = df.withColumn("_fold", fold)
        kept = df.columns if cv.preprocessing else []  # a preprocessing pipeline may read any column

        def one(k: int) -> dict[str, float]:
            part, (step, model) = rows.where(F.col("_fold") == k), cv.models_[k]
            valid = dealt(part.select(*[quoted(c) for c in df.columns if c in {*features, cv.id_col, cv.target, *kept}]), cv.id_col, cv.seed).persist()
            n = valid.count()
            value = lambda d: score_of(cv.metric, cv.metric_type, cv.trainer.predict(model, step.transform(d) if step is not None else d), cv.target)
            base = value(valid.drop("_at"))
            out = {f: sum(sign * (base - value(permuted_feature(valid, f, n, r))) for r in range(self.n_repeats)) / self.n_repeats for f in features}
            valid.unpersist()
            return out

        found = [one(k) for k in range(cv.folds)]  # one at a time: only one fold's places are kept
        self.importances_ = {f: sum(x[f] for x in found) / len(found) for f in features}
        return self.importances_


class ShapRecursiveFeatureElimination(_Elimination):
    """By the mean absolute SHAP value over the fold models, on at most max_samples_shap rows of the lowest hashes."""

    def __init__(self, estimator, cross_validator: CrossValidationTrainer, steps: int = 5, max_samples_shap: int = 50_000, alpha: float = 0.95, protected_features: Sequence[str] = ()):
        super().__init__(estimator, cross_validator, steps, alpha, protected_features)
        self.max_samples_shap = max_samples_shap

    def scores(self, df: DataFrame, features: list[str]) -> dict[str, float]:
        cv = self.cv
        fold = cv.fold if cv.fold is not None else fold_of(cv.id_col, cv.folds, cv.seed)
        rows = hash_sample(df, self.max_samples_shap, cv.id_col, cv.seed).withColumn("_fold", fold).persist()
        each = [mean_absolute_shap(compute_shap_values(m, (s.transform(p) if s is not None else p), features), features) for k, (s, m) in enumerate(cv.models_) for p in [rows.where(F.col("_fold") == k)]]
        rows.unpersist()
        return {f: sum(e[f] for e in each) / len(each) for f in features}
