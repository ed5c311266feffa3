"""Training on pyspark.ml estimators: cross-validation, out-of-fold prediction, ensembles and calibration.

A feature frame is a DataFrame with an id, a target and feature columns. Predictions are columns: `prediction`, and for
classes `probability`, an array of doubles. Text features are indexed (unseen ones apart)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import quoted, require
from .metrics import CustomMetricsHandler, Metric, argmax

PROBLEMS = ("classification", "regression")
FOLDS, SEED, CALIBRATION = 5, 17, ("isotonic", "sigmoid")
#: Fits that run side by side.
AT_ONCE = 4


def check_problem(problem_type: str) -> None:
    if problem_type not in PROBLEMS:
        raise ValueError(f"problem_type must be one of {', '.join(PROBLEMS)}")


def fold_of(id_col: str, folds: int, seed: int = SEED) -> Column:
    """The fold of a row, from its id alone: disjoint, exhaustive and the same on every run."""
    return F.pmod(F.xxhash64(quoted(id_col), F.lit(seed)), F.lit(folds)).cast("int")


def in_parallel(function: Callable, items: Sequence) -> list:
    if len(items) < 2:
        return [function(i) for i in items]
    with ThreadPool(min(AT_ONCE, len(items))) as pool:
        return pool.map(inheritable_thread_target(function), items)


class BaseTrainer:
    """Fits one estimator on feature columns and predicts with plain array columns."""

    def __init__(self, problem_type: str, target: str, features: Sequence[str], weight: str | None = None):
        check_problem(problem_type)
        self.problem_type, self.target, self.features, self.weight = problem_type, target, list(features), weight

    def stages(self, df: DataFrame) -> list:
        texts = [c for c in self.features if isinstance(df.schema[c].dataType, T.StringType | T.BooleanType)]
        index = [StringIndexer(inputCols=texts, outputCols=[f"_ix_{c}" for c in texts], handleInvalid="keep")] if texts else []
        inputs = [f"_ix_{c}" if c in texts else c for c in self.features]
        return [*index, VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep")]

    def fit_estimator(self, estimator, df: DataFrame, valid: DataFrame | None = None):
        """The fitted pipeline. With a validation frame, estimators that stop early (gradient-boosted trees) watch it."""
        require(df, [*self.features, self.target])
        own = estimator.copy()
        own.setParams(featuresCol="_features", labelCol="_label")
        rows = df.withColumn("_label", quoted(self.target).cast("double"))
        if self.weight:
            own.setParams(weightCol=self.weight)
        if valid is not None and own.hasParam("validationIndicatorCol"):
            own.setParams(validationIndicatorCol="_valid")
            both = valid.withColumn("_label", quoted(self.target).cast("double"))
            rows = rows.withColumn("_valid", F.lit(False)).unionByName(both.withColumn("_valid", F.lit(True)), allowMissingColumns=True)
        return Pipeline(stages=[*self.stages(df), own]).fit(rows)

    def predict(self, model, df: DataFrame) -> DataFrame:
        out = model.transform(df.drop("prediction", "probability"))
        keep = [quoted(c) for c in df.columns if c not in ("prediction", "probability")]
        if self.problem_type == "classification":
            return out.select(*keep, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("probability"))
        return out.select(*keep, "prediction")

    def fit_and_predict(self, estimator, df: DataFrame, valid: DataFrame) -> tuple:
        model = self.fit_estimator(estimator, df, valid)
        return model, self.predict(model, df), self.predict(model, valid)


def score_of(metric: Metric, kind: str, df: DataFrame, target: str) -> float:
    return metric(df, target, "probability" if kind == "probs" else "prediction")


def mean_arrays(arrays: Sequence[Column]) -> Column:
    total = arrays[0]
    for a in arrays[1:]:
        total = F.zip_with(total, a, lambda x, y: x + y)
    return F.transform(total, lambda x: x / len(arrays))


def blended(arrays: Sequence[Column], weights: Sequence[float]) -> Column:
    """The weighted sum of arrays, place by place."""
    scaled = lambda a, w: F.transform(a, lambda p: p * F.lit(float(w)))
    total = scaled(arrays[0], weights[0])
    for a, w in zip(arrays[1:], weights[1:], strict=True):
        total = F.zip_with(total, scaled(a, w), lambda x, y: x + y)
    return total


class CrossValidationTrainer:
    """Fits the estimator once for each fold on the others; a preprocessing pipeline, if given, is fitted there too."""

    def __init__(
        self, problem_type: str, metric_name: str, target: str, features: Sequence[str], id_col: str, folds: int = FOLDS, seed: int = SEED,
        preprocessing: Callable[[], object] | None = None, custom_metric: dict | None = None, fold: Column | None = None,
    ):
        self.trainer = BaseTrainer(problem_type, target, features)
        self.problem_type, self.target, self.id_col, self.folds, self.seed = problem_type, target, id_col, folds, seed
        self.metric_name, self.metric, self.metric_type, self.direction = CustomMetricsHandler.extract_metric_details(custom_metric, metric_name)
        self.preprocessing, self.fold, self.models_ = preprocessing, fold, None

    def fit(self, estimator, df: DataFrame, test: DataFrame | None = None) -> tuple[list[float], list[float], DataFrame | None]:
        """(train scores, validation scores, test with averaged predictions). Out-of-fold predictions are in oof_."""
        fold = self.fold if self.fold is not None else fold_of(self.id_col, self.folds, self.seed)
        rows, kept = df.withColumn("_fold", fold), df.storageLevel
        own = not (kept.useMemory or kept.useDisk)  # the rows of a caller that keeps them aren't kept twice
        if own:
            rows.persist()

        def one(k: int) -> tuple:
            train, valid = rows.where(F.col("_fold") != k), rows.where(F.col("_fold") == k)
            step = self.preprocessing() if self.preprocessing else None
            if step is not None:
                train, valid = step.fit_transform(train), step.transform(valid)
            model, on_train, on_valid = self.trainer.fit_and_predict(estimator, train, valid)
            return step, model, score_of(self.metric, self.metric_type, on_train, self.target), score_of(self.metric, self.metric_type, on_valid, self.target), on_valid

        found = in_parallel(one, list(range(self.folds)))
        self.models_ = [(step, model) for step, model, *_ in found]
        self.oof_ = found[0][4]
        for f in found[1:]:
            self.oof_ = self.oof_.unionByName(f[4])
        self.oof_ = self.oof_.drop("_fold")
        if own:
            rows.unpersist()
        return [f[2] for f in found], [f[3] for f in found], None if test is None else self.predict(test)

    def _each(self, df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
        """df with a column of each fold model's output."""
        if self.models_ is None:
            raise RuntimeError("the trainer is not fitted")
        names = df.columns
        for i, (step, model) in enumerate(self.models_):
            part = self.trainer.predict(model, step.transform(df) if step is not None else df)
            out = f"_m{i}"
            df = part.withColumnRenamed(column, out).select(*[quoted(c) for c in df.columns], out)
        return df.select(*[quoted(c) for c in names], *[f"_m{i}" for i in range(len(self.models_))]), [f"_m{i}" for i in range(len(self.models_))]

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if self.problem_type != "classification":
            raise ValueError("there are no probabilities in a regression")
        out, each = self._each(df.drop("prediction", "probability"), "probability")
        return out.withColumn("probability", mean_arrays([F.col(c) for c in each])).drop(*each)

    def predict(self, df: DataFrame) -> DataFrame:
        if self.problem_type == "classification":
            return self.predict_proba(df).withColumn("prediction", argmax(F.col("probability")))
        out, each = self._each(df.drop("prediction"), "prediction")
        return out.withColumn("prediction", sum((F.col(c) for c in each[1:]), F.col(each[0])) / len(each)).drop(*each)

    def predict_with_confidence(self, df: DataFrame) -> DataFrame:
        """Regression: prediction, std over folds, lower and upper (1.96 std). Classes: prediction, probability,
        confidence, and disagreement, the std over folds of the chosen class's probability."""
        kind = "probability" if self.problem_type == "classification" else "prediction"
        out, each = self._each(df.drop("prediction", "probability"), kind)
        k = len(each)
        spread = lambda cs, mean: F.sqrt(sum((F.pow(c - mean, 2) for c in cs[1:]), F.pow(cs[0] - mean, 2)) / k)
        if kind == "prediction":
            mean = sum((F.col(c) for c in each[1:]), F.col(each[0])) / k
            out = out.withColumns({"prediction": mean, "std": spread([F.col(c) for c in each], mean)})
            return out.withColumns({"lower": F.col("prediction") - 1.96 * F.col("std"), "upper": F.col("prediction") + 1.96 * F.col("std")}).drop(*each)
        out = out.withColumn("probability", mean_arrays([F.col(c) for c in each]))
        out = out.withColumns({"prediction": argmax(F.col("probability")), "confidence": F.array_max("probability")})
        picked = [F.get(F.col(c), F.col("prediction")) for c in each]
        return out.withColumn("disagreement", spread(picked, F.col("confidence"))).drop(*each)


# ---- calibration ----


class Calibrator:
    """One calibrator for each class against the rest (for two classes of class 1), then probabilities of sum 1."""

    EPSILON = 1e-6

    def __init__(self, method: str = "isotonic"):
        if method not in CALIBRATION:
            raise ValueError(f"method must be one of {', '.join(CALIBRATION)}")
        self.method = method

    def fit(self, df: DataFrame, target: str, prob: str = "probability") -> Calibrator:
        self.classes_ = df.select(F.size(prob)).first()[0]
        self.models_ = {}
        for k in [1] if self.classes_ == 2 else range(self.classes_):
            rows = df.select((quoted(target) == k).cast("double").alias("label"), F.get(F.col(prob), F.lit(k)).alias("p"))
            if self.method == "isotonic":
                m = IsotonicRegression(featuresCol="p").fit(rows)
                self.models_[k] = ("isotonic", [float(x) for x in m.boundaries], [float(x) for x in m.predictions])
            else:
                rows = rows.select("label", array_to_vector(F.array("p")).alias("features"))
                m = LogisticRegression(regParam=1e-6).fit(rows)
                self.models_[k] = ("sigmoid", float(m.coefficients[0]), float(m.intercept))
        return self

    def _one(self, k: int, p: Column) -> Column:
        kind, a, b = self.models_[k]
        if kind == "sigmoid":
            return 1 / (1 + F.exp(-(p * a + b)))
        x, y = F.array(*[F.lit(v) for v in a]), F.array(*[F.lit(v) for v in b])
        n = F.size(F.filter(x, lambda v: v <= p))
        lo, hi = F.greatest(n - 1, F.lit(0)), F.least(n, F.lit(len(a) - 1))
        x0, x1, y0, y1 = F.get(x, lo), F.get(x, hi), F.get(y, lo), F.get(y, hi)
        return F.when(p <= a[0], b[0]).when(p >= a[-1], b[-1]).otherwise(y0 + F.coalesce(F.try_divide((p - x0) * (y1 - y0), x1 - x0), F.lit(0.0)))

    def transform(self, df: DataFrame, prob: str = "probability") -> DataFrame:
        e = self.EPSILON
        each = {k: F.least(F.greatest(self._one(k, F.get(F.col(prob), F.lit(k))), F.lit(e)), F.lit(1 - e)) for k in self.models_}
        if self.classes_ == 2:
            return df.withColumn("_p", each[1]).withColumn(prob, F.array(1 - F.col("_p"), F.col("_p"))).drop("_p")
        df = df.withColumn("_p", F.array(*[each[k] for k in range(self.classes_)]))
        return df.withColumn(prob, F.transform("_p", lambda v: v / F.aggregate("_p", F.lit(0.0), lambda s, x: s + x))).drop("_p")


class CalibratedModel:
    """A calibrator fitted on a held-out part of each class, and the estimator refitted on all rows."""

    def __init__(self, estimator, target: str, features: Sequence[str], id_col: str, calibration_method: str = "isotonic", calibration_size: float = 0.2, seed: int = SEED):
        if not 0 < calibration_size < 1:
            raise ValueError("calibration_size must be between 0 and 1")
        self.estimator, self.id_col, self.size, self.seed = estimator, id_col, calibration_size, seed
        self.trainer, self.calibrator, self.target = BaseTrainer("classification", target, features), Calibrator(calibration_method), target

    def fit(self, df: DataFrame) -> CalibratedModel:
        # an even share of each class: its rows' hashes below that share of all hashes
        apart = F.pmod(F.xxhash64(quoted(self.id_col), F.lit(self.seed)), F.lit(1_000_000)) < int(self.size * 1_000_000)
        rows = df.withColumn("_apart", apart).persist()
        first = self.trainer.fit_estimator(self.estimator, rows.where(~F.col("_apart")))
        self.calibrator.fit(self.trainer.predict(first, rows.where("_apart")), self.target)
        self.model_ = self.trainer.fit_estimator(self.estimator, df)
        rows.unpersist()
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.calibrator.transform(self.trainer.predict(self.model_, df))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(df).withColumn("prediction", argmax(F.col("probability")))


class OOFModel:
    """Cross-validation whose fold models are averaged; with calibrate, a calibrator fitted on the out-of-fold
    probabilities and the estimator refitted on all rows."""

    def __init__(self, estimator, cross_validator: CrossValidationTrainer, calibrate: bool = False, method: str = "isotonic"):
        self.estimator, self.cv, self.calibrate, self.method = estimator, cross_validator, calibrate, method
        if calibrate and cross_validator.problem_type != "classification":
            raise ValueError("only classes can be calibrated")

    def fit(self, df: DataFrame) -> OOFModel:
        self.scores_ = self.cv.fit(self.estimator, df)[:2]
        if self.calibrate:
            self.calibrator_ = Calibrator(self.method).fit(self.cv.oof_, self.cv.target)
            step = self.cv.preprocessing() if self.cv.preprocessing else None
            own = self.estimator.copy()
            if own.hasParam("maxIter") and (n := mean_iterations([m for _, m in self.cv.models_])):
                own.setParams(maxIter=n)
            self.final_ = step, self.cv.trainer.fit_estimator(own, step.fit_transform(df) if step is not None else df)
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if not self.calibrate:
            return self.cv.predict_proba(df)
        step, model = self.final_
        return self.calibrator_.transform(self.cv.trainer.predict(model, step.transform(df) if step is not None else df))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(df).withColumn("prediction", argmax(F.col("probability"))) if self.cv.problem_type == "classification" else self.cv.predict(df)


def mean_iterations(models: Sequence) -> int | None:
    """The mean number of boosting rounds of fitted models; null for models without rounds."""
    rounds = [m.stages[-1].getNumTrees for m in models if type(m.stages[-1]).__name__.startswith("GBT")]
    return max(1, round(sum(rounds) / len(rounds))) if rounds else None


# ---- ensembles ----


class EnsembleModel:
    """A weighted blend of estimators, or a meta-learner over their outputs."""

    def __init__(self, estimators: Sequence, problem_type: str, target: str, features: Sequence[str], weights: Sequence[float] | None = None, meta_learner=None):
        self.trainer, self.estimators, self.meta_learner = BaseTrainer(problem_type, target, features), list(estimators), meta_learner
        self.problem_type, self.target = problem_type, target
        self.weights = self.normalized(weights, len(self.estimators))

    @staticmethod
    def normalized(weights: Sequence[float] | None, n: int) -> list[float]:
        if weights is None:
            return [1 / n] * n
        if len(weights) != n:
            raise ValueError("there must be a weight for each estimator")
        if sum(weights) == 0:
            raise ValueError("the weights sum to zero")
        return [w / sum(weights) for w in weights]

    def fit(self, df: DataFrame) -> EnsembleModel:
        rows = df.persist()
        self.models_ = in_parallel(lambda e: self.trainer.fit_estimator(e, rows), self.estimators)
        if self.meta_learner is not None:
            meta, names = self._meta(rows)
            self.meta_ = BaseTrainer(self.problem_type, self.target, names)
            self.meta_model_ = self.meta_.fit_estimator(self.meta_learner, meta)
        rows.unpersist()
        return self

    def _outputs(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        kind = "probability" if self.problem_type == "classification" else "prediction"
        out = df.drop("prediction", "probability")
        for i, m in enumerate(self.models_):
            have = out.columns
            out = self.trainer.predict(m, out).withColumnRenamed(kind, f"_b{i}").select(*[quoted(c) for c in have], f"_b{i}")
        return out, [f"_b{i}" for i in range(len(self.models_))]

    def _meta(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        out, each = self._outputs(df)
        if self.problem_type == "regression":
            return out, each
        k = out.select(F.size(each[0])).first()[0]
        cols = {f"{c}_{j}": F.get(F.col(c), F.lit(j)) for c in each for j in ([1] if k == 2 else range(k))}
        return out.withColumns(cols).drop(*each), list(cols)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        if self.problem_type != "classification":
            raise ValueError("there are no probabilities in a regression")
        if self.meta_learner is not None:
            meta, names = self._meta(df)
            return self.meta_.predict(self.meta_model_, meta).drop(*names)
        out, each = self._outputs(df)
        out = out.withColumn("_t", blended([F.transform(F.col(c), lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))) for c in each], self.weights))
        norm = F.transform("_t", lambda p: p / F.aggregate("_t", F.lit(0.0), lambda s, x: s + x))
        return out.withColumn("probability", norm).withColumn("prediction", argmax(F.col("probability"))).drop("_t", *each)

    def predict(self, df: DataFrame) -> DataFrame:
        if self.problem_type == "classification":
            return self.predict_proba(df).withColumn("prediction", argmax(F.col("probability")))
        if self.meta_learner is not None:
            meta, names = self._meta(df)
            return self.meta_.predict(self.meta_model_, meta).drop(*names)
        out, each = self._outputs(df)
        return out.withColumn("prediction", sum((F.col(c) * w for c, w in zip(each, self.weights, strict=True)), F.lit(0.0))).drop(*each)

    def predict_with_confidence(self, df: DataFrame) -> DataFrame:
        """prediction, and std over the estimators (of the chosen class's probability)."""
        out, each = self._outputs(df)
        if self.problem_type == "regression":
            mean = sum((F.col(c) * w for c, w in zip(each, self.weights, strict=True)), F.lit(0.0))
            values = [F.col(c) for c in each]
        else:
            out = self._with_outputs(df)
            mean = F.get(F.col("probability"), F.col("prediction"))
            values = [F.get(F.col(c), F.col("prediction")) for c in each]
        spread = F.sqrt(sum((w * F.pow(v - mean, 2) for v, w in zip(values, self.weights, strict=True)), F.lit(0.0)))
        if self.problem_type == "regression":
            out = out.withColumns({"prediction": mean, "std": spread})
            return out.withColumns({"lower": F.col("prediction") - 1.96 * F.col("std"), "upper": F.col("prediction") + 1.96 * F.col("std")}).drop(*each)
        return out.withColumns({"confidence": mean, "disagreement": spread}).drop(*each)

    def _with_outputs(self, df: DataFrame) -> DataFrame:
        out, each = self._outputs(df)
        return out.withColumn("probability", blended([F.col(c) for c in each], self.weights)).withColumn("prediction", argmax(F.col("probability")))

    @property
    def feature_importances_(self) -> dict[str, float]:
        """Each model's importances scaled to 0..1, then weighted."""
        out = dict.fromkeys(self.trainer.features, 0.0)
        for m, w in zip(self.models_, self.weights, strict=True):
            values = importances(m.stages[-1], len(out))
            low, high = min(values), max(values)
            for f, v in zip(out, values, strict=True):
                out[f] += w * ((v - low) / (high - low) if high > low else 0.0)
        return out


def importances(model, n: int) -> list[float]:
    """Tree importances, or the size of linear coefficients."""
    if hasattr(model, "featureImportances"):
        return [float(x) for x in model.featureImportances.toArray()]
    if hasattr(model, "coefficientMatrix"):
        return [float(x) for x in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    if hasattr(model, "coefficients"):
        return [abs(float(x)) for x in model.coefficients.toArray()]
    return [0.0] * n

