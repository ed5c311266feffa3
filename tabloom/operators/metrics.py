"""Metrics as aggregates: y and pred are columns, prob is an array column of class probabilities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import quoted, require
from ..functions.stats import average_ranks, div

TINY = 2.220446049250313e-16
Metric = Callable[..., float]


# ---- classes ----


def confusion(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., y, pred, n)"""
    return df.groupBy(*keys, quoted(y).cast("string").alias("y"), quoted(pred).cast("string").alias("pred")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per class its true and false positives, false negatives, precision, recall, f1 and support; 0 over 0 is 0."""
    cells = confusion(df, y, pred, keys)
    sides = F.explode(F.array(F.struct(F.col("y").alias("cls"), F.lit(0).alias("side")), F.struct(F.col("pred").alias("cls"), F.lit(1).alias("side"))))
    long = cells.select(*keys, "y", "pred", "n", sides.alias("s")).select(*keys, "y", "pred", "n", "s.*")
    n, hit = F.col("n"), F.col("y") == F.col("pred")
    sums = long.groupBy(*keys, "cls").agg(
        F.sum(F.when(hit & (F.col("side") == 0), n).otherwise(0)).alias("tp"), F.sum(F.when(~hit & (F.col("side") == 1), n).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & (F.col("side") == 0), n).otherwise(0)).alias("fn"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select(
        *keys, "cls", "tp", "fp", "fn", zero(div(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
        zero(div(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"), zero(div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def classification_summary(df: DataFrame, y: str, pred: str, keys: Sequence[str] = (), positive: str = "1") -> DataFrame:
    """One row (per key) with accuracy, balanced accuracy, and precision, recall and f1 in four averages."""
    c = per_class(df, y, pred, keys)
    tp, support = F.sum("tp"), F.sum("support")
    known = F.col("support") > 0
    out = [div(tp, support).alias("accuracy"), F.avg(F.when(known, F.col("recall"))).alias("balanced_accuracy")]
    for m in ("precision", "recall", "f1"):
        out += [
            F.coalesce(F.max(F.when(F.col("cls") == positive, F.col(m))), F.lit(0.0)).alias(f"{m}_binary"), div(tp, support).alias(f"{m}_micro"),
            F.avg(m).alias(f"{m}_macro"), div(F.sum(F.col(m) * F.col("support")), support).alias(f"{m}_weighted"),
        ]
    return c.groupBy(*keys).agg(*out) if keys else c.agg(*out)


# ---- probabilities ----


def score_counts(df: DataFrame, score: Column, positive: Column, keys: Sequence[Column] = ()) -> DataFrame:
    """(k0, k1, ..., value, n, p): rows and positive ones by distinct score."""
    names = [f"k{i}" for i in range(len(keys))]
    counts = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], score.cast("double").alias("value"), positive.cast("int").alias("p"))
    return counts.groupBy(*names, "value").agg(F.count("*").alias("n"), F.sum("p").alias("p"))


def auc_of(counts: DataFrame, names: Sequence[str], rows: int) -> DataFrame:
    """Exact area under the ROC curve by the rank sum, ties by average ranks; `rows` bounds the distinct scores of a key."""
    ranked = average_ranks(counts, names, rows)
    pos, n = F.sum("p").cast("double"), F.sum("n").cast("double")
    return ranked.groupBy(*names).agg(F.try_divide(F.sum(F.col("p") * F.col("rank")) - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"))


def auc_table(df: DataFrame, score: Column, positive: Column, keys: Sequence[Column] = ()) -> DataFrame:
    """auc_of by keys, as a lazy plan; windows run over distinct scores."""
    return auc_of(score_counts(df, score, positive, keys), [f"k{i}" for i in range(len(keys))], df.count())


def roc_auc(df: DataFrame, y: str, prob: str) -> float:
    """Rows are scored and counted once: their ranks may take several looks at the counts."""
    require(df, [y, prob])
    counts = score_counts(df, probability(df, prob, 1), quoted(y) == 1).persist()
    area = auc_of(counts, [], counts.count()).first()[0]
    counts.unpersist()
    return area


def probability(df: DataFrame, prob: str, k: int) -> Column:
    """The probability of class k; a plain column is that of class 1."""
    c = quoted(prob)
    if df.schema[prob].dataType.typeName() == "array":
        return F.get(c, F.lit(k))
    return c if k == 1 else 1 - c


def classes_of(df: DataFrame, y: str) -> int:
    return int(df.agg(F.max(quoted(y))).first()[0]) + 1


def roc_auc_ovr(df: DataFrame, y: str, prob: str) -> float:
    """The mean over classes of each one's area against the rest; one job for all classes."""
    pairs = F.posexplode(quoted(prob)).alias("k", "p")
    long = df.select(quoted(y).alias("y"), pairs)
    return auc_table(long, F.col("p"), F.col("y") == F.col("k"), [F.col("k")]).agg(F.avg("auc")).first()[0]


def log_loss(df: DataFrame, y: str, prob: str) -> float:
    p = F.when(quoted(y) == 1, probability(df, prob, 1)).otherwise(probability(df, prob, 0)) if df.schema[prob].dataType.typeName() != "array" else F.get(quoted(prob), quoted(y).cast("int"))
    return df.agg(F.avg(-F.ln(F.least(F.greatest(p, F.lit(TINY)), F.lit(1 - TINY))))).first()[0]


def brier_score(df: DataFrame, y: str, prob: str) -> float:
    """Squared error of the positive class; with more classes the mean over them."""
    k = df.select(F.size(quoted(prob))).first()[0] if df.schema[prob].dataType.typeName() == "array" else 2
    return brier_binary(df, y, prob) if k == 2 else brier_ovr(df, y, prob)


def brier_binary(df: DataFrame, y: str, prob: str) -> float:
    return df.agg(F.avg(F.pow(probability(df, prob, 1) - (quoted(y) == 1).cast("double"), 2))).first()[0]


def brier_ovr(df: DataFrame, y: str, prob: str) -> float:
    long = df.select(quoted(y).alias("y"), F.posexplode(quoted(prob)).alias("k", "p"))
    return long.agg(F.avg(F.pow(F.col("p") - (F.col("y") == F.col("k")).cast("double"), 2))).first()[0]


def ece_bins(df: DataFrame, y: str, prob: str, n_bins: int = 10) -> DataFrame:
    """(k, bin, n, confidence, share): equal-width bins of each class's probability. Also the points of a reliability curve."""
    if df.schema[prob].dataType.typeName() == "array":
        long = df.select(quoted(y).alias("y"), F.posexplode(quoted(prob)).alias("k", "p"))
    else:
        long = df.select(quoted(y).alias("y"), F.lit(1).alias("k"), quoted(prob).alias("p"))
    bin_ = sum(((F.col("p") >= F.lit(i / n_bins)).cast("int") for i in range(1, n_bins)), F.lit(0))
    return long.groupBy("k", bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg((F.col("y") == F.col("k")).cast("double")).alias("share"))


def expected_calibration_error(df: DataFrame, y: str, prob: str, n_bins: int = 10) -> float:
    """The mean over classes of the weighted gap between confidence and share; of two classes the positive one only."""
    bins = ece_bins(df, y, prob, n_bins).groupBy("k").agg(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("share"))).alias("s"), F.sum("n").alias("n"))
    rows = {r["k"]: r["s"] / r["n"] for r in bins.collect()}
    return rows[1] if set(rows) <= {0, 1} and 1 in rows else sum(rows.values()) / len(rows)


def apply_cutoffs(prob: Column, cutoffs: Sequence[float] | float) -> Column:
    """Two classes: probability of class 1 at or over the cutoff. More: the class of the largest p / cutoff, the first of equals."""
    if isinstance(cutoffs, int | float):
        return (F.get(prob, F.lit(1)) >= F.lit(float(cutoffs))).cast("int")
    scaled = F.zip_with(prob, F.array(*[F.lit(float(c)) for c in cutoffs]), lambda p, c: p / c)
    return (F.array_position(scaled, F.array_max(scaled)) - 1).cast("int")


def argmax(prob: Column) -> Column:
    return (F.array_position(prob, F.array_max(prob)) - 1).cast("int")


# ---- numbers ----


def regression_columns(y: Column, p: Column) -> dict[str, Column]:
    """All regression metrics that add up, for one aggregation."""
    y, p = y.cast("double"), p.cast("double")
    e = y - p
    return {
        "mae": F.avg(F.abs(e)), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)),
        "mape": F.avg(F.when(y != 0, F.abs(e / F.nullif(y, F.lit(0.0))))), "r2": 1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y)),
        "explained_variance": 1 - F.try_divide(F.var_pop(e), F.var_pop(y)),
    }


def _regression(pick: Callable[[Column, Column], Column]) -> Metric:
    def metric(df: DataFrame, y: str, pred: str) -> float:
        require(df, [y, pred])
        return df.agg(pick(quoted(y).cast("double"), quoted(pred).cast("double"))).first()[0]

    return metric


def root_mean_squared_percentage_error(df: DataFrame, y: str, pred: str) -> float:
    """Rows with y = 0 are left out; if there are no others, it is an error."""
    kept = df.where(quoted(y) != 0)
    out = kept.agg(F.sqrt(F.avg(F.pow((quoted(y) - quoted(pred)) / F.nullif(quoted(y).cast("double"), F.lit(0.0)), 2)))).first()[0]
    if out is None:
        raise ValueError("all true values are zero")
    return out


def _class_metric(column: str) -> Metric:
    return lambda df, y, pred: classification_summary(df, y, pred).first()[column]


#: name -> (function, kind of prediction, direction)
METRICS: dict[str, tuple[Metric, str, str]] = {
    "Accuracy": (_class_metric("accuracy"), "preds", "maximize"),
    "Balanced Accuracy": (_class_metric("balanced_accuracy"), "preds", "maximize"),
    **{
        f"{m}{suffix}": (_class_metric(f"{column}_{average}"), "preds", "maximize")
        for m, column in (("F1", "f1"), ("Recall", "recall"), ("Precision", "precision"))
        for suffix, average in (("", "binary"), (" (Micro)", "micro"), (" (Macro)", "macro"), (" (Weighted)", "weighted"))
    },
    "Roc AUC": (roc_auc, "probs", "maximize"),
    "Roc AUC (Multi-class)": (roc_auc_ovr, "probs", "maximize"),
    "Log Loss": (log_loss, "probs", "minimize"),
    "Brier Score": (brier_score, "probs", "minimize"),
    "MAE": (_regression(lambda y, p: F.avg(F.abs(y - p))), "preds", "minimize"),
    "MAPE": (_regression(lambda y, p: F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(TINY)))), "preds", "minimize"),
    "MSE": (_regression(lambda y, p: F.avg(F.pow(y - p, 2))), "preds", "minimize"),
    "RMSE": (_regression(lambda y, p: F.sqrt(F.avg(F.pow(y - p, 2)))), "preds", "minimize"),
    "R2": (_regression(lambda y, p: 1 - F.try_divide(F.sum(F.pow(y - p, 2)), F.var_pop(y) * F.count(y))), "preds", "maximize"),
    "RMSLE": (_regression(lambda y, p: F.sqrt(F.avg(F.pow(F.log1p(y) - F.log1p(p), 2)))), "preds", "minimize"),
    "RMSPE": (root_mean_squared_percentage_error, "preds", "minimize"),
}


def _entry(name: str) -> tuple[Metric, str, str]:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; there are {', '.join(METRICS)}")
    return METRICS[name]


def get_metric_function(name: str) -> Metric:
    return _entry(name)[0]


def get_metric_type(name: str) -> str:
    return _entry(name)[1]


def get_metric_direction(name: str) -> str:
    return _entry(name)[2]


def list_available_metrics() -> list[str]:
    return list(METRICS)


class CustomMetricsHandler:
    """Checks and unpacks {name, function, metric_type, direction, kwargs}."""

    @staticmethod
    def validate_custom_metric_config(config: dict) -> None:
        if missing := {"name", "function", "metric_type", "direction"} - set(config):
            raise ValueError(f"missing: {sorted(missing)}")
        if not callable(config["function"]):
            raise ValueError("function must be callable")
        if config["metric_type"] not in ("preds", "probs"):
            raise ValueError("metric_type must be preds or probs")
        if config["direction"] not in ("minimize", "maximize"):
            raise ValueError("direction must be minimize or maximize")

    @classmethod
    def extract_metric_details(cls, config: dict | None, name: str | None = None) -> tuple[str, Metric, str, str]:
        if config is None:
            return name, *_entry(name)
        cls.validate_custom_metric_config(config)
        more = config.get("kwargs") or {}
        return config["name"], lambda df, y, p: config["function"](df, y, p, **more), config["metric_type"], config["direction"]


@dataclass
class FBetaSelectionConfig:
    threshold: float = 0.5
    beta: float = 0.1
    normalize_by: float | None = None
    min_selected: int = 1


def f_beta_selection_score(df: DataFrame, label: str, prob: str, points: str, config: FBetaSelectionConfig | None = None) -> float:
    """The F-beta mean of two shares: the points of the rows whose probability reaches the threshold (their mean over
    normalize_by, or over the largest points, 1 at least; no more than 1), and how many of all rows those are. It is 0
    with fewer than min_selected of them."""
    require(df, [label, prob, points])
    c = config or FBetaSelectionConfig()
    picked, value = probability(df, prob, 1) >= c.threshold, quoted(points).cast("double")
    r = df.agg(F.count("*").alias("rows"), F.count_if(picked).alias("n"), F.avg(F.when(picked, value)).alias("mean"), F.max(value).alias("top")).first()
    if r["n"] < max(c.min_selected, 1):
        return 0.0
    worth, coverage, b = min(r["mean"] / (c.normalize_by or max(r["top"], 1.0)), 1.0), r["n"] / r["rows"], c.beta**2
    return (1 + b) * worth * coverage / (b * worth + coverage)
