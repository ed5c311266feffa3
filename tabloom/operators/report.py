"""Reports on predictions: metric tables by split, and the rows with the largest errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import quoted, require
from ..functions.stats import quantiles_of
from .convert import label_of
from .metrics import TINY, apply_cutoffs, auc_table, classification_summary, per_class, regression_columns


def regression_results(train: DataFrame, test: DataFrame, y: str, pred: str) -> DataFrame:
    """Train and Test by MAE, MedAE, MSE, RMSE, MAPE (without y = 0), R2 and explained variance: one
    aggregation, and quantiles of both splits together."""
    rows = [df.select(F.lit(n).alias("split"), quoted(y).alias("y"), quoted(pred).alias("p")) for n, df in (("Train", train), ("Test", test))]
    both = rows[0].unionByName(rows[1])
    error = F.abs(F.col("y").cast("double") - F.col("p").cast("double"))
    medians = quantiles_of(both, {n: F.when(F.col("split") == n, error) for n in ("Train", "Test")}, [0.5])
    table = both.groupBy("split").agg(*[c.alias(n) for n, c in regression_columns(F.col("y"), F.col("p")).items()])
    medae = F.when(F.col("split") == "Train", F.lit(medians["Train"][0])).otherwise(F.lit(medians["Test"][0])).cast("double")
    return table.select("split", "mae", medae.alias("medae"), *[c for c in table.columns if c not in ("split", "mae")])


def classification_results(
    train: DataFrame, test: DataFrame, y: str, pred: str, prob: str | None = None, id2label: Mapping[int, str] | None = None,
    cutoffs: Sequence[float] | float | None = None, average: str = "weighted",
) -> tuple[DataFrame, DataFrame]:
    """(overall, per class) tables by split, with cutoffs each for the plain and the cut prediction.

    y and pred hold class numbers, or labels when id2label is given; cutoffs need prob and id2label."""
    if average not in ("weighted", "macro", "micro"):
        raise ValueError("average must be weighted, macro or micro")
    if cutoffs is not None and (prob is None or id2label is None):
        raise ValueError("cutoffs need prob and id2label")
    named = {str(v): k for k, v in (id2label or {}).items()}
    parts = []
    for split, df in (("Train", train), ("Test", test)):
        require(df, [y, pred, *([prob] if prob else [])])
        c = lambda n: quoted(n).cast("string")
        p = quoted(prob) if prob else F.lit(None).cast("array<double>")
        base = df.select(F.lit(split).alias("split"), c(y).alias("y"), c(pred).alias("pred"), p.alias("prob"))
        parts.append(base.withColumn("cut", F.lit("none")))
        if cutoffs is not None:
            parts.append(base.withColumns({"pred": label_of(apply_cutoffs(F.col("prob"), cutoffs), id2label), "cut": F.lit("cutoffs")}))
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    keys = ["split", "cut"]
    s = classification_summary(rows, "y", "pred", keys)
    overall = s.select(*keys, "accuracy", "balanced_accuracy", *[F.col(f"{m}_{average}").alias(m) for m in ("precision", "recall", "f1")])
    each = per_class(rows, "y", "pred", keys)
    if prob:
        number = F.element_at(F.create_map(*[x for v, k in named.items() for x in (F.lit(v), F.lit(k))]), F.col("y")) if named else F.col("y").cast("int")
        plain = rows.where("cut = 'none'").withColumn("k", number)
        long = plain.select("split", "k", F.posexplode("prob").alias("cls", "p"))
        area = auc_table(long, F.col("p"), F.col("k") == F.col("cls"), [F.col("split"), F.col("cls")]).withColumnsRenamed({"k0": "split", "k1": "k"})
        mean = area.groupBy("split").agg(F.when(F.count("*") == 2, F.max(F.when(F.col("k") == 1, F.col("auc")))).otherwise(F.avg("auc")).alias("roc_auc"))
        loss = plain.groupBy("split").agg(F.avg(-F.ln(F.least(F.greatest(F.get("prob", F.col("k")), F.lit(TINY)), F.lit(1 - TINY)))).alias("log_loss"))
        overall = overall.join(mean, "split", "left").join(loss, "split", "left")
        names = label_of(F.col("k"), id2label) if id2label else F.col("k").cast("string")
        each = each.join(area.select("split", names.alias("cls"), F.col("auc").alias("roc_auc")), ["split", "cls"], "left")
    return overall, each


def get_top_regression_under_over_errors(df: DataFrame, y: str, pred: str, top_n: int = 15, log: bool = False, epsilon: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(underestimated, overestimated): the top_n rows each by error, true less predicted; with log, of the logs."""
    require(df, [y, pred])
    a, b = quoted(y).cast("double"), quoted(pred).cast("double")
    error = F.ln(F.greatest(a, F.lit(epsilon))) - F.ln(F.greatest(b, F.lit(epsilon))) if log else a - b
    rows = df.withColumns({"error": error, "abs_error": F.abs(error)})
    top = lambda side: rows.where(side).orderBy(F.desc("abs_error")).limit(top_n)
    return top(F.col("error") > 0), top(F.col("error") < 0)


def get_top_classification_errors(
    df: DataFrame, y: str, prob: str, class_id: int, id2label: Mapping[int, str] | None = None, top_n: int = 15, cutoffs: Sequence[float] | float | None = None
) -> DataFrame:
    """The top_n rows of a class that were taken for another, by how much surer the model was of that one."""
    require(df, [y, prob])
    p = quoted(prob)
    if cutoffs is None:
        pred = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    else:
        pred = apply_cutoffs(p, cutoffs)
    rows = df.withColumn("predicted", pred).where((quoted(y) == class_id) & (F.col("predicted") != class_id))
    rows = rows.withColumn("gap", F.get(p, F.col("predicted")) - F.get(p, F.lit(class_id)))
    names = id2label or {}
    return rows.orderBy(F.desc("gap")).limit(top_n).withColumns({"true_label": label_of(quoted(y), names), "predicted_label": label_of(F.col("predicted"), names)})


def to_html(df: DataFrame, caption: str = "", rows: int = 100) -> str:
    """A small result as an HTML table."""
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else f'{v:.6g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
    return f"<table><caption>{escape(caption)}</caption><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"
