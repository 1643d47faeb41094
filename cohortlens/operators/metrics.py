"""Classifier and regression metrics over tables of predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.functions.numbers import safe_div
from cohortlens.operators.ranking import running_totals
from cohortlens.session import checkpointed

CLASS_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def confusion(pred: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score",
              threshold: float = 0.5) -> DataFrame:
    """(by.., tn, fp, fn, tp) from one aggregate."""
    hit, event = F.col(score) >= threshold, F.col(y) == 1
    return pred.groupBy(*(by or [])).agg(
        F.count_if(~event & ~hit).alias("tn"), F.count_if(~event & hit).alias("fp"),
        F.count_if(event & ~hit).alias("fn"), F.count_if(event & hit).alias("tp"),
    )


def score_counts(pred: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score") -> DataFrame:
    """(by.., score, pos, neg) per distinct score, written once; rows without a score are left out.

    Everything below reads these counts, so the predictions behind them (and the
    models behind those) are evaluated a single time.
    """
    counts = pred.where(F.col(score).isNotNull()).groupBy(*(by or []), F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    return checkpointed(counts)


def _auc(counts: DataFrame, by: list[str]) -> DataFrame:
    below = running_totals(counts, by, "score", {"cum_neg": "neg"})
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return below.groupBy(*by).agg(F.nullif(F.try_divide(won, pairs), F.lit(float("nan"))).alias("roc_auc"))


def auc(pred: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score") -> DataFrame:
    """(by.., roc_auc): area under the ROC curve, ties counted half.

    The running totals over the scores are summed range by range.
    """
    return _auc(score_counts(pred, by, y, score), by or [])


def roc_points(pred: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score") -> DataFrame:
    """(by.., threshold, tp, fp, tpr, fpr) for every distinct score, without the origin."""
    by = by or []
    counts = score_counts(pred, by, y, score)
    run = running_totals(counts, by, "score", {"tp": "pos", "fp": "neg"}, descending=True)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    if by:
        run = run.join(totals, by)
        p, n = F.col("p"), F.col("n")
    else:
        both = totals.select(F.struct("p", "n")).scalar()
        p, n = both["p"], both["n"]
    return run.select(*by, F.col("score").alias("threshold"), "tp", "fp", safe_div(F.col("tp"), p).alias("tpr"),
                      safe_div(F.col("fp"), n).alias("fpr"))


def class_metrics(pred: DataFrame, by: list[str] | None = None, y: str = "y", score: str = "score",
                  threshold: float = 0.5) -> DataFrame:
    """(by.., tn, fp, fn, tp, accuracy, precision, recall, f1, roc_auc); 0/0 is 0."""
    by = by or []
    counts = score_counts(pred, by, y, score)
    hit = F.col("score") >= threshold
    cells = counts.groupBy(*by).agg(*[
        F.coalesce(F.sum(F.when(side, F.col(kind))), F.lit(0)).alias(name)
        for name, side, kind in (("tn", ~hit, "neg"), ("fp", hit, "neg"), ("fn", ~hit, "pos"), ("tp", hit, "pos"))
    ])
    area = _auc(counts, by)
    joined = cells.join(area, by, "left") if by else cells.withColumn("roc_auc", area.scalar())
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return joined.select(
        *by, "tn", "fp", "fn", "tp",
        safe_div(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "roc_auc",
    )


def rank_models(metrics: DataFrame) -> DataFrame:
    """Metric rows, best first: recall, then F1, then ROC-AUC, then name."""
    return metrics.orderBy(F.desc("recall"), F.desc("f1"), F.desc("roc_auc"), "model")


def compare_models(pred: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Metrics per ``model``, ranked, with a flag and the reason on the best one."""
    table = class_metrics(pred, ["model"], y, score)
    # One row per model.
    order = Window.orderBy(F.desc("recall"), F.desc("f1"), F.desc("roc_auc"), "model")
    ranked = table.withColumn("rank", F.row_number().over(order))
    reason = F.format_string("%s: Recall = %.4f, F1 = %.4f, ROC-AUC = %.4f",
                             F.col("model"), F.col("recall"), F.col("f1"), F.col("roc_auc"))
    return ranked.select("*", (F.col("rank") == 1).alias("is_best"), F.when(F.col("rank") == 1, reason).alias("reason"))


def fold_summary(per_fold: DataFrame, by: str = "model") -> DataFrame:
    """(model, cv_x, cv_x_std ..): mean and population deviation over folds, 4 digits."""
    aggs = []
    for m in CLASS_METRICS:
        aggs += [F.round(F.avg(m), 4).alias(f"cv_{m}"), F.round(F.stddev_pop(m), 4).alias(f"cv_{m}_std")]
    return per_fold.groupBy(by).agg(*aggs)


def merge_cv(metrics: DataFrame, cv: DataFrame | None) -> DataFrame:
    """Left-join the fold means (not the deviations) onto the test metrics."""
    if cv is None:
        return metrics
    means = [c for c in cv.columns if c.startswith("cv_") and not c.endswith("_std")]
    return metrics.join(cv.select("model", *means), "model", "left")


def regression_metrics(pred: DataFrame, by: list[str] | None = None, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """(by.., n, mae, mse, rmse, r2) from one aggregate."""
    actual, error = F.col(y).cast("double"), F.col(y) - F.col(prediction)
    return pred.groupBy(*(by or [])).agg(
        F.count(error).alias("n"), F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(actual))).alias("r2"),
    ).select(*(by or []), "n", "mae", "mse", F.sqrt("mse").alias("rmse"), "r2")


def union_predictions(named: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Predictions of several models in one long table with a ``model`` column."""
    parts = [p.select(F.lit(name).alias("model"), *columns) for name, p in named.items()]
    return reduce(DataFrame.unionByName, parts)
