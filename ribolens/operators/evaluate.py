"""Evaluation of predictions: class summary, confusion matrix, metrics, ROC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import running, with_ordinal


def class_summary(preds: DataFrame) -> DataFrame:
    """prediction, n, fraction of all."""
    counts = preds.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("prediction", "n", (F.col("n") / F.col("total")).alias("fraction"))


def join_labels(preds: DataFrame, labels: DataFrame, by: str = "ord") -> DataFrame:
    """Predictions with the labels of the same position; raises where the lengths differ."""
    n, m = preds.count(), labels.count()
    if n != m:
        raise ValueError(f"{n} predictions and {m} labels")
    return with_ordinal(preds, by).join(with_ordinal(labels, by).drop(by), "ordinal").drop("ordinal")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tp, fn, tn, fp and ``other``: rows whose label or prediction is neither 0 nor 1."""
    y, p = F.col(label), F.col(prediction)
    both = y.isin(0, 1) & p.isin(0, 1)
    cell = lambda a, b: F.count_if((y == a) & (p == b))
    return df.agg(
        cell(1, 1).alias("tp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), F.count_if(~F.coalesce(both, F.lit(False))).alias("other")
    )


def metrics(matrix: DataFrame) -> DataFrame:
    """sensitivity, specificity (fractions), accuracy (percent), mcc; null where a denominator is 0."""
    tp, fn, tn, fp = (F.col(c).cast("double") for c in ("tp", "fn", "tn", "fp"))
    over = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return matrix.select(
        *matrix.columns,
        over(tp, tp + fn).alias("sensitivity"),
        over(tn, tn + fp).alias("specificity"),
        over(100.0 * (tp + tn), tp + tn + fp + fn).alias("accuracy"),
        over(tp * tn - fp * fn, root).alias("mcc"),
    )


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def _totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.sum("pos").cast("double").alias("_p"), F.sum("neg").cast("double").alias("_n"))


def roc_points(df: DataFrame, score: str, label: str, width: float = 1 / 4096) -> DataFrame:
    """threshold, tp, fp, tpr, fpr of every different score, as the least score of a positive prediction.

    Scores are summed up in blocks of ``width``, so that no task holds all thresholds.
    """
    groups = _by_score(df, score, label)
    block: Column = F.floor(F.col("threshold") / width)
    points = running(groups, [F.desc("threshold")], block, {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b), F.lit(0.0)))
    return points.join(F.broadcast(_totals(groups))).select("threshold", "tp", "fp", rate("tp", "_p").alias("tpr"), rate("fp", "_n").alias("fpr"))


def roc_auc(df: DataFrame, score: str, label: str, width: float = 1 / 4096) -> DataFrame:
    """auc: the exact area, ties counted half; null where a class is missing."""
    groups = _by_score(df, score, label)
    block: Column = F.floor(F.col("threshold") / width)
    ranked = running(groups, [F.asc("threshold")], block, {"below": F.col("neg")})
    won = ranked.agg(F.sum(F.col("pos") * ((F.col("below") - F.col("neg")) + F.col("neg") / 2.0)).alias("won"))
    return won.join(F.broadcast(_totals(groups))).select(F.try_divide(F.col("won"), F.nullif(F.col("_p") * F.col("_n"), F.lit(0.0))).alias("auc"))
