"""Classifier metrics as aggregations; every shuffle carries per-class counts only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def round_scores(score: Column) -> Column:
    """Fractions as percentages with four decimals."""
    return F.round(score * 100, 4)


def accuracy(pred: str = "pred", label: str = "label") -> Column:
    return F.avg((F.col(pred) == F.col(label)).cast("double"))


def mse(pred: str = "pred", label: str = "label") -> Column:
    diff = F.col(pred).cast("double") - F.col(label)
    return F.avg(diff * diff)


def combined_score(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the mean of the metric columns when there is more than one."""
    if len(names) < 2:
        return metrics
    total = F.lit(0.0)
    for name in names:
        total = total + F.col(name)
    return metrics.withColumn("combined_score", total / len(names))


def long_metrics(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """One ``(metric, value)`` row per metric column."""
    return metrics.unpivot([], list(names), "metric", "value")


def confusion_counts(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: Sequence[int], pred: str = "pred", label: str = "label") -> DataFrame:
    """One row per true class, one column ``pred_<class>`` per predicted class and ``pred_other`` for all others."""
    own = [F.count(F.when(F.col(pred) == c, 1)).alias(f"pred_{c}") for c in classes]
    other = F.coalesce(~F.col(pred).isin(list(classes)), F.lit(True))
    return df.groupBy(label).agg(*own, F.count_if(other).alias("pred_other"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _scores(df: DataFrame) -> DataFrame:
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    return df.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def class_scores(df: DataFrame, pred: str = "pred", label: str = "label", classes: Sequence[int] | None = None) -> DataFrame:
    """``(class, hits, predicted, support, precision, recall, f1)``, zero division as 0."""
    cells = confusion_counts(df, pred, label)
    # A cell counts once for its true class and once for its predicted one.
    sides = cells.select(
        F.explode(F.array(
            F.struct(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                     F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("hits")),
            F.struct(F.col(pred).alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                     F.lit(0).cast("bigint").alias("hits")),
        )).alias("s")
    ).select("s.*")
    if classes is not None:
        sides = sides.filter(F.col("class").isin(*classes))
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hits", "predicted", "support")])
    return _scores(sums)


def classification_report(
    df: DataFrame, pred: str = "pred", label: str = "label", classes: Sequence[int] | None = None
) -> DataFrame:
    """Per-class rows plus ``micro avg``, ``macro avg`` and ``weighted avg``.

    Over all classes the micro average is the accuracy. Works on one row per class.
    """
    per_class = class_scores(df, pred, label, classes)
    shown = ["precision", "recall", "f1"]
    rows = per_class.select(F.col("class").cast("string").alias("class"), *shown, "support")
    micro = _scores(
        per_class.groupBy().agg(*[F.sum(c).alias(c) for c in ("hits", "predicted", "support")])
    ).select(F.lit("micro avg").alias("class"), *shown, "support")
    macro = per_class.groupBy().agg(
        *[F.avg(c).alias(c) for c in shown], F.sum("support").alias("support")
    ).select(F.lit("macro avg").alias("class"), *shown, "support")
    weighted = per_class.groupBy().agg(
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in shown],
        F.sum("support").alias("support"),
    ).select(F.lit("weighted avg").alias("class"), *shown, "support")
    return rows.unionByName(micro).unionByName(macro).unionByName(weighted)


def metrics_by_slice(
    df: DataFrame, slice_col: str, matched, mismatched, metrics: Sequence[Column], suffix: str = "_mm"
) -> DataFrame:
    """One row: the metrics of the matched slice, and of the other one with a suffix."""
    per_slice = df.filter(F.col(slice_col).isin(matched, mismatched)).groupBy(slice_col).agg(*metrics)
    values = [c for c in per_slice.columns if c != slice_col]
    return per_slice.groupBy().agg(
        *[F.max(F.when(F.col(slice_col) == matched, F.col(c))).alias(c) for c in values],
        *[F.max(F.when(F.col(slice_col) == mismatched, F.col(c))).alias(c + suffix) for c in values],
    )


def capped_sample_count(limit: int | None) -> Column:
    """``min(limit, rows)`` as reported next to the metrics."""
    rows = F.count(F.lit(1))
    return rows if limit is None else F.least(F.lit(limit).cast("bigint"), rows)


def compare_runs(scores: DataFrame, run: str, metrics: Sequence[str]) -> DataFrame:
    """Mean metrics per run, best marked by the first metric (ties by name)."""
    means = scores.groupBy(run).agg(
        *[round_scores(F.avg(m)).alias(m) for m in metrics], F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(metrics[0]), F.asc(run))
    return means.withColumn("rank", F.row_number().over(order))
