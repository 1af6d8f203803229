"""Ranking curves of scored rows with a known truth.

Rows with equal score move together, so the table is reduced to one row per
score first; the running sums then go through ``running_totals``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from connlens.functions.scalars import ratio
from connlens.operators.ordered import ONE_TASK_ROWS, running_totals


def score_steps(
    results: DataFrame, positive: str = "anomaly", higher_is_anomalous: bool = False, score: str = "score",
    truth: str = "true_label", one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """``rank_score, pos, neg, tp, fp`` per distinct score, strongest first.

    By default the rank score is ``-score``, as low scores are anomalous.
    """
    rank = F.col(score) if higher_is_anomalous else -F.col(score)
    known = results.filter(F.col(truth).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    steps = known.groupBy((rank + F.lit(0.0)).alias("rank_score")).agg(
        F.count_if(F.col(truth) == positive).alias("pos"), F.count_if(F.col(truth) != positive).alias("neg")
    )
    return running_totals(steps, ["rank_score"], {"tp": "pos", "fp": "neg"}, descending=True, one_task_rows=one_task_rows)


def _with_totals(steps: DataFrame) -> tuple[DataFrame, int, int]:
    row = steps.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return steps, row["p"] or 0, row["n"] or 0


def roc_points(results: DataFrame, **options) -> DataFrame:
    """``threshold, fpr, tpr`` at every distinct score, and the origin with a null threshold."""
    steps, p, n = _with_totals(score_steps(results, **options))
    points = steps.select(
        F.col("rank_score").alias("threshold"),
        ratio(F.col("fp"), F.lit(n)).alias("fpr"),
        ratio(F.col("tp"), F.lit(p)).alias("tpr"),
    )
    origin = steps.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(origin)


def roc_auc(results: DataFrame, **options) -> DataFrame:
    """Area under the curve by trapezoids; ties count half. Null when one class is absent."""
    steps, p, n = _with_totals(score_steps(results, **options))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    auc = area / F.lit(float(p * n)) if p and n else F.lit(None).cast("double")
    return steps.agg(auc.alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def pr_points(results: DataFrame, **options) -> DataFrame:
    """``threshold, precision, recall`` at every distinct score, and the closing point (1, 0) with a null threshold."""
    steps, p, _ = _with_totals(score_steps(results, **options))
    points = steps.select(
        F.col("rank_score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.lit(p)).alias("recall"),
    )
    closing = steps.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(closing)


def average_precision(results: DataFrame, **options) -> DataFrame:
    """Sum of precision times the gain in recall, and the baseline (share of positives)."""
    steps, p, n = _with_totals(score_steps(results, **options))
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    ap = gain / F.lit(float(p)) if p else F.lit(None).cast("double")
    return steps.agg(ap.alias("average_precision"), F.lit(p / (p + n) if p + n else 0.0).alias("baseline"))
