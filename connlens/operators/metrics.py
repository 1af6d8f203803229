"""Model quality: confusion, per-class scores, detector panel, prediction quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from connlens.functions.scalars import ratio
from connlens.operators.ordered import exact_percentile


def confusion(df: DataFrame, truth: str = "true_label", predicted: str = "prediction", classes: Sequence[str] | None = None) -> DataFrame:
    """Every (true, predicted) cell with its count, zero cells kept.

    Without ``classes`` the cells span the labels seen on either side. The
    counting is one aggregation; the rest works on the list of classes.
    """
    counts = df.groupBy(F.col(truth).alias("true_label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    if classes is not None:
        names = F.array(*[F.lit(c) for c in classes])
        grid = df.sparkSession.range(1).select(F.explode(names).alias("true_label"), names.alias("_all"))
    else:
        sides = counts.select(F.explode(F.array("true_label", "predicted")).alias("_c")).filter("_c is not null")
        grid = sides.agg(F.collect_set("_c").alias("_all")).select(F.explode("_all").alias("true_label"), "_all")
    cells = grid.select("true_label", F.explode("_all").alias("predicted"))
    return cells.join(counts, ["true_label", "predicted"], "left").fillna(0, ["n"])


def class_report(df: DataFrame, truth: str = "true_label", predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class over the labels of both sides; 0 on empty denominators."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(
        F.explode(F.array(
            F.struct(F.col("t").alias("label"), F.col("n").alias("true_n"), F.lit(0).cast("bigint").alias("pred_n"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("true_n"), F.col("n").alias("pred_n"), F.lit(0).cast("bigint").alias("hit")),
        )).alias("s")
    ).select("s.*").filter("label is not null")
    sums = sides.groupBy("label").agg(F.sum("hit").alias("tp"), F.sum("true_n").alias("support"), F.sum("pred_n").alias("predicted_n"))
    precision, recall = ratio(F.col("tp"), F.col("predicted_n")), ratio(F.col("tp"), F.col("support"))
    scored = sums.select("label", precision.alias("precision"), recall.alias("recall"), "support")
    f1 = ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select("label", "precision", "recall", f1.alias("f1_score"), "support")


def accuracy(df: DataFrame, truth: str = "true_label", predicted: str = "prediction") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.avg(F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0)).alias("accuracy"))


def confident_accuracy(df: DataFrame, truth: str, predicted: str, confidence: str, threshold: float = 0.7, *more: Column) -> DataFrame:
    """Accuracy over the rows at or above the threshold (0 when none) and their share; ``more`` joins the same pass."""
    sure = F.col(confidence) >= threshold
    hit = sure & (F.col(truth) == F.col(predicted))
    return df.agg(
        F.count("*").alias("n"), F.count_if(sure).alias("confident"),
        ratio(F.count_if(hit), F.count_if(sure)).alias("confident_accuracy"),
        ratio(F.count_if(sure), F.count("*")).alias("confident_ratio"),
        *more,
    )


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, nulls left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))


def detector_performance(df: DataFrame, score: str = "score", truth: str | None = None, positive: str = "anomaly", cut: float = 0.0) -> DataFrame:
    """Detection panel in percent, one row.

    Without ``truth`` every row counts as a labelled anomaly, so false
    positives stay 0. The false-positive rate is the share of scores strictly
    below their interpolated 10th percentile.
    """
    actual = F.lit(True) if truth is None else F.col(truth) == positive
    flagged = F.col(score) < cut
    tenth = exact_percentile(df, score, 0.1)
    under = F.count_if(F.col(score) < F.lit(tenth)) if tenth is not None else F.lit(0)
    row = df.agg(
        F.count("*").alias("total_samples"),
        F.count_if(actual & flagged).alias("true_positives"),
        F.count_if(~actual & flagged).alias("false_positives"),
        F.count_if(actual & ~flagged).alias("false_negatives"),
        F.count_if(~actual & ~flagged).alias("_tn"),
        under.alias("_under"),
        F.avg(-F.col(score)).alias("_mean"), F.stddev_pop(F.col(score)).alias("_std"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    right = tp if truth is None else tp + F.col("_tn")
    return row.select(
        F.round(ratio(tp, tp + fn, 100), 1).alias("detection_rate"),
        F.round(ratio(F.col("_under"), F.col("total_samples"), 100), 1).alias("false_positive_rate"),
        F.round(ratio(right, F.col("total_samples"), 100), 1).alias("accuracy"),
        F.round(ratio(tp, tp + fp, 100), 1).alias("precision"),
        "total_samples", "true_positives", "false_positives", "false_negatives",
        F.coalesce(F.round("_mean", 3), F.lit(0.0)).alias("mean_anomaly_score"),
        F.coalesce(F.round("_std", 3), F.lit(0.0)).alias("std_anomaly_score"),
    )


def compare_models(versions: Mapping[str, DataFrame], score: str = "score", created: Mapping[str, str] | None = None) -> DataFrame:
    """The detection panel of each version's scores, oldest version first."""
    out = None
    for name, frame in versions.items():
        one = detector_performance(frame, score).select(
            F.lit(name).alias("version"), F.lit((created or {}).get(name)).cast("string").alias("created"), "*"
        )
        out = one if out is None else out.unionByName(one)
    return out.orderBy("created", "version")


def prediction_quality(df: DataFrame) -> DataFrame:
    """Counts and rates of hybrid predictions, one row; absent parts count as false."""
    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    failed = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    anomaly = yes(F.col("anomaly_detection.is_anomaly"))
    classified = anomaly & F.col("classification").isNotNull() & yes(F.col("classification.error").isNull())
    counts = df.agg(
        F.count("*").alias("total_predictions"),
        F.count_if(~failed).alias("successful_predictions"),
        F.count_if(anomaly).alias("anomalies_detected"),
        F.count_if(classified).alias("classified_anomalies"),
        F.count_if(yes(F.col("classification.is_confident"))).alias("confident_classifications"),
        F.count_if(yes(F.col("final_prediction.requires_manual_review"))).alias("requires_review"),
    )
    total = F.col("total_predictions")
    return counts.select(
        "*",
        ratio(F.col("successful_predictions"), total).alias("success_rate"),
        ratio(F.col("anomalies_detected"), total).alias("anomaly_rate"),
        ratio(F.col("classified_anomalies"), F.col("anomalies_detected")).alias("classification_rate"),
        ratio(F.col("confident_classifications"), F.col("classified_anomalies")).alias("confidence_rate"),
        ratio(F.col("requires_review"), total).alias("review_rate"),
    )


def final_categories(df: DataFrame) -> DataFrame:
    category = F.coalesce("final_prediction.category", F.lit("unknown"))
    return df.groupBy(category.alias("category")).agg(F.count("*").alias("n"))
