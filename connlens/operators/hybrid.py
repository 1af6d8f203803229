"""Anomaly score first, attack class for the anomalous rows only."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from connlens.functions.scalars import missing
from connlens.operators import labels, metrics
from connlens.operators.attack_model import AttackModel, predict_classes
from connlens.operators.spread import spread_evenly
from connlens.session import cut_lineage

# Fixed value: note on an anomaly that no classifier could look at.
NO_CLASSIFIER = "Classification model not available"

CLASSIFICATION = (
    "struct<category: string, subcategory: string, confidence: double, is_confident: boolean, "
    "requires_review: boolean, probabilities: map<string,double>, error: string, note: string>"
)


def _final(category: Column, subcategory: Column, confidence: Column, review: Column) -> Column:
    return F.struct(
        category.alias("category"), subcategory.alias("subcategory"), confidence.cast("double").alias("confidence"), review.alias("requires_manual_review")
    )


def hybrid_predict(scored: DataFrame, model: AttackModel | None = None, threshold: float = -0.5, vector: str = "z", score: str = "score") -> DataFrame:
    """Adds ``anomaly_detection``, ``classification``, ``final_prediction`` and ``error``.

    Rows without a score failed. Rows at or above the threshold are normal.
    The rest is classified, or unknown and up for review without a classifier.
    """
    failed = missing(score)
    anomalous = ~failed & (F.col(score) < threshold)
    detection = F.when(~failed, F.struct(
        F.col(score).alias("score"), F.when(anomalous, "anomaly").otherwise("normal").alias("prediction"),
        anomalous.alias("is_anomaly"), F.lit(float(threshold)).alias("threshold"),
    ))
    base = scored.withColumns({
        "anomaly_detection": detection, "error": F.when(failed, "prediction failed: no score"), "_anomalous": anomalous,
    })
    final = (
        F.when(F.col("error").isNotNull(), _final(F.lit("error"), F.lit("processing_failed"), F.lit(0.0), F.lit(True)))
        .when(F.col("_anomalous"), _final(F.lit("unknown"), F.lit("unknown"), F.lit(0.0), F.lit(True)))
        .otherwise(_final(F.lit("normal"), F.lit("benign"), F.lit(1.0), F.lit(False)))
    )
    absent = F.lit(None).cast("string")
    undecided = F.struct(
        F.lit("unknown").alias("category"), F.lit("unknown").alias("subcategory"), F.lit(0.0).alias("confidence"),
        F.lit(False).alias("is_confident"), F.lit(True).alias("requires_review"),
        F.lit(None).cast("map<string,double>").alias("probabilities"), absent.alias("error"),
        F.lit(NO_CLASSIFIER).alias("note"),
    )
    if model is None:
        classification = F.when(F.col("_anomalous"), undecided).cast(CLASSIFICATION)
        return base.withColumns({"classification": classification, "final_prediction": final}).drop("_anomalous")
    # Only anomalies are classified. The scores are written once, so that the two parts don't make them twice; a stream can't
    # be written, and is scored in either part.
    base = base if base.isStreaming else cut_lineage(spread_evenly(base))
    rest = base.filter(~F.col("_anomalous")).withColumns({"classification": F.lit(None).cast(CLASSIFICATION), "final_prediction": final}).drop("_anomalous")
    c = F.col("_class_of")
    answered = predict_classes(base.filter("_anomalous"), model, vector, "_class_of")
    decided = _final(c["category"], c["subcategory"], c["confidence"], c["requires_review"])
    return rest.unionByName(answered.withColumns({"classification": c.cast(CLASSIFICATION), "final_prediction": decided}).select(*rest.columns))


def store_rows(predicted: DataFrame, vector: str = "z", now: Column | None = None) -> DataFrame:
    """Predictions that did not fail, in the stored layout."""
    moment = F.current_timestamp() if now is None else now
    present = set(predicted.columns)

    def own(c: str, default: str) -> Column:
        return F.coalesce(F.col(c), F.lit(default)) if c in present else F.lit(default)

    rows = predicted.filter(F.col("error").isNull()).withColumns({
        "timestamp": F.coalesce("ts", moment), "source_ip": own("source_ip", "0.0.0.0"), "dest_ip": own("dest_ip", "0.0.0.0"),
        "proto": own("proto", "unknown"), "feature_vector": F.col(vector),
        "anomaly_score": F.col("anomaly_detection.score"), "is_anomaly": F.col("anomaly_detection.is_anomaly"),
        "label_category": F.col("final_prediction.category"), "label_subcategory": F.col("final_prediction.subcategory"),
        "labeled_by": F.lit("hybrid_classifier"), "labeled_at": moment, "training_source": F.lit("hybrid_pipeline"),
    })
    return labels.conform(rows.drop("review_status", "confidence_level", "notes"), now)


def store_predictions(store: DataFrame, predicted: DataFrame, vector: str = "z", now: Column | None = None) -> DataFrame:
    return labels.upsert(store, store_rows(predicted, vector, now))


def live_batch(scored: DataFrame, model: AttackModel | None, store: DataFrame | None = None, threshold: float = -0.5, vector: str = "z", now: Column | None = None) -> dict[str, DataFrame]:
    """Predictions, their quality and, with a store, the grown store; the predictions are computed once."""
    predicted = hybrid_predict(scored, model, threshold, vector).persist(StorageLevel.MEMORY_AND_DISK)
    out = {
        "predictions": predicted,
        "quality": metrics.prediction_quality(predicted),
        "categories": metrics.final_categories(predicted),
        "review": predicted.agg(F.count_if("final_prediction.requires_manual_review").alias("requires_review")),
    }
    if store is not None:
        out["store"] = store_predictions(store, predicted, vector, now)
    return out
