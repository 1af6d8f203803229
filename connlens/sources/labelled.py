"""Labelled anomalies in the current and the legacy CSV layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.functions.scalars import text_to_timestamp, vector_from_text
from connlens.schemas import LABELLED, LABELLED_LEGACY


def read_labelled(spark: SparkSession, path: str, drop_bad: bool = True) -> DataFrame:
    """Rows with a parsed time and the vector as numbers; rows whose vector cannot be parsed are dropped.

    The layout is told by the header. Legacy rows get the category columns as null.
    """
    head = spark.read.option("header", True).csv(path).columns
    layout = LABELLED if "attack_category" in head else LABELLED_LEGACY
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(layout).csv(path)
    out = rows.withColumns({
        "timestamp": text_to_timestamp("timestamp"), "feature_vector": vector_from_text("feature_vector"),
    })
    return out.filter(F.col("feature_vector").isNotNull()) if drop_bad else out


def write_labelled(df: DataFrame, path: str, mode: str = "error") -> None:
    df.to(LABELLED).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def upgrade_legacy(df: DataFrame, confidence: str = "medium") -> DataFrame:
    """Legacy rows in the current layout: underscores become dashes, other labels are ``custom-threat``."""
    known = ["port-scan", "ddos"]
    named = F.translate("user_label", "_", "-")
    category = F.when(named == "ddos", "ddos-attack").when(named.isin(known), named).otherwise("custom-threat")
    return df.select(
        "timestamp", "uid", "score", category.alias("attack_category"), F.lit("").alias("attack_subcategory"),
        F.lit(confidence).alias("confidence"), F.lit("Unknown").alias("source_ip"), F.lit("Unknown").alias("dest_ip"),
        F.lit("migrated_label").alias("user_feedback"), F.lit("legacy_migration").alias("training_source"),
        "feature_vector", F.lit("").alias("suricata_rule_candidate"),
    )
