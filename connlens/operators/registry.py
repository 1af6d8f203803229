"""Versions of stored model parts: ``(model, version, part, path, created_at)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parts a usable version must have.
PARTS = ("model", "scaler", "encoders")


def _number(version: Column) -> Column:
    """0 for the base version, n for ``v<n>`` or a plain number."""
    digits = F.regexp_extract(version.cast("string"), r"^v?(\d+)$", 1)
    return F.when(version.isNull() | (version.cast("string") == ""), 0).otherwise(digits.try_cast("int"))


def model_versions(registry: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    """Every version with its number of needed parts and whether it is complete, newest first."""
    rows = registry.filter(F.col("part").isin(*parts)).select(_number(F.col("version")).alias("version"), "part").filter("version is not null")
    counts = rows.groupBy("version").agg(F.countDistinct("part").alias("parts"))
    return counts.withColumn("is_complete", F.col("parts") == len(parts)).orderBy(F.col("version").desc())


def latest_version(registry: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    """Highest complete version; null when there is none."""
    return model_versions(registry, parts).filter("is_complete").agg(F.max("version").alias("version"))


def next_version(registry: DataFrame, first: int = 1) -> DataFrame:
    """One above the highest stored number, complete or not."""
    top = registry.select(_number(F.col("version")).alias("version")).agg(F.max("version").alias("_top"))
    return top.select((F.greatest(F.coalesce("_top", F.lit(first)), F.lit(first)) + 1).alias("version"))
