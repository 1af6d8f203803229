"""Checks on labelled data before training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from connlens.functions.scalars import ratio, vector_from_text
from connlens.operators.spread import side_by_side


def class_balance(df: DataFrame, category: str = "attack_category", least_ratio: float = 0.2) -> DataFrame:
    """Smallest and largest class, their ratio and whether it exceeds the limit."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))
    row = counts.agg(F.count("*").alias("classes"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))
    share = ratio(F.col("min_n"), F.col("max_n"))
    return row.select("classes", "min_n", "max_n", share.alias("balance_ratio"), (share > least_ratio).alias("is_balanced"))


def vector_quality(df: DataFrame, vector: str = "feature_vector", sample_rows: int | None = None, order: str | None = None) -> DataFrame:
    """Parse errors, widths and whether they agree, over all rows or the first ``sample_rows`` along ``order``.

    The error rate divides by the rows looked at.
    """
    rows = df
    if sample_rows is not None:
        if order is None:
            raise ValueError("the first rows need an order to be the same at every run")
        rows = df.orderBy(order).limit(sample_rows)
    parsed = vector_from_text(vector) if df.schema[vector].dataType.typeName() == "string" else F.col(vector)
    width = F.size(parsed)
    good = F.when(parsed.isNotNull(), width)
    row = rows.agg(
        F.count("*").alias("sampled"), F.count(good).alias("parsed"), F.min(good).alias("_lo"), F.max(good).alias("_hi")
    )
    errors = F.col("sampled") - F.col("parsed")
    parseable = F.col("parsed") > 0
    return row.select(
        "sampled", errors.alias("parse_errors"), parseable.alias("parseable"),
        F.coalesce(parseable & (F.col("_lo") == F.col("_hi")), F.lit(False)).alias("consistent_dimensions"),
        F.coalesce("_lo", F.lit(0)).alias("feature_dimensions"),
        F.when(parseable, ratio(errors, F.col("sampled"))).otherwise(1.0).alias("parse_error_rate"),
    )


def confidence_mix(df: DataFrame, confidence: str = "confidence", high: float = 0.8, low: float = 0.3) -> DataFrame:
    share = ratio(F.count_if(F.col(confidence) == "high"), F.count("*"))
    row = df.agg(F.count("*").alias("n"), share.alias("high_share"))
    advice = F.when(F.col("high_share") > high, "review labeling criteria").when(F.col("high_share") < low, "improve label quality")
    return row.withColumn("advice", advice)


# What a training set needs, and from where on it is graded.
MIN_SAMPLES, MIN_CATEGORIES = 50, 2
HIGH_SHARE = (0.3, 0.8)
#: Of each topic: the measured column, then (level, bound below which it holds); level for all else, None for no remark.
GRADES = (
    ("samples", "total_samples", (("critical", 100), ("warning", 200)), "good"),
    ("categories", "category_count", (("critical", 3), ("warning", 5)), "good"),
    ("quality", "sound", (("critical", 0),), "good"),
    ("balance", "category_balance_ratio", (("critical", 0.1), ("warning", 0.3)), None),
    ("risk", "ease", (("high", 1), ("medium", 2)), "low"),
)


def _codes(found: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in their order; an unknown condition does not hold."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(code)) for code, holds in found.items()]))


def validate_labels(
    df: DataFrame, category: str = "attack_category", vector: str = "feature_vector", confidence: str = "confidence",
    min_samples: int = MIN_SAMPLES, min_categories: int = MIN_CATEGORIES, sample_rows: int | None = None, order: str | None = None,
) -> DataFrame:
    """One row: measures of size, balance, vectors and confidence, the verdict, and codes for ``issues`` and ``advice``."""
    has = {name: column in df.columns for name, column in (("category", category), ("vector", vector), ("confidence", confidence))}
    parts = [df.agg(F.count("*").alias("total_samples"))]
    if has["category"]:
        parts.append(class_balance(df, category))
    if has["vector"]:
        parts.append(vector_quality(df, vector, sample_rows, order))
    if has["confidence"]:
        parts.append(confidence_mix(df, confidence).select("high_share"))
    row = side_by_side(parts)
    absent = {"classes": F.lit(0).cast("bigint"), "balance_ratio": F.lit(1.0), "is_balanced": F.lit(True), "parseable": F.lit(None).cast("boolean"), "consistent_dimensions": F.lit(None).cast("boolean"), "parse_errors": F.lit(0).cast("bigint"), "high_share": F.lit(None).cast("double")}
    row = row.withColumns({name: value for name, value in absent.items() if name not in row.columns})

    readable = F.col("parseable")
    issues = {
        "no_category": F.lit(not has["category"]), "no_vector": F.lit(not has["vector"]), "unread_vectors": readable & (F.col("parse_errors") > 0),
        "uneven_vectors": readable & ~F.col("consistent_dimensions"), "no_read_vector": ~readable,
    }
    row = row.withColumn("issues", _codes(issues)).withColumns({
        "has_min_samples": F.col("total_samples") >= min_samples, "has_min_categories": F.col("classes") >= min_categories,
        "category_count": F.col("classes"), "category_balance_ratio": F.col("balance_ratio"),
    })
    count = F.size("issues")
    row = row.withColumn("is_valid", F.col("has_min_samples") & F.col("has_min_categories") & (count == 0))
    row = row.withColumn("training_recommended", F.col("is_valid") | (F.col("has_min_samples") & (count <= 1)))
    advice = {
        "uneven_classes": ~F.col("is_balanced"), "add_category": F.lit(not has["category"]), "few_samples": ~F.col("has_min_samples"), "few_categories": ~F.col("has_min_categories"),
        "mostly_high_confidence": F.col("high_share") > HIGH_SHARE[1], "rarely_high_confidence": F.col("high_share") < HIGH_SHARE[0],
        "train_with_care": ~F.col("is_valid") & F.col("training_recommended"), "do_not_train": ~F.col("training_recommended"),
    }
    risk = F.when(F.col("is_valid"), "low").when(F.col("training_recommended"), "medium").otherwise("high")
    return row.select(
        "total_samples", "category_count", "category_balance_ratio", "has_min_samples", "has_min_categories", "issues", "is_valid",
        risk.alias("risk_level"), "training_recommended", _codes(advice).alias("advice"),
    )


def training_advice(verdict: DataFrame) -> DataFrame:
    """Grades of a verdict by the table above: position, topic, level and the measured value, one row per remark."""
    measured = verdict.withColumn("sound", -F.size("issues")).withColumn("ease", F.when(F.col("risk_level") == "high", 0).when(F.col("risk_level") == "medium", 1).otherwise(2))

    def graded(topic: str, column: str, bounds: tuple, rest: str | None) -> Column:
        level = F.lit(rest)
        for name, bound in reversed(bounds):
            level = F.when(F.col(column) < bound, F.lit(name)).otherwise(level)
        return F.struct(F.lit(topic).alias("topic"), level.cast("string").alias("level"), F.col(column).cast("double").alias("value"))

    remarks = F.array(*[graded(*rule) for rule in GRADES])
    return measured.select(F.posexplode(remarks).alias("position", "r")).select("position", "r.*").filter("level is not null")
