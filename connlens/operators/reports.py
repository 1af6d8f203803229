"""Corpus, scan and protocol reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from connlens.functions.scalars import display_time, plain_time, ratio, scan_time, score_band, severity


def _anomalies() -> Column:
    return F.count_if(F.col("prediction") == "anomaly")


def corpus_totals(results: DataFrame) -> DataFrame:
    """Scans, rows, anomalies, normals and the overall rate in percent."""
    counts = results.agg(
        F.countDistinct("scan_id").alias("total_scans"),
        F.count("*").alias("total_connections"),
        _anomalies().alias("anomaly_count"),
        F.count_if(F.col("prediction") == "normal").alias("normal_count"),
    )
    return counts.withColumn("anomaly_rate", F.round(ratio(F.col("anomaly_count"), F.col("total_connections"), 100), 2))


def scan_totals(results: DataFrame) -> DataFrame:
    counts = results.groupBy("scan_id").agg(F.count("*").alias("connections"), _anomalies().alias("anomalies"))
    return counts.withColumn("anomaly_rate", F.round(ratio(F.col("anomalies"), F.col("connections"), 100), 2))


def newest_scans(rows: DataFrame, size: int = 10) -> list[str | None]:
    """The newest scan ids of a log or of results, at most ``size``; only the ids are read."""
    return [r["scan_id"] for r in rows.select("scan_id").distinct().orderBy(F.col("scan_id").desc()).limit(size).collect()]


def of_scans(rows: DataFrame, scans: Sequence[str | None]) -> DataFrame:
    """Rows of the named scans. The names are literals: the filter reaches the files when it is put before the scoring."""
    named = F.col("scan_id").isin([s for s in scans if s is not None])
    return rows.filter(named | F.col("scan_id").isNull() if None in scans else named)


def recent_scans(results: DataFrame, size: int = 10, origins: DataFrame | None = None, scans: Sequence[str | None] | None = None) -> DataFrame:
    """The newest scans with a readable time; ``origins`` adds one origin record per scan.

    ``scans`` names them when they are known, from ``newest_scans`` of the log
    or from the names of folders; ``results`` may then hold their rows alone.
    """
    chosen = of_scans(results, newest_scans(results, size) if scans is None else scans)
    named = F.coalesce(display_time(scan_time("scan_id")), F.translate("scan_id", "_", " "))
    out = scan_totals(chosen).withColumn("scan_time", named)
    if origins is None:
        return out
    joined = out.join(origins, "scan_id", "left")
    return joined.fillna({"origin_type": "unknown", "origin_description": "Unknown Source", "origin_details": "Could not determine PCAP origin"})


def threat_timeline(scans: DataFrame, high: float = 50.0, medium: float = 20.0) -> DataFrame:
    """Scans with anomalies and their severity."""
    return scans.filter(F.col("anomalies") > 0).withColumn("severity", severity("anomaly_rate", high, medium))


def protocol_distribution(log: DataFrame) -> DataFrame:
    """Rows per protocol; a null counts under the log's own mark ``-``."""
    return log.groupBy(F.coalesce("proto", F.lit("-")).alias("proto")).agg(F.count("*").alias("n"))


def imported_scans(results: DataFrame, training: DataFrame, source: str = "analysis_import") -> DataFrame:
    """Scans with at least one uid stored by an import."""
    stored = training.filter(F.col("training_source") == source).select("uid")
    return results.select("scan_id", "uid").join(stored, "uid", "left_semi").select("scan_id").distinct()


def scan_inventory(results: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Every scan with its counts, time and whether it was imported."""
    changed = [F.max("modified").alias("_modified")] if "modified" in results.columns else []
    counts = results.groupBy("scan_id").agg(F.count("*").alias("total_connections"), _anomalies().alias("anomaly_count"), *changed)
    when = scan_time("scan_id")
    if changed:
        when = F.coalesce(when, F.col("_modified"))
    out = counts.withColumn("normal_count", F.col("total_connections") - F.col("anomaly_count"))
    out = out.withColumn("timestamp_display", plain_time(when)).drop("_modified")
    if training is None:
        return out.withColumn("is_imported", F.lit(False))
    marks = imported_scans(results, training).withColumn("_in", F.lit(True))
    return out.join(marks, "scan_id", "left").withColumn("is_imported", F.coalesce("_in", F.lit(False))).drop("_in")


def scan_detail(flagged: DataFrame) -> DataFrame:
    """Header of each scan: totals, rate to two digits, rows with an extracted capture."""
    extracted = F.count_if("has_extracted_pcap") if "has_extracted_pcap" in flagged.columns else F.lit(0).cast("bigint")
    out = flagged.groupBy("scan_id").agg(
        F.count("*").alias("total"), _anomalies().alias("anomalies"), extracted.alias("extracted")
    )
    out = out.withColumn("normal", F.col("total") - F.col("anomalies"))
    return out.withColumn("anomaly_rate", F.round(ratio(F.col("anomalies"), F.col("total"), 100), 2))


def score_bands(results: DataFrame, high: float = -0.5, moderate: float = 0.0) -> DataFrame:
    return results.groupBy(score_band("score", high, moderate).alias("band")).agg(F.count("*").alias("n"))


def score_series(results: DataFrame, unit: str = "day") -> DataFrame:
    """Score over time: count, anomalies, lowest and mean score per time slot."""
    slots = results.groupBy(F.date_trunc(unit, "timestamp").alias("slot")).agg(
        F.count("*").alias("n"), _anomalies().alias("anomalies"), F.min("score").alias("min_score"), F.avg("score").alias("avg_score")
    )
    return slots.withColumn("avg_score", F.round("avg_score", 6))


def time_ordered(results: DataFrame) -> DataFrame:
    """Result rows in time order (a distributed range sort)."""
    return results.orderBy("timestamp", "uid")


def score_histogram(results: DataFrame, bins: int = 30, column: str = "score") -> DataFrame:
    """Equal-width bins between the smallest and the largest score, empty bins kept, split by side of the decision line."""
    values = results.filter(F.col(column).isNotNull() & ~F.isnan(column))
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None:
        return values.sparkSession.createDataFrame([], "bin int, bin_start double, n bigint, anomalies bigint")
    width = (high - low) / bins if high > low else 1.0
    index = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col(column) < 0).alias("anomalies"))
    grid = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(counts, "bin", "left").fillna(0, ["n", "anomalies"])
    return out.select("bin", F.round(F.lit(low) + F.col("bin") * F.lit(width), 9).alias("bin_start"), "n", "anomalies")


def score_density(results: DataFrame, points: int = 50, bins: int = 200, bandwidth: float | None = None, column: str = "score") -> DataFrame:
    """Gaussian kernel density on a fixed grid, from bin counts.

    The rows are reduced to ``bins`` counts first, so the kernel sum works on
    ``bins * points`` numbers whatever the size of the table. The bandwidth
    defaults to Scott's rule.
    """
    values = results.filter(F.col(column).isNotNull() & ~F.isnan(column))
    row = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.stddev_samp(column).alias("sd"), F.count("*").alias("n")).first()
    spark = values.sparkSession
    if not row["n"]:
        return spark.createDataFrame([], "x double, density double")
    low, high, n = row["lo"], row["hi"], row["n"]
    width = (high - low) / bins if high > low else 1.0
    h = bandwidth or (row["sd"] or 1.0) * n ** -0.2 or 1.0
    index = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    binned = values.groupBy(index.alias("b")).agg(F.count("*").alias("c"))
    centre = F.lit(low) + (F.col("b") + F.lit(0.5)) * F.lit(width)
    gathered = binned.select(F.struct(centre.alias("x"), F.col("c").cast("double").alias("c")).alias("p")).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    step = (high - low) / (points - 1) if points > 1 else 0.0
    grid = gathered.select("ps", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.lit(low) + F.col("i") * F.lit(step)
    kernel = F.aggregate(
        F.col("ps"), F.lit(0.0),
        lambda s, p: s + p["c"] * F.exp(F.lit(-0.5) * ((x - p["x"]) / F.lit(h)) * ((x - p["x"]) / F.lit(h))),
    )
    norm = n * h * (2.0 * 3.141592653589793) ** 0.5
    return grid.select(F.col("i").alias("point"), F.round(x, 6).alias("x"), F.round(kernel / F.lit(norm), 6).alias("density"))
