"""Scan results: one file of scored rows per scan."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from connlens.functions.scalars import scan_time, text_to_timestamp
from connlens.schemas import RESULT, RESULT_WITH_TRUTH
from connlens.sources.files import folders

REQUIRED = [f.name for f in RESULT.fields]


def read_results(spark: SparkSession, path: str, truth: bool = False) -> DataFrame:
    """Result rows of one scan with a parsed time; a missing required column raises."""
    head = spark.read.option("header", True).csv(path).columns
    absent = [c for c in REQUIRED if c not in head]
    if absent:
        raise ValueError(f"result columns absent: {absent}")
    known = {f.name: f.dataType.simpleString() for f in RESULT_WITH_TRUTH.fields}
    ddl = ", ".join(f"`{c}` {known.get(c, 'string')}" for c in head)
    rows = spark.read.option("header", True).schema(ddl).csv(path)
    kept = REQUIRED + (["true_label"] if "true_label" in head else [])
    if truth and "true_label" not in head:
        raise ValueError("result column absent: true_label")
    return rows.select(*kept).withColumn("timestamp", text_to_timestamp("timestamp"))


def has_truth(df: DataFrame) -> bool:
    return "true_label" in df.columns


def write_results(df: DataFrame, path: str, file_format: str = "csv", mode: str = "error") -> None:
    """One folder per scan; large scans are split over several files, small ones are not scattered."""
    writer = df.hint("rebalance", "scan_id").write.mode(mode).partitionBy("scan_id")
    if file_format == "csv":
        writer.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    else:
        writer.format(file_format).save(path)


def folder_scan_id(path: str | Column) -> Column:
    """Scan id from the folder that holds the file; Spark's ``scan_id=`` prefix is taken off."""
    return F.regexp_extract(path, r"(?:scan_id(?:=|%3D))?([^/=]+)/[^/]+$", 1)


def read_corpus(spark: SparkSession, root: str, file: str = "*.csv") -> DataFrame:
    """Rows of every scan below ``root`` with ``scan_id``, the scan's time and the file's change time."""
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(RESULT).csv(f"{root}/*/{file}")
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    scan = folder_scan_id(F.col("file"))
    return rows.select(
        scan.alias("scan_id"), "uid", text_to_timestamp("timestamp").alias("timestamp"), "score", "prediction",
        F.coalesce(scan_time(scan), F.col("modified")).alias("scan_start"), "modified", "file",
    )


def scan_folders(root: str) -> list[tuple[str, float]]:
    """(scan id, change time) of every scan below ``root``, from the names of the folders alone."""
    return [(unquote(name.removeprefix("scan_id=")), changed) for name, changed in folders(root)]


def newest_folders(root: str, size: int = 1, by: str = "scan_id") -> list[str]:
    """Ids of the newest scans, by name or by the change time of their folders."""
    found = scan_folders(root)
    return [name for name, _ in sorted(found, key=lambda f: f[0] if by == "scan_id" else (f[1], f[0]), reverse=True)[:size]]


def read_scans(spark: SparkSession, root: str, scans: Sequence[str]) -> DataFrame:
    """Rows of some scans: the ids are a literal filter on the partition column, so other folders are not opened."""
    schema = T.StructType([*RESULT.fields, T.StructField("scan_id", T.StringType())])
    rows = spark.read.option("header", True).schema(schema).option("basePath", root).csv(root).filter(F.col("scan_id").isin(list(scans)))
    return rows.select("scan_id", "uid", text_to_timestamp("timestamp").alias("timestamp"), "score", "prediction")


def latest_scan(corpus: DataFrame, by: str = "scan_id") -> DataFrame:
    """The newest scan by name or by file time, one row."""
    if by == "scan_id":
        return corpus.agg(F.max("scan_id").alias("scan_id"))
    return corpus.agg(F.max_by("scan_id", F.struct("modified", "scan_id")).alias("scan_id"))


def with_fallbacks(df: DataFrame) -> DataFrame:
    """``score`` and ``is_anomaly`` from whichever of the known columns exist."""
    scores = [F.col(c).cast("double") for c in ("score", "anomaly_score") if c in df.columns]
    score = F.coalesce(*scores, F.lit(0.0))
    flags = [F.coalesce(F.col("is_anomaly").cast("boolean"), F.lit(False))] if "is_anomaly" in df.columns else []
    if "prediction" in df.columns:
        flags.append(F.coalesce(F.col("prediction") == "anomaly", F.lit(False)))
    flag = F.lit(False)
    for f in flags:
        flag = flag | f
    return df.withColumn("score", score).withColumn("is_anomaly", flag)
