"""Capture documents and the flat lineage table behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.functions.scalars import file_stem, origin_of_name, text_to_timestamp
from connlens.operators.spread import sized_join
from connlens.schemas import CAPTURE_DOCUMENT

LINEAGE = (
    "pcap_name string, origin_type string, iface string, duration_seconds int, original_filename string, "
    "created timestamp, analysis_id string, anomaly_count bigint, total_connections bigint"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document, newest first."""
    rows = spark.read.option("multiLine", True).schema(CAPTURE_DOCUMENT).json(path)
    created = text_to_timestamp(F.regexp_replace("timestamp", "Z$", ""))
    return rows.withColumn("created", created).orderBy(F.col("created").desc_nulls_last(), "pcap_filename")


def list_captures(documents: DataFrame, names: DataFrame) -> DataFrame:
    """Every capture file with its document, or a record derived from its name; newest first.

    A document belongs to the file of the same stem.
    """
    files = names.select("pcap_name").distinct().withColumn("_stem", file_stem("pcap_name"))
    described = documents.withColumn("_stem", file_stem("pcap_filename"))
    joined = files.join(described, "_stem", "left")
    return joined.select(
        "pcap_name",
        F.coalesce("origin_type", origin_of_name("pcap_name")).alias("origin_type"),
        F.coalesce("metadata.interface", F.when(F.col("pcap_filename").isNull() & F.col("pcap_name").startswith("capture_"), "unknown")).alias("iface"),
        F.col("metadata.duration_seconds").alias("duration_seconds"),
        F.coalesce("metadata.original_filename", F.when(F.col("pcap_filename").isNull() & F.col("pcap_name").startswith("uploaded_"), F.col("pcap_name"))).alias("original_filename"),
        "created", F.coalesce("analysis_results", F.array()).alias("analysis_results"),
    ).orderBy(F.col("created").desc_nulls_last(), "pcap_name")


def lineage_of(documents: DataFrame) -> DataFrame:
    """One row per capture and analysis; a capture without analysis keeps one row with a null id."""
    flat = documents.select(
        F.col("pcap_filename").alias("pcap_name"), "origin_type", F.col("metadata.interface").alias("iface"),
        F.col("metadata.duration_seconds").alias("duration_seconds"), F.col("metadata.original_filename").alias("original_filename"),
        "created", F.inline_outer("analysis_results"),
    )
    return flat.select("pcap_name", "origin_type", "iface", "duration_seconds", "original_filename", "created", "analysis_id", "anomaly_count", "total_connections")


def append_lineage(rows: DataFrame, path: str) -> None:
    """Record analyses. Appending never rewrites a document; repeats are removed by the reader."""
    columns = [c.split()[0] for c in LINEAGE.split(", ")]
    rows.select(*columns).write.mode("append").parquet(path)


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINEAGE).parquet(path).distinct()


def nested_documents(lineage: DataFrame, largest: int = 100_000) -> DataFrame:
    """The document shape again: one row per capture with the array of its distinct analyses, and ``part``.

    A capture with more than ``largest`` analyses comes in numbered parts of
    about half that size, dealt by a hash of the analysis; most have part 0 alone.
    """
    rows = lineage.distinct()
    sizes = rows.groupBy("pcap_name").agg(F.count("*").alias("_n")).filter(F.col("_n") > largest)
    parts = sizes.select("pcap_name", F.ceil(F.col("_n") * 2 / largest).cast("int").alias("_parts"))
    # Only captures over the limit are listed, and few rows of a table can have that many.
    split = sized_join(rows, parts, "pcap_name")
    part = F.coalesce(F.pmod(F.xxhash64("analysis_id"), F.col("_parts")).cast("int"), F.lit(0))
    entry = F.when(F.col("analysis_id").isNotNull(), F.struct("analysis_id", "anomaly_count", "total_connections"))
    keys = ["pcap_name", "origin_type", "iface", "duration_seconds", "original_filename", "created"]
    return split.withColumn("part", part).groupBy(*keys, "part").agg(F.sort_array(F.collect_list(entry)).alias("analysis_results"))
