"""Follow growing logs, score each arriving line, write the anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from connlens.functions.scalars import zoned_time
from connlens.operators.scoring import Detector, score_log
from connlens.schemas import LOG_COLUMNS
from connlens.sources import tables
from connlens.sources.conn_log import parse_lines


def follow_log(spark: SparkSession, folder: str, fields: Sequence[str] = LOG_COLUMNS, files_per_trigger: int = 1000) -> DataFrame:
    """Connections of the log files that appear in a folder; the checkpoint remembers which were read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    data = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return parse_lines(data, fields)


def detect(conns: DataFrame, detector: Detector, nan_policy: str = "post", cut: float = 0.0, late: str | None = None) -> DataFrame:
    """Anomalous connections with the time of detection; every line counts, as in a scan.

    ``late`` is for logs that deliver a line twice: anomalies of one uid within
    that span become one, and lines later than it are given up. Lines without a
    uid are never taken for repeats. Scoring comes first, so that the state
    holds anomalies only; its parameters are literals or broadcast.
    """
    rows = conns if late is None else conns.withWatermark("ts", late)
    scored = score_log(rows, detector, nan_policy, cut).filter(F.col("prediction") == "anomaly")
    if late is not None:
        scored = scored.filter("uid is not null").dropDuplicatesWithinWatermark(["uid"]).unionByName(scored.filter("uid is null"))
    return scored.select(
        zoned_time("ts").alias("timestamp"),
        F.coalesce("uid", F.lit("unknown")).alias("uid"),
        "score", "prediction",
        zoned_time(F.current_timestamp()).alias("detected_at"),
        F.to_json(F.struct(*conns.columns)).alias("raw_data"),
    )


def write_anomalies(anomalies: DataFrame, csv_path: str, table_path: str, checkpoint: str, available_now: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Two sinks per batch: CSV without and a table with the raw line.

    Each batch goes to a folder named by its number and is written with
    overwrite, so a batch repeated after a failure replaces itself.
    """
    def both(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            kept.drop("raw_data").write.mode("overwrite").option("header", True).csv(f"{csv_path}/batch={number}")
            kept.write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        finally:
            kept.unpersist()

    writer = anomalies.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def running_counters(conns: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Connections per time slot and protocol as data arrives; anomalies too when a prediction is present.

    ``late`` closes a slot that long after its end, which the append and update
    modes need to let go of it; later lines are given up then.
    """
    rows = conns if late is None else conns.withWatermark("ts", late)
    sums = [F.count("*").alias("n")]
    if "prediction" in conns.columns:
        sums.append(F.count_if(F.col("prediction") == "anomaly").alias("anomalies"))
    slots = rows.groupBy(F.window("ts", width).alias("_w"), F.coalesce("proto", F.lit("-")).alias("proto")).agg(*sums)
    return slots.select(F.col("_w.start").alias("slot"), *[c for c in slots.columns if c != "_w"])


def write_counters(counted: DataFrame, root: str, checkpoint: str, name: str = "counters", buckets: int = 8, available_now: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Merge the slots that a batch has changed into a stored table: only their buckets are rewritten.

    The rows are totals, not differences, so a batch that is repeated after a
    failure leaves the table as it was. ``read_counters`` gives the table.
    """
    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("key", F.concat_ws("|", F.col("slot").cast("string"), "proto")).persist()
        try:
            if tables.exists(rows.sparkSession, root, name):
                tables.change(root, name, rows, lambda old: old.join(rows, "key", "left_anti").unionByName(rows))
            elif rows.limit(1).count():
                tables.publish(rows, root, name, key="key", buckets=buckets, first=True)
        finally:
            rows.unpersist()

    writer = counted.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def read_counters(spark: SparkSession, root: str, name: str = "counters") -> DataFrame:
    return tables.current(spark, root, name).drop("key", "_bucket")
