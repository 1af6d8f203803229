"""Row filters, paging and lookups on the training table and the scan results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from connlens.operators.spread import sized_join, spread_join
from connlens.schemas import BROWSE_FIELDS, CONFIDENCE_ORDER, EXPORT_FIELDS

EQUAL_FILTERS = ("is_anomaly", "label_category", "review_status", "training_source")


def browse(df: DataFrame, start_date=None, end_date=None, time: str = "timestamp", **equal) -> DataFrame:
    """AND of the given equalities and the inclusive time range; None and '' mean no filter."""
    unknown = set(equal) - set(EQUAL_FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    out = df
    for name, value in equal.items():
        if value is not None and value != "":
            out = out.filter(F.col(name) == F.lit(value))
    if start_date not in (None, ""):
        out = out.filter(F.col(time) >= F.lit(start_date).cast("timestamp"))
    if end_date not in (None, ""):
        out = out.filter(F.col(time) <= F.lit(end_date).cast("timestamp"))
    return out


def page(df: DataFrame, limit: int = 100, offset: int = 0, cap: int | None = None, time: str = "timestamp", key: str = "uid") -> DataFrame:
    """Newest first, one page; the key breaks ties so that pages do not overlap."""
    size = limit if cap is None else min(limit, cap)
    ordered = df.orderBy(F.col(time).desc(), F.col(key))
    return (ordered.offset(offset) if offset else ordered).limit(size)


def browse_record(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in BROWSE_FIELDS if c in df.columns])


def export_record(df: DataFrame, vector: bool = False) -> DataFrame:
    return df.select(*EXPORT_FIELDS, *(["feature_vector"] if vector else []))


def confidence_rank(level: str | Column) -> Column:
    c = F.col(level) if isinstance(level, str) else level
    out = F.lit(None).cast("int")
    for name, rank in CONFIDENCE_ORDER.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def trainable(df: DataFrame, minimum: str = "medium", vector: str | None = "feature_vector") -> DataFrame:
    """Rows with both label parts, a vector and at least the minimum confidence."""
    filled = (F.length("label_category") > 0) & (F.length("label_subcategory") > 0)
    if vector:
        filled = filled & F.col(vector).isNotNull()
    return df.filter(filled & (confidence_rank("confidence_level") >= CONFIDENCE_ORDER[minimum]))


def with_class(df: DataFrame, name: str = "class_name") -> DataFrame:
    return df.withColumn(name, F.concat_ws(".", "label_category", "label_subcategory"))


def frequent_classes(df: DataFrame, class_column: str = "class_name", least: int = 10) -> DataFrame:
    """Keep the rows of classes with at least ``least`` rows."""
    kept = df.groupBy(class_column).count().filter(F.col("count") >= least).select(class_column)
    return sized_join(df, kept, class_column, "left_semi")


def check_trainable(rows: int, classes: int, least_rows: int = 20, least_classes: int = 2) -> None:
    if rows < least_rows:
        raise ValueError(f"too few rows to train on: {rows}, at least {least_rows} are needed")
    if classes < least_classes:
        raise ValueError(f"too few classes to tell apart: {classes}, at least {least_classes} are needed")


def label_queue(results: DataFrame, labelled: DataFrame, size: int = 20, cut: float = 0.0) -> DataFrame:
    """The ``size`` strongest anomalies with their absolute score and whether they are labelled already.

    The queue is cut before the lookup, so the join sees ``size`` rows.
    """
    score = "anomaly_score" if "anomaly_score" in results.columns else "score"
    queue = results.filter(F.col(score) < cut).orderBy(F.col(score), F.col("uid")).limit(size)
    marks = labelled.select("uid").join(F.broadcast(queue.select("uid")), "uid", "left_semi").distinct()
    flagged = queue.join(marks.withColumn("current_label", F.lit("labeled")), "uid", "left")
    return flagged.orderBy(F.col(score), F.col("uid")).withColumn("score", F.abs(score))


def result_anomalies(df: DataFrame) -> DataFrame:
    """Rows flagged by ``is_anomaly`` or by the text prediction, whichever columns exist."""
    tests = []
    if "is_anomaly" in df.columns:
        tests.append(F.coalesce(F.col("is_anomaly").cast("boolean"), F.lit(False)))
    if "prediction" in df.columns:
        tests.append(F.coalesce(F.col("prediction") == "anomaly", F.lit(False)))
    if not tests:
        return df.limit(0)
    either = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return df.filter(either)


def lookup_uids(log: DataFrame, uids: DataFrame) -> DataFrame:
    """Five-tuple of each wanted uid, protocol in lower case; the first log line answers."""
    tuple_columns = ["source_ip", "source_port", "dest_ip", "dest_port", "proto"]
    found = sized_join(log.select("uid", "line_no", *tuple_columns), uids.select("uid"), "uid", "left_semi", distinct=True)
    first = found.groupBy("uid").agg(F.min_by(F.struct(*tuple_columns), "line_no").alias("_t"))
    return first.select("uid", *[F.col(f"_t.{c}") for c in tuple_columns[:-1]], F.lower("_t.proto").alias("proto"))


def scan_of_uid(corpus: DataFrame, uids: DataFrame | None = None) -> DataFrame:
    """Earliest scan that contains each uid."""
    rows = corpus.select("uid", "scan_id")
    if uids is not None:
        rows = sized_join(rows, uids.select("uid"), "uid", "left_semi", distinct=True)
    return rows.groupBy("uid").agg(F.min("scan_id").alias("scan_id"))
