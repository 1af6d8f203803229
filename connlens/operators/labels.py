"""The label store as table-to-table changes, and its statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.functions.scalars import vector_from_text, vector_to_text
from connlens.operators.filters import result_anomalies
from connlens.operators.joins import enrich_first
from connlens.operators.spread import sized_join
from connlens.schemas import DEFAULT_LABELS, LABEL_DEFINITION, LABELLED, TRAINING_TYPES

LABEL_FIELDS = ["label_category", "label_subcategory", "confidence_level", "labeled_by", "labeled_at", "review_status", "notes"]


# --- statistics ------------------------------------------------------------

def label_statistics(df: DataFrame) -> DataFrame:
    """Totals of the store; the sums are null on an empty table."""
    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    return df.agg(
        F.count("*").alias("total_connections"),
        total(F.coalesce(F.col("is_anomaly"), F.lit(False))).alias("total_anomalies"),
        total(F.col("label_category").isNotNull()).alias("labeled_connections"),
        total(F.coalesce(F.col("review_status") == "verified", F.lit(False))).alias("verified_connections"),
    )


def label_distribution(df: DataFrame) -> DataFrame:
    labelled = df.filter(F.col("label_category").isNotNull())
    counts = labelled.groupBy("label_category", "label_subcategory").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "label_category", "label_subcategory")


def breakdown(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


# --- table changes ---------------------------------------------------------

def keep_last(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """The row with the highest ``order`` per key, combined map-side."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def stack(first: DataFrame | None, second: DataFrame | None) -> DataFrame:
    """Rows of both feature sets; one may be absent."""
    if first is None and second is None:
        raise ValueError("no training data: both inputs are absent")
    if first is None or second is None:
        return first if second is None else second
    return first.unionByName(second)


def append_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def merge_labels(old: DataFrame, new: DataFrame, key: str = "uid") -> DataFrame:
    """Append, then keep the newest label of each key. Old rows with a new label are dropped before the append."""
    remaining = sized_join(old, new.select(key), key, "left_anti", distinct=True)
    return append_labels(remaining, new)


def conform(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Layout of the stored table, absent columns filled with their defaults."""
    moment = F.current_timestamp() if now is None else now
    defaults = {"is_anomaly": F.lit(False), "review_status": F.lit("pending"), "has_extracted_pcap": F.lit(False)}
    generated = {"created_at": moment, "updated_at": moment}
    out = []
    for name, dtype in TRAINING_TYPES.items():
        if name in generated:
            value = generated[name]
        elif name in df.columns:
            value = F.coalesce(F.col(name), defaults[name]) if name in defaults else F.col(name)
        else:
            value = defaults.get(name, F.lit(None))
        out.append(value.cast(dtype).alias(name))
    return df.select(*out)


def upsert(old: DataFrame, new: DataFrame, key: str | Sequence[str] = "uid", keep_labels: bool = False, order: str | None = None) -> DataFrame:
    """Whole-row replace on ``key``; ``new`` may repeat a key when ``order`` tells which row is the last.

    ``keep_labels`` carries the label columns of a replaced row over.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = new if order is None else keep_last(new, keys, order)
    if order is not None and order not in old.columns:
        rows = rows.drop(order)
    if keep_labels:
        names = [c for c in LABEL_FIELDS if c in old.columns]
        held = old.filter(F.col("label_category").isNotNull()).select(*keys, F.struct(*names).alias("_held"))
        joined = rows.join(held, keys, "left")
        rows = joined.select(*[
            F.when(F.col("_held").isNotNull(), F.col(f"_held.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns
        ])
    if len(keys) == 1:
        remaining = sized_join(old, rows.select(*keys), keys[0], "left_anti", distinct=True)
    else:
        remaining = old.join(rows.select(*keys).distinct(), keys, "left_anti")
    return remaining.unionByName(rows)


def bulk_label(
    df: DataFrame, uids: DataFrame, category: str, subcategory: str, confidence: str, labeled_by: str,
    notes: str | None = None, review_status: str = "reviewed", now: Column | None = None,
) -> DataFrame:
    """Set the label columns of the listed uids; a null note overwrites the old one."""
    moment = F.current_timestamp() if now is None else now
    new = {
        "label_category": F.lit(category), "label_subcategory": F.lit(subcategory), "confidence_level": F.lit(confidence),
        "labeled_by": F.lit(labeled_by), "labeled_at": moment, "review_status": F.lit(review_status),
        "notes": F.lit(notes).cast("string"), "updated_at": moment,
    }
    return _update(df, uids, new)


def mark_extracted(df: DataFrame, uids: DataFrame, value: bool = True, now: Column | None = None) -> DataFrame:
    return _update(df, uids, {"has_extracted_pcap": F.lit(value), "updated_at": F.current_timestamp() if now is None else now})


def _update(df: DataFrame, uids: DataFrame, new: dict[str, Column]) -> DataFrame:
    hit = sized_join(df, uids.select("uid", F.lit(True).alias("_hit")), "uid", distinct=True)
    return hit.select(*[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def count_listed(df: DataFrame, uids: DataFrame) -> DataFrame:
    """How many stored rows a uid list reaches: the count an update or a delete reports."""
    return sized_join(df.select("uid"), uids.select("uid"), "uid", "left_semi", distinct=True).agg(F.count("*").alias("changed"))


def delete_uids(df: DataFrame, uids: DataFrame) -> DataFrame:
    return sized_join(df, uids.select("uid"), "uid", "left_anti", distinct=True)


def add_column(df: DataFrame, name: str = "has_extracted_pcap", default=False) -> DataFrame:
    """The column with its default where it is absent or null."""
    if name not in df.columns:
        return df.withColumn(name, F.lit(default))
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


# --- imports and labelling -------------------------------------------------

def import_rows(results: DataFrame, log: DataFrame, source: str = "analysis_import", scan_start=None, now: Column | None = None) -> DataFrame:
    """Anomalous results with their log details, in the stored layout, pending review and without a label."""
    score = "score" if "score" in results.columns else "anomaly_score"
    detailed = enrich_first(result_anomalies(results), log, scan_start)
    vector = F.lit(None).cast("array<double>")
    if "feature_vector" in results.columns:
        is_text = results.schema["feature_vector"].dataType.typeName() == "string"
        vector = vector_from_text("feature_vector") if is_text else F.col("feature_vector")
    rows = detailed.withColumns({
        "feature_vector": vector, "anomaly_score": F.coalesce(F.col(score), F.lit(0.0)), "is_anomaly": F.lit(True),
        "training_source": F.lit(source), "review_status": F.lit("pending"),
        **{c: F.lit(None).cast("string") for c in ("label_category", "label_subcategory", "confidence_level", "labeled_by", "notes")},
    })
    return conform(rows, now)


def import_scan(store: DataFrame, results: DataFrame, log: DataFrame, keep_labels: bool = False, now: Column | None = None) -> DataFrame:
    return upsert(store, import_rows(results, log, now=now), keep_labels=keep_labels)


def label_from_scan(
    labels: DataFrame, results: DataFrame, uids: DataFrame, category: str, confidence: str = "medium",
    now: Column | None = None, order: str = "line_no",
) -> DataFrame:
    """Label the first result row of each listed uid and keep one label per uid."""
    return merge_labels(labels, scan_labels(results, uids, category, confidence, now, order))


def scan_labels(results: DataFrame, uids: DataFrame, category: str, confidence: str = "medium", now: Column | None = None, order: str = "line_no") -> DataFrame:
    moment = F.current_timestamp() if now is None else now
    score = "anomaly_score" if "anomaly_score" in results.columns else "score"
    wanted = sized_join(results, uids.select("uid"), "uid", "left_semi", distinct=True)
    columns = [c for c in results.columns if c != "uid"]
    first = wanted.groupBy("uid").agg(F.min_by(F.struct(*columns), F.col(order)).alias("_r"))

    def own(c: str, default: str) -> Column:
        return F.coalesce(F.col(f"_r.{c}").cast("string"), F.lit(default)) if c in columns else F.lit(default)

    numbers = [f.name for f in results.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer") and f.name != order]
    vector = F.col("_r.feature_vector") if "feature_vector" in columns else vector_to_text(F.array(*[F.col(f"_r.{c}").cast("double") for c in numbers]))
    if "feature_vector" in columns and results.schema["feature_vector"].dataType.typeName() != "string":
        vector = vector_to_text(F.col("_r.feature_vector"))
    return first.select(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "uid", F.abs(F.coalesce(F.col(f"_r.{score}"), F.lit(0.0))).alias("score"),
        F.lit(category).alias("attack_category"), F.lit("").alias("attack_subcategory"), F.lit(confidence).alias("confidence"),
        own("source_ip", "Unknown").alias("source_ip"), own("dest_ip", "Unknown").alias("dest_ip"),
        F.lit("manual_label").alias("user_feedback"), F.lit("web_interface").alias("training_source"),
        vector.alias("feature_vector"), F.lit("").alias("suricata_rule_candidate"),
    ).to(LABELLED)


def append_user_label(log: DataFrame, results: DataFrame, uids: DataFrame, user_label: str) -> DataFrame:
    """Result rows of the uids with the user's label, appended to a label log."""
    hits = sized_join(results, uids.select("uid"), "uid", "left_semi", distinct=True)
    return append_labels(log, hits.withColumn("user_label", F.lit(user_label)))


# --- label definitions -----------------------------------------------------

def default_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, True) for row in DEFAULT_LABELS], LABEL_DEFINITION)


def seed_definitions(existing: DataFrame) -> DataFrame:
    """Existing definitions plus the default ones that are absent."""
    seeds = default_definitions(existing.sparkSession)
    absent = seeds.join(existing.select("category", "subcategory"), ["category", "subcategory"], "left_anti")
    return existing.unionByName(absent)


def upsert_definitions(existing: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(existing, new, ["category", "subcategory"])


def active_definitions(df: DataFrame) -> DataFrame:
    return df.filter("is_active").orderBy("category", "subcategory")


def definitions_map(df: DataFrame) -> DataFrame:
    """One row per category with a map subcategory -> (description, colour)."""
    entry = F.struct(F.col("subcategory").alias("key"), F.struct("description", "color_hex").alias("value"))
    return df.filter("is_active").groupBy("category").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("subcategories"))
