"""The label store: statistics, changes, validation and the model registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from connlens.functions.scalars import vector_to_text
from connlens.operators import attack_model, labels, metrics, registry, validation
from connlens.plans import fixtures as fx
from connlens.plans.registry import query

NOW = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("""
SELECT count(*) AS total_connections, CAST(sum(CAST(is_anomaly AS INT)) AS BIGINT) AS total_anomalies,
  count(label_category) AS labeled_connections, count(*) FILTER (WHERE review_status = 'verified') AS verified_connections FROM training
""")
def label_statistics(spark, sf_dir):
    return labels.label_statistics(fx.training(spark, sf_dir))


@query("SELECT label_category, label_subcategory, count(*) AS n FROM training WHERE label_category IS NOT NULL GROUP BY 1, 2")
def label_distribution(spark, sf_dir):
    return labels.label_distribution(fx.training(spark, sf_dir))


@query("SELECT training_source, count(*) AS n FROM training GROUP BY 1")
def source_breakdown(spark, sf_dir):
    return labels.breakdown(fx.training(spark, sf_dir), "training_source")


@query("SELECT review_status, count(*) AS n FROM training GROUP BY 1")
def review_breakdown(spark, sf_dir):
    return labels.breakdown(fx.training(spark, sf_dir), "review_status")


@query("SELECT confidence_level, count(*) AS n FROM training WHERE confidence_level IS NOT NULL GROUP BY 1")
def category_counts(spark, sf_dir):
    return metrics.value_counts(fx.training(spark, sf_dir), "confidence_level")


def used_definitions(spark, sf_dir):
    """One definition per label pair found in the store."""
    pairs = fx.training(spark, sf_dir).filter("label_category IS NOT NULL").groupBy(
        F.col("label_category").alias("category"), F.col("label_subcategory").alias("subcategory")
    ).agg(F.count("*").alias("n"))
    return pairs.select(
        "category", "subcategory", F.concat(F.lit("seen "), F.col("n").cast("string")).alias("description"),
        F.lit("#123456").alias("color_hex"), (F.col("n") >= 10).alias("is_active"),
    )


def _seed_values() -> str:
    from connlens.schemas import DEFAULT_LABELS

    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ", true)" for row in DEFAULT_LABELS)


DEFINITIONS = f"""
+seeds(category, subcategory, description, color_hex, is_active) AS (VALUES {_seed_values()}),
used AS (SELECT label_category AS category, label_subcategory AS subcategory, concat('seen ', count(*)) AS description, '#123456' AS color_hex, count(*) >= 10 AS is_active
  FROM training WHERE label_category IS NOT NULL GROUP BY 1, 2),
merged AS (
  SELECT * FROM used UNION ALL
  SELECT s.* FROM seeds s WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.category = s.category AND u.subcategory = s.subcategory))
"""


@query(DEFINITIONS + "SELECT * FROM merged WHERE is_active")
def label_definitions(spark, sf_dir):
    seeds = labels.default_definitions(spark)
    return labels.active_definitions(labels.upsert_definitions(seeds, used_definitions(spark, sf_dir)))


@query(DEFINITIONS + """
SELECT category, count(*) AS n, string_agg(concat(subcategory, '=', description, color_hex), ';' ORDER BY subcategory) AS entries FROM merged WHERE is_active GROUP BY category
""")
def definitions_map(spark, sf_dir):
    table = labels.seed_definitions(used_definitions(spark, sf_dir))
    nested = labels.definitions_map(table)
    entries = F.transform(
        F.array_sort(F.map_entries("subcategories")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["description"], e["value"]["color_hex"])
    )
    return nested.select("category", F.size("subcategories").cast("bigint").alias("n"), F.concat_ws(";", entries).alias("entries"))


# --- table changes ---------------------------------------------------------

STORE_FIELDS = "uid, service, anomaly_score, label_category, label_subcategory, confidence_level, training_source, review_status"


def _short(df):
    return df.select(*STORE_FIELDS.split(", "))


@query(f"""
+new AS (SELECT uid, 'renewed' AS service, anomaly_score, 'malware' AS label_category, 'infected-host' AS label_subcategory, 'high' AS confidence_level,
  'manual' AS training_source, 'needs_review' AS review_status FROM training WHERE anomaly_score < -0.4),
added AS (SELECT concat('N', uid) AS uid, service, anomaly_score, label_category, label_subcategory, confidence_level, training_source, review_status FROM training WHERE proto = 'icmp')
SELECT {STORE_FIELDS} FROM training WHERE NOT anomaly_score < -0.4
UNION ALL SELECT {STORE_FIELDS} FROM new UNION ALL SELECT {STORE_FIELDS} FROM added
""")
def upsert(spark, sf_dir):
    base = fx.store(spark, sf_dir)
    renewed = base.filter("anomaly_score < -0.4").withColumns({
        "service": F.lit("renewed"), "label_category": F.lit("malware"), "label_subcategory": F.lit("infected-host"),
        "confidence_level": F.lit("high"), "training_source": F.lit("manual"), "review_status": F.lit("needs_review"),
    })
    added = base.filter("proto = 'icmp'").withColumn("uid", F.concat(F.lit("N"), F.col("uid")))
    return _short(labels.upsert(base, renewed.unionByName(added)))


@query("""
SELECT uid, CASE WHEN s THEN 'malware' ELSE label_category END AS label_category, CASE WHEN s THEN 'c2-communication' ELSE label_subcategory END AS label_subcategory,
  CASE WHEN s THEN 'high' ELSE confidence_level END AS confidence_level, CASE WHEN s THEN 'verified' ELSE review_status END AS review_status,
  CASE WHEN s THEN 'analyst' END AS labeled_by, CASE WHEN s THEN TIMESTAMP '2024-06-01 00:00:00' END AS labeled_at
FROM (SELECT *, anomaly_score < -0.4 AS s FROM training) t
""")
def bulk_label(spark, sf_dir):
    wanted = fx.pred(spark, sf_dir).filter("score < -0.4")
    out = labels.bulk_label(
        fx.store(spark, sf_dir), wanted, "malware", "c2-communication", "high", "analyst", review_status="verified", now=now()
    )
    return out.select("uid", "label_category", "label_subcategory", "confidence_level", "review_status", "labeled_by", "labeled_at")


@query("SELECT uid, service IS NOT NULL AND service = 'dns' AS has_extracted_pcap FROM training")
def mark_extracted(spark, sf_dir):
    out = labels.mark_extracted(fx.store(spark, sf_dir), fx.conn(spark, sf_dir).filter("service = 'dns'"), now=now())
    return out.select("uid", "has_extracted_pcap")


@query("SELECT count(*) AS changed FROM training WHERE anomaly_score < -0.4")
def changed_count(spark, sf_dir):
    return labels.count_listed(fx.store(spark, sf_dir), fx.pred(spark, sf_dir).filter("score < -0.4"))


@query(f"SELECT {STORE_FIELDS} FROM training WHERE anomaly_score >= -0.4")
def delete_uids(spark, sf_dir):
    return _short(labels.delete_uids(fx.store(spark, sf_dir), fx.pred(spark, sf_dir).filter("score < -0.4")))


IMPORT_FIELDS = ["uid", "timestamp", "source_ip", "dest_port", "proto", "service", "duration", "anomaly_score", "is_anomaly", "label_category", "training_source", "review_status"]


@query("""
SELECT uid, ts AS timestamp, source_ip, dest_port, proto, service, duration, anomaly_score, is_anomaly,
  CASE WHEN is_anomaly THEN NULL ELSE label_category END AS label_category,
  CASE WHEN is_anomaly THEN 'analysis_import' ELSE training_source END AS training_source,
  CASE WHEN is_anomaly THEN 'pending' ELSE review_status END AS review_status FROM training
""")
def import_scan(spark, sf_dir):
    out = labels.import_scan(fx.store(spark, sf_dir), fx.pred(spark, sf_dir), fx.conn_dup(spark, sf_dir), now=now())
    return out.select(*IMPORT_FIELDS)


@query("""
SELECT uid, anomaly_score, label_category, label_subcategory,
  CASE WHEN label_category IS NULL AND is_anomaly THEN NULL ELSE confidence_level END AS confidence_level,
  CASE WHEN is_anomaly THEN 'analysis_import' ELSE training_source END AS training_source,
  CASE WHEN is_anomaly AND label_category IS NULL THEN 'pending' ELSE review_status END AS review_status FROM training
""")
def import_keep_labels(spark, sf_dir):
    out = labels.import_scan(fx.store(spark, sf_dir), fx.pred(spark, sf_dir), fx.conn_dup(spark, sf_dir), keep_labels=True, now=now())
    return out.select("uid", "anomaly_score", "label_category", "label_subcategory", "confidence_level", "training_source", "review_status")


def labelled_log(spark, sf_dir):
    """Label records of the stored anomalies that carry a label."""
    rows = fx.scored(spark, sf_dir).filter("score < 0")
    return labels.scan_labels(rows, fx.training(spark, sf_dir).filter("label_category = 'malware'"), "port-scan", "low", now())


@query("""
SELECT uid, abs(anomaly_score) AS score, CASE WHEN anomaly_score < -0.4 THEN 'ddos-attack' ELSE 'port-scan' END AS attack_category, '' AS attack_subcategory,
  CASE WHEN anomaly_score < -0.4 THEN 'high' ELSE 'low' END AS confidence, source_ip, dest_ip, 'manual_label' AS user_feedback, 'web_interface' AS training_source, '2024-06-01T00:00:00' AS timestamp
FROM training WHERE anomaly_score < -0.4 OR (anomaly_score < 0 AND label_category = 'malware')
""")
def label_from_scan(spark, sf_dir):
    rows = fx.scored(spark, sf_dir)
    out = labels.label_from_scan(labelled_log(spark, sf_dir), rows, rows.filter("score < -0.4"), "ddos-attack", "high", now())
    return out.select("uid", "score", "attack_category", "attack_subcategory", "confidence", "source_ip", "dest_ip", "user_feedback", "training_source", "timestamp")


@query("""
SELECT uid, score, prediction, NULL AS user_label FROM pred WHERE score < -0.5
UNION ALL SELECT uid, score, prediction, 'false_alarm' FROM pred WHERE score < -0.4
""")
def append_label(spark, sf_dir):
    rows = fx.pred(spark, sf_dir).select("uid", "score", "prediction")
    return labels.append_user_label(rows.filter("score < -0.5"), rows, rows.filter("score < -0.4"), "false_alarm")


@query("""
SELECT uid, max(line_no) AS line_no, arg_max(proto, line_no) AS proto, arg_max(dest_port, line_no) AS dest_port FROM conn_dup GROUP BY uid
""")
def keep_last(spark, sf_dir):
    return labels.keep_last(fx.conn_dup(spark, sf_dir).select("uid", "line_no", "proto", "dest_port"), "uid", "line_no")


@query("SELECT uid, false AS has_extracted_pcap FROM training")
def add_column(spark, sf_dir):
    return labels.add_column(fx.training(spark, sf_dir)).select("uid", "has_extracted_pcap")


@query("SELECT 'normal' AS origin, uid FROM training WHERE NOT is_anomaly UNION ALL SELECT 'labelled', uid FROM training WHERE label_category IS NOT NULL")
def stack_normal_labelled(spark, sf_dir):
    rows = fx.training(spark, sf_dir)
    normal = rows.filter(~F.col("is_anomaly")).select(F.lit("normal").alias("origin"), "uid")
    marked = rows.filter("label_category IS NOT NULL").select(F.lit("labelled").alias("origin"), "uid")
    return labels.stack(normal, marked)


# --- validation ------------------------------------------------------------

@query("""
SELECT count(*) AS classes, min(n) AS min_n, max(n) AS max_n, round(CAST(min(n) AS DOUBLE) / max(n), 9) AS balance_ratio, CAST(min(n) AS DOUBLE) / max(n) > 0.2 AS is_balanced
FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c
""")
def class_balance(spark, sf_dir):
    return validation.class_balance(fx.vectors(spark, sf_dir)).withColumn("balance_ratio", F.round("balance_ratio", 9))


def text_vectors(spark, sf_dir):
    """Vectors as text; those of class 3 are damaged and those of class 5 are short."""
    rows = fx.vectors(spark, sf_dir)
    short = F.when(F.col("class_name") == "class.5", F.slice("features", 1, 8)).otherwise(F.col("features"))
    text = F.when(F.col("class_name") == "class.3", F.lit("[1.0, x]")).otherwise(vector_to_text(short))
    return rows.select("uid", "attack_category", "confidence", text.alias("feature_vector"))


@query("""
SELECT count(*) AS sampled, count(*) FILTER (WHERE label = 3) AS parse_errors, true AS parseable, count(*) FILTER (WHERE label = 5) = 0 AS consistent_dimensions,
  CASE WHEN count(*) FILTER (WHERE label = 5) > 0 THEN 8 ELSE 64 END AS feature_dimensions, round(CAST(count(*) FILTER (WHERE label = 3) AS DOUBLE) / count(*), 9) AS parse_error_rate
FROM embeddings
""")
def vector_quality(spark, sf_dir):
    out = validation.vector_quality(text_vectors(spark, sf_dir), sample_rows=None)
    return out.withColumn("parse_error_rate", F.round("parse_error_rate", 9))


@query("""
SELECT count(*) AS n, round(CAST(count(*) FILTER (WHERE confidence_level = 'high') AS DOUBLE) / count(*), 9) AS high_share, 'improve label quality' AS advice FROM training
""")
def confidence_mix(spark, sf_dir):
    out = validation.confidence_mix(fx.training(spark, sf_dir), "confidence_level")
    return out.withColumn("high_share", F.round("high_share", 9))


@query("""
SELECT count(*) AS total_samples, count(DISTINCT label) AS category_count, 2 AS issue_count, false AS is_valid, 'high' AS risk_level, false AS training_recommended
FROM embeddings
""")
def label_verdict(spark, sf_dir):
    out = validation.validate_labels(text_vectors(spark, sf_dir), sample_rows=None)
    return out.select("total_samples", "category_count", F.size("issues").alias("issue_count"), "is_valid", "risk_level", "training_recommended")


@query("""
+t AS (SELECT count(*) AS n, count(DISTINCT label_category) AS k FROM training),
c AS (SELECT min(n) * CAST(1 AS DOUBLE) / max(n) AS b FROM (SELECT count(*) AS n FROM training WHERE label_category IS NOT NULL GROUP BY label_category) x)
SELECT 0 AS position, 'samples' AS topic, CASE WHEN n < 100 THEN 'critical' WHEN n < 200 THEN 'warning' ELSE 'good' END AS level FROM t
UNION ALL SELECT 1, 'categories', CASE WHEN k < 3 THEN 'critical' WHEN k < 5 THEN 'warning' ELSE 'good' END FROM t
UNION ALL SELECT 2, 'quality', 'good'
UNION ALL SELECT 3, 'balance', CASE WHEN b < 0.1 THEN 'critical' ELSE 'warning' END FROM c WHERE b < 0.3
UNION ALL SELECT 4, 'risk', 'low'
""")
def label_advice(spark, sf_dir):
    rows = fx.store(spark, sf_dir)
    verdict = validation.validate_labels(rows, "label_category", "feature_vector", "confidence_level", sample_rows=None)
    return validation.training_advice(verdict).select("position", "topic", "level")


# --- registry --------------------------------------------------------------

def part_registry(spark, sf_dir):
    """Model parts derived from the log: one version per service and protocol seen, parts by kind of traffic."""
    part = F.when(F.col("proto") == "tcp", "model").when(F.col("proto") == "udp", "scaler").otherwise("encoders")
    version = F.concat(F.lit("v"), F.dayofmonth("ts").cast("string"))
    kept = fx.conn(spark, sf_dir).filter(~((F.dayofmonth("ts") > 27) & (F.col("proto") == "icmp")))
    return kept.groupBy(version.alias("version"), part.alias("part")).agg(F.max("ts").alias("created_at"))


PARTS = """
+parts AS (SELECT DISTINCT day(ts) AS version, CASE proto WHEN 'tcp' THEN 'model' WHEN 'udp' THEN 'scaler' ELSE 'encoders' END AS part FROM conn WHERE NOT (day(ts) > 27 AND proto = 'icmp')),
v AS (SELECT version, count(DISTINCT part) AS parts FROM parts GROUP BY version)
"""


@query(PARTS + "SELECT CAST(version AS INT) AS version, parts, parts = 3 AS is_complete FROM v")
def model_versions(spark, sf_dir):
    return registry.model_versions(part_registry(spark, sf_dir))


@query(PARTS + "SELECT CAST(max(version) AS INT) AS version FROM v WHERE parts = 3")
def latest_version(spark, sf_dir):
    return registry.latest_version(part_registry(spark, sf_dir))


@query(PARTS + "SELECT CAST(max(version) + 1 AS INT) AS version FROM v")
def next_version(spark, sf_dir):
    return registry.next_version(part_registry(spark, sf_dir))


@query("""
+c AS (SELECT concat(label_category, '.', label_subcategory) AS class_name, count(*) AS n FROM training WHERE label_category IS NOT NULL GROUP BY 1)
SELECT class_name, CAST(round(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS test, CAST(n - round(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS train FROM c
""")
def stratified_split(spark, sf_dir):
    from connlens.operators.filters import with_class

    rows = with_class(fx.training(spark, sf_dir).filter("label_category IS NOT NULL")).select("uid", "class_name")
    split = attack_model.stratified_split(rows)
    return split.groupBy("class_name").agg(F.count_if(F.col("side") == "test").alias("test"), F.count_if(F.col("side") == "train").alias("train"))
