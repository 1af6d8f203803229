"""Scan scoring, reports, filters and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.operators import curves, encoding, filters, joins, reports, scaling
from connlens.operators.one_class import label
from connlens.operators.scoring import Detector, score_vectors, vectorise
from connlens.plans import fixtures as fx
from connlens.plans.registry import query


def full_detector(spark: SparkSession, sf_dir: str) -> Detector:
    """Encoder and scaler fitted on the log, with the fixed eight-feature model."""
    log = fx.conn(spark, sf_dir)
    table = encoding.fit_encoder(log)
    encoded = encoding.apply_encoder(log, table, suffix="_id")
    features = scaling.feature_order(log)
    fitted = scaling.fit_scaler(encoded, [f"{c}_id" if c in encoding.CATEGORICAL else c for c in features])
    return Detector(table, scaling.Scaler(tuple(features), fitted.mean, fitted.std), fx.FULL_MODEL)


def full_scored(spark: SparkSession, sf_dir: str, scans: list | None = None) -> DataFrame:
    """The scored log, or some of its scans; the detector is fitted on the whole log."""
    detector = full_detector(spark, sf_dir)
    log = fx.conn(spark, sf_dir)
    z = vectorise(log if scans is None else reports.of_scans(log, scans), detector.encoder, detector.scaler)
    scored = score_vectors(z, detector.model).withColumn("score", F.round("score", 6))
    return scored.withColumn("prediction", label("score"))


@query("""
SELECT scan_id, connections, anomalies, anomaly_rate,
  upper(strftime(strptime(scan_id, '%Y%m%d_%H%M%S'), '%d %b %Y %H:%M')) AS scan_time,
  CASE WHEN anomaly_rate > 50 THEN 'high' WHEN anomaly_rate > 20 THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT scan_id, count(*) AS connections, count(*) FILTER (WHERE score < 0) AS anomalies,
    round(100 * CAST(count(*) FILTER (WHERE score < 0) AS DOUBLE) / count(*), 2) AS anomaly_rate
  FROM full_scored GROUP BY scan_id ORDER BY scan_id DESC LIMIT 10) r
WHERE anomalies > 0
""")
def scan_severity(spark, sf_dir):
    newest = reports.newest_scans(fx.conn(spark, sf_dir))
    return reports.threat_timeline(reports.recent_scans(full_scored(spark, sf_dir, newest), scans=newest))


@query("""
SELECT count(DISTINCT scan_id) AS total_scans, count(*) AS total_connections, count(*) FILTER (WHERE prediction = 'anomaly') AS anomaly_count,
  count(*) FILTER (WHERE prediction = 'normal') AS normal_count,
  round(100 * CAST(count(*) FILTER (WHERE prediction = 'anomaly') AS DOUBLE) / count(*), 2) AS anomaly_rate FROM pred
""")
def corpus_totals(spark, sf_dir):
    return reports.corpus_totals(fx.pred(spark, sf_dir))


@query("SELECT proto, count(*) AS n FROM conn_dup GROUP BY proto")
def protocol_distribution(spark, sf_dir):
    return reports.protocol_distribution(fx.conn_dup(spark, sf_dir))


@query("""
SELECT p.scan_id, count(*) AS total_connections, count(*) FILTER (WHERE prediction = 'anomaly') AS anomaly_count,
  count(*) - count(*) FILTER (WHERE prediction = 'anomaly') AS normal_count,
  strftime(strptime(p.scan_id, '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS timestamp_display,
  bool_or(p.uid IN (SELECT uid FROM training WHERE training_source = 'analysis_import')) AS is_imported
FROM pred p GROUP BY p.scan_id
""")
def scan_inventory(spark, sf_dir):
    return reports.scan_inventory(fx.pred(spark, sf_dir), fx.training(spark, sf_dir))


@query("""
SELECT p.scan_id, count(*) AS total, count(*) FILTER (WHERE prediction = 'anomaly') AS anomalies,
  count(*) FILTER (WHERE p.uid IN (SELECT uid FROM conn WHERE service = 'dns')) AS extracted,
  count(*) - count(*) FILTER (WHERE prediction = 'anomaly') AS normal,
  round(100 * CAST(count(*) FILTER (WHERE prediction = 'anomaly') AS DOUBLE) / count(*), 2) AS anomaly_rate
FROM pred p GROUP BY p.scan_id
""")
def scan_detail(spark, sf_dir):
    extracted = fx.conn(spark, sf_dir).filter("service = 'dns'")
    return reports.scan_detail(joins.flag_present(fx.pred(spark, sf_dir), extracted))


@query("""
SELECT CASE WHEN score < -0.5 THEN 'high' WHEN score <= 0 THEN 'moderate' ELSE 'normal' END AS band, count(*) AS n FROM pred GROUP BY 1
""")
def score_bands(spark, sf_dir):
    return reports.score_bands(fx.pred(spark, sf_dir))


@query("""
SELECT q.uid, q.scan_id, q.timestamp, abs(q.score) AS score, q.prediction,
  CASE WHEN q.uid IN (SELECT uid FROM training WHERE label_category IS NOT NULL) THEN 'labeled' END AS current_label
FROM (SELECT * FROM pred WHERE score < 0 ORDER BY score, uid LIMIT 20) q
""")
def label_queue(spark, sf_dir):
    labelled = fx.training(spark, sf_dir).filter("label_category IS NOT NULL")
    return filters.label_queue(fx.pred(spark, sf_dir), labelled)


@query("""
SELECT uid, ts AS timestamp, source_ip, dest_ip, source_port, dest_port, proto, service, duration, orig_bytes, resp_bytes, orig_pkts,
  resp_pkts, history, anomaly_score, is_anomaly, label_category, label_subcategory, confidence_level, training_source, review_status
FROM training WHERE is_anomaly AND review_status = 'verified' AND training_source = 'manual'
  AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'
ORDER BY ts DESC, uid LIMIT 100 OFFSET 20
""")
def browse_filter_page(spark, sf_dir):
    rows = fx.training(spark, sf_dir).withColumnRenamed("ts", "timestamp")
    found = filters.browse(
        rows, start_date="2024-01-05 00:00:00", end_date="2024-01-25 12:00:00", is_anomaly=True, review_status="verified", training_source="manual"
    )
    return filters.browse_record(filters.page(found, limit=100, offset=20))


@query("""
SELECT uid, ts AS timestamp, source_ip, dest_ip, proto, service, anomaly_score, is_anomaly, label_category, label_subcategory,
  confidence_level, training_source, review_status
FROM training WHERE label_category IS NOT NULL AND label_subcategory IS NOT NULL AND confidence_level IN ('medium', 'high')
""")
def trainable_rows(spark, sf_dir):
    return filters.export_record(filters.trainable(fx.store(spark, sf_dir)))


@query("""
SELECT uid, concat(label_category, '.', label_subcategory) AS class_name FROM training
WHERE label_category IS NOT NULL AND concat(label_category, '.', label_subcategory) IN (
  SELECT concat(label_category, '.', label_subcategory) FROM training WHERE label_category IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)
""")
def rare_class_filter(spark, sf_dir):
    labelled = fx.training(spark, sf_dir).filter("label_category IS NOT NULL")
    return filters.frequent_classes(filters.with_class(labelled)).select("uid", "class_name")


@query("""
SELECT uid, source_ip, source_port, dest_ip, dest_port, lower(proto) AS proto
FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY line_no) AS rn FROM conn_dup WHERE uid IN (SELECT uid FROM pred WHERE score < -0.5)) d
WHERE rn = 1
""")
def uid_lookup(spark, sf_dir):
    wanted = fx.pred(spark, sf_dir).filter("score < -0.5")
    return filters.lookup_uids(fx.conn_dup(spark, sf_dir), wanted)


@query("SELECT uid, min(scan_id) AS scan_id FROM conn_dup GROUP BY uid")
def scan_of_uid(spark, sf_dir):
    return filters.scan_of_uid(fx.conn_dup(spark, sf_dir))


@query("""
SELECT uid, timestamp, score, prediction FROM pred WHERE score < 0
""")
def import_anomalies_only(spark, sf_dir):
    return filters.result_anomalies(fx.pred(spark, sf_dir)).select("uid", "timestamp", "score", "prediction")


@query("""
+b AS (SELECT min(score) AS lo, (max(score) - min(score)) / 30 AS w FROM pred),
c AS (SELECT least(CAST(floor((score - lo) / w) AS INT), 29) AS bin, count(*) AS n, count(*) FILTER (WHERE score < 0) AS anomalies FROM pred CROSS JOIN b GROUP BY 1)
SELECT CAST(g.i AS INT) AS bin, round(lo + g.i * w, 9) AS bin_start, coalesce(n, 0) AS n, coalesce(anomalies, 0) AS anomalies
FROM range(30) g(i) CROSS JOIN b LEFT JOIN c ON c.bin = g.i
""")
def score_histogram(spark, sf_dir):
    return reports.score_histogram(fx.pred(spark, sf_dir))


@query("""
+b AS (SELECT min(score) AS lo, max(score) AS hi, (max(score) - min(score)) / 200 AS w, stddev_samp(score) * power(count(*), -0.2) AS h, count(*) AS n FROM pred),
c AS (SELECT least(CAST(floor((score - lo) / w) AS INT), 199) AS bin, count(*) AS k FROM pred CROSS JOIN b GROUP BY 1)
SELECT CAST(g.i AS INT) AS point, round(any_value(lo + g.i * (hi - lo) / 49), 6) AS x,
  round(sum(k * exp(-0.5 * power((lo + g.i * (hi - lo) / 49 - (lo + (bin + 0.5) * w)) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 6) AS density
FROM range(50) g(i) CROSS JOIN b CROSS JOIN c GROUP BY g.i
""")
def score_kde(spark, sf_dir):
    return reports.score_density(fx.pred(spark, sf_dir))


@query("""
SELECT date_trunc('day', timestamp) AS slot, count(*) AS n, count(*) FILTER (WHERE prediction = 'anomaly') AS anomalies,
  min(score) AS min_score, round(avg(score), 6) AS avg_score FROM pred GROUP BY 1
""")
def score_series(spark, sf_dir):
    return reports.score_series(fx.pred(spark, sf_dir))


# --- curves ----------------------------------------------------------------

STEPS = """
+g AS (SELECT -score AS s, count(*) FILTER (WHERE true_label = 'anomaly') AS pos, count(*) FILTER (WHERE true_label <> 'anomaly') AS neg FROM truth GROUP BY 1),
t AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)
"""


@query(STEPS + """
SELECT s + 0 AS threshold, CAST(fp AS DOUBLE) / CAST(n AS DOUBLE) AS fpr, CAST(tp AS DOUBLE) / CAST(p AS DOUBLE) AS tpr FROM t
UNION ALL SELECT NULL, 0, 0
""")
def roc_points(spark, sf_dir):
    return curves.roc_points(fx.truth(spark, sf_dir))


@query(STEPS + """
SELECT round(sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / CAST(any_value(p * n) AS DOUBLE), 9) AS auc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM t
""")
def roc_auc(spark, sf_dir):
    return curves.roc_auc(fx.truth(spark, sf_dir)).withColumn("auc", F.round("auc", 9))


@query(STEPS + """
SELECT s + 0 AS threshold, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision, CAST(tp AS DOUBLE) / CAST(p AS DOUBLE) AS recall FROM t
UNION ALL SELECT NULL, 1, 0
""")
def pr_points(spark, sf_dir):
    return curves.pr_points(fx.truth(spark, sf_dir))


@query(STEPS + """
SELECT round(sum(pos * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / CAST(any_value(p) AS DOUBLE), 9) AS average_precision,
  round(CAST(any_value(p) AS DOUBLE) / CAST(any_value(p + n) AS DOUBLE), 9) AS baseline FROM t
""")
def avg_precision(spark, sf_dir):
    out = curves.average_precision(fx.truth(spark, sf_dir))
    return out.select(F.round("average_precision", 9).alias("average_precision"), F.round("baseline", 9).alias("baseline"))
