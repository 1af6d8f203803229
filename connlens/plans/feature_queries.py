"""Encoders, scalers, scores and detector metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from connlens.functions.scalars import fit_width
from connlens.operators import encoding, hybrid, metrics, scaling
from connlens.operators.one_class import KernelModel, kernel_score
from connlens.plans import fixtures as fx
from connlens.plans.registry import query


@query("SELECT col AS column, value, CAST(id AS INT) AS id FROM enc")
def encoder_fit(spark, sf_dir):
    return encoding.fit_encoder(fx.conn(spark, sf_dir))


@query("""
SELECT c.uid, c.line_no, CAST(coalesce(p.id, -1) AS INT) AS proto, CAST(coalesce(s.id, -1) AS INT) AS service, CAST(coalesce(h.id, -1) AS INT) AS history
FROM conn_dup c LEFT JOIN enc p ON p.col = 'proto' AND p.value = coalesce(c.proto, 'unknown')
  LEFT JOIN enc s ON s.col = 'service' AND s.value = coalesce(c.service, 'unknown')
  LEFT JOIN enc h ON h.col = 'history' AND h.value = coalesce(c.history, 'unknown')
""")
def encoder_apply(spark, sf_dir):
    table = encoding.fit_encoder(fx.conn(spark, sf_dir))
    out = encoding.apply_encoder(fx.conn_dup(spark, sf_dir), table)
    return out.select("uid", "line_no", "proto", "service", "history")


SEEN = """
+seen AS (
  SELECT DISTINCT 'proto' AS col, coalesce(proto, 'unknown') AS value FROM conn_dup
  UNION SELECT DISTINCT 'service', coalesce(service, 'unknown') FROM conn_dup
  UNION SELECT DISTINCT 'history', coalesce(history, 'unknown') FROM conn_dup),
fresh AS (SELECT s.col, s.value FROM seen s LEFT JOIN enc e ON e.col = s.col AND e.value = s.value WHERE e.id IS NULL)
"""


@query(SEEN + "SELECT col AS column, value FROM fresh")
def unknown_values(spark, sf_dir):
    table = encoding.fit_encoder(fx.conn(spark, sf_dir))
    return encoding.unknown_values(fx.conn_dup(spark, sf_dir), table)


@query(SEEN + """
SELECT col AS column, value, CAST(id AS INT) AS id FROM enc
UNION ALL
SELECT f.col, f.value, CAST((SELECT max(e.id) FROM enc e WHERE e.col = f.col) + row_number() OVER (PARTITION BY f.col ORDER BY f.value) AS INT) FROM fresh f
""")
def encoder_expand(spark, sf_dir):
    table = encoding.fit_encoder(fx.conn(spark, sf_dir))
    new = encoding.long_categories(fx.conn_dup(spark, sf_dir))
    return encoding.expand_encoder(table, new)[0]


@query(SEEN + """
, stored AS (SELECT 'history' AS col, coalesce(history, 'unknown') AS value FROM conn WHERE service = 'dns')
SELECT col AS column, value FROM stored UNION SELECT col, value FROM fresh
""")
def unknown_union(spark, sf_dir):
    log = fx.conn(spark, sf_dir)
    stored = encoding.long_categories(log.filter("service = 'dns'"), ["history"]).distinct()
    new = encoding.unknown_values(fx.conn_dup(spark, sf_dir), encoding.fit_encoder(log))
    return encoding.merge_unknown(stored, new)


@query(SEEN + """
, grown AS (
  SELECT col, value, CAST(id AS INT) AS id FROM enc
  UNION ALL
  SELECT f.col, f.value, CAST((SELECT max(e.id) FROM enc e WHERE e.col = f.col) + row_number() OVER (PARTITION BY f.col ORDER BY f.value) AS INT) FROM fresh f)
SELECT g.col AS column, count(*) AS known, coalesce(max(a.n), 0) AS added, 0 AS pending
FROM grown g LEFT JOIN (SELECT col, count(*) AS n FROM fresh GROUP BY col) a ON a.col = g.col GROUP BY g.col
""")
def incorporate_unknown(spark, sf_dir):
    table = encoding.fit_encoder(fx.conn(spark, sf_dir))
    stored = encoding.unknown_values(fx.conn_dup(spark, sf_dir), table)
    grown, emptied, counts = encoding.incorporate_unknown(table, stored)
    known = grown.groupBy("column").agg(F.count("*").alias("known"))
    pending = emptied.groupBy("column").agg(F.count("*").alias("pending"))
    return known.join(counts, "column", "left").join(pending, "column", "left").select(
        "column", "known", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("pending", F.lit(0)).cast("int").alias("pending")
    )


@query("""
SELECT unnest(['duration', 'orig_bytes', 'resp_bytes', 'orig_pkts', 'resp_pkts']) AS feature,
  unnest([round(m3, 6), round(m4, 6), round(m5, 6), round(m6, 6), round(m7, 6)]) AS mean,
  unnest([round(s3, 6), round(s4, 6), round(s5, 6), round(s6, 6), round(s7, 6)]) AS std FROM stats8
""")
def scaler_fit(spark, sf_dir):
    fitted = scaling.fit_scaler(fx.conn(spark, sf_dir), ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"])
    return fitted.table(spark).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _scaled(spark, sf_dir, policy):
    log = fx.conn(spark, sf_dir)
    fitted = scaling.fit_scaler(log, ["duration", "resp_bytes"])
    z = scaling.scaled(fitted, policy)
    return log.select("uid", F.round(z[0], 6).alias("duration"), F.round(z[1], 6).alias("resp_bytes"))


@query("SELECT uid, round((coalesce(f3, 0) - m3) / s3, 6) AS duration, round((coalesce(f5, 0) - m5) / s5, 6) AS resp_bytes FROM feat CROSS JOIN stats8")
def scale_pre(spark, sf_dir):
    return _scaled(spark, sf_dir, "pre")


@query("SELECT uid, coalesce(round((f3 - m3) / s3, 6), 0) AS duration, coalesce(round((f5 - m5) / s5, 6), 0) AS resp_bytes FROM feat CROSS JOIN stats8")
def scale_post(spark, sf_dir):
    return _scaled(spark, sf_dir, "post")


@query("SELECT uid, round((coalesce(f3, m3) - m3) / s3, 6) AS duration, round((coalesce(f5, m5) - m5) / s5, 6) AS resp_bytes FROM feat CROSS JOIN stats8")
def scale_mean(spark, sf_dir):
    return _scaled(spark, sf_dir, "mean")


@query("""
SELECT concat('V', vec_id) AS uid, 80 AS padded_width, 8 AS cut_width,
  round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS padded_sum, round(list_sum(CAST(embedding AS DOUBLE[])[1:8]), 6) AS cut_sum FROM embeddings
""")
def align_width(spark, sf_dir):
    def total(c):
        return F.round(F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x), 6)

    rows = fx.vectors(spark, sf_dir).select("uid", fit_width("features", 80).alias("padded"), fit_width("features", 8).alias("cut"))
    return rows.select(
        "uid", F.size("padded").alias("padded_width"), F.size("cut").alias("cut_width"), total("padded").alias("padded_sum"), total("cut").alias("cut_sum")
    )


@query("""
SELECT count(*) AS n, sum(CAST(f3 IS NULL AS INT) + CAST(f5 IS NULL AS INT)) AS missing_before, sum(CAST(f3 IS NULL AS INT) + CAST(f5 IS NULL AS INT)) AS missing_after FROM feat
""")
def nan_census(spark, sf_dir):
    log = fx.conn(spark, sf_dir)
    columns = ["duration", "orig_bytes", "resp_bytes"]
    return scaling.missing_census(log, columns, scaling.fit_scaler(log, columns))


@query("SELECT uid, line_no, score, CASE WHEN score < 0 THEN 'anomaly' ELSE 'normal' END AS prediction FROM full_scored")
def ocsvm_score(spark, sf_dir):
    from connlens.plans.report_queries import full_scored

    return full_scored(spark, sf_dir).select("uid", "line_no", "score", "prediction")


@query("""
SELECT uid, score, CASE WHEN score < -0.5 THEN 'unknown' ELSE 'normal' END AS category, CASE WHEN score < -0.5 THEN 'unknown' ELSE 'benign' END AS subcategory,
  CASE WHEN score < -0.5 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS confidence, score < -0.5 AS requires_manual_review FROM pred
""")
def hybrid_gate(spark, sf_dir):
    out = hybrid.hybrid_predict(fx.pred(spark, sf_dir))
    return out.select("uid", "score", "final_prediction.*")


@query("""
SELECT round(100 * avg(CAST(score < 0 AS INT)), 1) AS detection_rate,
  round(100 * avg(CAST(score < q AS INT)), 1) AS false_positive_rate, round(100 * avg(CAST(score < 0 AS INT)), 1) AS accuracy, CAST(100 AS DOUBLE) AS precision,
  count(*) AS total_samples, count(*) FILTER (WHERE score < 0) AS true_positives, 0 AS false_positives, count(*) FILTER (WHERE score >= 0) AS false_negatives,
  round(avg(-score), 3) AS mean_anomaly_score, round(stddev_pop(score), 3) AS std_anomaly_score
FROM pred CROSS JOIN (SELECT quantile_cont(score, 0.1) AS q FROM pred) t
""")
def detector_performance(spark, sf_dir):
    return metrics.detector_performance(fx.pred(spark, sf_dir))


@query("""
+v AS (
  SELECT 'v1' AS version, score FROM pred
  UNION ALL
  SELECT 'v2', round(CAST(0.8 AS DOUBLE) * exp(CAST(-0.5 AS DOUBLE) * (zd * zd + zo * zo))
      + CAST(0.4 AS DOUBLE) * exp(CAST(-0.5 AS DOUBLE) * ((zd - 1) * (zd - 1) + (zo - 1) * (zo - 1))) - CAST(0.8 AS DOUBLE), 6)
  FROM (SELECT coalesce((duration - md) / sd, 0) AS zd, (orig_bytes - mo) / so AS zo FROM conn CROSS JOIN stats) z),
q AS (SELECT version, quantile_cont(score, 0.1) AS q FROM v GROUP BY version)
SELECT v.version, CASE v.version WHEN 'v1' THEN '2024-01-01' ELSE '2024-02-01' END AS created,
  round(100 * avg(CAST(score < 0 AS INT)), 1) AS detection_rate,
  round(100 * avg(CAST(score < q AS INT)), 1) AS false_positive_rate, round(100 * avg(CAST(score < 0 AS INT)), 1) AS accuracy, CAST(100 AS DOUBLE) AS precision,
  count(*) AS total_samples, count(*) FILTER (WHERE score < 0) AS true_positives, 0 AS false_positives, count(*) FILTER (WHERE score >= 0) AS false_negatives,
  round(avg(-score), 3) AS mean_anomaly_score, round(stddev_pop(score), 3) AS std_anomaly_score
FROM v JOIN q ON q.version = v.version GROUP BY v.version
""")
def model_compare(spark, sf_dir):
    log = fx.conn(spark, sf_dir)
    z = scaling.scaled(scaling.fit_scaler(log, ["duration", "orig_bytes"]), "post")
    strict = KernelModel(fx.SMALL_MODEL.vectors, fx.SMALL_MODEL.alphas, fx.SMALL_MODEL.gamma, 0.8)
    versions = {"v1": fx.pred(spark, sf_dir).select("score"), "v2": log.select(F.round(kernel_score(z, strict), 6).alias("score"))}
    return metrics.compare_models(versions, created={"v1": "2024-01-01", "v2": "2024-02-01"})


@query("""
SELECT count(*) AS total_predictions, count(*) AS successful_predictions, count(*) FILTER (WHERE score < -0.5) AS anomalies_detected,
  count(*) FILTER (WHERE score < -0.5) AS classified_anomalies, 0 AS confident_classifications, count(*) FILTER (WHERE score < -0.5) AS requires_review,
  CAST(1 AS DOUBLE) AS success_rate, round(avg(CAST(score < -0.5 AS INT)), 9) AS anomaly_rate, CAST(1 AS DOUBLE) AS classification_rate,
  CAST(0 AS DOUBLE) AS confidence_rate, round(avg(CAST(score < -0.5 AS INT)), 9) AS review_rate
FROM pred
""")
def prediction_quality(spark, sf_dir):
    out = metrics.prediction_quality(hybrid.hybrid_predict(fx.pred(spark, sf_dir)))
    return out.withColumns({"anomaly_rate": F.round("anomaly_rate", 9), "review_rate": F.round("review_rate", 9)})


@query("SELECT CASE WHEN score < -0.5 THEN 'unknown' ELSE 'normal' END AS category, count(*) AS n FROM pred GROUP BY 1")
def final_categories(spark, sf_dir):
    return metrics.final_categories(hybrid.hybrid_predict(fx.pred(spark, sf_dir)))


CELLS = "+cells AS (SELECT t.c AS true_label, p.c AS predicted FROM (SELECT unnest(['anomaly', 'normal']) AS c) t CROSS JOIN (SELECT unnest(['anomaly', 'normal']) AS c) p)\n"


@query(CELLS + """
SELECT c.true_label, c.predicted, count(t.uid) AS n FROM cells c LEFT JOIN truth t ON t.true_label = c.true_label AND t.prediction = c.predicted GROUP BY 1, 2
""")
def confusion(spark, sf_dir):
    return metrics.confusion(fx.truth(spark, sf_dir), classes=["anomaly", "normal"])


@query("""
+c AS (SELECT l AS label, count(*) FILTER (WHERE true_label = l AND prediction = l) AS tp, count(*) FILTER (WHERE prediction = l) AS pn, count(*) FILTER (WHERE true_label = l) AS support
  FROM truth CROSS JOIN (SELECT unnest(['anomaly', 'normal']) AS l) k GROUP BY l),
r AS (SELECT label, CASE WHEN pn > 0 THEN CAST(tp AS DOUBLE) / pn ELSE 0 END AS p, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS r, support FROM c)
SELECT label, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1_score, support FROM r
""")
def class_report(spark, sf_dir):
    out = metrics.class_report(fx.truth(spark, sf_dir))
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@query("""
SELECT count(*) AS n, count(*) FILTER (WHERE abs(score) >= 0.7) AS confident,
  round(CAST(count(*) FILTER (WHERE abs(score) >= 0.7 AND true_label = prediction) AS DOUBLE) / count(*) FILTER (WHERE abs(score) >= 0.7), 9) AS confident_accuracy,
  round(CAST(count(*) FILTER (WHERE abs(score) >= 0.7) AS DOUBLE) / count(*), 9) AS confident_ratio FROM truth
""")
def confident_accuracy(spark, sf_dir):
    rows = fx.truth(spark, sf_dir).withColumn("confidence", F.abs("score"))
    out = metrics.confident_accuracy(rows, "true_label", "prediction", "confidence")
    return out.withColumns({c: F.round(c, 9) for c in ("confident_accuracy", "confident_ratio")})
