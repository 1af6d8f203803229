"""Training, evaluation and hybrid prediction. Fits are checked by their properties."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from connlens.operators import attack_model, hybrid, labels, metrics, scaling, scoring
from connlens.operators.one_class import fit_one_class, score_one_class
from connlens.operators.spread import side_by_side, spread_evenly
from connlens.plans import fixtures as fx
from connlens.plans.label_queries import now
from connlens.plans.registry import query
from connlens.plans.report_queries import full_detector
from connlens.session import cut_lineage

def _detector(spark, sf_dir, nu=0.05):
    return scoring.fit_detector(fx.conn(spark, sf_dir), nu=nu)


@query("SELECT count(*) AS rows, 8 AS width, true AS share_matches_nu FROM conn")
def ocsvm_train(spark, sf_dir):
    nu = 0.05
    detector = _detector(spark, sf_dir, nu)
    scored = scoring.score_log(fx.conn(spark, sf_dir), detector)
    out = scored.agg(F.count("*").alias("rows"), F.avg((F.col("score") < 0).cast("double")).alias("share"))
    close = F.abs(F.col("share") - nu) <= 3.0 / math.sqrt(max(detector.model.rows, 1))
    return out.select("rows", F.lit(detector.model.width).alias("width"), close.alias("share_matches_nu"))


def _finite_moments(report):
    """The report with 1 in place of each moment of the score that is a finite number, else 0."""
    finite = F.coalesce((~F.isnan("value")) & (F.abs("value") < float("inf")), F.lit(False)).cast("double")
    return report.withColumn("value", F.when(F.col("name").endswith("_anomaly_score"), finite).otherwise(F.col("value")))


@query("SELECT scan_id, count(*) AS n FROM conn GROUP BY scan_id")
def batch_scan(spark, sf_dir):
    results, rejected = scoring.score_corpus(fx.conn(spark, sf_dir), full_detector(spark, sf_dir))
    both = results.select("scan_id").unionByName(rejected.select("scan_id"))
    return both.groupBy("scan_id").agg(F.count("*").alias("n"))


@query("""
+r AS (SELECT attack_category, count(*) AS n FROM (SELECT concat('class-', label) AS attack_category FROM embeddings) e GROUP BY 1)
SELECT 'total' AS measure, 'rows' AS name, CAST(sum(n) AS DOUBLE) AS value FROM r
UNION ALL SELECT 'category', attack_category, CAST(n AS DOUBLE) FROM r
UNION ALL SELECT 'total', unnest(['mean_anomaly_score', 'std_anomaly_score']), CAST(1 AS DOUBLE)
""")
def retrain_labelled(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir).withColumnRenamed("features", "feature_vector")
    fitted = scaling.fit_vector_scaler(rows, "feature_vector", 64)
    _, report = scoring.retrain_labelled(rows, fitted, nu=0.1)
    return _finite_moments(report)


@query("""
SELECT 'total' AS measure, 'rows' AS name, (SELECT count(*) FROM conn) + (SELECT count(*) FROM embeddings) + CAST(0 AS DOUBLE) AS value
UNION ALL SELECT 'origin', 'normal', CAST(count(*) AS DOUBLE) FROM conn
UNION ALL SELECT 'origin', 'labelled', CAST(count(*) AS DOUBLE) FROM embeddings
UNION ALL SELECT 'total', unnest(['mean_anomaly_score', 'std_anomaly_score']), CAST(1 AS DOUBLE)
""")
def full_retrain(spark, sf_dir):
    log = fx.conn(spark, sf_dir)
    _, report = scoring.full_retrain(log, fx.vectors(spark, sf_dir), nu=0.05)
    return _finite_moments(report.filter("measure <> 'category'"))


def _split(spark, sf_dir):
    """The split vectors, cut once: the fit and the evaluation read the same rows."""
    return cut_lineage(attack_model.stratified_split(fx.vectors(spark, sf_dir)))


def _train(spark, sf_dir, kind="random_forest", **options):
    split = _split(spark, sf_dir)
    model = attack_model.fit_attack_model(split.filter("side = 'train'"), kind, **options)
    return model, split.filter("side = 'test'")


SUPPORT = """
+c AS (SELECT concat('class.', label) AS label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, CAST(round(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS support, true AS in_range FROM c
"""


def _report(report):
    """Support per class, which the exact split fixes, and whether the scores are shares."""
    shares = [F.col(c).between(0.0, 1.0) for c in ("precision", "recall", "f1_score")]
    return report.select("label", "support", (shares[0] & shares[1] & shares[2]).alias("in_range"))


@query(SUPPORT)
def forest_train(spark, sf_dir):
    model, test = _train(spark, sf_dir)
    return _report(attack_model.evaluate(test, model)["report"])


@query(SUPPORT)
def boost_train(spark, sf_dir):
    model, test = _train(spark, sf_dir, "gradient_boosting", maxIter=3, maxDepth=3)
    return _report(attack_model.evaluate(test, model)["report"])


@query("""
SELECT concat('V', vec_id) AS uid, 10 AS classes, true AS gated, true AS sums_to_one FROM embeddings
""")
def class_predict(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir)
    model = attack_model.fit_attack_model(rows)
    c = F.col("classification")
    total = F.aggregate(F.map_values(c["probabilities"]), F.lit(0.0), lambda s, x: s + x)
    gated = F.when(c["is_confident"], ~c["requires_review"] & (c["category"] == "class")).otherwise(c["requires_review"] & (c["category"] == "unknown"))
    out = attack_model.predict_classes(spread_evenly(rows), model)
    return out.select("uid", F.size(c["probabilities"]).alias("classes"), gated.alias("gated"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("""
+c AS (SELECT concat('class.', label) AS class_name, count(*) AS n FROM embeddings GROUP BY 1),
f AS (SELECT class_name, n, unnest(range(5)) AS fold FROM c),
s AS (SELECT class_name, CAST(fold AS INT) AS fold, CAST(round((fold + 1) / 5 * n) - round(fold / 5 * n) AS BIGINT) AS n FROM f)
SELECT class_name, fold, n, 5 AS folds, true AS in_range FROM s WHERE n > 0
""")
def cross_validate(spark, sf_dir):
    """Size of every class in every fold, and whether mean and deviation of the accuracy can be such."""
    rows = fx.vectors(spark, sf_dir)
    found = attack_model.cross_validate(rows, count=5).first()
    fair = 0.0 <= found["cv_mean"] <= 1.0 and 0.0 <= found["cv_std"] <= 0.5
    sizes = attack_model.folds(rows, count=5).groupBy("class_name", "fold").agg(F.count("*").alias("n"))
    return sizes.select("class_name", "fold", "n", F.lit(found["folds"]).alias("folds"), F.lit(fair).alias("in_range"))


@query("""
SELECT unnest([5, 5, 10, 10]) AS trees, unnest([3, 6, 3, 6]) AS depth, true AS in_range
""")
def grid_search(spark, sf_dir):
    grid = {"numTrees": [5, 10], "maxDepth": [3, 6]}
    out = attack_model.grid_search(fx.vectors(spark, sf_dir), grid)
    params = F.col("params")
    return out.select(params["numTrees"].cast("int").alias("trees"), params["maxDepth"].cast("int").alias("depth"), F.col("accuracy").between(0.0, 1.0).alias("in_range"))


@query("""
SELECT CAST(unnest(range(width)) AS INT) AS feature, true AS is_share, true AS sums_to_one FROM (SELECT max(len(embedding)) AS width FROM embeddings) w
""")
def feature_importance(spark, sf_dir):
    model = attack_model.fit_attack_model(fx.vectors(spark, sf_dir))
    out = attack_model.feature_importance(model, spark)
    total = out.agg(F.sum("importance")).first()[0]
    return out.select("feature", F.col("importance").between(0.0, 1.0).alias("is_share"), F.lit(abs(total - 1.0) < 1e-6).alias("sums_to_one"))


@query("""
+c AS (SELECT count(*) AS n FROM embeddings GROUP BY label)
SELECT 'nightly' AS session_name, 'v1' AS model_version, CAST(sum(n - round(CAST(0.2 AS DOUBLE) * n)) AS BIGINT) AS training_data_count, true AS in_range FROM c
""")
def training_session(spark, sf_dir):
    model, test = _train(spark, sf_dir)
    row = attack_model.session_record("nightly", "v1", model, attack_model.evaluate(test, model))
    shares = [F.col(c).between(0.0, 1.0) for c in ("accuracy_score", "precision_score", "recall_score", "f1_score")]
    return row.select("session_name", "model_version", "training_data_count", (shares[0] & shares[1] & shares[2] & shares[3]).alias("in_range"))


@query("""
+v AS (SELECT label_category, label_subcategory FROM (SELECT * FROM training WHERE review_status = 'verified') t WHERE label_category IS NOT NULL)
SELECT concat(label_category, '.', label_subcategory) AS label, count(*) AS support FROM v GROUP BY 1
""")
def verified_eval(spark, sf_dir):
    store = fx.store(spark, sf_dir)
    model, _ = attack_model.train_from_store(store)
    report = attack_model.evaluate_verified(store, model)
    return report.filter("support > 0").select("label", "support")


@query("""
+c AS (SELECT label_category, label_subcategory, count(*) AS n FROM training WHERE label_category IS NOT NULL AND confidence_level IN ('medium', 'high') GROUP BY 1, 2),
f AS (SELECT n FROM c WHERE n >= 10)
SELECT 'random_forest' AS kind, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS rows_before_class_filter, (SELECT CAST(sum(n) AS BIGINT) FROM f) AS training_samples,
  (SELECT count(*) FROM f) AS classes_count, (SELECT CAST(sum(round(CAST(0.2 AS DOUBLE) * n)) AS BIGINT) FROM f) AS test_rows, true AS in_range
""")
def performance_panel(spark, sf_dir):
    """Label statistics, model facts and the summary of the test side in one record."""
    store = fx.store(spark, sf_dir)
    model, parts = attack_model.train_from_store(store)
    row = side_by_side([labels.label_statistics(store), parts["summary"]])
    shares = [F.col(c).between(0.0, 1.0) for c in ("accuracy", "confident_accuracy", "confident_ratio")]
    facts = [F.lit(v).cast("bigint").alias(k) for k, v in model.facts.items()]
    return row.select(F.lit(model.kind).alias("kind"), *facts, F.col("n").alias("test_rows"), (shares[0] & shares[1] & shares[2]).alias("in_range"))


@query("""
SELECT count(*) AS total_predictions, count(*) AS successful_predictions, count(*) FILTER (WHERE score < -0.5) AS anomalies_detected,
  count(*) FILTER (WHERE score < -0.5) AS classified_anomalies FROM pred
""")
def hybrid_live(spark, sf_dir):
    model, _ = attack_model.train_from_store(fx.store(spark, sf_dir))
    wide = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("duration", "orig_bytes", "orig_pkts", "resp_pkts")])
    scored = fx.scored(spark, sf_dir).withColumn("z", wide)
    out = hybrid.live_batch(scored, model)
    return out["quality"].select("total_predictions", "successful_predictions", "anomalies_detected", "classified_anomalies")


@query("""
SELECT uid, ts AS timestamp, source_ip, proto, score AS anomaly_score, score < -0.5 AS is_anomaly, CASE WHEN score < -0.5 THEN 'unknown' ELSE 'normal' END AS label_category,
  'hybrid_classifier' AS labeled_by, 'hybrid_pipeline' AS training_source, 'pending' AS review_status FROM scored
""")
def store_hybrid(spark, sf_dir):
    scored = fx.scored(spark, sf_dir).withColumn("z", F.array(F.col("score")))
    out = hybrid.store_predictions(fx.store(spark, sf_dir), hybrid.hybrid_predict(scored), now=now())
    return out.select("uid", "timestamp", "source_ip", "proto", "anomaly_score", "is_anomaly", "label_category", "labeled_by", "training_source", "review_status")


@query("SELECT 1 AS version, true AS same_scores, count(*) AS n FROM conn")
def detector_storage(spark, sf_dir):
    """A saved and reloaded detector gives the same scores."""
    from connlens.operators.registry import latest_version
    from connlens.session import scratch_path

    root = scratch_path(spark, "detector")
    detector = full_detector(spark, sf_dir)
    scoring.save_detector(detector, root, 1)
    log = fx.conn(spark, sf_dir)
    loaded = scoring.load_detector(spark, root)
    a = scoring.score_log(log, detector).select("uid", "score")
    b = scoring.score_log(log, loaded).select("uid", F.col("score").alias("again"))
    same = a.join(b, "uid").agg(F.max(F.abs(F.col("score") - F.col("again"))).alias("d"), F.count("*").alias("n"))
    version = latest_version(scoring.read_registry(spark, root)).first()["version"]
    return same.select(F.lit(version).alias("version"), (F.col("d") < 1e-9).alias("same_scores"), "n")


@query("SELECT unnest(['anomaly', 'normal']) AS prediction, true AS present")
def linear_one_class(spark, sf_dir):
    log = fx.conn(spark, sf_dir)
    fitted = scaling.fit_scaler(log, ["duration", "orig_bytes", "orig_pkts"])
    z = scaling.apply_scaler(log, scaling.Scaler(fitted.features, (0.0,) * 3, fitted.std), "pre")
    model = fit_one_class(z, kernel="linear", nu=0.1)
    scored = score_one_class(z, model).withColumn("prediction", scoring.label("score"))
    return metrics.value_counts(scored, "prediction").select("prediction", (F.col("n") > 0).alias("present"))
