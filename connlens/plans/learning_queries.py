"""Fitted models held against bounds that a constant answer fails; grids in full."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from connlens.operators import attack_model, hybrid, scaling, scoring, tuning
from connlens.plans import fixtures as fx
from connlens.plans.registry import query
from connlens.plans.report_queries import full_detector
from connlens.session import cut_lineage

# The class of a vector is the place of the largest of its first three numbers: a constant answer is right for a good third.
CLASSES = "c AS (SELECT vec_id, concat('class.', list_position(embedding[1:3], list_max(embedding[1:3]))) AS label FROM embeddings)"
BOUND = 0.6


def placed_vectors(spark, sf_dir):
    first = F.slice("features", 1, 3)
    return fx.vectors(spark, sf_dir).withColumn("class_name", F.concat(F.lit("class."), F.array_position(first, F.array_max(first)).cast("string")))


def _grid(out, names):
    params = F.col("params")
    return out.select(*[(params[n] if n == "rate" else params[n].cast("int")).alias(n) for n in names], (F.col("accuracy") > BOUND).alias("learned"))


@query("""
SELECT t AS trees, d AS depth, s AS least_split, l AS least_leaf, true AS learned
FROM (SELECT unnest([50, 100, 200]) AS t) a, (SELECT unnest([10, 15, 20, 0]) AS d) b, (SELECT unnest([2, 5, 10]) AS s) c, (SELECT unnest([1, 2, 4]) AS l) e
""")
def forest_grid(spark, sf_dir):
    """All 108 combinations over one binned table."""
    return _grid(tuning.grid_search(placed_vectors(spark, sf_dir)), ["trees", "depth", "least_split", "least_leaf"])


@query("""
SELECT t AS trees, CAST(r AS DOUBLE) AS rate, d AS depth, s AS least_split, true AS learned
FROM (SELECT unnest([50, 100, 200]) AS t) a, (SELECT unnest([0.05, 0.1, 0.2]) AS r) b, (SELECT unnest([5, 10, 15]) AS d) c, (SELECT unnest([2, 5, 10]) AS s) e
""")
def boost_grid(spark, sf_dir):
    """All 81 combinations; the shorter chains are read off the longer ones."""
    return _grid(tuning.grid_search(placed_vectors(spark, sf_dir), "gradient_boosting"), ["trees", "rate", "depth", "least_split"])


def _learned(spark, sf_dir, kind):
    """Test rows of each class, whether the confusion counts them all, and whether most are found."""
    split = cut_lineage(attack_model.stratified_split(placed_vectors(spark, sf_dir)))
    model = tuning.fit_trees(split.filter("side = 'train'"), kind)
    out = tuning.predict_trees(split.filter("side = 'test'"), model)
    right = F.avg((F.col("predicted_class") == F.col("class_name")).cast("double"))
    sure = F.abs(F.aggregate("class_shares", F.lit(0.0), lambda s, x: s + x) - 1) < 1e-9
    return out.groupBy(F.col("class_name").alias("label")).agg(F.count("predicted_class").alias("support"), (right > BOUND).alias("learned"), F.bool_and(sure).alias("shares"))


LEARNED = f"""
+{CLASSES}
SELECT label, CAST(round(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS support, true AS learned, true AS shares FROM c GROUP BY label
"""


@query(LEARNED)
def forest_fit(spark, sf_dir):
    """100 trees of depth 15, at least 5 rows to split and 2 in a leaf."""
    return _learned(spark, sf_dir, "random_forest")


@query(LEARNED)
def boost_fit(spark, sf_dir):
    """100 rounds of depth 10 at rate 0.1 with softmax gradients."""
    return _learned(spark, sf_dir, "gradient_boosting")


@query("""
+v AS (SELECT concat(label_category, '.', label_subcategory) AS label FROM training WHERE review_status = 'verified' AND label_category IS NOT NULL AND confidence_level IN ('medium', 'high')),
t AS (SELECT concat(label_category, '.', label_subcategory) AS label, count(*) AS n FROM training WHERE label_category IS NOT NULL AND confidence_level IN ('medium', 'high') GROUP BY 1)
SELECT label, count(*) AS support, true AS precise FROM v WHERE label IN (SELECT label FROM t WHERE n >= 10) GROUP BY label
""")
def verified_precision(spark, sf_dir):
    """Confident answers on verified rows of the kind that was learned are right for every class."""
    store = fx.store(spark, sf_dir)
    rows = store.filter("confidence_level in ('medium', 'high')")
    model, _ = attack_model.train_from_store(store)
    report = attack_model.evaluate_verified(rows, model)
    known = F.array(*[F.lit(c) for c in model.classes])
    return report.filter(F.array_contains(known, F.col("label")) & (F.col("support") > 0)).select("label", "support", (F.col("precision") > 0.8).alias("precise"))


@query("""
+t AS (SELECT concat(label_category, '.', label_subcategory) AS label, count(*) AS n FROM training WHERE label_category IS NOT NULL AND confidence_level IN ('medium', 'high') GROUP BY 1),
f AS (SELECT n FROM t WHERE n >= 10)
SELECT 'nightly' AS session_name, CAST(sum(n - round(CAST(0.2 AS DOUBLE) * n)) AS BIGINT) AS training_rows, CAST(sum(round(CAST(0.2 AS DOUBLE) * n)) AS BIGINT) AS confusion_total, true AS learned FROM f
""")
def session_learned(spark, sf_dir):
    """The record of a training session: the matrix counts the whole test side, accuracy and class means are those of a model that has learned."""
    model, parts = attack_model.train_from_store(fx.store(spark, sf_dir))
    row = attack_model.session_record("nightly", "v1", model, parts)
    cells = F.from_json("confusion_matrix", "array<struct<true_label: string, predicted: string, n: bigint>>")
    learned = (F.col("accuracy_score") > 0.7) & (F.col("precision_score") > 0.7) & (F.col("recall_score") > 0.7) & (F.col("f1_score") > 0.7)
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda s, c: s + c["n"])
    trained = F.col("training_data_count") - total
    return row.select("session_name", trained.alias("training_rows"), total.alias("confusion_total"), learned.alias("learned"))


@query("""
+t AS (SELECT uid, concat(label_category, '.', label_subcategory) AS label FROM training WHERE label_category IS NOT NULL AND confidence_level IN ('medium', 'high')),
f AS (SELECT label FROM t GROUP BY label HAVING count(*) >= 10)
SELECT t.label, count(*) AS rows, count(*) FILTER (WHERE score < -0.5) AS anomalies, true AS precise FROM t JOIN scored s ON s.uid = t.uid WHERE t.label IN (SELECT label FROM f) GROUP BY t.label
""")
def hybrid_precision(spark, sf_dir):
    """Anomalies that get a class with confidence get the right one; normal rows get none."""
    store = fx.store(spark, sf_dir)
    model, _ = attack_model.train_from_store(store)
    wide = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("duration", "orig_bytes", "orig_pkts", "resp_pkts")])
    out = hybrid.live_batch(fx.scored(spark, sf_dir).withColumn("z", wide), model)["predictions"]
    labelled = store.filter("confidence_level in ('medium', 'high')").select("uid", F.concat_ws(".", "label_category", "label_subcategory").alias("label")).filter(F.col("label").isin(list(model.classes)))
    c = F.col("classification")
    found = out.join(labelled, "uid")
    sure = F.coalesce(c["is_confident"], F.lit(False))
    wrong = sure & (F.concat_ws(".", c["category"], c["subcategory"]) != F.col("label"))
    normal = ~F.col("anomaly_detection.is_anomaly") & c.isNotNull()
    return found.groupBy("label").agg(
        F.count("*").alias("rows"), F.count_if("anomaly_detection.is_anomaly").alias("anomalies"),
        ((F.count_if(wrong) <= 0.2 * F.count_if(sure)) & (F.count_if(normal) == 0)).alias("precise"))


@query("""
SELECT uid, CASE WHEN line_no % 10 = 3 THEN NULL ELSE scan_id END AS scan_id, score,
  CASE WHEN line_no % 10 = 3 THEN 'no scan' WHEN line_no % 10 = 4 THEN 'no time' END AS reason
FROM (SELECT f.uid, c.line_no, c.scan_id, CASE WHEN c.line_no % 10 IN (3, 4) THEN NULL ELSE f.score END AS score FROM full_scored f JOIN conn c ON c.uid = f.uid) s
""")
def corpus_scores(spark, sf_dir):
    """Scores of a corpus of scans next to the rows that could not be scored and why."""
    log, bad = fx.conn(spark, sf_dir), F.col("line_no") % 10
    broken = log.withColumn("scan_id", F.when(bad != 3, F.col("scan_id"))).withColumn("ts", F.when(bad != 4, F.col("ts")))
    results, rejected = scoring.score_corpus(broken, full_detector(spark, sf_dir))
    scored = results.select("uid", "scan_id", F.round("score", 6).alias("score"), F.lit(None).cast("string").alias("reason"))
    return scored.unionByName(rejected.select("uid", "scan_id", F.lit(None).cast("double").alias("score"), "reason"))


def _close(share, nu, rows):
    return F.abs(share - nu) <= 3.0 / math.sqrt(max(rows, 1))


@query("""
SELECT 'labelled' AS run, (SELECT count(*) FROM embeddings) AS rows, true AS share_matches_nu, true AS far_is_lower
UNION ALL SELECT 'full', (SELECT count(*) FROM conn) + (SELECT count(*) FROM embeddings), true, true
""")
def retrain_boundary(spark, sf_dir):
    """Retrained models leave out the share nu of their rows, and score a row far from all of them lower than the mean row."""
    nu, rows = 0.1, fx.vectors(spark, sf_dir).withColumnRenamed("features", "feature_vector")
    fitted = scaling.fit_vector_scaler(rows, "feature_vector", 64)
    model, _ = scoring.retrain_labelled(rows, fitted, nu=nu)
    own = scaling.scale_vector(rows, "feature_vector", fitted).select("z")
    log, vectors = fx.conn(spark, sf_dir), fx.vectors(spark, sf_dir)
    detector, _ = scoring.full_retrain(log, vectors, nu=nu)
    whole = scoring.vectorise(log, detector.encoder, scaling.Scaler(detector.scaler.features, detector.scaler.mean, detector.scaler.std), "pre").select("z").unionByName(
        scaling.scale_vector(scaling.align_width(vectors, "features", len(detector.scaler.mean)), "features", detector.scaler).select("z"))
    out = None
    for name, z, fit in (("labelled", own, model), ("full", whole, detector.model)):
        far = spark.createDataFrame([([1000.0] * fit.width,)], "z array<double>").withColumn("far", F.lit(True))
        scored = scoring.score_vectors(z.withColumn("far", F.lit(False)).unionByName(far), fit)
        near = ~F.col("far")
        facts = scored.agg(F.count_if(near).alias("rows"), F.avg(F.when(near, (F.col("score") < 0).cast("double"))).alias("share"), F.avg(F.when(near, F.col("score"))).alias("mean"), F.max(F.when(F.col("far"), F.col("score"))).alias("away"))
        row = facts.select(F.lit(name).alias("run"), "rows", _close(F.col("share"), nu, fit.rows).alias("share_matches_nu"), (F.col("away") < F.col("mean")).alias("far_is_lower"))
        out = row if out is None else out.unionByName(row)
    return out
