import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from connlens.operators import attack_model, curves, hybrid, labels, metrics, one_class
from helpers import at, rows


def truth(spark, pairs):
    data = [(s, "anomaly" if y else "normal", "anomaly" if s < 0 else "normal") for s, y in pairs]
    return spark.createDataFrame(data, "score double, true_label string, prediction string").repartition(3)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([-1.0, -0.5, 0.0, 0.25, 2.0]), st.booleans()), min_size=2, max_size=40))
def test_auc_equals_pair_counting(spark, pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    got = curves.roc_auc(truth(spark, pairs)).first()["auc"]
    if not pos or not neg:
        assert got is None
        return
    wins = sum(1.0 if p < n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    assert got == pytest.approx(wins / (len(pos) * len(neg)))
    turned = curves.roc_auc(truth(spark, pairs), higher_is_anomalous=True).first()["auc"]
    assert got + turned == pytest.approx(1.0)


@pytest.mark.parametrize("limit", [0, 50_000])
def test_curve_points(spark, limit):
    pairs = [(-2.0, True), (-1.0, False), (-1.0, True), (0.0, False), (3.0, True)]
    roc = rows(curves.roc_points(truth(spark, pairs), one_task_rows=limit).filter("threshold IS NOT NULL"))
    assert [tuple(round(x, 6) for x in r) for r in sorted(roc, reverse=True)] == [(2.0, 0.0, 0.333333), (1.0, 0.5, 0.666667), (0.0, 1.0, 0.666667), (-3.0, 1.0, 1.0)]
    pr = sorted(rows(curves.pr_points(truth(spark, pairs), one_task_rows=limit).filter("threshold IS NOT NULL")), reverse=True)
    assert [tuple(round(x, 6) for x in r) for r in pr] == [(2.0, 1.0, 0.333333), (1.0, 0.666667, 0.666667), (0.0, 0.5, 0.666667), (-3.0, 0.6, 1.0)]
    ap = curves.average_precision(truth(spark, pairs)).first()
    assert ap["average_precision"] == pytest.approx(1 / 3 + 2 / 9 + 0.6 / 3) and ap["baseline"] == 0.6
    assert curves.pr_points(truth(spark, pairs)).filter("threshold IS NULL AND precision = 1 AND recall = 0").count() == 1


def test_confusion_and_report(spark):
    cells = {("anomaly", "anomaly"): 8, ("normal", "anomaly"): 1, ("anomaly", "normal"): 4, ("normal", "normal"): 87}
    data = [(t, p) for (t, p), n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(data, "true_label string, prediction string")
    assert {(r["true_label"], r["predicted"]): r["n"] for r in metrics.confusion(df).collect()} == cells
    row = metrics.class_report(df).filter("label = 'anomaly'").first()
    assert (round(row["precision"], 6), round(row["recall"], 6), round(row["f1_score"], 6), row["support"]) == (0.888889, 0.666667, 0.761905, 12)
    assert metrics.accuracy(df).first()["accuracy"] == 0.95
    one = spark.createDataFrame([("a", "b")], "true_label string, prediction string")
    assert rows(metrics.confusion(one)) == [("a", "a", 0), ("a", "b", 1), ("b", "a", 0), ("b", "b", 0)]
    assert rows(metrics.class_report(one)) == [("a", 0.0, 0.0, 0.0, 1), ("b", 0.0, 0.0, 0.0, 0)]


def test_detector_panel(spark):
    df = spark.createDataFrame([(s,) for s in (-1.0, -0.5, 0.5, -0.25)], "score double")
    row = metrics.detector_performance(df).first()
    assert (row["detection_rate"], row["precision"], row["false_positives"], row["false_negatives"]) == (75.0, 100.0, 0, 1)
    assert row["false_positive_rate"] == 25.0 and row["mean_anomaly_score"] == 0.313
    empty = metrics.detector_performance(df.limit(0)).first()
    assert empty["total_samples"] == 0 and empty["detection_rate"] == 0.0 and empty["mean_anomaly_score"] == 0.0


def vectors(spark, n=200, hot=0.6):
    draw = random.Random(2)
    data = []
    for i in range(n):
        kind = 0 if draw.random() < hot else draw.choice([1, 2])
        data.append((f"U{i}", [kind * 5 + draw.random(), draw.random()], f"attack.k{kind}"))
    return spark.createDataFrame(data, "uid string, features array<double>, class_name string")


@pytest.mark.parametrize("parts", [1, 5])
def test_split_is_exact_and_stable(spark, parts):
    df = vectors(spark).repartition(parts)
    split = attack_model.stratified_split(df)
    sizes = {r["class_name"]: r["count"] for r in df.groupBy("class_name").count().collect()}
    tests = {r["class_name"]: r["count"] for r in split.filter("side = 'test'").groupBy("class_name").count().collect()}
    assert tests == {c: int(0.2 * n + 0.5) for c, n in sizes.items()}
    again = attack_model.stratified_split(vectors(spark).repartition(3))
    assert rows(split, "uid", "side") == rows(again, "uid", "side")
    assert rows(split, "uid") == rows(df, "uid")


@pytest.fixture(scope="module")
def forest(spark):
    return attack_model.fit_attack_model(vectors(spark), numTrees=8, maxDepth=4)


def test_prediction_gate(spark, forest, tmp_path):
    out = attack_model.predict_classes(vectors(spark), forest)
    right = out.filter("predicted_class = class_name").count()
    assert right >= 195
    strict = attack_model.predict_classes(vectors(spark), forest.with_threshold(1.0)).filter("NOT classification.is_confident")
    for r in strict.limit(5).collect():
        assert (r["classification"]["category"], r["classification"]["subcategory"], r["classification"]["requires_review"]) == ("unknown", "unknown", True)
    sure = out.filter("classification.is_confident").first()["classification"]
    assert sure["category"] == "attack" and sure["subcategory"].startswith("k") and len(sure["probabilities"]) == 3
    with pytest.raises(ValueError):
        forest.with_threshold(1.5)
    attack_model.save_attack_model(forest, str(tmp_path / "m"), spark)
    again = attack_model.load_attack_model(spark, str(tmp_path / "m"))
    assert rows(attack_model.predict_classes(vectors(spark), again), "uid", "predicted_class") == rows(out, "uid", "predicted_class")


def test_boosting_gives_shares(spark):
    model = attack_model.fit_attack_model(vectors(spark), "gradient_boosting", maxIter=2, maxDepth=2)
    out = attack_model.predict_classes(vectors(spark), model)
    row = out.first()["classification"]
    assert sum(row["probabilities"].values()) == pytest.approx(1.0) and out.filter("predicted_class = class_name").count() >= 190
    assert attack_model.feature_importance(model, spark).count() == 2


def test_tuning(spark):
    cv = attack_model.cross_validate(vectors(spark), count=3, numTrees=3, maxDepth=3).first()
    assert cv["folds"] == 3 and 0.9 <= cv["cv_mean"] <= 1.0 and cv["cv_std"] >= 0
    best = attack_model.grid_search(vectors(spark), {"numTrees": [2, 3], "maxDepth": [2]}, count=2)
    assert best.count() == 2


def test_cross_validation_fits_each_fold_once_in_its_share_of_the_slots(spark, monkeypatch):
    seen, fit = [], attack_model.RandomForestClassifier._fit

    def counted(self, train):
        seen.append((train.count(), train.rdd.getNumPartitions()))
        return fit(self, train)

    monkeypatch.setattr(attack_model.RandomForestClassifier, "_fit", counted)
    df = vectors(spark)
    cv = attack_model.cross_validate(df, count=3, numTrees=3, maxDepth=3).first()
    assert len(seen) == 3 and sum(n for n, _ in seen) == 2 * df.count() and {p for _, p in seen} == {spark.sparkContext.defaultParallelism // 2}
    assert 0.9 <= cv["cv_mean"] <= 1.0
    with pytest.raises(ValueError, match="data at fold .* is empty"):
        attack_model.cross_validate(df.limit(1), count=3, numTrees=1, maxDepth=1)


def scored(spark):
    return spark.createDataFrame(
        [("N", at(0), 0.4, [0.1, 0.2]), ("A", at(1), -0.9, [10.3, 0.5]), ("E", at(2), None, [0.0, 0.0]), ("M", at(3), -0.3, [5.2, 0.1])],
        "uid string, ts timestamp, score double, z array<double>")


def test_hybrid_prediction(spark, forest):
    out = {r["uid"]: r for r in hybrid.hybrid_predict(scored(spark), forest).collect()}
    assert out["N"]["final_prediction"][:] == ("normal", "benign", 1.0, False) and out["N"]["classification"] is None
    assert out["M"]["anomaly_detection"]["prediction"] == "normal"
    assert out["A"]["classification"]["category"] == "attack" and out["A"]["final_prediction"]["subcategory"] == "k2"
    assert out["E"]["final_prediction"][:] == ("error", "processing_failed", 0.0, True) and out["E"]["anomaly_detection"] is None
    bare = {r["uid"]: r for r in hybrid.hybrid_predict(scored(spark)).collect()}
    assert bare["A"]["final_prediction"][:] == ("unknown", "unknown", 0.0, True)
    assert bare["A"]["classification"]["note"] == "Classification model not available"


def test_hybrid_prediction_reads_its_rows_once(spark, forest, monkeypatch):
    late = scored(spark).unionByName(spark.createDataFrame([("X", at(4), None, None)], scored(spark).schema))
    out = hybrid.hybrid_predict(late, forest)
    assert out.columns == [*late.columns, "anomaly_detection", "error", "classification", "final_prediction"]
    assert rows(out, "uid") == [("A",), ("E",), ("M",), ("N",), ("X",)]
    # Every row is scored once, and only the anomaly is classified.
    seen, asked = spark.sparkContext.accumulator(0), []

    @F.udf("double")
    def counted(score):
        seen.add(1)
        return score

    real = hybrid.predict_classes
    monkeypatch.setattr(hybrid, "predict_classes", lambda df, *more: asked.append(df.count()) or real(df, *more))
    assert len(hybrid.hybrid_predict(late.withColumn("score", counted("score")), forest).collect()) == 5
    assert seen.value == 5 and asked == [1]


def test_quality_counts_absent_parts_as_false(spark, forest):
    row = metrics.prediction_quality(hybrid.hybrid_predict(scored(spark), forest)).first()
    assert (row["total_predictions"], row["successful_predictions"], row["anomalies_detected"], row["classified_anomalies"]) == (4, 3, 1, 1)
    assert row["success_rate"] == 0.75 and row["classification_rate"] == 1.0
    empty = metrics.prediction_quality(hybrid.hybrid_predict(scored(spark).limit(0))).first()
    assert empty["success_rate"] == 0.0


def test_stored_predictions_skip_failures(spark, forest):
    empty = labels.conform(spark.createDataFrame([], "uid string"))
    out = hybrid.live_batch(scored(spark), forest, empty)
    assert rows(out["store"], "uid", "label_category", "labeled_by", "source_ip") == [
        ("A", "attack", "hybrid_classifier", "0.0.0.0"), ("M", "normal", "hybrid_classifier", "0.0.0.0"), ("N", "normal", "hybrid_classifier", "0.0.0.0")]
    assert out["review"].first()[0] >= 1


def test_training_from_the_store(spark):
    base = vectors(spark).select("uid", F.col("features").alias("feature_vector"), F.lit("attack").alias("label_category"),
                                 F.split("class_name", "[.]")[1].alias("label_subcategory"), F.lit("high").alias("confidence_level"),
                                 F.lit("verified").alias("review_status"), F.lit("manual").alias("training_source"))
    store = labels.conform(base)
    model, parts = attack_model.train_from_store(store, numTrees=5, maxDepth=4)
    assert parts["summary"].first()["accuracy"] >= 0.9 and model.facts["classes_count"] == 3
    assert attack_model.evaluate_verified(store, model).agg(F.sum("support")).first()[0] == 200
    with pytest.raises(ValueError, match="too few"):
        attack_model.train_from_store(store.limit(5), numTrees=2)
    with pytest.raises(ValueError, match="too few"):
        attack_model.evaluate_verified(store.limit(5), model)


def test_folds_are_balanced_in_every_class(spark):
    df = vectors(spark)
    counts = attack_model.folds(df, count=4).groupBy("class_name", "fold").count().collect()
    for kind in {r["class_name"] for r in counts}:
        sizes = [r["count"] for r in counts if r["class_name"] == kind]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    tiny = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "uid string, class_name string")
    assert rows(attack_model.stratified_split(tiny), "uid", "side") == [("a", "train"), ("b", "train"), ("c", "train")]
    assert attack_model.folds(tiny, count=5).filter("fold BETWEEN 0 AND 4").count() == 3


def test_linear_one_class_runs_all_default_epochs(spark, sf_dir, monkeypatch):
    from connlens.plans import model_queries

    asked, real = [], model_queries.fit_one_class
    monkeypatch.setattr(model_queries, "fit_one_class", lambda z, **options: asked.append(options) or real(z, **options))
    assert model_queries.linear_one_class(spark, sf_dir).count() == 2 and "epochs" not in asked[0]


def plain_fit(z, nu, gamma, size, epochs, seed):
    """The same steps over all rows in one matrix."""
    w, b = one_class._draw(z.shape[1], size, gamma, seed)
    phi = math.sqrt(2.0 / size) * np.cos(z @ w + b)
    weights, average, mass = phi.mean(axis=0), np.zeros(size), 0.0

    def quantile():
        return np.sort(phi @ weights)[math.ceil(nu * len(z)) - 1]

    for t in range(1, epochs + 1):
        held = phi[phi @ weights <= quantile()]
        weights = weights - (weights - held.mean(axis=0)) / (t + 1.0)
        if t > epochs // 2:
            average, mass = average + t * weights, mass + t
    weights = average / mass
    return weights, quantile()


def test_the_fit_equals_plain_steps_and_makes_features_of_all_rows_once_an_epoch(spark, tmp_path, monkeypatch):
    z = np.random.default_rng(6).normal(size=(300, 3))
    df = spark.createDataFrame([([float(x) for x in v],) for v in z], "z array<double>")
    made = []
    summed = one_class._feature_sum

    def counted(rows, *rest):
        made.append(rows.count())
        return summed(rows, *rest)

    monkeypatch.setattr(one_class, "_feature_sum", counted)
    model = one_class.fit_one_class(df, nu=0.1, gamma=0.4, size=64, epochs=6)
    weights, rho = plain_fit(z, 0.1, 0.4, 64, 6, 42)
    assert np.allclose(model.weights, weights, atol=1e-12) and model.rho == pytest.approx(rho, abs=1e-12)
    assert made == [300] + [30] * 6


def test_features_are_made_in_blocks_and_equal_numpy_s_cosine():
    z = np.concatenate([np.random.default_rng(1).normal(size=(200, 4)) * 30, np.full((1, 4), 1000.0)])
    drawn = one_class._draw(4, 32, 0.3, 7)
    parts = list(one_class._features(z, "rbf", drawn))
    assert max(len(p) for p in parts) <= one_class.BLOCK
    assert np.abs(np.concatenate(parts) - 0.25 * np.cos(z @ drawn[0] + drawn[1])).max() < 1e-11
    assert len(one_class._margins(z[:0], "rbf", drawn, np.ones(32))) == 0


def test_one_partition_of_rows_is_fitted_and_predicted_by_all_slots(spark, monkeypatch):
    df, seen, slots = vectors(spark).coalesce(1), [], spark.sparkContext.defaultParallelism
    real, predicted = attack_model._estimator, attack_model.predict_classes

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, rows):
            seen.append(rows.groupBy(F.spark_partition_id()).count().count())
            return self.inner.fit(rows)

    def counted(rows, *rest):
        seen.append(rows.groupBy(F.spark_partition_id()).count().count())
        return predicted(rows, *rest)

    monkeypatch.setattr(attack_model, "_estimator", lambda *a: Counted(real(*a)))
    monkeypatch.setattr(attack_model, "predict_classes", counted)
    model = attack_model.fit_attack_model(df, numTrees=3, maxDepth=3)
    report = attack_model.evaluate(df, model)["report"]
    assert seen == [slots] * 2 and report.agg(F.sum("support")).first()[0] == 200


def test_a_forest_remembers_the_node_of_each_row(spark):
    data = [(f"u{i}", [float(i % 17), float(i % 5)], f"c.{(i % 17) // 6}") for i in range(300)]
    df = spark.createDataFrame(data, "uid string, features array<double>, class_name string")
    model = attack_model.fit_attack_model(df, numTrees=4, maxDepth=4)
    walked = attack_model.fit_attack_model(df, numTrees=4, maxDepth=4, cacheNodeIds=False)
    assert model.fitted.getOrDefault("cacheNodeIds") and model.fitted.toDebugString.split("\n")[1:] == walked.fitted.toDebugString.split("\n")[1:]


def test_only_the_ranges_of_hashes_that_hold_a_cut_are_ranked(spark, monkeypatch):
    data = [("a", f"u{i}") for i in range(4000)] + [("b", None if i < 4 else f"u{i // 2}") for i in range(30)] + [(None, "u1")]
    df = spark.createDataFrame(data, "class_name string, uid string")
    seen, real = [], attack_model.running_totals

    def counted(rows, *rest):
        seen.append(rows.count())
        return real(rows, *rest)

    placed = df.select("class_name", attack_model._place("uid", 42).alias("p")).collect()
    wanted = {}
    for kind in ("a", "b"):
        own = sorted(((r["p"]["h"], r["p"]["k"]) for r in placed if r["class_name"] == kind), key=lambda p: (p[0], p[1] or ""))
        wanted[kind] = [own[round(share * len(own)) - 1] for share in (0.2, 0.5)]
    monkeypatch.setattr(attack_model, "running_totals", counted)
    for limit in (50_000, 0):
        monkeypatch.setattr(attack_model, "ONE_TASK_ROWS", limit)
        cuts = attack_model.class_cuts(df, "class_name", "uid", [0.0, 0.2, 0.5], 42).filter("class_name is not null").collect()
        assert {r["class_name"]: [tuple(c) for c in r["_cuts"]] for r in cuts} == wanted and {r["_none"] for r in cuts} == {1}
    assert len(seen) == 1 and seen[0] < 100
