import pytest
from pyspark.sql import functions as F

from connlens.operators import filters, labels, registry, validation
from connlens.schemas import TRAINING_TYPES
from helpers import at, conn, rows


def moment():
    return F.lit("2024-06-01").cast("timestamp")


def store(spark, n=6, **columns):
    base = spark.range(n).select(
        F.concat(F.lit("U"), F.col("id").cast("string")).alias("uid"), F.timestamp_seconds(F.col("id")).alias("timestamp"),
        (-F.col("id") / 10.0).alias("anomaly_score"), F.array(F.lit(1.0)).alias("feature_vector"), F.lit("manual").alias("training_source"),
    )
    return labels.conform(base.withColumns(columns), moment())


def test_upsert_replaces_whole_rows_and_is_idempotent(spark):
    old = store(spark, label_category=F.lit("malware"))
    new = store(spark, 8).filter("uid >= 'U4'").withColumn("service", F.lit("new"))
    once = labels.upsert(old, new)
    assert once.columns == list(TRAINING_TYPES) and once.count() == 8
    assert rows(once.filter("service = 'new'"), "uid", "label_category") == [(f"U{i}", None) for i in range(4, 8)]
    assert rows(labels.upsert(once, new)) == rows(once)
    kept = labels.upsert(old, new, keep_labels=True)
    assert rows(kept.filter("service = 'new'"), "uid", "label_category") == [("U4", "malware"), ("U5", "malware"), ("U6", None), ("U7", None)]


def test_upsert_takes_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([("a", 0)], "uid string, v int")
    new = spark.createDataFrame([("a", 1, 1), ("a", 3, 3), ("a", 2, 2), ("b", 9, 1)], "uid string, v int, seq int")
    assert rows(labels.upsert(old, new, order="seq")) == [("a", 3), ("b", 9)]


def test_bulk_label_overwrites_notes_and_counts(spark):
    df = store(spark, notes=F.lit("old"))
    uids = spark.createDataFrame([("U1",), ("U1",), ("U9",)], "uid string")
    out = labels.bulk_label(df, uids, "malware", "infected-host", "high", "me", now=moment())
    hit = out.filter("uid = 'U1'").first()
    assert (hit["label_category"], hit["notes"], hit["review_status"], hit["confidence_level"]) == ("malware", None, "reviewed", "high")
    assert out.filter("notes = 'old'").count() == 5 and out.count() == 6
    assert labels.count_listed(df, uids).first()[0] == 1
    assert labels.delete_uids(df, uids).count() == 5 and labels.delete_uids(df, uids.limit(0)).count() == 6
    assert rows(labels.mark_extracted(df, uids, now=moment()).filter("has_extracted_pcap"), "uid") == [("U1",)]


def test_statistics_of_an_empty_store(spark):
    row = labels.label_statistics(store(spark, 0)).first()
    assert tuple(row) == (0, None, None, None)


def test_import_skips_normals_and_parses_vectors(spark):
    results = spark.createDataFrame(
        [("A", at(0), -0.2, "anomaly", "[1, 2]"), ("B", at(0), 0.2, "normal", "[1]"), ("Z", at(9), -0.3, "anomaly", "bad")],
        "uid string, timestamp timestamp, score double, prediction string, feature_vector string")
    out = labels.import_rows(results, conn(spark, [("A", 1, "tcp", None), ("A", 2, "udp", None)]), now=moment())
    assert rows(out, "uid", "proto", "feature_vector", "review_status", "training_source") == [
        ("A", "tcp", [1.0, 2.0], "pending", "analysis_import"), ("Z", "unknown", None, "pending", "analysis_import")]


def test_label_from_scan_keeps_one_label_per_uid(spark):
    results = conn(spark, [("A", 2, "tcp", None), ("A", 1, "udp", None), ("B", 3, "tcp", None)]).withColumn("score", F.lit(-0.25))
    some = spark.createDataFrame([("A",), ("A",), ("Q",)], "uid string")
    first = labels.scan_labels(results, some, "port-scan", now=moment())
    assert rows(first, "uid", "score", "source_ip", "confidence") == [("A", 0.25, "10.0.0.1", "medium")]
    both = labels.label_from_scan(first, results, results.select("uid"), "ddos-attack", "high", moment())
    assert rows(both, "uid", "attack_category") == [("A", "ddos-attack"), ("B", "ddos-attack")]


def test_definitions(spark):
    seeds = labels.default_definitions(spark)
    assert seeds.count() == 18 and labels.seed_definitions(seeds).count() == 18
    new = spark.createDataFrame([("malware", "infected-host", "changed", "#000000", False)], seeds.schema)
    merged = labels.upsert_definitions(seeds, new)
    assert merged.count() == 18 and labels.active_definitions(merged).count() == 17
    nested = {r["category"]: r["subcategories"] for r in labels.definitions_map(merged).collect()}
    assert set(nested["normal"]) == {"benign", "maintenance"}


def test_stack_and_add_column(spark):
    df = spark.createDataFrame([(1, None), (2, True)], "a int, flag boolean")
    assert rows(labels.add_column(df, "flag"), "flag") == [(False,), (True,)]
    assert labels.stack(df, None) is df
    with pytest.raises(ValueError):
        labels.stack(None, None)


def test_browse_ignores_blank_filters_and_includes_both_ends(spark):
    df = store(spark)
    out = filters.browse(df, start_date="1970-01-01 00:00:01", end_date="1970-01-01 00:00:03", review_status="", label_category=None)
    assert rows(out, "uid") == [("U1",), ("U2",), ("U3",)]
    with pytest.raises(ValueError):
        filters.browse(df, color="red")


def test_pages_do_not_overlap(spark):
    df = store(spark, 25).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    pages = [filters.page(df, 10, at_) for at_ in (0, 10, 20)]
    uids = [r["uid"] for p in pages for r in p.collect()]
    assert len(uids) == 25 == len(set(uids))
    assert filters.page(df, 5000, cap=7).count() == 7 and filters.page(df, 5000).count() == 25


def test_trainable_and_queue(spark):
    level = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.substring("uid", 2, 1).cast("int") % 3 + 1))
    df = store(spark, label_category=F.lit("a"), label_subcategory=F.lit("b"), confidence_level=level)
    assert filters.trainable(df, "medium").count() == 4 and filters.trainable(df, "high").count() == 2
    queue = filters.label_queue(df.select("uid", "anomaly_score"), df.filter("uid = 'U5'"), 2)
    assert [(r["uid"], r["score"], r["current_label"]) for r in queue.collect()] == [("U5", 0.5, "labeled"), ("U4", 0.4, None)]


def labelled(spark, n, categories=3, confidence="medium", text="[1, 2]"):
    return spark.range(n).select(
        F.concat(F.lit("c"), (F.col("id") % categories).cast("string")).alias("attack_category"), F.lit(confidence).alias("confidence"),
        F.lit(text).alias("feature_vector"))


def test_verdicts(spark):
    three = validation.validate_labels(labelled(spark, 3)).first()
    assert (three["category_balance_ratio"], three["is_valid"], three["risk_level"], three["training_recommended"]) == (1.0, False, "high", False)
    assert three["advice"] == ["few_samples", "rarely_high_confidence", "do_not_train"]
    levels = {r["topic"]: (r["level"], r["value"]) for r in validation.training_advice(validation.validate_labels(labelled(spark, 3))).collect()}
    assert levels == {"samples": ("critical", 3.0), "categories": ("warning", 3.0), "quality": ("good", 0.0), "risk": ("high", 0.0)}
    good = validation.validate_labels(labelled(spark, 60, confidence="high")).first()
    assert (good["is_valid"], good["risk_level"], good["issues"]) == (True, "low", [])
    one_issue = validation.validate_labels(labelled(spark, 60, text="x")).first()
    assert (one_issue["is_valid"], one_issue["risk_level"], one_issue["issues"]) == (False, "medium", ["no_read_vector"])
    bare = validation.validate_labels(labelled(spark, 60).select("confidence")).first()
    assert bare["risk_level"] == "high" and bare["issues"] == ["no_category", "no_vector"]


def test_vector_quality_rates_divide_by_the_rows_looked_at(spark):
    df = labelled(spark, 3).union(labelled(spark, 1, text="bad"))
    row = validation.vector_quality(df).first()
    assert (row["sampled"], row["parse_errors"], row["parse_error_rate"], row["feature_dimensions"]) == (4, 1, 0.25, 2)


def test_versions(spark):
    parts = [("", p) for p in registry.PARTS] + [("v2", p) for p in registry.PARTS] + [("v3", "model"), ("v3", "encoders"), ("vx", "model")]
    df = spark.createDataFrame(parts, "version string, part string")
    assert registry.latest_version(df).first()[0] == 2 and registry.next_version(df).first()[0] == 4
    assert [tuple(r) for r in registry.model_versions(df).collect()] == [(3, 2, False), (2, 3, True), (0, 3, True)]
    assert registry.next_version(df.limit(0)).first()[0] == 2 and registry.latest_version(df.limit(0)).first()[0] is None
