import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from connlens.functions import scalars
from connlens.operators import encoding, scaling
from connlens.operators.one_class import KernelModel, fit_one_class, kernel_score, label, score_kernel, score_one_class
from connlens.operators.scoring import Detector, fit_detector, full_retrain, load_detector, result_rows, retrain_labelled, save_detector, score_corpus, score_log, score_scan
from helpers import at, conn, rows


def test_ids_follow_first_appearance_on_any_partitioning(spark):
    log = conn(spark, [("C3", 3, "icmp", None), ("C1", 1, "udp", "dns"), ("C2", 2, "tcp", None), ("C4", 4, "udp", "ssl")])
    want = [("proto", "icmp", 2), ("proto", "tcp", 1), ("proto", "udp", 0), ("service", "dns", 0), ("service", "ssl", 2), ("service", "unknown", 1)]
    for n in (1, 7):
        assert rows(encoding.fit_encoder(log.repartition(n), ["proto", "service"])) == want


def test_unknown_category_row_gets_minus_one(spark):
    table = encoding.fit_encoder(conn(spark, [("C1", 1, "tcp", "http")]))
    new = conn(spark, [("N", 1, "new_proto", "new_service")]).withColumn("history", F.lit("new_history"))
    assert rows(encoding.apply_encoder(new, table), "proto", "service", "history") == [(-1, -1, -1)]
    assert rows(encoding.unknown_values(new, table), "column", "value") == [("history", "new_history"), ("proto", "new_proto"), ("service", "new_service")]


@pytest.mark.parametrize("map_rows,broadcast_rows", [(64, 100), (0, 100), (0, 0)])
def test_every_way_to_apply_gives_the_same_ids(spark, map_rows, broadcast_rows):
    log = conn(spark, [(f"C{i}", i, ["tcp", "udp", None][i % 3], f"s{i % 11}") for i in range(60)])
    table = encoding.fit_encoder(log)
    other = conn(spark, [(f"D{i}", i, ["tcp", "sctp", None][i % 3], f"s{i % 13}") for i in range(60)])
    got = rows(encoding.apply_encoder(other, table, map_rows=map_rows, broadcast_rows=broadcast_rows), "uid", "proto", "service", "history")
    ids = {(r["column"], r["value"]): r["id"] for r in table.collect()}
    want = [(f"D{i}", ids.get(("proto", ["tcp", "sctp", "unknown"][i % 3]), -1), ids.get(("service", f"s{i % 13}"), -1), 0) for i in range(60)]
    assert got == sorted(want, key=str)


def test_column_absent_at_fit_time_is_fitted_on_the_new_rows(spark):
    table = encoding.fit_encoder(conn(spark, [("C1", 1, "tcp", "http")]).drop("service"))
    assert ("service", None, -1) in rows(table)
    out = encoding.apply_encoder(conn(spark, [("C1", 1, "tcp", "b"), ("C2", 2, "tcp", "a")]), table, order="line_no")
    assert rows(out, "uid", "service") == [("C1", 0), ("C2", 1)]


def test_expansion_continues_the_ids_in_list_order(spark):
    table = encoding.fit_encoder(conn(spark, [("C1", 1, "tcp", "http"), ("C2", 2, "udp", "http")]))
    new = spark.createDataFrame([("proto", "zz", 0), ("proto", "aa", 1), ("proto", "tcp", 2), ("other", "x", 3)], "column string, value string, at int")
    grown, counts = encoding.expand_encoder(table, new, "at")
    ids = {(r["column"], r["value"]): r["id"] for r in grown.collect()}
    assert ids[("proto", "zz")] == 2 and ids[("proto", "aa")] == 3 and ("other", "x") not in ids
    assert rows(counts) == [("proto", 2)]
    again, none = encoding.expand_encoder(grown, new, "at")
    assert rows(again) == rows(grown) and none.count() == 0


def test_scaler_uses_population_deviation_without_missing_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0), (float("nan"), 5.0)], "a double, b double")
    fitted = scaling.fit_scaler(df, ["a", "b"])
    assert fitted.mean == (2.0, 5.0) and fitted.std == (1.0, 1.0)
    for policy, value in (("pre", -2.0), ("post", 0.0), ("mean", 0.0)):
        z = [r["z"][0] for r in scaling.apply_scaler(df, fitted, policy).collect()]
        assert z == [-1.0, 1.0, value, value]
    census = scaling.missing_census(df, ["a", "b"], fitted).first()
    assert (census["missing_before"], census["missing_after"]) == (2, 2)
    with pytest.raises(ValueError):
        scaling.scaled(fitted, "other")


def test_vectors_are_parsed_padded_and_cut(spark):
    df = spark.createDataFrame([("[ 0.1, -0.6,  1.2]",), ("[1, x]",), ("[]",), ("",), (None,), ("[NaN, 1]",)], "t string")
    got = [r[0] for r in df.select(scalars.vector_from_text("t")).collect()]
    assert got[0] == [0.1, -0.6, 1.2] and got[1:5] == [None] * 4 and math.isnan(got[5][0])
    wide = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert scaling.align_width(wide, "v", 5).first()[0] == [1.0, 2.0, 3.0, 0.0, 0.0]
    assert scaling.align_width(wide, "v", 2).first()[0] == [1.0, 2.0]


def test_scalar_texts(spark):
    df = spark.createDataFrame([("x/capture_20240105_102300.pcap", "20240105_102300", "-", " 12 ")], "p string, s string, d string, n string")
    row = df.select(
        scalars.display_time(scalars.scan_time("s")), scalars.file_name("p"), scalars.file_stem("p"), scalars.dash_to_null("d", "bigint"),
        scalars.dash_to_null("n", "bigint"), scalars.scan_id_of(scalars.file_time("p")), scalars.iso_time(scalars.scan_time("s"), "Z"),
    ).first()
    assert tuple(row) == (
        "05 JAN 2024 10:23", "capture_20240105_102300.pcap", "capture_20240105_102300", None, 12, "20240105_102300", "2024-01-05T10:23:00.000000Z")


def test_bands_and_severity(spark):
    df = spark.createDataFrame([(-0.6,), (-0.5,), (0.0,), (0.1,)], "s double")
    assert [r[0] for r in df.select(scalars.score_band("s")).collect()] == ["high", "moderate", "moderate", "normal"]
    rates = spark.createDataFrame([(50.1,), (50.0,), (20.0,)], "r double")
    assert [r[0] for r in rates.select(scalars.severity("r")).collect()] == ["high", "medium", "low"]


def test_kernel_expression_equals_batches_and_numpy(spark):
    draw = np.random.default_rng(3)
    z = draw.normal(size=(40, 6))
    support = draw.normal(size=(60, 6))
    alphas = draw.uniform(size=60)
    model = KernelModel(tuple(map(tuple, support.tolist())), tuple(alphas.tolist()), 0.3, 0.7)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(z)], "i int, z array<double>").repartition(3)
    want = np.exp(-0.3 * ((z[:, None, :] - support[None]) ** 2).sum(-1)) @ alphas - 0.7
    batched = {r["i"]: r["score"] for r in score_kernel(df, model).collect()}
    unrolled = {r["i"]: r["s"] for r in df.select("i", kernel_score([F.col("z")[i] for i in range(6)], model).alias("s")).collect()}
    for i in range(40):
        assert batched[i] == pytest.approx(want[i], abs=1e-9) and unrolled[i] == pytest.approx(want[i], abs=1e-9)


def test_label_boundary(spark):
    df = spark.createDataFrame([(-1e-9,), (0.0,)], "score double")
    assert [r[0] for r in df.select(label("score")).collect()] == ["anomaly", "normal"]


def cloud(spark, n=400, parts=3):
    draw = np.random.default_rng(5)
    points = draw.normal(size=(n, 3))
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, z array<double>").repartition(parts)


def test_training_share_and_distance(spark):
    nu, n = 0.1, 400
    model = fit_one_class(cloud(spark, n), nu=nu, epochs=10)
    scores = [r["score"] for r in score_one_class(cloud(spark, n), model).collect()]
    assert abs(np.mean(np.array(scores) < 0) - nu) <= 3 / math.sqrt(n)
    line = spark.createDataFrame([(i, [float(i), 0.0, 0.0]) for i in (0, 2, 4)], "i int, z array<double>")
    falling = [r["score"] for r in score_one_class(line, model).orderBy("i").collect()]
    assert falling == sorted(falling, reverse=True)


def test_fit_does_not_depend_on_partitioning(spark):
    models = [fit_one_class(cloud(spark, 200, parts), nu=0.2, size=64, epochs=4) for parts in (1, 4, 17)]
    for other in models[1:]:
        assert np.allclose(models[0].weights, other.weights, atol=1e-9) and other.rho == pytest.approx(models[0].rho, abs=1e-9)


def test_fit_rejects_bad_input(spark):
    with pytest.raises(ValueError):
        fit_one_class(cloud(spark), nu=0.0)
    with pytest.raises(ValueError):
        fit_one_class(cloud(spark), kernel="poly")
    with pytest.raises(ValueError):
        fit_one_class(cloud(spark).limit(0))


def log_of(spark, n=80):
    return conn(spark, [(f"C{i}", i, ["tcp", "udp"][i % 2], ["http", None][i % 2], 0.1 * (i % 7)) for i in range(n)])


def test_scan_job_storage_and_rejects(spark, tmp_path):
    log = log_of(spark)
    detector = fit_detector(log, nu=0.1, size=64, epochs=4)
    out = score_scan(log, detector)
    assert out.columns == ["uid", "timestamp", "score", "prediction"] and out.count() == 80
    save_detector(detector, str(tmp_path / "m"), 1)
    again = load_detector(spark, str(tmp_path / "m"))
    a, b = rows(out, "uid", "score"), rows(score_scan(log, again), "uid", "score")
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])
    mixed = log.withColumn("scan_id", F.when(F.col("line_no") > 1, "20240101_000000"))
    good, rejected = score_corpus(mixed, detector)
    assert good.count() == 78 and rows(rejected, "reason") == [("no scan",), ("no scan",)]
    assert score_scan(log.limit(0), detector).count() == 0


def test_row_without_uid_is_named(spark):
    log = log_of(spark, 10).withColumn("uid", F.when(F.col("line_no") != 3, F.col("uid")))
    detector = Detector(encoding.fit_encoder(log), scaling.fit_scaler(log, ["duration", "orig_bytes"]), KernelModel(((0.0, 0.0),), (1.0,), 0.5, 0.5))
    assert "unknown-3" in [r["uid"] for r in score_scan(log, detector).collect()]


def test_retraining(spark):
    labelled = spark.createDataFrame([([float(i % 5), float(i % 3)], ["a", "b"][i % 2]) for i in range(40)], "feature_vector array<double>, attack_category string")
    fitted = scaling.fit_vector_scaler(labelled, "feature_vector", 2)
    model, report = retrain_labelled(labelled, fitted, nu=0.2, size=32, epochs=3)
    counts = {(r["measure"], r["name"]): r["value"] for r in report.collect()}
    assert model.width == 2 and counts[("category", "a")] == 20 and counts[("total", "rows")] == 40
    with pytest.raises(ValueError, match="width"):
        retrain_labelled(labelled.withColumn("feature_vector", F.array(F.lit(1.0))), fitted)
    detector, report = full_retrain(log_of(spark), labelled, vector="feature_vector", nu=0.2, size=32, epochs=3)
    counts = {(r["measure"], r["name"]): r["value"] for r in report.collect()}
    assert detector.model.width == 8 and counts[("origin", "normal")] == 80 and counts[("origin", "labelled")] == 40
    with pytest.raises(ValueError):
        full_retrain(None, None)


def test_scores_carry_the_log_columns(spark):
    log = log_of(spark, 5)
    detector = Detector(encoding.fit_encoder(log), scaling.fit_scaler(log, ["duration", "orig_bytes"]), KernelModel(((0.0, 0.0),), (1.0,), 0.5, 0.5))
    scored = score_log(log, detector)
    assert set(log.columns) <= set(scored.columns)
    assert result_rows(scored).filter("uid = 'C1'").first()["timestamp"] == at(1).isoformat() + ".000000+00:00"
