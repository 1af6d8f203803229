import json

import pytest
from pyspark.sql import functions as F

from connlens.operators import labels, reports
from connlens.sources import captures, conn_log, labelled, results, tables
from connlens.schemas import LOG_COLUMNS
from helpers import at, rows

HEAD_A = "#separator \\x09\n#fields\tts\tuid\tproto\tservice\tduration\torig_bytes\n"
HEAD_B = "#fields\tuid\tts\thistory\tproto\n"


@pytest.fixture()
def log_folder(tmp_path):
    (tmp_path / "a.log").write_text(HEAD_A + "1704067200.123456\tC1\ttcp\t-\t1.5\t10\n1704067201\tC2\tudp\tdns\tNaN\t-\n#close\n\n")
    (tmp_path / "b.log").write_text(HEAD_B + "C3\t1704067202.5\tS#x\ticmp\n")
    return str(tmp_path)


def test_header_decides_the_columns_of_each_file(spark, log_folder):
    out = conn_log.read_conn_log(spark, log_folder)
    got = {r["uid"]: r for r in out.collect()}
    assert got["C1"]["ts"] == at(0.123456) and got["C1"]["service"] is None and got["C1"]["orig_bytes"] == 10
    assert got["C2"]["duration"] is None and got["C2"]["orig_bytes"] is None and got["C2"]["service"] == "dns"
    # A '#' inside a value does not cut the row, and the absent column is null in the mixed frame.
    assert got["C3"]["history"] == "S#x" and got["C3"]["ts"] == at(2.5) and got["C3"]["duration"] is None


def test_log_without_header_raises(spark, tmp_path):
    (tmp_path / "x.log").write_text("1\tC1\n")
    with pytest.raises(ValueError):
        conn_log.read_conn_log(spark, str(tmp_path))


def test_raw_log_pads_cuts_or_skips(spark, tmp_path):
    (tmp_path / "r.log").write_text("#fields\tuid\tproto\tservice\nC1\ttcp\nC2\tudp\tdns\textra\n")
    padded = conn_log.read_raw_log(spark, str(tmp_path), "pad")
    assert rows(padded) == [("C1", "tcp", "-"), ("C2", "udp", "dns")]
    assert rows(conn_log.read_raw_log(spark, str(tmp_path), "skip")) == [("C2", "udp", "dns")]


def test_raw_log_without_header_takes_the_default_layout(spark, tmp_path):
    (tmp_path / "r.log").write_text("1704067200\tC1\t10.0.0.1\t1\t10.0.0.2\t2\ttcp\n")
    out = conn_log.read_raw_log(spark, str(tmp_path))
    assert out.columns == LOG_COLUMNS
    assert out.select("uid", F.col("`id.resp_h`"), "proto", "service").first()[:] == ("C1", "10.0.0.2", "tcp", "-")


def write_csv(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_result_reader(spark, tmp_path):
    write_csv(tmp_path / "r.csv", "uid,timestamp,score,prediction,true_label\nC0,2025-05-14T12:59:46.281556,-0.75,normal,normal\n")
    out = results.read_results(spark, str(tmp_path / "r.csv"))
    row = out.first()
    assert results.has_truth(out) and row["score"] == -0.75 and row["timestamp"].microsecond == 281556
    write_csv(tmp_path / "bad.csv", "uid,score\nC0,1\n")
    with pytest.raises(ValueError, match="prediction"):
        results.read_results(spark, str(tmp_path / "bad.csv"))


def test_corpus_takes_scan_and_time_from_the_folder(spark, tmp_path):
    text = "uid,timestamp,score,prediction\nC0,2024-01-01T00:00:00,-0.1,anomaly\n"
    write_csv(tmp_path / "20240102_030405" / "prediction_results.csv", text)
    write_csv(tmp_path / "named_scan" / "prediction_results.csv", text)
    out = results.read_corpus(spark, str(tmp_path), "prediction_results.csv")
    got = {r["scan_id"]: r for r in out.collect()}
    assert set(got) == {"20240102_030405", "named_scan"}
    assert got["20240102_030405"]["scan_start"] == at(86400 + 3 * 3600 + 4 * 60 + 5)
    assert got["named_scan"]["scan_start"] == got["named_scan"]["modified"]
    assert results.latest_scan(out).first()[0] == "named_scan"


def test_written_corpus_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("20240101_000000", "C0", at(1.5), -0.25, "anomaly")], "scan_id string, uid string, timestamp timestamp, score double, prediction string")
    results.write_results(df, str(tmp_path / "w"))
    out = results.read_corpus(spark, str(tmp_path / "w")).select(df.columns)
    assert rows(out) == rows(df)


def test_fallback_columns(spark):
    df = spark.createDataFrame([(-0.5, "anomaly"), (0.5, "normal")], "anomaly_score double, prediction string")
    assert rows(results.with_fallbacks(df), "score", "is_anomaly") == [(-0.5, True), (0.5, False)]


def test_labelled_layouts(spark, tmp_path):
    write_csv(tmp_path / "new.csv", (
        "timestamp,uid,score,attack_category,attack_subcategory,confidence,source_ip,dest_ip,user_feedback,training_source,feature_vector,suricata_rule_candidate\n"
        '2023-05-13T12:00:00,U1,0.9,port-scan,,medium,Unknown,Unknown,m,l,"[ 0.1, -0.6,  1.2]",\n'
        '2023-05-13T12:00:00,U2,0.8,port-scan,,medium,Unknown,Unknown,m,l,"[ 0.1, x]",\n'))
    good = labelled.read_labelled(spark, str(tmp_path / "new.csv"))
    assert [r["feature_vector"] for r in good.collect()] == [[0.1, -0.6, 1.2]]
    assert labelled.read_labelled(spark, str(tmp_path / "new.csv"), drop_bad=False).count() == 2
    write_csv(tmp_path / "old.csv", 'timestamp,uid,score,original_label,user_label,feature_vector\n2023-05-13T12:00:00,U1,0.9,anomaly,ddos,"[1, 2]"\n')
    old = labelled.upgrade_legacy(labelled.read_labelled(spark, str(tmp_path / "old.csv")))
    assert rows(old, "uid", "attack_category", "feature_vector") == [("U1", "ddos-attack", [1.0, 2.0])]


def test_captures_with_and_without_document(spark, tmp_path):
    doc = {
        "pcap_filename": "capture_20240101_000100.pcap", "origin_type": "timed_capture", "timestamp": "2024-01-01T00:01:00.000000Z",
        "metadata": {"interface": "eth0", "duration_seconds": 30}, "analysis_results": [{"analysis_id": "20240101_000000", "anomaly_count": 1, "total_connections": 5}],
    }
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "capture_20240101_000100.json").write_text(json.dumps(doc, indent=2))
    documents = captures.read_documents(spark, str(tmp_path / "d"))
    names = spark.createDataFrame([("capture_20240101_000100.pcap",), ("uploaded_20240101_000200_x.pcapng",), ("other.pcap",)], "pcap_name string")
    listed = captures.list_captures(documents, names)
    assert rows(listed, "pcap_name", "origin_type", "iface") == [
        ("capture_20240101_000100.pcap", "timed_capture", "eth0"), ("other.pcap", "unknown", None), ("uploaded_20240101_000200_x.pcapng", "upload", None)]
    assert listed.first()["pcap_name"].startswith("capture_")
    flat = captures.lineage_of(documents)
    captures.append_lineage(flat, str(tmp_path / "l"))
    captures.append_lineage(flat, str(tmp_path / "l"))
    assert captures.read_lineage(spark, str(tmp_path / "l")).count() == 1


def test_a_change_rewrites_only_the_touched_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    first = spark.range(40).select(F.concat(F.lit("U"), F.col("id").cast("string")).alias("uid"), F.lit(0).alias("v"))
    assert tables.publish(first, root, "x", buckets=8, first=True) == 1
    keys = spark.createDataFrame([("U3",), ("U7",)], "uid string")
    new = keys.withColumn("v", F.lit(1))
    assert tables.change(root, "x", keys, lambda old: labels.upsert(old, new)) == 2
    now = tables.current(spark, root, "x")
    assert now.count() == 40 and rows(now.filter("v = 1")) == [("U3", 1), ("U7", 1)]
    assert len(list((tmp_path / "t" / "x" / "v2").glob("_bucket=*"))) <= 2
    assert rows(tables.current(spark, root, "x", version=1)) == rows(first)
    everyone = first.select("uid")
    assert tables.change(root, "x", keys, lambda old: labels.delete_uids(old, keys)) == 3
    assert tables.current(spark, root, "x").count() == 38
    tables.change(root, "x", everyone, lambda old: labels.delete_uids(old, everyone.filter("uid <> 'U1'")))
    assert rows(tables.current(spark, root, "x")) == [("U1", 0)]
    assert tables.change(root, "x", keys.limit(0), lambda old: old) == 4
    with pytest.raises(ValueError):
        tables.current(spark, root, "absent")


def test_analyses_of_a_hot_capture_come_in_bounded_parts(spark):
    flat = spark.range(500).select(F.when(F.col("id") < 480, "hot.pcap").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("pcap_name"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("analysis_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("origin_type", "string"), ("iface", "string"), ("duration_seconds", "int"), ("original_filename", "string"), ("created", "timestamp"))], F.lit(1).cast("bigint").alias("anomaly_count"), F.col("id").alias("total_connections"))
    out = captures.nested_documents(flat.unionByName(flat), largest=50).collect()
    hot = [r for r in out if r["pcap_name"] == "hot.pcap"]
    assert len(hot) > 9 and all(len(r["analysis_results"]) <= 50 for r in hot) and len({r["part"] for r in hot}) == len(hot)
    assert sorted(a["analysis_id"] for r in out for a in r["analysis_results"]) == sorted(f"a{i}" for i in range(500))
    assert all(r["part"] == 0 for r in out if r["pcap_name"] != "hot.pcap")


def test_second_writer_of_a_version_is_refused_and_begins_again(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(f"u{i}", 0) for i in range(40)], "uid string, n int")
    tables.publish(df, root, "t", buckets=4, first=True)
    keys = spark.createDataFrame([("u1",), ("u2",)], "uid string")
    calls = []

    def add(old):
        if not calls:
            # Another writer is first while this one works.
            calls.append(1)
            tables.change(root, "t", keys, lambda o: o.withColumn("n", F.when(F.col("uid").isin("u1", "u2"), F.col("n") + 10).otherwise(F.col("n"))))
        return old.withColumn("n", F.when(F.col("uid").isin("u1", "u2"), F.col("n") + 1).otherwise(F.col("n")))

    assert tables.change(root, "t", keys, add) == 3
    got = {r["uid"]: r["n"] for r in tables.current(spark, root, "t").collect()}
    assert len(got) == 40 and got["u1"] == got["u2"] == 11 and sum(got.values()) == 22
    with pytest.raises(tables.Conflict):
        tables._write(df, root, "t", 3, "uid", 4, [0, 1, 2, 3])
    assert {r["uid"]: r["n"] for r in tables.current(spark, root, "t", version=2).collect()}["u1"] == 10


def test_buckets_follow_the_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(f"u{i}", i) for i in range(45)], "uid string, n int")
    root = str(tmp_path)
    tables.publish(df.limit(15), root, "t", first=True)
    assert tables._pointers(spark, root, "t").first()["buckets"] == 2
    tables.publish(df, root, "t")
    assert tables._pointers(spark, root, "t").filter("version = 2").first()["buckets"] == 5
    assert tables.current(spark, root, "t").count() == 45 and tables.current(spark, root, "t", version=1).count() == 15
    assert tables.exists(spark, root, "t") and not tables.exists(spark, root, "other") and not tables.exists(spark, root + "/none", "t")


def test_only_the_named_scans_are_opened(spark, tmp_path):
    root = str(tmp_path / "results")
    df = spark.createDataFrame([(f"2024010{d}_000000", f"u{d}{i}", at(i), 0.1 * i, "normal") for d in range(1, 6) for i in range(3)], "scan_id string, uid string, timestamp timestamp, score double, prediction string")
    results.write_results(df, root)
    assert results.newest_folders(root, 2) == ["20240105_000000", "20240104_000000"] and len(results.newest_folders(root, 9, by="modified")) == 5
    out = results.read_scans(spark, root, results.newest_folders(root, 2))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [scan_id" in plan and "20240105_000000" in plan
    assert rows(out, "scan_id", "uid") == [(f"2024010{d}_000000", f"u{d}{i}") for d in (4, 5) for i in range(3)] and out.first()["timestamp"] is not None
    assert sorted({r["scan_id"] for r in reports.recent_scans(results.read_scans(spark, root, ["20240103_000000"]), scans=["20240103_000000"]).collect()}) == ["20240103_000000"]


def test_newest_scans_may_hold_none(spark):
    df = spark.createDataFrame([("20240101_000000", "anomaly"), (None, "normal"), (None, "anomaly")], "scan_id string, prediction string")
    assert reports.newest_scans(df, 5) == ["20240101_000000", None] and reports.newest_scans(df, 1) == ["20240101_000000"]
    assert {r["scan_id"]: r["connections"] for r in reports.recent_scans(df, 5).collect()} == {"20240101_000000": 1, None: 2}
