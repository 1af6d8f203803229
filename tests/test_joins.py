import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from connlens.operators import filters, flows, joins, reports
from helpers import at, conn, rows

PRED = "scan_id string, uid string, timestamp timestamp, score double, prediction string"


def pred(spark, uids):
    return spark.createDataFrame([("20240101_000000", u, at(0), -0.1, "anomaly") for u in uids], PRED)


LINES = [("A", 1, "tcp", "http"), ("A", 5, "udp", None), ("A", 3, "icmp", "dns"), ("B", 2, "tcp", "-")]


@pytest.mark.parametrize("parts", [1, 7])
def test_three_rules_for_repeated_uids(spark, parts):
    log = conn(spark, LINES).repartition(parts)
    results = pred(spark, ["A", "B", "Z"])
    assert rows(joins.enrich_last(results, log), "uid", "proto", "service", "dest_port") == [
        ("A", "udp", "undetected", "5"), ("B", "tcp", "undetected", "2"), ("Z", "not_found", "undetected", "-")]
    assert rows(joins.enrich_fanout(results, log), "uid", "proto") == [("A", "icmp"), ("A", "tcp"), ("A", "udp"), ("B", "tcp"), ("Z", None)]
    first = joins.enrich_first(results, log)
    assert rows(first, "uid", "proto", "source_ip", "timestamp") == [
        ("A", "tcp", "10.0.0.1", at(1)), ("B", "tcp", "10.0.0.2", at(2)), ("Z", "unknown", "0.0.0.0", at(0))]
    assert rows(joins.enrich_fanout(results, None), "proto") == [("unknown",)] * 3


def test_one_uid_holding_most_rows(spark):
    results = pred(spark, ["A"] * 400 + [f"U{i}" for i in range(100)]).repartition(4)
    out = joins.enrich_last(results, conn(spark, LINES))
    assert out.filter("uid = 'A' AND proto = 'udp'").count() == 400 and out.count() == 500


def test_unmatched_import_keeps_its_own_columns(spark):
    results = pred(spark, ["Z"]).withColumn("proto", F.lit("gre")).withColumn("source_ip", F.lit("1.2.3.4"))
    assert rows(joins.enrich_first(results, conn(spark, LINES)), "proto", "source_ip", "dest_ip") == [("gre", "1.2.3.4", "0.0.0.0")]


def test_newest_capture_of_an_analysis_wins(spark):
    analyses = spark.createDataFrame([("old.pcap", "S1"), ("capture_1.pcap", "S1"), ("capture_1.pcap", "S1")], "pcap_name string, analysis_id string")
    captures = spark.createDataFrame([("old.pcap", at(1), None), ("capture_1.pcap", at(2), "timed_capture")], "pcap_name string, created timestamp, origin_type string")
    scans = spark.createDataFrame([("S1",), ("S2",)], "scan_id string")
    assert rows(joins.scan_origins(scans, analyses, captures), "scan_id", "pcap_name", "origin_description") == [
        ("S1", "capture_1.pcap", "Captured on unknown"), ("S2", None, "Unknown Source")]


def stamp(seconds):
    return at(seconds).strftime("%Y%m%d_%H%M%S")


def nearest_by_hand(scan, names, tolerance, inclusive, exact):
    if exact:
        hits = sorted(n for t, n in names if stamp(t) == stamp(scan))
        if hits:
            return hits[0]
    near = sorted((abs(t - scan), n) for t, n in names if abs(t - scan) < tolerance or (inclusive and abs(t - scan) == tolerance))
    return near[0][1] if near else None


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.integers(0, 4000), min_size=1, max_size=12), st.lists(st.integers(0, 4000), min_size=1, max_size=12),
    st.sampled_from([1, 60, 300, 1800]), st.booleans(), st.booleans(),
)
def test_nearest_equals_brute_force(spark, scans, times, tolerance, inclusive, exact):
    names = [(t, f"{'capture' if i % 2 else 'uploaded'}_{stamp(t)}{'' if i % 2 else f'_{i}'}.pcap") for i, t in enumerate(times)]
    left = spark.createDataFrame([(stamp(s),) for s in scans], "scan_id string")
    right = spark.createDataFrame([(n,) for _, n in names] + [("misc.pcap",)], "pcap_name string")
    got = dict(rows(joins.nearest_capture(left, right, tolerance, inclusive, exact), "scan_id", "pcap_name"))
    assert got == {stamp(s): nearest_by_hand(s, names, tolerance, inclusive, exact) for s in scans}


def test_tolerance_boundary(spark):
    left = spark.createDataFrame([(stamp(1000),)], "scan_id string")
    right = spark.createDataFrame([(f"capture_{stamp(1300)}.pcap",)], "pcap_name string")
    assert joins.nearest_capture(left, right, 300, True).first()["seconds"] == 300.0
    assert joins.nearest_capture(left, right, 300, False).first()["pcap_name"] is None


def test_loose_match_rules(spark):
    scans = spark.createDataFrame([("20240101_101010",), ("20240102_101010",), ("20240103_101010",), ("20240104_101010",)], "scan_id string")
    names = ["x_20240101_101010.pcap", "20240102-101010.pcap", "capture_20240103_000000.pcap", "other_20240104.pcap"]
    out = joins.loose_capture(scans, spark.createDataFrame([(n,) for n in names], "pcap_name string"))
    assert rows(out, "scan_id", "pcap_name", "rule") == [
        ("20240101_101010", names[0], 1), ("20240102_101010", names[1], 2), ("20240103_101010", names[2], 3), ("20240104_101010", None, None)]


PACKET = "iface string, ts timestamp, pkt_id bigint, proto string, src string, sport int, dst string, dport int, length bigint"


def matches(p, c):
    (proto, a, ap, b, bp), (kind, src, sport, dst, dport) = c, p
    both = (src, dst) in ((a, b), (b, a))
    if proto in ("tcp", "udp"):
        return kind == proto and ((src, sport, dst, dport) in ((a, ap, b, bp), (b, bp, a, ap)))
    if proto in ("icmp", "sctp"):
        return kind == proto and both
    return both


def test_flow_packets_equal_brute_force_in_every_protocol_class(spark):
    draw = random.Random(7)
    ends = ["10.0.0.1", "10.0.0.2", "fe80::1"]
    packets = [(draw.choice(["tcp", "udp", "icmp", "sctp", "gre"]), draw.choice(ends), draw.choice([1, 2]), draw.choice(ends), draw.choice([1, 2])) for _ in range(200)]
    conns = [(draw.choice(["tcp", "udp", "icmp", "sctp", "unknown_transport", "gre"]), draw.choice(ends), draw.choice([1, 2]), draw.choice(ends), draw.choice([1, 2])) for _ in range(12)]
    pdf = spark.createDataFrame([("e", at(i), i, p[0], p[1], p[2], p[3], p[4], 10) for i, p in enumerate(packets)], PACKET)
    cdf = spark.createDataFrame([(f"C{i}", c[0], c[1], c[2], c[3], c[4]) for i, c in enumerate(conns)], "uid string, proto string, source_ip string, source_port int, dest_ip string, dest_port int")
    totals = dict(rows(flows.flow_totals(pdf, cdf), "uid", "n_packets"))
    assert totals == {f"C{i}": sum(matches(p, c) for p in packets) for i, c in enumerate(conns)}
    found = {r[0] for r in flows.flow_packets(pdf, cdf).select("pkt_id").collect()}
    assert found == {i for i, p in enumerate(packets) if any(matches(p, c) for c in conns)}
    repeated = cdf
    for _ in range(3):
        repeated = repeated.union(cdf)
    assert rows(flows.flow_packets(pdf, repeated)) == rows(flows.flow_packets(pdf, cdf))


@pytest.mark.parametrize("limit", [0, 50_000])
def test_context_equals_brute_force_with_one_busy_interface(spark, monkeypatch, limit):
    monkeypatch.setattr(flows, "running_totals", lambda *a, **k: __import__("connlens.operators.ordered", fromlist=["x"]).running_totals(*a, **k, one_task_rows=limit))
    draw = random.Random(1)
    packets = [("eth0" if i % 4 else "eth1", draw.randrange(60), i) for i in range(300)]
    anomalies = [("eth0" if i % 3 else "eth1", 30 if i < 20 else draw.randrange(-5, 70), f"A{i}") for i in range(30)]
    pdf = spark.createDataFrame([(n, at(t), i) for n, t, i in packets], "iface string, ts timestamp, pkt_id bigint").repartition(5)
    adf = spark.createDataFrame([(n, at(t), u) for n, t, u in anomalies], "iface string, ts timestamp, uid string")
    got = rows(flows.anomaly_context(pdf, adf, last=25), "uid", "pkt_id", "back")
    want = []
    for n, t, u in anomalies:
        before = sorted((pt, i) for pn, pt, i in packets if pn == n and pt <= t)[-25:]
        want += [(u, i, back) for back, (_, i) in enumerate(reversed(before), 1)]
    assert got == sorted(want, key=str)


def test_scan_of_uid_and_lookup(spark):
    corpus = spark.createDataFrame([("A", "2"), ("A", "1"), ("B", "3")], "uid string, scan_id string")
    assert rows(filters.scan_of_uid(corpus)) == [("A", "1"), ("B", "3")]
    assert rows(filters.scan_of_uid(corpus, corpus.filter("uid = 'A'"))) == [("A", "1")]
    found = filters.lookup_uids(conn(spark, [("A", 2, "UDP", None), ("A", 1, "TCP", None)]), corpus)
    assert rows(found) == [("A", "10.0.0.1", 1001, "192.168.0.1", 1, "tcp")]


def test_reports_on_an_empty_corpus(spark):
    empty = pred(spark, ["x"]).limit(0)
    assert reports.corpus_totals(empty).first()["anomaly_rate"] == 0.0
    assert reports.threat_timeline(reports.recent_scans(empty)).count() == 0
    assert reports.score_histogram(empty).count() == 0 and reports.score_density(empty).count() == 0


def test_recent_scans_name_odd_folders(spark):
    results = pred(spark, ["a", "b"]).withColumn("scan_id", F.when(F.col("uid") == "a", "20250605_102300").otherwise("my_scan"))
    assert rows(reports.recent_scans(results), "scan_id", "scan_time") == [("20250605_102300", "05 JUN 2025 10:23"), ("my_scan", "my scan")]


def test_histogram_keeps_every_row_and_empty_bins(spark):
    results = spark.createDataFrame([(-1.0,), (-1.0,), (0.5,), (1.0,)], "score double")
    out = reports.score_histogram(results, 4)
    assert [(r["n"], r["anomalies"]) for r in out.orderBy("bin").collect()] == [(2, 2), (0, 0), (0, 0), (2, 0)]


def test_newest_packets_are_ranked_in_lanes_first(spark):
    from connlens.operators.flows import newest_packets

    df = spark.range(3000).select(F.lit("eth0").alias("iface"), (F.col("id") % 700).cast("timestamp").alias("ts"), F.col("id").alias("pkt_id"))
    want = sorted(((i % 700, i) for i in range(3000)), reverse=True)[:50]
    got = newest_packets(df, 50, lanes=7)
    assert sorted((r["ts"].timestamp(), r["pkt_id"]) for r in got.select(F.col("ts"), "pkt_id").collect()) == sorted((float(t), i) for t, i in want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
