"""Joins of results with logs, captures, lineage and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from connlens.operators import flows, joins
from connlens.plans import fixtures as fx
from connlens.plans.registry import query


@query("""
SELECT p.*, coalesce(c.proto, 'not_found') AS proto, coalesce(c.service, 'undetected') AS service, coalesce(concat('', c.dest_port), '-') AS dest_port
FROM pred p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY line_no DESC) AS rn FROM conn_dup) c ON c.uid = p.uid AND c.rn = 1
""")
def enrich_last(spark, sf_dir):
    return joins.enrich_last(fx.pred(spark, sf_dir), fx.conn_dup(spark, sf_dir))


@query("SELECT p.*, c.proto FROM pred p LEFT JOIN conn_dup c ON c.uid = p.uid")
def enrich_fanout(spark, sf_dir):
    return joins.enrich_fanout(fx.pred(spark, sf_dir), fx.conn_dup(spark, sf_dir))


@query("""
SELECT p.scan_id, p.uid, p.score, p.prediction, coalesce(c.ts, p.timestamp) AS timestamp, c.source_ip, c.source_port, c.dest_ip, c.dest_port, c.proto,
  c.service, c.duration, c.orig_bytes, c.resp_bytes, c.orig_pkts, c.resp_pkts, c.history
FROM pred p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY line_no) AS rn FROM conn_dup) c ON c.uid = p.uid AND c.rn = 1
""")
def enrich_first(spark, sf_dir):
    return joins.enrich_first(fx.pred(spark, sf_dir), fx.conn_dup(spark, sf_dir))


@query("SELECT uid, scan_id, uid IN (SELECT uid FROM conn WHERE service = 'dns') AS has_extracted_pcap FROM pred")
def extraction_flag(spark, sf_dir):
    extracted = fx.conn(spark, sf_dir).filter("service = 'dns'")
    return joins.flag_present(fx.pred(spark, sf_dir), extracted).select("uid", "scan_id", "has_extracted_pcap")


@query("""
+facts AS (SELECT scan_id, max(ts) AS created, min(iface) AS iface, count(*) AS seconds FROM conn GROUP BY scan_id),
found AS (
  SELECT DISTINCT l.analysis_id AS scan_id, c.pcap_name, CASE WHEN c.pcap_name LIKE 'capture%' THEN 'timed_capture' ELSE 'upload' END AS origin_type,
    f.iface, f.seconds FROM lineage l JOIN capture c ON c.pcap_name = l.pcap_name JOIN facts f ON f.scan_id = c.scan_id)
SELECT s.scan_id, f.pcap_name, coalesce(f.origin_type, 'unknown') AS origin_type,
  CASE f.origin_type WHEN 'timed_capture' THEN concat('Captured on ', f.iface) WHEN 'upload' THEN concat('Uploaded: up_', s.scan_id) ELSE 'Unknown Source' END AS origin_description,
  CASE f.origin_type WHEN 'timed_capture' THEN concat('Network capture on interface ', f.iface, ' for ', f.seconds, ' seconds')
    WHEN 'upload' THEN concat('User uploaded file: up_', s.scan_id) ELSE 'Could not determine PCAP origin' END AS origin_details
FROM (SELECT DISTINCT scan_id FROM pred) s LEFT JOIN found f ON f.scan_id = s.scan_id
""")
def lineage_origin(spark, sf_dir):
    return joins.scan_origins(fx.pred(spark, sf_dir), fx.lineage(spark, sf_dir), documented_captures(spark, sf_dir))


def documented_captures(spark, sf_dir):
    facts = fx.conn(spark, sf_dir).groupBy("scan_id").agg(
        F.max("ts").alias("created"), F.min("iface").alias("iface"), F.count("*").cast("int").alias("duration_seconds")
    )
    name = F.col("pcap_name")
    origin = F.when(name.startswith("capture_"), "timed_capture").when(name.startswith("uploaded_"), "upload")
    return fx.capture(spark, sf_dir).join(facts, "scan_id").select(
        "pcap_name", "created", origin.alias("origin_type"), "iface", "duration_seconds", F.concat(F.lit("up_"), F.col("scan_id")).alias("original_filename")
    )


NEAREST = """
+cap AS (SELECT pcap_name, try_strptime(regexp_extract(pcap_name, '([0-9]{{8}}_[0-9]{{6}})', 1), '%Y%m%d_%H%M%S') AS at FROM capture),
cand AS (
  SELECT s.scan_id, c.pcap_name, CAST(abs(epoch(c.at) - epoch(strptime(s.scan_id, '%Y%m%d_%H%M%S'))) AS DOUBLE) AS seconds
  FROM (SELECT DISTINCT scan_id FROM pred) s JOIN cap c ON c.at IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seconds, pcap_name) AS rn FROM cand WHERE seconds {test})
SELECT s.scan_id, b.pcap_name, b.seconds FROM (SELECT DISTINCT scan_id FROM pred) s LEFT JOIN best b ON b.scan_id = s.scan_id AND b.rn = 1
"""


@query(NEAREST.format(test="<= 300"))
def nearest_capture_300(spark, sf_dir):
    return joins.nearest_capture(fx.pred(spark, sf_dir), fx.capture(spark, sf_dir))


@query(NEAREST.format(test="< 1800"))
def nearest_capture_1800(spark, sf_dir):
    return joins.nearest_capture(fx.pred(spark, sf_dir), fx.capture(spark, sf_dir), tolerance=1800, inclusive=False, exact=False)


@query("""
+ranked AS (
  SELECT s.scan_id, c.pcap_name,
    CASE WHEN contains(c.pcap_name, s.scan_id) THEN 1
      WHEN contains(c.pcap_name, split_part(s.scan_id, '_', 1)) AND contains(c.pcap_name, split_part(s.scan_id, '_', 2)) THEN 2
      WHEN c.pcap_name LIKE 'capture@_%' ESCAPE '@' AND contains(c.pcap_name, split_part(s.scan_id, '_', 1)) THEN 3 END AS rule
  FROM (SELECT DISTINCT scan_id FROM pred) s CROSS JOIN capture c),
best AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY rule, pcap_name) AS rn FROM ranked WHERE rule IS NOT NULL)
SELECT s.scan_id, b.pcap_name, b.rule FROM (SELECT DISTINCT scan_id FROM pred) s LEFT JOIN best b ON b.scan_id = s.scan_id AND b.rn = 1
""")
def loose_capture(spark, sf_dir):
    return joins.loose_capture(fx.pred(spark, sf_dir), fx.capture(spark, sf_dir))


@query("""
+want AS (SELECT DISTINCT source_ip, dest_ip, source_port, dest_port, proto FROM scored WHERE score < -0.5),
tcp AS (
  SELECT p.pkt_id FROM packet p JOIN want c ON p.proto = c.proto AND p.src = c.source_ip AND p.dst = c.dest_ip AND p.sport = c.source_port AND p.dport = c.dest_port WHERE c.proto IN ('tcp', 'udp')
  UNION SELECT p.pkt_id FROM packet p JOIN want c ON p.proto = c.proto AND p.src = c.dest_ip AND p.dst = c.source_ip AND p.sport = c.dest_port AND p.dport = c.source_port WHERE c.proto IN ('tcp', 'udp')
  UNION SELECT p.pkt_id FROM packet p JOIN want c ON p.proto = 'icmp' AND p.src = c.source_ip AND p.dst = c.dest_ip WHERE c.proto = 'icmp'
  UNION SELECT p.pkt_id FROM packet p JOIN want c ON p.proto = 'icmp' AND p.src = c.dest_ip AND p.dst = c.source_ip WHERE c.proto = 'icmp')
SELECT p.* FROM packet p JOIN tcp t ON t.pkt_id = p.pkt_id
""")
def flow_packets(spark, sf_dir):
    wanted = fx.scored(spark, sf_dir).filter("score < -0.5")
    return flows.flow_packets(fx.packet(spark, sf_dir), wanted).drop("flow_key")


@query("""
+k AS (
  SELECT ts, length, CASE WHEN proto = 'icmp' THEN concat('icmp/', least(src, dst), '|', greatest(src, dst))
    ELSE concat(proto, '/', least(concat(src, '#', sport), concat(dst, '#', dport)), '|', greatest(concat(src, '#', sport), concat(dst, '#', dport))) END AS key FROM packet),
t AS (SELECT key, count(*) AS n_packets, sum(length) AS n_bytes, min(ts) AS first_ts, max(ts) AS last_ts FROM k GROUP BY key)
SELECT c.uid, coalesce(t.n_packets, 0) AS n_packets, CAST(coalesce(t.n_bytes, 0) AS BIGINT) AS n_bytes, t.first_ts, t.last_ts
FROM conn c LEFT JOIN t ON t.key = CASE WHEN c.proto = 'icmp' THEN concat('icmp/', least(source_ip, dest_ip), '|', greatest(source_ip, dest_ip))
  ELSE concat(proto, '/', least(concat(source_ip, '#', source_port), concat(dest_ip, '#', dest_port)), '|', greatest(concat(source_ip, '#', source_port), concat(dest_ip, '#', dest_port))) END
""")
def flow_totals(spark, sf_dir):
    return flows.flow_totals(fx.packet(spark, sf_dir), fx.conn(spark, sf_dir))


@query("""
+pk AS (SELECT iface, ts, pkt_id, row_number() OVER (PARTITION BY iface ORDER BY ts, pkt_id) AS r FROM packet),
an AS (
  SELECT a.uid, a.iface, max(k.r) AS r FROM (SELECT uid, iface, ts FROM scored WHERE score < -0.5) a
  ASOF JOIN (SELECT iface, ts, max(r) AS r FROM pk GROUP BY iface, ts) k ON k.iface = a.iface AND a.ts >= k.ts GROUP BY a.uid, a.iface)
SELECT an.uid, an.iface, pk.pkt_id, pk.ts AS packet_ts, an.r - pk.r + 1 AS back
FROM an JOIN pk ON pk.iface = an.iface AND pk.r <= an.r AND pk.r > an.r - 500
""")
def anomaly_context(spark, sf_dir):
    return flows.anomaly_context(fx.packet(spark, sf_dir), fx.scored(spark, sf_dir).filter("score < -0.5"))


@query("""
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY iface ORDER BY ts DESC, pkt_id DESC) AS n FROM packet) p WHERE n <= 5000
""")
def newest_packets(spark, sf_dir):
    return flows.newest_packets(fx.packet(spark, sf_dir))
