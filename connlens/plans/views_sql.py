"""The views of ``fixtures`` as SQL, for the checks against another engine."""

VIEWS = """
conn AS (
  SELECT concat('C', lpad(concat('', event_id), 8, '0')) AS uid, event_id AS line_no, ts,
    concat('10.0.0.', user_id) AS source_ip, concat('192.168.1.', k) AS dest_ip,
    CAST(1024 + event_id % 60000 AS INT) AS source_port,
    CASE k % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 ELSE 22 END AS dest_port,
    CASE WHEN event_type IN ('view', 'click') THEN 'tcp' WHEN event_type = 'error' THEN 'icmp' ELSE 'udp' END AS proto,
    CASE k % 5 WHEN 1 THEN 'http' WHEN 2 THEN 'ssl' WHEN 3 THEN 'dns' WHEN 4 THEN 'ssh' END AS service,
    CASE WHEN k % 7 = 0 THEN NULL ELSE value / 10 END AS duration,
    CAST(floor(value * 100) AS BIGINT) AS orig_bytes,
    CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(floor(value * 37) AS BIGINT) END AS resp_bytes,
    CAST(1 + event_id % 48 AS BIGINT) AS orig_pkts, CAST(event_id % 40 AS BIGINT) AS resp_pkts,
    CASE event_type WHEN 'view' THEN 'ShADadFf' WHEN 'click' THEN 'Dd' WHEN 'purchase' THEN 'S' WHEN 'signup' THEN 'SR' ELSE '^hCadCf' END AS history,
    concat('eth', user_id % 3) AS iface,
    concat(strftime(ts, '%Y%m%d'), '_000000') AS scan_id
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e),
conn_dup AS (
  SELECT * FROM conn
  UNION ALL
  SELECT uid, line_no + 100000000 AS line_no, ts, source_ip, dest_ip, source_port, dest_port + 1 AS dest_port, 'sctp' AS proto, 'dup' AS service,
    duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts, history, iface, scan_id
  FROM conn WHERE proto = 'icmp'),
stats AS (
  SELECT avg(duration) AS md, stddev_pop(duration) AS sd,
    avg(CAST(orig_bytes AS DOUBLE)) AS mo, stddev_pop(CAST(orig_bytes AS DOUBLE)) AS so FROM conn),
scored AS (
  SELECT z.* EXCLUDE (zd, zo),
    round(CAST(0.8 AS DOUBLE) * exp(CAST(-0.5 AS DOUBLE) * (zd * zd + zo * zo))
      + CAST(0.4 AS DOUBLE) * exp(CAST(-0.5 AS DOUBLE) * ((zd - 1) * (zd - 1) + (zo - 1) * (zo - 1))) - CAST(0.6 AS DOUBLE), 6) AS score
  FROM (SELECT conn.*, coalesce((duration - md) / sd, 0) AS zd, (orig_bytes - mo) / so AS zo FROM conn CROSS JOIN stats) z),
pred AS (
  SELECT scan_id, uid, ts AS timestamp, score, CASE WHEN score < 0 THEN 'anomaly' ELSE 'normal' END AS prediction FROM scored),
training AS (
  SELECT c.* EXCLUDE (score), c.score AS anomaly_score, c.score < 0 AS is_anomaly,
    CASE WHEN line_no % 2000 = 7 THEN 'persistence' WHEN line_no % 6 = 0 THEN 'reconnaissance' WHEN line_no % 6 = 1 THEN 'exploitation'
      WHEN line_no % 6 = 2 THEN 'denial-of-service' WHEN line_no % 6 = 3 THEN 'malware' WHEN line_no % 6 = 4 THEN 'normal' END AS label_category,
    CASE WHEN line_no % 2000 = 7 THEN 'backdoor' WHEN line_no % 6 = 0 THEN 'port-scan' WHEN line_no % 6 = 1 THEN 'brute-force-attack'
      WHEN line_no % 6 = 2 THEN 'ddos-attack' WHEN line_no % 6 = 3 THEN 'c2-communication' WHEN line_no % 6 = 4 THEN 'benign' END AS label_subcategory,
    CASE line_no % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS confidence_level,
    CASE line_no % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'reviewed' ELSE 'pending' END AS review_status,
    CASE line_no % 3 WHEN 0 THEN 'analysis_import' WHEN 1 THEN 'hybrid_pipeline' ELSE 'manual' END AS training_source
  FROM scored c),
capture AS (
  SELECT scan_id, CASE CAST(substr(scan_id, 7, 2) AS INT) % 3
      WHEN 0 THEN concat('capture_', substr(scan_id, 1, 8), '_000100.pcap')
      WHEN 1 THEN concat('uploaded_', substr(scan_id, 1, 8), '_001500_x.pcap')
      ELSE concat('misc_', substr(scan_id, 1, 8), '.pcap') END AS pcap_name
  FROM (SELECT DISTINCT scan_id FROM conn) d),
lineage AS (
  SELECT pcap_name, scan_id AS analysis_id, n AS entry
  FROM capture CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) t
  WHERE pcap_name NOT LIKE 'misc@_%' ESCAPE '@'),
packet AS (
  SELECT iface, ts, line_no * 10 + j AS pkt_id, proto,
    CASE WHEN j % 2 = 1 THEN source_ip ELSE dest_ip END AS src, CASE WHEN j % 2 = 1 THEN source_port ELSE dest_port END AS sport,
    CASE WHEN j % 2 = 1 THEN dest_ip ELSE source_ip END AS dst, CASE WHEN j % 2 = 1 THEN dest_port ELSE source_port END AS dport,
    60 + (line_no * 7 + j) % 1400 AS length
  FROM conn CROSS JOIN (SELECT 1 AS j UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) t WHERE j <= 1 + orig_pkts % 4),
truth AS (
  SELECT concat('D', l.doc_id) AS uid, round(1 - n_chars / CAST(4000 AS DOUBLE), 6) AS score,
    CASE WHEN 1 - n_chars / CAST(4000 AS DOUBLE) < 0 THEN 'anomaly' ELSE 'normal' END AS prediction,
    CASE WHEN toxic = 1 THEN 'anomaly' ELSE 'normal' END AS true_label
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
enc AS (
  SELECT 'proto' AS col, value, row_number() OVER (ORDER BY f) - 1 AS id FROM (SELECT coalesce(proto, 'unknown') AS value, min(line_no) AS f FROM conn GROUP BY 1) a
  UNION ALL
  SELECT 'service', value, row_number() OVER (ORDER BY f) - 1 FROM (SELECT coalesce(service, 'unknown') AS value, min(line_no) AS f FROM conn GROUP BY 1) b
  UNION ALL
  SELECT 'history', value, row_number() OVER (ORDER BY f) - 1 FROM (SELECT coalesce(history, 'unknown') AS value, min(line_no) AS f FROM conn GROUP BY 1) c),
feat AS (
  SELECT c.uid, c.line_no, c.ts, c.scan_id, p.id AS f0, s.id AS f1, h.id AS f2, duration AS f3, orig_bytes AS f4, resp_bytes AS f5, orig_pkts AS f6, resp_pkts AS f7
  FROM conn c JOIN enc p ON p.col = 'proto' AND p.value = coalesce(c.proto, 'unknown')
    JOIN enc s ON s.col = 'service' AND s.value = coalesce(c.service, 'unknown')
    JOIN enc h ON h.col = 'history' AND h.value = coalesce(c.history, 'unknown')),
stats8 AS (
  SELECT avg(CAST(f0 AS DOUBLE)) AS m0, stddev_pop(CAST(f0 AS DOUBLE)) AS s0, avg(CAST(f1 AS DOUBLE)) AS m1, stddev_pop(CAST(f1 AS DOUBLE)) AS s1,
    avg(CAST(f2 AS DOUBLE)) AS m2, stddev_pop(CAST(f2 AS DOUBLE)) AS s2, avg(CAST(f3 AS DOUBLE)) AS m3, stddev_pop(CAST(f3 AS DOUBLE)) AS s3,
    avg(CAST(f4 AS DOUBLE)) AS m4, stddev_pop(CAST(f4 AS DOUBLE)) AS s4, avg(CAST(f5 AS DOUBLE)) AS m5, stddev_pop(CAST(f5 AS DOUBLE)) AS s5,
    avg(CAST(f6 AS DOUBLE)) AS m6, stddev_pop(CAST(f6 AS DOUBLE)) AS s6, avg(CAST(f7 AS DOUBLE)) AS m7, stddev_pop(CAST(f7 AS DOUBLE)) AS s7 FROM feat),
zpre AS (
  SELECT uid, line_no, ts, scan_id, (f0 - m0) / s0 AS z0, (f1 - m1) / s1 AS z1, (f2 - m2) / s2 AS z2, (coalesce(f3, 0) - m3) / s3 AS z3,
    (coalesce(f4, 0) - m4) / s4 AS z4, (coalesce(f5, 0) - m5) / s5 AS z5, (coalesce(f6, 0) - m6) / s6 AS z6, (coalesce(f7, 0) - m7) / s7 AS z7
  FROM feat CROSS JOIN stats8),
full_scored AS (
  SELECT uid, line_no, ts, scan_id,
    round(CAST(0.8 AS DOUBLE) * exp(CAST(-0.125 AS DOUBLE) * (z0*z0 + z1*z1 + z2*z2 + z3*z3 + z4*z4 + z5*z5 + z6*z6 + z7*z7))
      + CAST(0.4 AS DOUBLE) * exp(CAST(-0.125 AS DOUBLE) * (power(z0 - 0.5, 2) + power(z1 - 0.5, 2) + power(z2 - 0.5, 2) + power(z3 - 0.5, 2)
        + power(z4 - 0.5, 2) + power(z5 - 0.5, 2) + power(z6 - 0.5, 2) + power(z7 - 0.5, 2))) - CAST(0.6 AS DOUBLE), 6) AS score
  FROM zpre)"""
