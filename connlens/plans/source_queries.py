"""Readers and writers: each query writes data derived from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from connlens.functions.scalars import is_ipv6, iso_time, scan_id_of
from connlens.operators import joins, labels, reports
from connlens.plans import fixtures as fx
from connlens.plans.label_queries import NOW, STORE_FIELDS, labelled_log
from connlens.plans.registry import ORACLES, query
from connlens.schemas import LOG_COLUMNS
from connlens.session import scratch_path
from connlens.sources import captures, conn_log, labelled, log_source, results, tables


def written_log(spark, sf_dir):
    path = scratch_path(spark, "log")
    conn_log.write_conn_log(fx.log_lines(spark, sf_dir).select("scan_id", "value"), path)
    return path


@query("""
SELECT uid, ts, source_ip, source_port, dest_ip, dest_port, proto, service, duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts, history FROM conn
""")
def conn_log_roundtrip(spark, sf_dir):
    return conn_log.read_conn_log(spark, written_log(spark, sf_dir) + "/*", fields=LOG_COLUMNS)


@query("""
SELECT proto, coalesce(service, '-') AS service, count(*) AS n FROM conn GROUP BY 1, 2
""")
def raw_log_scan(spark, sf_dir):
    raw = conn_log.read_raw_log(spark, written_log(spark, sf_dir) + "/*", "pad")
    return raw.groupBy("proto", "service").agg(F.count("*").alias("n"))


def headed_log(rows, names, path):
    """One file per scan, its header line first. ``rows`` is (scan_id, line_no, value)."""
    head = rows.select("scan_id").distinct().select("scan_id", F.lit(-1).cast("bigint").alias("line_no"), F.lit("\t".join(["#fields", *names])).alias("value"))
    both = head.unionByName(rows.select("scan_id", "line_no", "value")).repartition("scan_id").sortWithinPartitions("scan_id", "line_no")
    both.select("scan_id", "value").write.partitionBy("scan_id").text(path)


@query("""
SELECT uid, ts, proto, service, CASE WHEN line_no % 2 = 0 THEN duration END AS duration, orig_bytes, resp_bytes FROM conn
""")
def log_headers(spark, sf_dir):
    """Files of two layouts under their own headers; the second has fewer columns in another order."""
    path = mixed_layouts(spark, sf_dir)
    return conn_log.read_conn_log(spark, path + "/*/*").select("uid", "ts", "proto", "service", "duration", "orig_bytes", "resp_bytes")


def repeated_log(spark, sf_dir):
    """Files in which some uids come twice: the second line later in the same file, or in a file of a later folder."""
    path = scratch_path(spark, "log")
    both = fx.log_lines(spark, sf_dir, fx.conn_dup(spark, sf_dir))
    later = (F.col("line_no") >= 100_000_000) & (F.col("line_no") % 20 == 0)
    headed_log(both.filter(~later), LOG_COLUMNS, f"{path}/log=1")
    headed_log(both.filter(later), LOG_COLUMNS, f"{path}/log=2")
    return path


@query("""
SELECT p.*, coalesce(c.proto, 'not_found') AS proto, coalesce(c.service, 'undetected') AS service, coalesce(concat('', c.dest_port), '-') AS dest_port
FROM pred p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY line_no DESC) AS rn FROM conn_dup) c ON c.uid = p.uid AND c.rn = 1
""")
def enrich_last_of_files(spark, sf_dir):
    """The last line of each uid, the order of the lines known from the files alone."""
    return joins.enrich_last(fx.pred(spark, sf_dir), conn_log.read_conn_log(spark, repeated_log(spark, sf_dir) + "/*/*", numbered=True))


@query("""
SELECT p.scan_id, p.uid, p.score, p.prediction, coalesce(c.ts, p.timestamp) AS timestamp, c.source_ip, c.source_port, c.dest_ip, c.dest_port, c.proto,
  c.service, c.duration, c.orig_bytes, c.resp_bytes, c.orig_pkts, c.resp_pkts, c.history
FROM pred p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY line_no) AS rn FROM conn_dup) c ON c.uid = p.uid AND c.rn = 1
""")
def enrich_first_of_files(spark, sf_dir):
    """The first line of each uid, from the data source: one pass over the files, small splits."""
    return joins.enrich_first(fx.pred(spark, sf_dir), log_source.scan_log(spark, repeated_log(spark, sf_dir), split_bytes=1 << 20))


@query("SELECT count(*) AS n, min(line_no) AS first, max(line_no) AS last, count(DISTINCT line_no) AS different FROM (SELECT row_number() OVER (ORDER BY line_no) AS line_no FROM conn_dup) d")
def line_numbers(spark, sf_dir):
    """Numbers of the data lines run on over all files: header lines have numbers of their own, one a file."""
    numbered = conn_log.read_conn_log(spark, repeated_log(spark, sf_dir) + "/*/*", numbered=True, with_file=True)
    files = numbered.groupBy("file").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("n"), F.count_distinct("line_no").alias("different"))
    # A file's lines are consecutive: what is missing before its first line are the headers of the files up to it.
    whole = files.filter("last - first + 1 = n")
    return whole.agg(F.sum("n").alias("n"), (F.min("first") - 1).alias("first"), (F.max("last") - F.count("*")).alias("last"), F.sum("different").alias("different"))


def mixed_layouts(spark, sf_dir):
    path = scratch_path(spark, "log")
    even = F.col("line_no") % 2 == 0
    headed_log(fx.log_lines(spark, sf_dir).filter(even), LOG_COLUMNS, f"{path}/layout=whole")
    dash = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("resp_bytes", "service", "proto", "uid", "orig_bytes")]
    seconds = F.format_string("%.6f", F.unix_micros("ts") / F.lit(1e6))
    few = fx.conn(spark, sf_dir).filter(~even).select("scan_id", "line_no", F.concat_ws("\t", *dash, seconds).alias("value"))
    headed_log(few, ["resp_bytes", "service", "proto", "uid", "orig_bytes", "ts"], f"{path}/layout=few")
    return path


@query("SELECT uid, ts, proto, service, CASE WHEN line_no % 2 = 0 THEN duration END AS duration, orig_bytes, resp_bytes FROM conn")
def log_source_layouts(spark, sf_dir):
    """Two layouts in one pass: each file is opened with its own header."""
    columns = ["uid", "ts", "proto", "service", "duration", "orig_bytes", "resp_bytes"]
    return log_source.scan_log(spark, mixed_layouts(spark, sf_dir), columns=columns).select(*columns)


@query("SELECT uid, proto, coalesce(service, '-') AS service, '-' AS ip_proto FROM conn WHERE line_no % 3 <> 0")
def raw_log_skip(spark, sf_dir):
    """Short lines are dropped, long ones cut."""
    third, value = F.col("line_no") % 3, F.col("value")
    uneven = F.when(third == 0, F.substring_index(value, "\t", 10)).when(third == 1, F.concat(value, F.lit("\tmore"))).otherwise(value)
    path = scratch_path(spark, "log")
    conn_log.write_conn_log(fx.log_lines(spark, sf_dir).select("scan_id", uneven.alias("value")), path)
    return conn_log.read_raw_log(spark, path + "/*", "skip").select("uid", "proto", "service", "ip_proto")


@query("""
SELECT uid, score, score < 0 AS is_anomaly, 'renamed' AS layout FROM pred
UNION ALL SELECT uid, CAST(0 AS DOUBLE), false, 'bare' FROM pred
""")
def fallback_columns(spark, sf_dir):
    rows = fx.pred(spark, sf_dir)
    layouts = {"renamed": rows.withColumnRenamed("score", "anomaly_score"), "bare": rows.select("uid")}
    parts = [results.with_fallbacks(df).select("uid", "score", "is_anomaly", F.lit(name).alias("layout")) for name, df in layouts.items()]
    return parts[0].unionByName(parts[1])


@query("""
SELECT uid, contains(source_ip, ':') AS short_is_v6, contains(concat('::ffff:', source_ip), ':') AS long_is_v6,
  strftime(ts, '%Y%m%d_%H%M%S') AS scan, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM conn
""")
def address_and_time_texts(spark, sf_dir):
    long = F.concat(F.lit("::ffff:"), F.col("source_ip"))
    return fx.conn(spark, sf_dir).select(
        "uid", is_ipv6("source_ip").alias("short_is_v6"), is_ipv6(long).alias("long_is_v6"), scan_id_of("ts").alias("scan"), iso_time("ts", "Z").alias("iso")
    )


@query("SELECT scan_id, uid, timestamp, score, prediction FROM pred")
def result_corpus(spark, sf_dir):
    path = scratch_path(spark, "results")
    results.write_results(fx.pred(spark, sf_dir), path)
    return results.read_corpus(spark, path).select("scan_id", "uid", "timestamp", "score", "prediction")


@query("SELECT max(scan_id) AS scan_id, count(*) AS n FROM pred WHERE scan_id = (SELECT max(scan_id) FROM pred)")
def latest_scan(spark, sf_dir):
    path = scratch_path(spark, "results")
    results.write_results(fx.pred(spark, sf_dir), path)
    newest = results.newest_folders(path)[0]
    rows = results.read_results(spark, f"{path}/scan_id={newest}")
    return rows.agg(F.count("*").alias("n")).select(F.lit(newest).alias("scan_id"), "n")


@query("""
SELECT scan_id, connections, anomalies, anomaly_rate,
  upper(strftime(strptime(scan_id, '%Y%m%d_%H%M%S'), '%d %b %Y %H:%M')) AS scan_time,
  CASE WHEN anomaly_rate > 50 THEN 'high' WHEN anomaly_rate > 20 THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT scan_id, count(*) AS connections, count(*) FILTER (WHERE score < 0) AS anomalies,
    round(100 * CAST(count(*) FILTER (WHERE score < 0) AS DOUBLE) / count(*), 2) AS anomaly_rate
  FROM pred GROUP BY scan_id ORDER BY scan_id DESC LIMIT 10) r
WHERE anomalies > 0
""")
def folder_severity(spark, sf_dir):
    """Severity of the newest scans of a corpus: the folders' names choose them, other folders are not opened."""
    path = scratch_path(spark, "results")
    results.write_results(fx.pred(spark, sf_dir), path)
    newest = results.newest_folders(path, 10)
    return reports.threat_timeline(reports.recent_scans(results.read_scans(spark, path, newest), scans=newest))


@query("SELECT uid, source_ip, anomaly_score, is_anomaly, label_category, confidence_level, review_status, 4 AS width FROM training")
def export_json(spark, sf_dir):
    path = scratch_path(spark, "export")
    tables.export_training(fx.store(spark, sf_dir), path, "json")
    back = spark.read.schema(
        "uid string, source_ip string, anomaly_score double, is_anomaly boolean, label_category string, confidence_level string, "
        "review_status string, feature_vector array<double>"
    ).json(path)
    return back.select("*", F.size("feature_vector").alias("width")).drop("feature_vector")


@query("SELECT uid, source_ip, anomaly_score, is_anomaly, label_category, confidence_level, review_status FROM training")
def export_csv(spark, sf_dir):
    path = scratch_path(spark, "export")
    tables.export_training(fx.store(spark, sf_dir), path, "csv")
    types = {"anomaly_score": "double", "is_anomaly": "boolean"}
    from connlens.schemas import EXPORT_FIELDS

    back = spark.read.option("header", True).schema(", ".join(f"{c} {types.get(c, 'string')}" for c in EXPORT_FIELDS)).csv(path)
    return back.select("uid", "source_ip", "anomaly_score", "is_anomaly", "label_category", "confidence_level", "review_status")


@query(f"""
SELECT uid, abs(anomaly_score) AS score, 'port-scan' AS attack_category, source_ip, TIMESTAMP '{NOW}' AS timestamp, true AS has_vector
FROM training WHERE anomaly_score < 0 AND label_category = 'malware'
""")
def labelled_csv(spark, sf_dir):
    path = scratch_path(spark, "labelled")
    rows = labelled_log(spark, sf_dir).filter("feature_vector IS NOT NULL")
    labelled.write_labelled(rows, path)
    back = labelled.read_labelled(spark, path, drop_bad=False)
    return back.select("uid", "score", "attack_category", "source_ip", "timestamp", F.col("feature_vector").isNotNull().alias("has_vector"))


@query("""
+facts AS (SELECT scan_id, min(iface) AS iface, count(*) AS n FROM conn GROUP BY scan_id)
SELECT c.pcap_name, CASE WHEN c.pcap_name LIKE 'capture%' THEN 'timed_capture' WHEN c.pcap_name LIKE 'uploaded%' THEN 'upload' ELSE 'unknown' END AS origin_type,
  CASE WHEN c.pcap_name LIKE 'capture%' THEN f.iface END AS iface, CASE WHEN c.pcap_name LIKE 'misc%' THEN 0 ELSE 1 END AS analyses,
  CASE WHEN c.pcap_name NOT LIKE 'misc%' THEN f.n END AS total_connections
FROM capture c JOIN facts f ON f.scan_id = c.scan_id
""")
def capture_metadata(spark, sf_dir):
    facts = fx.conn(spark, sf_dir).groupBy("scan_id").agg(F.min("iface").alias("iface"), F.count("*").alias("n"))
    name = F.col("pcap_name")
    known = fx.capture(spark, sf_dir).join(facts, "scan_id").filter(~name.startswith("misc_"))
    timed = name.startswith("capture_")
    entry = F.struct(F.col("scan_id").alias("analysis_id"), F.lit(0).cast("bigint").alias("anomaly_count"), F.col("n").alias("total_connections"))
    documents = known.select(
        F.split(name, "[.]")[0].alias("folder"), name.alias("pcap_filename"), F.when(timed, "timed_capture").otherwise("upload").alias("origin_type"),
        F.lit("2024-06-01T00:00:00.000000Z").alias("timestamp"),
        F.struct(F.when(timed, F.col("iface")).alias("interface"), F.when(~timed, name).alias("original_filename")).alias("metadata"),
        F.array(entry, entry).alias("analysis_results"),
    )
    path = scratch_path(spark, "captures")
    documents.write.partitionBy("folder").json(path)
    read = captures.read_documents(spark, path + "/*")
    flat = captures.lineage_of(read)
    lineage_path = scratch_path(spark, "lineage")
    captures.append_lineage(flat, lineage_path)
    captures.append_lineage(flat, lineage_path)
    nested = captures.nested_documents(captures.read_lineage(spark, lineage_path))
    listed = captures.list_captures(read, fx.capture(spark, sf_dir)).select("pcap_name", "origin_type", "iface")
    counts = nested.select("pcap_name", F.size("analysis_results").alias("analyses"), F.col("analysis_results")[0]["total_connections"].alias("total_connections"))
    return listed.join(counts, "pcap_name", "left").fillna(0, ["analyses"])


@query()
def table_versions(spark, sf_dir):
    """Two published versions of the store; the second holds the upsert."""
    root = scratch_path(spark, "store")
    tables.publish(fx.store(spark, sf_dir), root, "training", buckets=8, first=True)
    base = fx.store(spark, sf_dir)
    renewed = base.filter("anomaly_score < -0.4").withColumns({
        "service": F.lit("renewed"), "label_category": F.lit("malware"), "label_subcategory": F.lit("infected-host"),
        "confidence_level": F.lit("high"), "training_source": F.lit("manual"), "review_status": F.lit("needs_review"),
    })
    new = renewed.unionByName(base.filter("proto = 'icmp'").withColumn("uid", F.concat(F.lit("N"), F.col("uid"))))
    tables.change(root, "training", new.select("uid"), lambda old: labels.upsert(old, new))
    return tables.current(spark, root, "training").select(*STORE_FIELDS.split(", "))


ORACLES["table_versions"] = ORACLES["upsert"]
