"""Column lists, table layouts and other fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Feature order of the model vector.
CATEGORICAL = ["proto", "service", "history"]
NUMERIC = ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"]
FEATURES = CATEGORICAL + NUMERIC

# The 22 columns of a connection log without a header line.
LOG_COLUMNS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration",
    "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp", "missed_bytes", "history",
    "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", "tunnel_parents", "ip_proto",
]

# Texts read as null besides '-', as pandas does by default.
NULL_TEXTS = [
    "-", "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Log column -> (column of the ``conn`` frame, type). The first ten carry the analysis, the rest address the flow.
LOG_TYPES = {
    "ts": ("ts", "double"),
    "proto": ("proto", "string"),
    "service": ("service", "string"),
    "duration": ("duration", "double"),
    "orig_bytes": ("orig_bytes", "bigint"),
    "resp_bytes": ("resp_bytes", "bigint"),
    "orig_pkts": ("orig_pkts", "bigint"),
    "resp_pkts": ("resp_pkts", "bigint"),
    "history": ("history", "string"),
    "uid": ("uid", "string"),
    "id.orig_h": ("source_ip", "string"),
    "id.orig_p": ("source_port", "int"),
    "id.resp_h": ("dest_ip", "string"),
    "id.resp_p": ("dest_port", "int"),
}

RESULT = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("prediction", T.StringType()),
])
RESULT_WITH_TRUTH = T.StructType(RESULT.fields + [T.StructField("true_label", T.StringType())])

LABELLED = T.StructType([
    T.StructField(name, T.DoubleType() if name == "score" else T.StringType())
    for name in (
        "timestamp", "uid", "score", "attack_category", "attack_subcategory", "confidence", "source_ip",
        "dest_ip", "user_feedback", "training_source", "feature_vector", "suricata_rule_candidate",
    )
])
LABELLED_LEGACY = T.StructType([
    T.StructField(name, T.DoubleType() if name == "score" else T.StringType())
    for name in ("timestamp", "uid", "score", "original_label", "user_label", "feature_vector")
])

# Layout of a capture document.
CAPTURE_DOCUMENT = (
    "pcap_filename string, pcap_path string, origin_type string, timestamp string, "
    "metadata struct<interface: string, duration_seconds: int, capture_method: string, "
    "original_filename: string, file_size_bytes: bigint, upload_source: string>, "
    "analysis_results array<struct<analysis_dir: string, csv_path: string, anomaly_count: bigint, "
    "total_connections: bigint, analysis_timestamp: string, analysis_id: string>>"
)

# Columns of the training table.
TRAINING = (
    "uid string, timestamp timestamp, source_ip string, dest_ip string, source_port int, dest_port int, proto string, "
    "service string, duration double, orig_bytes bigint, resp_bytes bigint, orig_pkts bigint, resp_pkts bigint, "
    "history string, feature_vector array<double>, anomaly_score double, is_anomaly boolean, label_category string, "
    "label_subcategory string, confidence_level string, labeled_by string, labeled_at timestamp, training_source string, "
    "review_status string, notes string, has_extracted_pcap boolean, created_at timestamp, updated_at timestamp"
)

TRAINING_TYPES = dict(part.split(" ", 1) for part in TRAINING.split(", "))

# Displayed texts on where a capture came from, short and long, by whether a document tells and by the
# origin (None: any other). Braces name what is put in.
ORIGIN_TEXTS = [
    (True, "timed_capture", "Captured on {iface}", "Network capture on interface {iface} for {seconds} seconds"),
    (True, "upload", "Uploaded: {file}", "User uploaded file: {file}"),
    (True, None, "Source: {origin}", "PCAP from {origin}"),
    (False, "timed_capture", "Network Capture", "Timed network capture (metadata unavailable)"),
    (False, "upload", "File Upload", "Uploaded PCAP file (metadata unavailable)"),
    (False, "unknown", "Unknown Source", "Origin unknown"),
    (False, None, "Unknown Source", None),
]

# Record shapes handed to readers of the training table.
BROWSE_FIELDS = [
    "uid", "timestamp", "source_ip", "dest_ip", "source_port", "dest_port", "proto", "service", "duration",
    "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "history", "anomaly_score", "is_anomaly",
    "label_category", "label_subcategory", "confidence_level", "training_source", "review_status",
    "has_extracted_pcap",
]
EXPORT_FIELDS = [
    "uid", "timestamp", "source_ip", "dest_ip", "proto", "service", "anomaly_score", "is_anomaly",
    "label_category", "label_subcategory", "confidence_level", "training_source", "review_status",
]

# Confidence order and review states.
CONFIDENCE_ORDER = {"low": 0, "medium": 1, "high": 2}
REVIEW_STATES = ["pending", "reviewed", "needs_review", "verified"]

LABEL_DEFINITION = (
    "category string, subcategory string, description string, color_hex string, is_active boolean"
)

# Label definitions every new store starts with.
DEFAULT_LABELS = [
    ("reconnaissance", "port-scan", "Port scanning activity", "#FF6B6B"),
    ("reconnaissance", "host-discovery", "Network host discovery", "#FF8E8E"),
    ("reconnaissance", "service-enumeration", "Service enumeration attempts", "#FFB3B3"),
    ("exploitation", "brute-force-attack", "Brute force login attempts", "#4ECDC4"),
    ("exploitation", "buffer-overflow", "Buffer overflow exploitation", "#45B7B8"),
    ("exploitation", "privilege-escalation", "Privilege escalation attempts", "#26D0CE"),
    ("persistence", "backdoor", "Backdoor installation", "#FFE66D"),
    ("persistence", "lateral-movement", "Lateral network movement", "#FFD93D"),
    ("persistence", "data-exfiltration", "Data exfiltration activity", "#FFCC02"),
    ("denial-of-service", "ddos-attack", "Distributed denial of service", "#A8E6CF"),
    ("denial-of-service", "resource-exhaustion", "Resource exhaustion attacks", "#7FCDCD"),
    ("malware", "c2-communication", "Command and control communication", "#B19CD9"),
    ("malware", "malware-download", "Malware download activity", "#C7A2FF"),
    ("malware", "infected-host", "Infected host behavior", "#DDA0DD"),
    ("unknown", "unknown", "Uncategorized anomalous activity", "#95A5A6"),
    ("unknown", "suspicious", "Suspicious but unclassified activity", "#7F8C8D"),
    ("normal", "benign", "Normal network activity", "#2ECC71"),
    ("normal", "maintenance", "Maintenance activity", "#27AE60"),
]
