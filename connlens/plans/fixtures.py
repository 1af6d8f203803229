"""Connection logs, scores, captures and packets derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.operators.one_class import KernelModel, kernel_score, label
from connlens.operators.scaling import fit_scaler, scaled

# Two support vectors over (duration, orig_bytes).
SMALL_MODEL = KernelModel(((0.0, 0.0), (1.0, 1.0)), (0.8, 0.4), 0.5, 0.6)

# Two support vectors over all eight features.
FULL_MODEL = KernelModel(((0.0,) * 8, (0.5,) * 8), (0.8, 0.4), 0.125, 0.6)

PACKET_SLOTS = [1, 2, 3, 4]


# Layouts of the tables read here; naming them spares a look at the file before every query.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    event = F.col("event_type")
    hole = F.col("k") % 7 == 0
    service = F.element_at(F.array(*[F.lit(x) for x in (None, "http", "ssl", "dns", "ssh")]), F.col("k") % 5 + 1)
    port = F.element_at(F.array(*[F.lit(x) for x in (80, 443, 53, 22)]), F.col("k") % 4 + 1)
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").withColumn("k", k).select(
        F.concat(F.lit("C"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("uid"),
        F.col("event_id").alias("line_no"),
        ts.alias("ts"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("source_ip"),
        F.concat(F.lit("192.168.1."), F.col("k").cast("string")).alias("dest_ip"),
        (F.lit(1024) + F.col("event_id") % 60000).cast("int").alias("source_port"),
        port.alias("dest_port"),
        F.when(event.isin("view", "click"), "tcp").when(event == "error", "icmp").otherwise("udp").alias("proto"),
        service.alias("service"),
        F.when(~hole, F.col("value") / 10).alias("duration"),
        F.floor(F.col("value") * 100).cast("bigint").alias("orig_bytes"),
        F.when(~hole, F.floor(F.col("value") * 37).cast("bigint")).alias("resp_bytes"),
        (F.lit(1) + F.col("event_id") % 48).cast("bigint").alias("orig_pkts"),
        (F.col("event_id") % 40).cast("bigint").alias("resp_pkts"),
        F.when(event == "view", "ShADadFf").when(event == "click", "Dd").when(event == "purchase", "S")
        .when(event == "signup", "SR").otherwise("^hCadCf").alias("history"),
        F.concat(F.lit("eth"), (F.col("user_id") % 3).cast("string")).alias("iface"),
        F.concat(F.date_format(ts, "yyyyMMdd"), F.lit("_000000")).alias("scan_id"),
    )


def conn_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with a second, later line for every icmp connection."""
    base = conn(spark, sf_dir)
    second = base.filter(F.col("proto") == "icmp").withColumns({
        "line_no": F.col("line_no") + 100_000_000,
        "dest_port": F.col("dest_port") + 1,
        "proto": F.lit("sctp"),
        "service": F.lit("dup"),
    })
    return base.unionByName(second)


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows scored with SMALL_MODEL; missing numbers count as 0 after scaling."""
    base = conn(spark, sf_dir)
    scaler = fit_scaler(base, ["duration", "orig_bytes"])
    score = F.round(kernel_score(scaled(scaler, "post"), SMALL_MODEL), 6)
    out = base.select("scan_id", "uid", F.col("ts").alias("timestamp"), score.alias("score"))
    return out.withColumn("prediction", label("score"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections with their score, in one narrow plan."""
    base = conn(spark, sf_dir)
    scaler = fit_scaler(base, ["duration", "orig_bytes"])
    return base.withColumn("score", F.round(kernel_score(scaled(scaler, "post"), SMALL_MODEL), 6)).withColumn(
        "prediction", label("score")
    )


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled store: six classes (one rare), some rows without label or confidence, every review state."""
    n = F.col("line_no")
    rare, kind = n % 2000 == 7, n % 6
    categories = ["reconnaissance", "exploitation", "denial-of-service", "malware", "normal", None]
    subcategories = ["port-scan", "brute-force-attack", "ddos-attack", "c2-communication", "benign", None]

    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))

    rows = scored(spark, sf_dir)
    return rows.select(
        *[c for c in rows.columns if c not in ("score", "prediction")],
        F.col("score").alias("anomaly_score"),
        (F.col("score") < 0).alias("is_anomaly"),
        F.when(rare, "persistence").otherwise(pick(categories, kind)).alias("label_category"),
        F.when(rare, "backdoor").otherwise(pick(subcategories, kind)).alias("label_subcategory"),
        pick(["low", "medium", "high", None], n % 4).alias("confidence_level"),
        pick(["verified", "needs_review", "reviewed", "pending", "pending"], n % 5).alias("review_status"),
        pick(["analysis_import", "hybrid_pipeline", "manual"], n % 3).alias("training_source"),
    )


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``training`` in the layout of the stored table."""
    return training(spark, sf_dir).select(
        "uid", F.col("ts").alias("timestamp"), "source_ip", "dest_ip", "source_port", "dest_port", "proto", "service",
        "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "history",
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("duration", "orig_bytes", "orig_pkts", "resp_pkts")]).alias("feature_vector"),
        "anomaly_score", "is_anomaly", "label_category", "label_subcategory", "confidence_level",
        F.lit(None).cast("string").alias("labeled_by"), F.lit(None).cast("timestamp").alias("labeled_at"),
        "training_source", "review_status", F.lit(None).cast("string").alias("notes"),
        F.lit(False).alias("has_extracted_pcap"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture file per scan, in three naming patterns."""
    day = F.substring("scan_id", 1, 8)
    third = F.substring("scan_id", 7, 2).cast("int") % 3
    name = (
        F.when(third == 0, F.concat(F.lit("capture_"), day, F.lit("_000100.pcap")))
        .when(third == 1, F.concat(F.lit("uploaded_"), day, F.lit("_001500_x.pcap")))
        .otherwise(F.concat(F.lit("misc_"), day, F.lit(".pcap")))
    )
    return conn(spark, sf_dir).select("scan_id").distinct().select("scan_id", name.alias("pcap_name"))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis entries of the captures with a time in their name, each written three times."""
    entries = F.array(*[F.lit(i) for i in (1, 2, 3)])
    named = capture(spark, sf_dir).filter(~F.col("pcap_name").startswith("misc_"))
    return named.select("pcap_name", F.col("scan_id").alias("analysis_id"), F.explode(entries).alias("entry"))


def packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to four packets per connection, odd ones forward, even ones backward."""
    slots = F.slice(F.array(*[F.lit(j) for j in PACKET_SLOTS]), 1, (F.lit(1) + F.col("orig_pkts") % 4).cast("int"))
    forward = F.col("j") % 2 == 1
    return conn(spark, sf_dir).withColumn("j", F.explode(slots)).select(
        "iface", "ts", (F.col("line_no") * 10 + F.col("j")).alias("pkt_id"), "proto",
        F.when(forward, F.col("source_ip")).otherwise(F.col("dest_ip")).alias("src"),
        F.when(forward, F.col("source_port")).otherwise(F.col("dest_port")).alias("sport"),
        F.when(forward, F.col("dest_ip")).otherwise(F.col("source_ip")).alias("dst"),
        F.when(forward, F.col("dest_port")).otherwise(F.col("source_port")).alias("dport"),
        (F.lit(60) + (F.col("line_no") * 7 + F.col("j")) % 1400).alias("length"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with an independent truth: text length against the toxic flag."""
    score = F.round(F.lit(1) - F.col("n_chars") / F.lit(4000.0), 6)
    flags = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    sizes = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return flags.join(sizes, "doc_id").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("uid"),
        score.alias("score"),
        label(F.lit(1) - F.col("n_chars") / F.lit(4000.0)).alias("prediction"),
        F.when(F.col("toxic") == 1, "anomaly").otherwise("normal").alias("true_label"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feature vectors for the multi-class model."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("uid"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.concat(F.lit("class."), F.col("label").cast("string")).alias("class_name"),
        F.concat(F.lit("class-"), F.col("label").cast("string")).alias("attack_category"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("vec_id") % 3 + 1).cast("int")).alias("confidence"),
    )


def log_lines(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Connections (all by default) as tab-separated log lines of the 22-column layout, nulls as ``-``."""
    from connlens.schemas import LOG_COLUMNS

    source = {
        "ts": F.format_string("%.6f", F.unix_micros("ts") / F.lit(1e6)), "uid": F.col("uid"),
        "id.orig_h": F.col("source_ip"), "id.orig_p": F.col("source_port"), "id.resp_h": F.col("dest_ip"),
        "id.resp_p": F.col("dest_port"), "proto": F.col("proto"), "service": F.col("service"),
        "duration": F.col("duration"), "orig_bytes": F.col("orig_bytes"), "resp_bytes": F.col("resp_bytes"),
        "history": F.col("history"), "orig_pkts": F.col("orig_pkts"), "resp_pkts": F.col("resp_pkts"),
    }
    cells = [F.coalesce(source[c].cast("string"), F.lit("-")) if c in source else F.lit("-") for c in LOG_COLUMNS]
    return (conn(spark, sf_dir) if rows is None else rows).select("scan_id", "line_no", F.concat_ws("\t", *cells).alias("value"))

