"""Joins of results, logs, capture lists and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from connlens.functions.scalars import FILE_TIME, file_time, origin_of_name, origin_text, scan_time
from connlens.operators.spread import sized_join, spread_join
from connlens.schemas import LOG_TYPES

DETAIL = [name for name, _ in LOG_TYPES.values() if name != "uid"]


def one_line_per_uid(log: DataFrame, columns: list[str], rule: str, order: str = "line_no") -> DataFrame:
    """First or last log line of each uid, combined map-side so that a repeated uid costs one buffer."""
    pick = {"first": F.min_by, "last": F.max_by}[rule]
    chosen = log.groupBy("uid").agg(pick(F.struct(*columns), F.col(order)).alias("_line"))
    return chosen.select("uid", *[F.col(f"_line.{c}").alias(c) for c in columns])


def enrich_last(results: DataFrame, log: DataFrame) -> DataFrame:
    """Protocol, service and port of the LAST log line of each uid, with the report's defaults."""
    lines = one_line_per_uid(log, ["proto", "service", "dest_port"], "last").withColumn("_hit", F.lit(True))
    joined = spread_join(results, lines, "uid")
    return joined.select(
        *results.columns,
        F.when(F.col("_hit"), F.coalesce("proto", F.lit("-"))).otherwise("not_found").alias("proto"),
        F.when(F.col("service").isNull() | (F.col("service") == "-"), "undetected").otherwise(F.col("service")).alias("service"),
        F.coalesce(F.col("dest_port").cast("string"), F.lit("-")).alias("dest_port"),
    )


def enrich_fanout(results: DataFrame, log: DataFrame | None) -> DataFrame:
    """Protocol of EVERY log line of the uid: repeated uids multiply the rows on purpose."""
    if log is None:
        return results.withColumn("proto", F.lit("unknown"))
    return spread_join(results, log.select("uid", "proto"), "uid")


def enrich_first(results: DataFrame, log: DataFrame, scan_start: str | Column | None = None) -> DataFrame:
    """Details of the FIRST log line of each uid; rows without a line keep their own columns or the defaults.

    A missing time falls back to the result's own time.
    """
    lines = one_line_per_uid(log, DETAIL, "first")
    renamed = lines.select("uid", *[F.col(c).alias(f"_l_{c}") for c in DETAIL], F.lit(True).alias("_hit"))
    joined = spread_join(results, renamed, "uid")
    own_time = F.col("timestamp") if scan_start is None else scan_start

    def fallback(c: str) -> Column:
        return F.col(c) if c in results.columns else F.lit(None)

    chosen = [F.coalesce(F.when(F.col("_hit"), F.col("_l_ts")), own_time).alias("timestamp")]
    defaults = {"source_ip": "0.0.0.0", "dest_ip": "0.0.0.0", "proto": "unknown"}
    for c in DETAIL:
        if c == "ts":
            continue
        value = F.when(F.col("_hit"), F.col(f"_l_{c}")).otherwise(fallback(c))
        chosen.append((F.coalesce(value, F.lit(defaults[c])) if c in defaults else value).alias(c))
    kept = [c for c in results.columns if c not in DETAIL and c != "timestamp"]
    return joined.select(*kept, *chosen)


def flag_present(df: DataFrame, uids: DataFrame, flag: str = "has_extracted_pcap") -> DataFrame:
    """True where the uid is in the list."""
    marks = uids.select("uid", F.lit(True).alias("_in"))
    joined = sized_join(df, marks, "uid", distinct=True)
    return joined.withColumn(flag, F.coalesce("_in", F.lit(False))).drop("_in")


def scan_lineage(analyses: DataFrame, captures: DataFrame) -> DataFrame:
    """The newest capture of each analysis id.

    An analysis may have been recorded several times for one capture, so the
    pairs are made distinct first. ``captures`` is ``(pcap_name, created, ...)``.
    """
    pairs = analyses.select("pcap_name", F.col("analysis_id").alias("scan_id")).distinct()
    columns = [c for c in captures.columns if c != "scan_id"]
    joined = spread_join(pairs, captures.select(*columns).dropDuplicates(["pcap_name"]), "pcap_name", "inner")
    latest = joined.groupBy("scan_id").agg(
        F.max_by(F.struct(*columns), F.struct(F.coalesce("created", F.lit("1970-01-01").cast("timestamp")), "pcap_name")).alias("_c")
    )
    return latest.select("scan_id", *[F.col(f"_c.{c}") for c in columns])


def scan_origins(scans: DataFrame, analyses: DataFrame, captures: DataFrame) -> DataFrame:
    """Origin type and texts per scan; scans without lineage are of unknown origin."""
    found = scan_lineage(analyses, captures)

    def given(name: str, dtype: str) -> Column:
        return F.col(name) if name in captures.columns else F.lit(None).cast(dtype)

    documented = given("origin_type", "string").isNotNull()
    origin = F.coalesce(given("origin_type", "string"), origin_of_name("pcap_name"))
    short, full = origin_text(origin, given("iface", "string"), given("duration_seconds", "int"), given("original_filename", "string"), documented)
    texts = found.select(
        "scan_id", "pcap_name", origin.alias("origin_type"), short.alias("origin_description"), full.alias("origin_details")
    )
    joined = scans.select("scan_id").distinct().join(texts, "scan_id", "left")
    return joined.fillna({
        "origin_type": "unknown", "origin_description": "Unknown Source", "origin_details": "Could not determine PCAP origin",
    })


def nearest_capture(scans: DataFrame, captures: DataFrame, tolerance: int = 300, inclusive: bool = True, exact: bool = True) -> DataFrame:
    """Capture whose file-name time is closest to the scan's time, within ``tolerance`` seconds.

    With ``exact`` a file whose name holds the scan id wins outright. Ties keep
    the first name. Times in names have a resolution of one second, so both
    sides are reduced to distinct seconds; a time cell of ``tolerance`` seconds
    then holds at most ``tolerance`` of them, and each scan looks at the last
    capture before and the first one after it.
    """
    when = F.unix_seconds(scan_time("scan_id")) if "scan_time" not in scans.columns else F.unix_seconds("scan_time")
    wanted = scans.select("scan_id", when.alias("_at")).distinct()
    names = captures.select("pcap_name", F.unix_seconds(file_time("pcap_name")).alias("_at"))
    points = names.filter(F.col("_at").isNotNull()).groupBy("_at").agg(F.min("pcap_name").alias("pcap_name"))

    cell = F.floor(F.col("_at") / F.lit(tolerance))
    around = F.array(*[cell + F.lit(i) for i in (-1, 0, 1)])
    offered = points.select(F.explode(around).alias("_cell"), "_at", F.struct("_at", "pcap_name").alias("_c"), F.lit(False).alias("_ask"))
    asked = wanted.filter(F.col("_at").isNotNull()).select("_at").distinct().select(
        cell.alias("_cell"), "_at", F.lit(None).cast(offered.schema["_c"].dataType).alias("_c"), F.lit(True).alias("_ask")
    )
    both = offered.unionByName(asked)
    before = W.partitionBy("_cell").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("_cell").orderBy("_at").rangeBetween(W.currentRow, W.unboundedFollowing)
    seen = both.select(
        "_at", "_ask", F.max("_c").over(before).alias("_b"), F.min("_c").over(after).alias("_a")
    ).filter("_ask")
    options = F.array_compact(F.array(
        *[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._at") - F.col("_at")).alias("diff"), F.col(f"{c}.pcap_name").alias("pcap_name"))) for c in ("_b", "_a")]
    ))
    best = seen.select("_at", F.array_min(options).alias("_best"))
    near = F.col("_best.diff") <= tolerance if inclusive else F.col("_best.diff") < tolerance
    best = best.filter(near).select("_at", F.col("_best.pcap_name").alias("_near"), F.col("_best.diff").alias("_diff"))

    out = wanted.join(best, "_at", "left")
    if exact:
        named = _name_keys(captures).groupBy("scan_id").agg(F.min("pcap_name").alias("_exact"))
        out = out.join(named, "scan_id", "left")
        out = out.withColumn("pcap_name", F.coalesce("_exact", "_near"))
        diff = F.when(F.col("_exact").isNull(), F.col("_diff"))
    else:
        out = out.withColumn("pcap_name", F.col("_near"))
        diff = F.col("_diff")
    return out.select("scan_id", "pcap_name", diff.cast("double").alias("seconds"))


def _name_keys(captures: DataFrame) -> DataFrame:
    """(scan_id, pcap_name) for every time written in a file name."""
    return captures.select("pcap_name", F.explode(F.regexp_extract_all("pcap_name", F.lit(FILE_TIME))).alias("scan_id"))


def loose_capture(scans: DataFrame, captures: DataFrame) -> DataFrame:
    """First of: name holds the scan id; name holds its date and its time; ``capture_`` file of the same date.

    Each rule is an equi-join on a key read from the name, with one name kept per key.
    """
    wanted = scans.select("scan_id").distinct().select(
        "scan_id", F.split("scan_id", "_", 2)[0].alias("_day"), F.get(F.split("scan_id", "_", 2), F.lit(1)).alias("_time")
    )
    whole = _name_keys(captures).groupBy("scan_id").agg(F.min("pcap_name").alias("_whole"))
    days = captures.select("pcap_name", F.explode(F.array_distinct(F.regexp_extract_all("pcap_name", F.lit(r"(\d{8})")))).alias("_day"))
    parts = days.withColumn("_time", F.explode(F.array_distinct(F.regexp_extract_all("pcap_name", F.lit(r"(?<!\d)(\d{6})(?!\d)")))))
    split = parts.groupBy("_day", "_time").agg(F.min("pcap_name").alias("_split"))
    daily = days.filter(F.col("pcap_name").startswith("capture_")).groupBy("_day").agg(F.min("pcap_name").alias("_daily"))
    out = wanted.join(whole, "scan_id", "left").join(split, ["_day", "_time"], "left").join(daily, "_day", "left")
    rule = F.when(F.col("_whole").isNotNull(), 1).when(F.col("_split").isNotNull(), 2).when(F.col("_daily").isNotNull(), 3)
    return out.select("scan_id", F.coalesce("_whole", "_split", "_daily").alias("pcap_name"), rule.alias("rule"))
