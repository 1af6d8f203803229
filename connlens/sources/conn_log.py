"""Tab-separated connection logs with a ``#fields`` header."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from connlens.functions.scalars import epoch_to_timestamp
from connlens.schemas import LOG_COLUMNS, LOG_TYPES, NULL_TEXTS
from connlens.session import cut_lineage

HEADER = "#fields"
#: Splits of a log, a path and three numbers each, up to which their first line numbers are broadcast.
MOST_SPLITS = 100_000
ANALYSIS_COLUMNS = list(LOG_TYPES)[:10]

log = logging.getLogger(__name__)


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Data lines with their file; lines starting with ``#`` and blank lines are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))


def header_layouts(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """(column names, files) per distinct header.

    The driver receives one path per file, as much as the file listing holds already.
    """
    heads = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.col("value").startswith(HEADER))
    first = heads.groupBy("file").agg(F.min("value").alias("value"))
    groups: dict[str, list[str]] = {}
    for row in first.toLocalIterator():
        groups.setdefault(row["value"], []).append(row["file"])
    return [(text.strip().split("\t")[1:], sorted(files)) for text, files in sorted(groups.items())]


def typed(source: str, text: Column, null_texts: Sequence[str] = NULL_TEXTS) -> Column:
    """A log column from its text."""
    target, dtype = LOG_TYPES[source]
    text = F.when(~text.isin(list(null_texts)), text)
    if source == "ts":
        return epoch_to_timestamp(text).alias(target)
    if dtype in ("bigint", "int"):
        # A count written as 12.0 is still a count.
        return text.try_cast("double").cast(dtype).alias(target)
    return (text if dtype == "string" else text.try_cast(dtype)).alias(target)


def _typed(cells: Column, names: Sequence[str], null_texts: Sequence[str]) -> list[Column]:
    return [typed(source, F.get(cells, F.lit(list(names).index(source))), null_texts) for source in LOG_TYPES if source in names]


def parse_lines(lines: DataFrame, names: Sequence[str], carry: Sequence[str] = (), null_texts: Sequence[str] = NULL_TEXTS) -> DataFrame:
    """Typed connection columns from raw lines; only the named columns that exist."""
    cells = lines.select(*carry, F.split("value", "\t").alias("_cells"))
    return cells.select(*carry, *_typed(F.col("_cells"), names, null_texts))


def numbered_lines(spark: SparkSession, groups: Sequence[str | Sequence[str]]) -> list[DataFrame]:
    """The data lines of each group of paths with ``line_no``, their place from 1 among all lines of all files.

    Files follow each other in the order of their paths. A split's lines are
    counted first, and the prefix sums of those counts (one row for each split)
    give each split its first number. The counting scan and the reading scan
    deal splits alike; a task that holds another split than counted fails.
    """
    # Comments are lines, too: they are left out after the numbers are given.
    every = [spark.read.text(g).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id")) for g in groups]
    counted = None
    for i, lines in enumerate(every):
        sizes = lines.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).withColumn("_group", F.lit(i))
        counted = sizes if counted is None else counted.unionByName(sizes)
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    bases = cut_lineage(counted.select("file", "block", "_group", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    small = bases.limit(MOST_SPLITS + 1).count() <= MOST_SPLITS
    out = []
    for i, lines in enumerate(every):
        own = bases.filter(F.col("_group") == i).drop("_group")
        joined = lines.join(F.broadcast(own) if small else own, ["file", "block"])
        place = F.col("_id") - F.col("_first")
        # Identifiers are the partition's number and the row's place in it.
        sound = F.shiftright("_id", 33) == F.shiftright("_first", 33)
        number = F.when(sound & (place >= 0), F.col("_base") + place + 1).otherwise(F.raise_error(F.lit("the splits of the log were dealt otherwise when they were counted")).cast("bigint"))
        numbered = joined.select("value", "file", number.alias("line_no"))
        out.append(numbered.filter(~F.col("value").startswith("#") & (F.trim("value") != "")))
    return out


def read_conn_log(spark: SparkSession, path: str | Sequence[str], fields: Sequence[str] | None = None, with_file: bool = False, numbered: bool = False) -> DataFrame:
    """Connection log(s) as typed columns, absent columns left out.

    Column names come from each file's own header, so files of different
    layouts may be mixed. Passing ``fields`` skips the scan for headers.
    ``numbered`` adds ``line_no``, by which first and last lines are told.
    """
    carry = [*(["file"] if with_file else []), *(["line_no"] if numbered else [])]
    layouts = [(list(fields), path)] if fields is not None else header_layouts(spark, path)
    if not layouts:
        raise ValueError(f"no {HEADER} line found in {path}")
    lines = numbered_lines(spark, [files for _, files in layouts]) if numbered else [read_lines(spark, files) for _, files in layouts]
    out = None
    for (names, _), rows in zip(layouts, lines, strict=True):
        absent = [c for c in ANALYSIS_COLUMNS if c not in names]
        if absent and fields is None:
            log.warning("log columns absent: %s", absent)
        part = parse_lines(rows, names, carry)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_raw_log(spark: SparkSession, path: str | Sequence[str], mode: str = "pad", fields: Sequence[str] | None = None, with_file: bool = False) -> DataFrame:
    """All columns as text, ``-`` kept.

    ``pad`` fills short rows with ``-`` and cuts long ones; ``skip`` drops short
    rows. Without a header the 22-column layout is taken.
    """
    if mode not in ("pad", "skip"):
        raise ValueError("mode must be 'pad' or 'skip'")
    layouts = [(list(fields), path)] if fields is not None else header_layouts(spark, path) or [(LOG_COLUMNS, path)]
    carry = ["file"] if with_file else []
    out = None
    for names, files in layouts:
        cells = read_lines(spark, files).select(*carry, F.split("value", "\t").alias("_cells"))
        if mode == "skip":
            cells = cells.filter(F.size("_cells") >= len(names))
        part = cells.select(*carry, *[F.coalesce(F.get("_cells", F.lit(i)), F.lit("-")).alias(n) for i, n in enumerate(names)])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_conn_log(lines: DataFrame, path: str, names: Sequence[str] = LOG_COLUMNS, partition: str | None = "scan_id") -> None:
    """Write ready-made lines as header-free text, one folder per scan; read them back with ``fields``."""
    if partition:
        lines.hint("rebalance", partition).write.mode("error").partitionBy(partition).text(path)
    else:
        lines.write.mode("error").text(path)
