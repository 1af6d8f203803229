"""Versioned parquet tables in buckets of the key.

A change writes new folders for the buckets it touches and then names them in
pointer rows, which take effect by one rename. A job never overwrites the files
it reads, a reader sees whole buckets, and labelling a few rows rewrites a few
buckets, not the table. A version is named once: of two writers that start from
the same one, the second is refused, and ``change`` then begins again from what
the first has left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.operators.filters import export_record

POINTER = "name string, version int, bucket int, buckets int, key string, path string"
#: Rows of a bucket when a table is published; a change of few rows writes few of them anew.
BUCKET_ROWS = 250_000
MOST_BUCKETS = 4096


class Conflict(RuntimeError):
    """Another writer has named this version of the table."""


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _pointers(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(POINTER).option("recursiveFileLookup", True).parquet(f"{root}/pointers").filter(F.col("name") == name)


def exists(spark: SparkSession, root: str, name: str) -> bool:
    try:
        return _pointers(spark, root, name).limit(1).count() > 0
    except AnalysisException:
        # No table has been published under the root yet.
        return False


def _move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder unless the target is there already."""
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    paths[1].getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(paths[1].getParent())
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(paths[0].toUri(), spark._jsc.hadoopConfiguration()).rename(paths[0], paths[1], options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def _write(df: DataFrame, root: str, name: str, version: int, key: str, buckets: int, touched: list[int]) -> int:
    spark = df.sparkSession
    # Writers of one version write apart until one of them has named it.
    path = f"{root}/{name}/v{version}-{uuid.uuid4().hex}"
    df.withColumn("_bucket", bucket_of(key, buckets)).hint("rebalance", "_bucket").write.mode("error").partitionBy("_bucket").parquet(path)
    # An empty frame leaves a folder without buckets.
    written = spark.read.schema("_bucket int").option("recursiveFileLookup", False).parquet(path).select("_bucket").distinct()
    filled = {r["_bucket"] for r in written.collect() if r["_bucket"] is not None}
    rows = [(name, version, b, buckets, key, f"{path}/_bucket={b}" if b in filled else None) for b in touched]
    staged = f"{root}/staged/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("error").parquet(staged)
    if not _move_new(spark, staged, f"{root}/pointers/{name}-v{version}"):
        raise Conflict(f"version {version} of table {name!r} has been written by another job")
    return version


def publish(df: DataFrame, root: str, name: str, key: str = "uid", buckets: int | None = None, first: bool = False) -> int:
    """Write a whole new version of a table, in as many buckets as its rows ask for. ``first`` starts the table."""
    spark = df.sparkSession
    last = None
    if not first:
        last = _pointers(spark, root, name).agg(F.max("version").alias("v")).first()["v"]
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(1, -(-df.count() // BUCKET_ROWS)))
    return _write(df, root, name, (last or 0) + 1, key, buckets, list(range(buckets)))


def current(spark: SparkSession, root: str, name: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The table as of its last or the given version, or some of its buckets."""
    rows = _pointers(spark, root, name)
    if version is not None:
        rows = rows.filter(F.col("version") <= version)
    # A whole new version may have another number of buckets: older pointers are those of the same number since then.
    listed = rows.collect()
    if not listed:
        raise ValueError(f"table {name!r} has no such version under {root}")
    number = max(listed, key=lambda r: r["version"])["buckets"]
    since = max((r["version"] for r in listed if r["buckets"] != number), default=0)
    newest: dict[int, tuple] = {}
    for r in listed:
        if r["version"] > since:
            newest[r["bucket"]] = max(newest.get(r["bucket"], (0, None)), (r["version"], r["path"]), key=lambda p: p[0])
    every = [path for _, path in newest.values() if path]
    if not every:
        raise ValueError(f"table {name!r} holds no rows")
    chosen = [path for bucket, (_, path) in newest.items() if path and (buckets is None or bucket in buckets)]
    if chosen:
        return spark.read.parquet(*chosen)
    return spark.read.parquet(every[0]).limit(0)


def change(root: str, name: str, keys: DataFrame, apply: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
    """Rewrite the buckets that hold ``keys``: ``apply`` maps their old rows to their new rows.

    The rows ``apply`` adds must have keys from ``keys``. When another writer
    was first, the change is made again on what that one has left.
    """
    spark = keys.sparkSession
    for left in range(tries - 1, -1, -1):
        last = _pointers(spark, root, name).agg(F.max_by(F.struct("version", "buckets", "key"), "version").alias("p")).first()["p"]
        key, buckets = last["key"], last["buckets"]
        touched = sorted(r[0] for r in keys.select(bucket_of(key, buckets)).distinct().collect())
        if not touched:
            return last["version"]
        try:
            return _write(apply(current(spark, root, name, version=last["version"], buckets=set(touched))), root, name, last["version"] + 1, key, buckets, touched)
        except Conflict:
            if not left:
                raise
    raise ValueError("a change needs at least one try")


def export_training(df: DataFrame, path: str, file_format: str = "csv", mode: str = "error") -> None:
    """All rows, newest first: 13 columns as CSV, 14 (with the vector) as JSON."""
    if file_format not in ("csv", "json"):
        raise ValueError("export format must be 'csv' or 'json'")
    rows = export_record(df, vector=file_format == "json").orderBy(F.col("timestamp").desc(), "uid")
    if file_format == "csv":
        rows.write.mode(mode).option("header", True).csv(path)
    else:
        rows.write.mode(mode).json(path)
