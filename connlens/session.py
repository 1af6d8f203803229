"""Session settings used by the tests, the benchmark and ad-hoc runs."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    # The driver serves the archive to the workers, so its own folder is enough.
    archive = os.path.join(tempfile.mkdtemp(prefix="connlens-"), "connlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shipped(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The same query, after the package is sent to the workers of its session."""

    @functools.wraps(run)
    def query(spark: SparkSession, *args) -> DataFrame:
        ship_package(spark)
        return run(spark, *args)

    return query


def build_session(app: str = "connlens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("CONNLENS_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A local master may fall back to a new temporary folder; a cluster without
    the setting is refused, because a machine-local path would not survive the
    loss of an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="connlens-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages restart from written files, not from the whole plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
