"""Places of rows in an order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from connlens.llm.common import quoted, saved

#: Sums of earlier runs that are broadcast; there is one for each task and group.
MOST_RUNS = 1_000_000
_ROW = (1 << 33) - 1


def placed(rows: DataFrame, order: Sequence, within: str | None = None) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in ``order`` among the rows of their group, and ``size``, the rows of the group.

    Rows are range-partitioned on (group, order) and written once, sorted; the
    counts of the runs become the places at which they start. Rows alike in
    group and order are dealt to several tasks; their places are arbitrary.
    ``order`` holds columns; null groups are one group.
    """
    keys = ([quoted(within).asc_nulls_first()] if within else []) + list(order)
    dealt = rows.withColumn("_place", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartitionByRange(parts, *keys, F.col("_place").asc()).sortWithinPartitions(*keys).drop("_place")
    kept = saved(ordered.withColumn("_row", F.monotonically_increasing_id()), "placed").withColumn("_run", F.shiftright("_row", 33))
    group = [quoted(within).alias("_group")] if within else [F.lit(0).alias("_group")]
    counts = kept.groupBy(*group, F.col("_run").alias("_r")).agg(F.count("*").alias("_n"), F.min(F.col("_row").bitwiseAND(_ROW)).alias("_first"))
    earlier = W.partitionBy("_group").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    runs = counts.select("_group", "_r", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_n").over(W.partitionBy("_group")).alias("size"))
    # A few numbers for each task and group.
    runs = F.broadcast(runs) if runs.limit(MOST_RUNS + 1).count() <= MOST_RUNS else runs
    same = F.col("_run") == F.col("_r")
    same = same & quoted(within).eqNullSafe(F.col("_group")) if within else same
    found = kept.join(runs, same).withColumn("pos", F.col("_base") + F.col("_row").bitwiseAND(_ROW))
    return found.drop("_row", "_run", "_group", "_r", "_base")
