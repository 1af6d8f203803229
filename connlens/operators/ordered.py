"""Running sums and exact percentiles without a single-task sort of the data."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from connlens.functions.scalars import missing
from connlens.operators.spread import pin_small
from connlens.session import cut_lineage

# Up to this many rows one sorted task is cheaper than the two-level sum.
ONE_TASK_ROWS = 50_000


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, str | Column],
    group: Sequence[str] = (),
    descending: bool = False,
    one_task_rows: int = ONE_TASK_ROWS,
    expect_small: bool = False,
) -> DataFrame:
    """Inclusive running sum of each expression in ``totals`` along ``order`` inside ``group``.

    ``order`` must be unique within a group. Rows are range-partitioned on
    (group, order), so a group holding most of the table is spread over many
    tasks; run numbers are frozen by a checkpoint, each run is summed on its
    own and the sums of the earlier runs of the group are added.

    ``expect_small`` first asks for at most PINNED_ROWS rows: when that is all
    of them, one sort of a local table replaces the distributed steps.
    """
    values = {name: F.col(e) if isinstance(e, str) else e for name, e in totals.items()}
    staged = df.select("*", *[v.alias(f"_v_{name}") for name, v in values.items()])
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    one_task = W.partitionBy(*group).orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    plain = [f"_v_{name}" for name in values]

    def in_one_task(rows: DataFrame) -> DataFrame:
        return rows.select("*", *[F.sum(f"_v_{n}").over(one_task).alias(n) for n in values]).drop("_run", *plain)

    if expect_small:
        pinned = pin_small(staged)
        if pinned is not None:
            return pin_small(in_one_task(pinned))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged.repartitionByRange(parts, *[F.col(c).asc() for c in group], *keys)
    frozen = cut_lineage(ranged.withColumn("_run", F.spark_partition_id()))
    if frozen.count() <= one_task_rows:
        return in_one_task(frozen)

    per_run = frozen.groupBy(*group, "_run").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    earlier = W.partitionBy(*group).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_run.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col("_run").alias("_r"),
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values],
    )
    local = W.partitionBy(*group, "_run").orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    same = F.col("_run") == F.col("_r")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    within = frozen.join(offsets, same)
    out = within.select("*", *[(F.sum(f"_v_{n}").over(local) + F.col(f"_o_{n}")).alias(n) for n in values])
    return out.drop("_run", "_r", *plain, *[f"_o_{n}" for n in values], *[f"_g_{c}" for c in group])


def exact_percentile(df: DataFrame, name: str, share: float, accuracy: int = 10_000, keep: int = 10_000) -> float | None:
    """Linearly interpolated percentile of a numeric column.

    A bracket that holds the wanted ranks is narrowed until it has at most
    ``keep`` distinct values; their counts then reach the driver. The sketch
    that proposes a narrower bracket always has the same size. The column alone
    is persisted, so its expression is computed once.
    """
    values = df.select(F.col(name).cast("double").alias("x")).filter(~missing("x")).persist(StorageLevel.MEMORY_AND_DISK)
    low, high = -math.inf, math.inf
    try:
        n = values.count()
        if not n:
            return None
        position = share * (n - 1)
        while True:
            inside = F.when(F.col("x") >= low, F.col("x"))
            counts = values.filter(F.col("x") <= high).groupBy(inside.alias("x")).agg(F.count("*").alias("n")).limit(keep + 2).collect()
            if len(counts) <= keep + 1:
                return _interpolate(counts, position)
            low, high = _narrower(values, low, high, math.floor(position), math.ceil(position), accuracy)
    finally:
        values.unpersist()


def _narrower(values: DataFrame, low: float, high: float, first: int, last: int, accuracy: int) -> tuple[float, float]:
    """A bracket inside [low, high] that still holds the ranks ``first`` to ``last``.

    A sketch of the rows in the bracket proposes its ends, a count confirms
    each. Where ties at both ends leave it as it is, the range is halved.
    """
    x, margin = F.col("x"), 2.0 / accuracy
    held = x.between(low, high)
    row = values.agg(F.count_if(x < low).alias("below"), F.count_if(held).alias("n")).first()
    around = [max(0.0, (first - row["below"]) / row["n"] - margin), min(1.0, (last - row["below"]) / row["n"] + margin)]
    a, b = values.filter(held).agg(F.percentile_approx("x", around, accuracy).alias("p")).first()["p"]
    row = values.agg(F.count_if(x < a).alias("below"), F.count_if(x <= b).alias("reached")).first()
    found = (a if row["below"] <= first else low, b if row["reached"] > last else high)
    if found != (low, high):
        return found
    middle = max(low, -1e308) / 2 + min(high, 1e308) / 2
    row = values.agg(F.count_if(x <= middle).alias("reached"), F.max(F.when(x <= middle, x)).alias("left"), F.min(F.when(x > middle, x)).alias("right")).first()
    if row["reached"] > last:
        return low, row["left"]
    return (row["right"], high) if row["reached"] <= first else (row["left"], row["right"])


def _interpolate(counts: Sequence, position: float) -> float | None:
    """Value at a fractional rank; the null row counts what lies below the listed values."""
    reached = sum(c["n"] for c in counts if c["x"] is None)
    first, last = math.floor(position), math.ceil(position)
    at: dict[int, float] = {}
    for value, n in sorted((c["x"], c["n"]) for c in counts if c["x"] is not None):
        for rank in (first, last):
            if reached <= rank < reached + n:
                at[rank] = value
        reached += n
    if first not in at or last not in at:
        return None
    return float(at[first] + (at[last] - at[first]) * (position - first))
