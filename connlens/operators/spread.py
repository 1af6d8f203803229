"""Equi-joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with at least this share of the rows counts as hot, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.005
SALTS = 32

# A result of at most this many rows may be pinned on the driver and broadcast.
PINNED_ROWS = 10_000


def hot_values(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Heavy hitters of a column, None among them, from one bounded sketch; no shuffle of the data."""
    tracked = int(20 / share)
    row = df.agg(
        F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"),
        F.expr(f"approx_top_k(`{key}`, {int(1 / share)}, {tracked})").alias("top"),
    ).first()
    least = max(2, int(row["n"] * share))
    found = [t["item"] for t in row["top"] or [] if t["item"] is not None and t["count"] >= least]
    return found + ([None] if row["nulls"] >= least else [])


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: Sequence | None = None, salts: int = SALTS) -> DataFrame:
    """Join on ``key`` with the hot keys of the left side salted.

    Left rows of a hot key get a salt from their content, the matching right
    rows are repeated once per salt, all other rows keep salt 0. Null keys,
    which match nothing, are only spread. The result is that of the plain
    join. ``hot`` lists the keys when they are known.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} cannot be salted on the left side")
    hot = hot_values(left, key) if hot is None else list(hot)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin([v for v in hot if v is not None]), F.lit(False))
    plain = [F.col(f"`{f.name}`") for f in left.schema.fields if f.dataType.typeName() not in ("map", "struct", "array", "variant")]
    # Rows that are alike in every plain column are told apart by their partition.
    picked = F.pmod(F.xxhash64(*plain, *([F.spark_partition_id()] if len(plain) < 2 else [])), F.lit(salts)).cast("int")
    salted = left.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), picked).otherwise(F.lit(0)))
    every = F.array(*[F.lit(i) for i in range(salts)])
    repeated = right.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def spread_evenly(df: DataFrame) -> DataFrame:
    """The same rows in one even partition for each slot, for work that is long for every row: a file of one row group is one partition, whatever its size."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def pin_small(df: DataFrame, limit: int = PINNED_ROWS) -> DataFrame | None:
    """The same rows as a local table when there are at most ``limit``, else None. Runs ``df`` once."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def sized_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", distinct: bool = False, limit: int = PINNED_ROWS) -> DataFrame:
    """Broadcast the right side when its checked size allows it, else a salted shuffle join.

    With ``distinct`` the right side may repeat rows. Its size is checked
    before they are made distinct, so that a long list is left after a few
    tasks and no shuffle is run for the check.
    """
    pinned = pin_small(right, limit)
    if pinned is not None:
        return left.join(F.broadcast(pinned.distinct() if distinct else pinned), key, how)
    return spread_join(left, right.distinct() if distinct else right, key, how)


def side_by_side(rows: Sequence[DataFrame]) -> DataFrame:
    """One-row frames with different columns as one row, without a join."""
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])
