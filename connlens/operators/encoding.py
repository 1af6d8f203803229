"""Category encoders: fit, apply, expand, and the bookkeeping of unknown values.

An encoder is a table ``(column, value, id)``. A column absent from the
training frame is recorded by one row with a null value and id -1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from connlens.operators.ordered import running_totals
from connlens.operators.spread import spread_join
from connlens.schemas import CATEGORICAL

NULL_CATEGORY = "unknown"

# Encoders up to this size become a literal map, larger ones up to BROADCAST_ROWS a broadcast table.
MAP_ROWS = 64
BROADCAST_ROWS = 200_000


def fill_categories(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    return df.fillna(NULL_CATEGORY, [c for c in columns if c in df.columns])


def long_categories(df: DataFrame, columns: Sequence[str] = CATEGORICAL, carry: Sequence[str] = ()) -> DataFrame:
    """One row per (row, category column), nulls filled."""
    present = [c for c in columns if c in df.columns]
    pairs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(NULL_CATEGORY)).alias("value")) for c in present]
    return df.select(*carry, F.explode(F.array(*pairs)).alias("_p")).select(*carry, "_p.column", "_p.value")


def fit_encoder(df: DataFrame, columns: Sequence[str] = CATEGORICAL, order: str = "line_no") -> DataFrame:
    """Ids 0, 1, 2, ... per column in order of first appearance along ``order``."""
    present = [c for c in columns if c in df.columns]
    absent = [c for c in columns if c not in df.columns]
    out = None
    if present:
        first = long_categories(df, present, [order]).groupBy("column", "value").agg(F.min(order).alias("_first"))
        ranked = running_totals(first, ["_first", "value"], {"_n": F.lit(1)}, ["column"], expect_small=True)
        out = ranked.select("column", "value", (F.col("_n") - 1).cast("int").alias("id"))
    if absent:
        flags = df.sparkSession.createDataFrame([(c, None, -1) for c in absent], "column string, value string, id int")
        out = flags if out is None else out.unionByName(flags)
    return out


def apply_encoder(
    df: DataFrame,
    encoder: DataFrame,
    columns: Sequence[str] = CATEGORICAL,
    suffix: str = "",
    order: str | None = None,
    map_rows: int = MAP_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace each category by its id, -1 when unknown.

    A column flagged missing at fit time is fitted on ``df`` itself, along
    ``order``. The size of each column's table decides between a literal map,
    a broadcast and a salted shuffle join.
    """
    present = [c for c in columns if c in df.columns]
    head = encoder.limit(map_rows * len(columns) + 1).collect()
    whole = len(head) <= map_rows * len(columns)
    if whole:
        sizes = {c: sum(r["column"] == c and r["value"] is not None for r in head) for c in present}
        absent = {c for c in present if sizes[c] == 0}
    else:
        counts = {r["column"]: r for r in encoder.groupBy("column").agg(F.count("value").alias("n"), F.min("id").alias("least")).collect()}
        sizes = {c: counts[c]["n"] if c in counts else 0 for c in present}
        absent = {c for c in present if c not in counts or counts[c]["least"] == -1}
    out = fill_categories(df, present)
    for c in present:
        rows = head if whole else None
        table = encoder.filter((F.col("column") == c) & F.col("value").isNotNull())
        size = sizes[c]
        if c in absent:
            if order is None:
                raise ValueError(f"column {c!r} was absent at fit time: an order column is needed to fit it now")
            table = fit_encoder(df, [c], order)
            size, rows = table.count(), None
        target = c + suffix
        if size <= map_rows:
            ids = {r["value"]: r["id"] for r in rows or table.collect() if r["column"] == c and r["value"] is not None}
            entries = [F.lit(x) for item in ids.items() for x in item]
            known = F.try_element_at(F.create_map(*entries), F.col(c)) if entries else F.lit(None).cast("int")
            out = out.withColumn(target, F.coalesce(known, F.lit(-1)))
            continue
        keyed = table.select(F.col("value").alias("_value"), F.col("id").alias("_id"))
        if size <= broadcast_rows:
            out = out.join(F.broadcast(keyed), F.col(c) == F.col("_value"), "left")
        else:
            out = spread_join(out.withColumn("_value", F.col(c)), keyed, "_value")
        out = out.withColumn("_id", F.coalesce(F.col("_id"), F.lit(-1)))
        out = out.drop("_value").withColumn(target, F.col("_id")).drop("_id")
    return out


def unknown_values(df: DataFrame, encoder: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Distinct (column, value) pairs the encoder does not know; columns flagged missing are skipped."""
    flagged = encoder.filter(F.col("value").isNull()).select("column")
    seen = long_categories(df, columns).distinct().join(flagged, "column", "left_anti")
    return seen.join(encoder.select("column", "value"), ["column", "value"], "left_anti")


def merge_unknown(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.select("column", "value").unionByName(new.select("column", "value")).distinct()


def expand_encoder(encoder: DataFrame, new: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Give values not yet known the ids max+1, max+2, ... in list order.

    ``new`` is ``(column, value[, order])``; columns the encoder lacks or flags
    missing are skipped. Returns the grown encoder and the count added per column.
    """
    known = encoder.filter(F.col("value").isNotNull())
    position = F.col(order) if order else F.lit(0)
    wanted = new.select("column", "value", position.alias("_at")).groupBy("column", "value").agg(F.min("_at").alias("_at"))
    top = known.groupBy("column").agg(F.max("id").alias("_top"))
    fresh = wanted.join(known.select("column", "value"), ["column", "value"], "left_anti")
    ranked = running_totals(fresh, ["_at", "value"], {"_n": F.lit(1)}, ["column"], expect_small=True)
    added = ranked.join(top, "column").select("column", "value", (F.col("_top") + F.col("_n")).cast("int").alias("id"))
    counts = added.groupBy("column").agg(F.count("*").alias("added"))
    return encoder.unionByName(added), counts


def incorporate_unknown(encoder: DataFrame, stored: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Expand the encoder by the stored unknown values and return it with the emptied list and the counts."""
    grown, counts = expand_encoder(encoder, stored, order)
    return grown, stored.limit(0), counts
