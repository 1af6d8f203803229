"""Shared steps of the vector searches: valid rows, segments against query blocks, the last ranks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from connlens.llm.common import quoted, saved

#: Candidates of a segment and queries of a block at most: a task holds one of each at a time.
SEGMENT = 32768
QUERIES = 8192
#: Segments are made smaller than that to keep all cores busy, but not below this.
SMALL_SEGMENT = 2048


def valid(df: DataFrame, key: str, vector: str, component: Callable[[Column], Column], zero: bool) -> DataFrame:
    """(uid, id, v) of rows with an id and a vector of finite components, as a written table; uid tells rows apart.

    ``zero`` keeps vectors whose components are all 0, the empty one among them.
    """
    v = quoted(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = df.select(quoted(key).cast("long").alias("id"), v.alias("raw")).filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select("id", F.transform("raw", lambda x: component(x.cast("double"))).alias("v"))
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    return saved(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "v"), "vectors")


def packed(vectors: pd.Series, width: int, kind: type = np.float64) -> list[bytes]:
    """Vectors as bytes of one length; a shorter one counts as filled with zeros."""
    out = []
    for v in vectors:
        row = np.zeros(width, kind)
        row[: len(v)] = v
        out.append(row.tobytes())
    return out


def stacked(rows: pd.Series, width: int, kind: type = np.float64) -> np.ndarray:
    """Packed vectors as rows of an array."""
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), width)


def segment_size(rows: DataFrame, n: int) -> int:
    """Candidates of a segment when there are ``n``."""
    return min(SEGMENT, max(SMALL_SEGMENT, math.ceil(n / rows.sparkSession.sparkContext.defaultParallelism)))


def searched(rows: DataFrame, every: int, n: int, k: int, segments: int, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], score: str, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): ``search(candidates, queries)`` for every segment and query block, then the ``k`` best of each query.

    ``rows`` has (uid, id, seg, v) and, in ``more``, what else a search wants of
    a candidate. Each query meets every segment, as a stated query set against
    all rows, in blocks. A task reads one segment and one block of queries; a
    candidate is sent once for each block, so blocks are as large as memory
    allows.
    """
    blocks = max(1, math.ceil(n / every / queries))
    side = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Names of their own, so that the two sides of the cogroup share no column.
    asked = rows.filter(F.col("id") % every == 0).select(
        F.col("uid").alias("quid"), F.col("id").alias("query_id"), F.col("v").alias("asked"), F.col("more").alias("asked_more"),
        F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("of_block"), F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("of_seg"))
    found = side.groupBy("seg", "block").cogroup(asked.groupBy("of_seg", "of_block")).applyInPandas(search, f"quid long, query_id long, uid long, vec_id long, score {score}")
    order = W.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def results(found: list[pd.DataFrame], score: type) -> pd.DataFrame:
    columns = {c: np.empty(0, np.int64) for c in ("quid", "query_id", "uid", "vec_id")} | {"score": np.empty(0, score)}
    return pd.concat(found) if found else pd.DataFrame(columns)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id, in order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]
