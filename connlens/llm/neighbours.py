"""Approximate search by largest inner product with collision-counting hashing.

As in the exact search one more component turns the largest inner product into
the smallest distance. Each hash function is a single projection; a segment
keeps, for each, its vectors in the order of their projections, an index that is
written once. A query's window in every such array is centred on its own
projection. All windows widen by the same factor (virtual rehashing: no array is
made anew), each widening counts only the vectors that come in, and vectors that
stand in at least ``share`` of the windows are verified. Widening ends when
``verify`` of the segment, and ``beyond`` more than are asked for, are over that
threshold; the scores of those are exact.
Windows end at one of some ranks, and are counted for many vectors at a time
(``collisions``).

Projections are random orthogonal directions, as many bases as needed for
``hashes``. Every row is indexed; nothing is fitted but the scale of the windows.
Defined results: as in the exact search, and a zero vector takes no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.llm.collisions import Arrays, candidates, ranks
from connlens.llm.common import saved, table
from connlens.llm.vectors import best, packed, results, searched, segment_size, stacked, valid

HASHES = 128
#: Share of the windows that a vector must stand in to be verified; share of a segment, and number beyond ``k``, verified at least.
SHARE = 0.8
VERIFY, BEYOND = 0.04, 200
#: First half-width of a window in standard deviations of the projections, and the factor of each widening.
START, FACTOR = 1.1, 1.06
#: Queries counted at once.
STEP = 128


def directions(width: int, hashes: int, seed: int = 11) -> np.ndarray:
    """Random orthogonal directions as columns, basis after basis."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-hashes // width))]
    return np.hstack(bases)[:, :hashes] * np.sqrt(width)


def nearest(
    df: DataFrame, every: int, k: int, key: str = "vec_id", vector: str = "embedding", hashes: int = HASHES, share: float = SHARE,
    verify: float = VERIFY, beyond: int = BEYOND, start: float = START, factor: float = FACTOR,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows whose id is divisible by ``every``."""
    rows = valid(df, key, vector, lambda x: x, zero=False)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).first()
    n, width, most = facts["n"], facts["width"] or 0, facts["most"] or 0.0
    lines = directions(width + 1, hashes)
    size = segment_size(rows, n)
    segments = max(1, -(-n // size))

    def projections(x: np.ndarray) -> np.ndarray:
        far = np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))
        return np.hstack((x, far[:, None])) @ lines

    def indexed(frame: pd.DataFrame) -> pd.DataFrame:
        v = packed(frame["v"], width)
        rank = ranks(projections(stacked(v, width)))
        return pd.DataFrame({"uid": frame["uid"], "id": frame["id"], "seg": frame["seg"], "v": v, "more": [r.tobytes() for r in rank]})

    index = saved(rows.withColumn("seg", F.pmod(F.xxhash64("uid"), F.lit(segments)).cast("int")).groupBy("seg").applyInPandas(indexed, "uid long, id long, seg int, v binary, more binary"), "index")

    def search(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(queries):
            x = stacked(held["v"], width)
            ids, uids = held["id"].to_numpy(), held["uid"].to_numpy()
            projected = projections(x)
            arrays = Arrays(projected, stacked(held["more"], hashes, np.int32))
            spread = float(projected.std()) or 1.0
            q = stacked(queries["asked"], width)
            # A query's length does not change its order of candidates: it is brought to the candidates' scale.
            centres = (q / np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt(most)) @ lines[:width]
            enough, wanted = int(np.ceil(share * hashes)), min(len(x), max(k + beyond, int(np.ceil(verify * len(x)))))
            quids, qids = queries["quid"].to_numpy(), queries["query_id"].to_numpy()
            for at in range(0, len(q), STEP):
                for i, over in enumerate(candidates(arrays, centres[at : at + STEP], enough, wanted, start * spread, factor), at):
                    over = over[uids[over] != quids[i]]
                    scores = (x[over] * q[i]).sum(axis=1)
                    top = best(scores, ids[over], k)
                    out.append(pd.DataFrame({"quid": quids[i], "query_id": qids[i], "uid": uids[over[top]], "vec_id": ids[over[top]], "score": scores[top]}))
        return results(out, np.float64)

    return searched(index, every, n, k, segments, search, "double")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)
