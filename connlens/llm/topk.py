"""Exact search by largest inner product with a pivot table.

One more component makes the largest inner product the smallest distance: with
M the largest norm, a candidate x gets sqrt(M^2 - |x|^2) and a query 0, so that
the squared distance is |q|^2 + M^2 - 2 q.x. The distances to the pivots bound
it from below: |d(q, p) - d(x, p)| for every pivot p.

Rows are dealt to segments by their nearest pivot. A bounded draw of rows, the
pivots among them, gives each query a first threshold: the k-th best score among
them. The rings of a segment, its least and largest distance to each pivot, may
rule it out for a query at once. Else the largest lower bound is made of a few
pivots, then of all unless most candidates outlast the few; the candidates of the
best bounds are evaluated first and raise the threshold; what then still may
reach it is evaluated in bound order until no later one can. Where most of a
segment is left, the products of many queries are made together.

Defined results: rows without an id, without a vector, or with a null or
non-finite component take no part; shorter vectors count as filled with zeros;
a row that repeats another is a candidate of its own; ties go to the smaller
id; fewer candidates give fewer ranks; an empty table gives an empty result.
Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.llm.common import saved, table
from connlens.llm.vectors import best, packed, results, searched, segment_size, stacked, valid

PIVOTS = 64
#: Rows drawn for the first thresholds, the pivots among them.
SCOUTS = 4096
#: Pivots of the first bounds, and the share of candidates that must go for the other pivots to pay.
FIRST, PAYS = 8, 0.25
#: Bounds are kept in single precision; this much of M^2 is given away for its rounding.
SLACK = 1e-5
#: Candidates evaluated at once in bound order; queries whose bounds are held at once.
STEP, TOGETHER = 256, 32
#: Share of a segment from which its products are made for many queries together.
DENSE = 0.125


class Bounds:
    """Distances to the pivots, and what they say about inner products with rows of norm at most sqrt(``most``)."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots.astype(float), most
        self.far = np.sqrt(np.maximum(0.0, most - (self.pivots**2).sum(axis=1)))

    def distances(self, x: np.ndarray, of_rows: bool) -> np.ndarray:
        x = x.astype(float)
        square = (x * x).sum(axis=1)
        far = np.sqrt(np.maximum(0.0, self.most - square)) if of_rows else np.zeros(len(x))
        all_squares = square[:, None] + far[:, None] ** 2 + self.most - 2 * (x @ self.pivots.T + far[:, None] * self.far[None, :])
        return np.sqrt(np.maximum(all_squares, 0)).astype(np.float32)

    def reach(self, bound: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Largest inner product of a query of square ``base`` with a row at least ``bound`` away."""
        return (base + (self.most + base) * SLACK + self.most - bound.astype(float) ** 2) / 2


def searched_segment(x: np.ndarray, near: np.ndarray, ids: np.ndarray, uids: np.ndarray, q: np.ndarray, quids: np.ndarray, floors: np.ndarray, k: int, bounds: Bounds) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Places and scores of each query's best rows that reach its floor, and the number of pairs evaluated.

    ``x`` and ``q`` are whole numbers in a type in which their products are exact; ``near`` has a row for each pivot.
    """
    base, d = (q.astype(float) ** 2).sum(axis=1), bounds.distances(q, False)
    low, high = near.min(axis=1, initial=np.inf), near.max(axis=1, initial=0)
    ring = np.maximum(np.maximum(low - d, d - high), 0).max(axis=1, initial=0)
    live = np.flatnonzero(bounds.reach(ring, base) >= floors)
    places, scores, evaluated = [np.empty(0, int)] * len(q), [np.empty(0, x.dtype)] * len(q), 0
    for at in range(0, len(live), TOGETHER):
        some = live[at : at + TOGETHER]
        bound, gap = np.zeros((len(some), len(x)), np.float32), np.empty((len(some), len(x)), np.float32)
        for first, last in ((0, FIRST), (FIRST, len(near))):
            for p in range(first, min(last, len(near))):
                np.subtract(near[p], d[some, p, None], out=gap)
                np.maximum(bound, np.abs(gap, out=gap), out=bound)
            kept = (bounds.reach(bound, base[some, None]) >= floors[some, None]) & (uids != quids[some, None])
            if kept.mean() > 1 - PAYS:
                break
        dense = []
        for i, one in enumerate(some.tolist()):
            cols = np.flatnonzero(kept[i])
            floor = floors[one]
            if len(cols) > STEP:
                nearest = cols[np.argpartition(bound[i, cols], STEP)[:STEP]]
                found = x[nearest] @ q[one]
                evaluated += STEP
                floor = max(floor, np.partition(found, STEP - k)[STEP - k]) if k <= STEP else floor
                cols = cols[bounds.reach(bound[i, cols], base[one]) >= floor]
            if len(cols) >= max(STEP, DENSE * len(x)):
                dense.append((one, cols, floor))
                continue
            order = cols[np.argsort(bound[i, cols], kind="stable")]
            held, found = np.empty(0, x.dtype), np.empty(0, int)
            for step in range(0, len(order), STEP):
                if len(held) >= k and bounds.reach(bound[i, order[step]], base[one]) < held.min():
                    break
                more = order[step : step + STEP]
                evaluated += len(more)
                held, found = np.concatenate((held, x[more] @ q[one])), np.concatenate((found, more))
                top = best(held, ids[found], k)
                held, found = held[top], found[top]
            places[one], scores[one] = found[held >= floor], held[held >= floor]
        if dense:
            products = q[[one for one, *_ in dense]] @ x.T
            for row, (one, cols, floor) in zip(products, dense, strict=True):
                evaluated += len(cols)
                reached = cols[row[cols] >= floor]
                top = reached[best(row[reached], ids[reached], k)]
                places[one], scores[one] = top, row[top]
    return places, scores, evaluated


def _kind(largest: float, width: int) -> type:
    """A type in which sums of ``width`` products of whole numbers up to ``largest`` are exact."""
    sums = largest**2 * max(1, width)
    return np.float32 if sums < 2**24 else np.float64 if sums < 2**53 else np.int64


def exact_top(df: DataFrame, every: int, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 64, pivots: int = PIVOTS, scouts: int = SCOUTS) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows whose id is divisible by ``every``, over floor(scale * x)."""
    rows = valid(df, key, vector, lambda x: F.floor(x * scale).cast("long"), zero=True)
    facts = rows.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("most"),
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("largest"),
    ).first()
    n, width, most = facts["n"], facts["width"] or 0, facts["most"] or 0.0
    kind = _kind(float(facts["largest"] or 0), width)
    # A bounded draw, the same at every run.
    drawn = rows.orderBy(F.xxhash64("id", "uid"), "uid").limit(scouts).toPandas()
    known, known_uid = stacked(packed(drawn["v"], width, kind), width, kind), drawn["uid"].to_numpy()
    bounds = Bounds(known[:pivots], most)

    # The pivot table: distances of every row, made once.
    def measured(frames):
        for frame in frames:
            v = packed(frame["v"], width, kind)
            d = bounds.distances(stacked(v, width, kind), True)
            cell = d.argmin(axis=1).astype(np.int32) if d.shape[1] else np.zeros(len(d), np.int32)
            yield pd.DataFrame({"uid": frame["uid"], "id": frame["id"], "cell": cell, "v": v, "more": [row.tobytes() for row in d]})

    listed = saved(rows.mapInPandas(measured, "uid long, id long, cell int, v binary, more binary"), "pivot-table")
    # A row for each pivot at most: small cells share a segment, large ones are split.
    size = segment_size(rows, n)
    first, split, segments, filled = {}, {}, 0, size
    for cell, m in sorted((r["cell"], r["m"]) for r in listed.groupBy("cell").agg(F.count("*").alias("m")).collect()):
        if filled + m > size:
            segments, filled = segments + 1, 0
        first[cell], split[cell] = segments - 1, -(-m // size)
        segments, filled = segments + split[cell] - 1, (filled + m if split[cell] == 1 else size)
    cells = [(c, first[c], split[c]) for c in first] or [(0, 0, 1)]
    place = F.create_map(*[F.lit(x) for c, f, s in cells for x in (c, f)])[F.col("cell")], F.create_map(*[F.lit(x) for c, f, s in cells for x in (c, s)])[F.col("cell")]
    dealt = listed.select("uid", "id", (place[0] + F.pmod(F.xxhash64("uid"), place[1])).cast("int").alias("seg"), "v", "more")

    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            x, q = stacked(candidates["v"], width, kind), stacked(queries["asked"], width, kind)
            near = stacked(candidates["more"], len(bounds.pivots), np.float32).T.copy()
            ids, uids, quids = candidates["id"].to_numpy(), candidates["uid"].to_numpy(), queries["quid"].to_numpy()
            floors = np.full(len(q), -np.inf)
            for at in range(0, len(q), 256):
                own = (q[at : at + 256] @ known.T).astype(float)
                own[known_uid == quids[at : at + 256, None]] = -np.inf
                if own.shape[1] >= k:
                    floors[at : at + 256] = np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k]
            places, scores, _ = searched_segment(x, near, ids, uids, q, quids, floors, k, bounds)
            for i, (quid, qid) in enumerate(zip(quids, queries["query_id"], strict=True)):
                out.append(pd.DataFrame({"quid": quid, "query_id": qid, "uid": uids[places[i]], "vec_id": ids[places[i]], "score": scores[i].astype(np.int64)}))
        return results(out, np.int64)

    return searched(dealt, every, n, k, max(1, segments), search, "long")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top(table(spark, sf_dir, "embeddings"), every=20, k=20)


SQL = """
    WITH v AS (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.u AS qu, q.vec_id AS query_id, c.u, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.u <> c.u WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qu ORDER BY score DESC, vec_id, u)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
