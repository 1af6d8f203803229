"""One-class support vector model: scoring, labelling and a distributed fit.

The fit follows the nu-formulation of Schoelkopf et al. (2001) on the random
Fourier features of Rahimi and Recht (2007): the objective is linear in the
features, so an epoch is a quantile of the margins and one sum per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from connlens.functions.scalars import missing

# Support vectors times features up to this product are unrolled into one generated expression; beyond it the same sums
# are made in the same order by Arrow batches.
UNROLLED_TERMS = 256

# Rows whose features are made at a time, so that they stay in a core's cache; terms of the cosine's series at a quarter of the angle.
BLOCK = 64
QUARTER_TURN = tuple((-1) ** k * (math.pi / 2) ** (2 * k) / math.factorial(2 * k) for k in range(9))


@dataclass(frozen=True)
class KernelModel:
    """Support vectors, their weights, kernel width and offset of an rbf model."""

    vectors: tuple[tuple[float, ...], ...]
    alphas: tuple[float, ...]
    gamma: float
    rho: float


def kernel_score(z: Sequence[Column], model: KernelModel) -> Column:
    """``sum(alpha * exp(-gamma * |z - s|^2)) - rho`` as one arithmetic expression."""
    total = F.lit(0.0)
    for vector, alpha in zip(model.vectors, model.alphas, strict=True):
        distance = F.lit(0.0)
        for x, s in zip(z, vector, strict=True):
            distance = distance + (x - F.lit(float(s))) * (x - F.lit(float(s)))
        total = total + F.lit(float(alpha)) * F.exp(F.lit(-float(model.gamma)) * distance)
    return total - F.lit(float(model.rho))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(-1, width)


def score_kernel(df: DataFrame, model: KernelModel, vector: str = "z", output: str = "score") -> DataFrame:
    """Score an array column; large models go through Arrow batches instead of an unrolled expression."""
    width = len(model.vectors[0])
    if len(model.vectors) * width <= UNROLLED_TERMS:
        return df.withColumn(output, kernel_score([F.col(vector)[i] for i in range(width)], model))

    def score(z: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(z.T)
        total = np.zeros(len(z))
        for vector_, alpha in zip(model.vectors, model.alphas, strict=True):
            distance = np.zeros(len(z))
            for x, s in zip(columns, vector_, strict=True):
                distance += (x - s) * (x - s)
            total += alpha * np.exp(-model.gamma * distance)
        return total - model.rho

    return _append_score(df, vector, output, width, score)


def label(score: str | Column, cut: float = 0.0) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s < F.lit(float(cut)), "anomaly").otherwise("normal")


def _append_score(df: DataFrame, vector: str, output: str, width: int, score) -> DataFrame:
    schema = T.StructType([f for f in df.schema.fields if f.name != output] + [T.StructField(output, T.DoubleType())])
    kept = [c for c in df.columns if c != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column(batch.schema.get_field_index(vector)), width)
            values = score(z) if len(z) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, output])

    return df.select(*kept).mapInArrow(run, schema)


@dataclass(frozen=True)
class OneClassModel:
    """Weights over random Fourier features. The frequencies are redrawn from ``seed``."""

    weights: tuple[float, ...]
    rho: float
    gamma: float
    width: int
    seed: int
    nu: float
    rows: int
    kernel: str = "rbf"
    history: tuple[float, ...] = field(default=(), compare=False)

    def frequencies(self) -> tuple[np.ndarray, np.ndarray]:
        return _draw(self.width, len(self.weights), self.gamma, self.seed)

    def table(self, spark) -> DataFrame:
        row = (self.kernel, self.gamma, self.rho, self.width, self.seed, self.nu, self.rows, list(self.weights))
        return spark.createDataFrame(
            [row], "kernel string, gamma double, rho double, width int, seed int, nu double, rows bigint, weights array<double>"
        )

    @staticmethod
    def from_row(row) -> OneClassModel:
        return OneClassModel(tuple(row["weights"]), row["rho"], row["gamma"], row["width"], row["seed"], row["nu"], row["rows"], row["kernel"])


def _draw(width: int, size: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    source = np.random.default_rng(seed)
    return source.normal(0.0, math.sqrt(2.0 * gamma), (width, size)), source.uniform(0.0, 2.0 * math.pi, size)


def _cosines(turns: np.ndarray) -> np.ndarray:
    """Cosine of an angle in turns, in place: the series of a quarter of the angle, doubled twice; within 1e-14 of ``np.cos``, whose doubles are slow."""
    turns -= np.rint(turns)
    turns *= turns
    out = turns * QUARTER_TURN[-1]
    for c in QUARTER_TURN[-2:0:-1]:
        out += c
        out *= turns
    out += 1.0
    for _ in range(2):
        out *= out
        out *= 2.0
        out -= 1.0
    return out


def _features(z: np.ndarray, kernel: str, drawn) -> Iterator[np.ndarray]:
    """Features of the rows, BLOCK of them at a time."""
    if kernel == "linear":
        yield z
        return
    w, b = (x / (2.0 * math.pi) for x in drawn)
    share = math.sqrt(2.0 / w.shape[1])
    for at in range(0, len(z), BLOCK):
        turns = z[at : at + BLOCK] @ w
        turns += b
        phi = _cosines(turns)
        phi *= share
        yield phi


def _margins(z: np.ndarray, kernel: str, drawn, weights: np.ndarray) -> np.ndarray:
    parts = [phi @ weights for phi in _features(z, kernel, drawn)]
    return np.concatenate(parts) if parts else np.empty(0)


def score_one_class(df: DataFrame, model: OneClassModel, vector: str = "z", output: str = "score") -> DataFrame:
    """Decision value in the scale of the sum of dual weights, ``nu * n``, so that fixed cuts keep their meaning."""
    weights = np.array(model.weights)
    drawn = None if model.kernel == "linear" else model.frequencies()
    scale = model.nu * model.rows

    def score(z: np.ndarray) -> np.ndarray:
        return scale * (_margins(z, model.kernel, drawn, weights) - model.rho)

    return _append_score(df, vector, output, model.width, score)


def cell_sums(vector: str) -> list[Column]:
    """Rows, narrowest and widest vector, sum and sum of squares of all cells: the facts a fit needs, in one pass."""
    cell = F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x * x)
    return [
        F.count("*").alias("n"), F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.sum(cell).alias("s"), F.sum(square).alias("q")
    ]


def scale_gamma(cells: int, total: float, squares: float, width: int) -> float:
    """1 / (features * variance of all cells)."""
    variance = squares / cells - (total / cells) ** 2
    return 1.0 / (width * variance) if variance > 0 else 1.0


def fit_one_class(
    df: DataFrame,
    vector: str = "z",
    nu: float = 0.01,
    kernel: str = "rbf",
    gamma: str | float = "scale",
    size: int = 1024,
    epochs: int = 20,
    seed: int = 42,
) -> OneClassModel:
    """Fit on every row of an array column without missing values.

    Each epoch makes one narrow pass over the persisted vectors and keeps their
    margins: the nu-share quantile of these gives the offset, then every task
    returns one feature sum of the rows at or below it, the only ones whose
    features are made again. The sums are added by feature on the executors,
    so the driver receives ``size`` numbers whatever the number of tasks. The
    second half of the steps is averaged.
    """
    if not 0.0 < nu <= 1.0:
        raise ValueError("nu must be in (0, 1]")
    if kernel not in ("rbf", "linear"):
        raise ValueError(f"kernel {kernel!r} is not supported; use 'rbf' or 'linear'")
    rows = df.select(vector).filter(F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: missing(x)))
    # A file may arrive as one partition, or as many of which few hold rows; the passes below are compute-bound.
    slots = df.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(max(2 * slots, rows.rdd.getNumPartitions())).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        head = rows.agg(*cell_sums(vector)).first()
        if not head["n"]:
            raise ValueError("no training rows")
        if head["lo"] != head["hi"]:
            raise ValueError("training vectors differ in width")
        n, width = head["n"], head["lo"]
        value = scale_gamma(n * width, head["s"], head["q"], width) if gamma == "scale" else 1.0 / width if gamma == "auto" else float(gamma)
        drawn = None if kernel == "linear" else _draw(width, size, value, seed)
        length = width if kernel == "linear" else size
        weights = _feature_sum(rows, vector, width, kernel, drawn, length)[0] / n
        average, mass, history = np.zeros(length), 0.0, []
        rho = 0.0
        for t in range(1, epochs + 1):
            margins = _with_margins(rows, vector, width, kernel, drawn, weights).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                rho = _quantile(margins, nu)
                total, count = _feature_sum(margins.filter(F.col("m") <= rho).select(vector), vector, width, kernel, drawn, length)
            finally:
                margins.unpersist()
            history.append(0.5 * float(weights @ weights) - rho)
            weights = weights - (weights - total / max(count, 1)) / (t + 1.0)
            if t > epochs // 2:
                average, mass = average + t * weights, mass + t
        if mass:
            weights = average / mass
        rho = _quantile(_with_margins(rows, vector, width, kernel, drawn, weights), nu)
    finally:
        rows.unpersist()
    return OneClassModel(tuple(weights.tolist()), rho, value, width, seed, nu, n, kernel, tuple(history))


def _with_margins(rows: DataFrame, vector: str, width: int, kernel: str, drawn, weights: np.ndarray) -> DataFrame:
    """The vectors and their margins ``m``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = _margins(_matrix(batch.column(0), width), kernel, drawn, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margins)], names=[vector, "m"])

    return rows.mapInArrow(run, T.StructType([rows.schema[vector], T.StructField("m", T.DoubleType())]))


def _quantile(margins: DataFrame, nu: float) -> float:
    return margins.agg(F.percentile_approx("m", nu, 100_000).alias("q")).first()["q"]


def _feature_sum(rows: DataFrame, vector: str, width: int, kernel: str, drawn, length: int) -> tuple[np.ndarray, int]:
    """Sum of the feature vectors of the rows and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(length), 0
        for batch in batches:
            for phi in _features(_matrix(batch.column(0), width), kernel, drawn):
                total += phi.sum(axis=0)
                count += len(phi)
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, length, dtype=np.int32)), pa.array(np.concatenate(([float(count)], total)))], names=["j", "s"]
            )

    sums = np.zeros(length)
    count = 0
    for r in rows.mapInArrow(run, "j int, s double").groupBy("j").agg(F.sum("s").alias("s")).collect():
        if r["j"] < 0:
            count = int(r["s"])
        else:
            sums[r["j"]] = r["s"]
    return sums, count
