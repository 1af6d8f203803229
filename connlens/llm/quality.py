"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates.

Features of a text: every word or run of marks, every pair of neighbours, and
every pair of neighbouring shapes with a note whether the second word repeats
the first. Each is hashed to one of 2**bits weights; a text's vector holds
count / sqrt(number of features), so that scoring is one sparse dot product.

Defined results: a null or empty text has no feature and gets the score of the
bias alone; repeated rows get equal scores; an empty table gives an empty
result; without labelled rows every score is 0.5. Extra columns are kept as
they are, the result columns avoid their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.llm.common import BYTE_KIND, kept, mixed, quoted, remainder, table, text_batches, tokens

BITS = 18
#: Labelled rows used by the fit.
SAMPLE = 6000
#: Texts of an Arrow batch made Python objects at a time, and bytes whose features are made at a time: a worker then needs
#: a few times the batch itself.
STEP = 200
MOST = 1 << 20

_SHAPE = np.zeros(256, np.uint64)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 1, 2, 3, 4
_SHAPE[BYTE_KIND == 2] = 5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers of all features of a batch of texts, and the text of each."""
    starts, ends, word = tokens(data, marks=True)
    doc = np.searchsorted(offsets, starts, "right") - 1
    last = ends - 1
    shape = _SHAPE[data[starts]] * np.uint64(36) + _SHAPE[data[np.minimum(starts + 1, last)]] * np.uint64(6) + _SHAPE[data[last]]
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    again = (word[pair] == word[pair + 1]).astype(np.uint64)
    both = mixed(word[pair] * np.uint64(3) + word[pair + 1])
    shapes = mixed(shape[pair] * np.uint64(1009) + shape[pair + 1] * np.uint64(2) + again + np.uint64(1 << 40))
    number = np.concatenate((word, both, shapes)) >> np.uint64(64 - bits)
    return number.astype(np.int64), np.concatenate((doc, doc[pair], doc[pair]))


def _vectors(texts: list, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, n, data, offsets in text_batches(texts, MOST):
        number, doc = features(data, offsets, bits)
        ordered = number[np.argsort(doc, kind="stable")]
        cuts = np.cumsum(np.bincount(doc, minlength=n))
        for i in range(n):
            index, count = np.unique(ordered[cuts[i - 1] if i else 0 : cuts[i]], return_counts=True)
            yield index.astype(np.int32), (count / np.sqrt(max(1, count.sum()))).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE,
    bits: int = BITS, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5,
) -> Model:
    """Fit on at most ``sample`` labelled rows, those with the smallest hash of their key.

    The chosen keys are bounded by ``sample``, so they are broadcast; the
    features are made by tasks, and the updates run over them in hash order.
    """
    known = labels.select(quoted(key).alias("k"), quoted(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)")
    picked = known.distinct().orderBy(F.xxhash64(F.col("k").cast("string")), "k", "y").limit(sample)
    rows = docs.select(quoted(key).alias("k"), quoted(text).alias("t")).join(F.broadcast(picked), "k")
    rows = rows.groupBy("k", "y").agg(F.min("t").alias("t"))

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = list(_vectors(list(frame["t"]), bits))
            order = [int(x) for x in frame["o"]]
            yield pd.DataFrame({"o": order, "y": frame["y"], "i": [i.tobytes() for i, _ in made], "x": [x.tobytes() for _, x in made]})

    staged = rows.select(F.xxhash64(F.col("k").cast("string")).alias("o"), "y", "t")
    found = staged.mapInPandas(vectors, "o long, y int, i binary, x binary").collect()
    found.sort(key=lambda r: (r["o"], r["y"]))
    data = [(np.frombuffer(r["i"], np.int32), np.frombuffer(r["x"], np.float32).astype(float), r["y"]) for r in found]
    weights = np.zeros(1 << bits, np.float32)
    if not data:
        return Model(weights, 0.0, bits)
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for index, x, y in data:
            zi, ni = z[index], n[index]
            w = weight(zi, ni)
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            error = 1 / (1 + np.exp(-np.clip(w @ x + wb, -35, 35))) - y
            g = error * x
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] = ni + g * g
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / alpha * wb
            nb += error * error
    return Model(weight(z, n).astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha)), bits)


def score(texts: list, model: Model) -> np.ndarray:
    """Share of label 1 for each text, whole texts in bounded batches."""
    out = np.empty(len(texts))
    for first, n, data, offsets in text_batches(texts, MOST):
        number, doc = features(data, offsets, model.bits)
        total = np.bincount(doc, model.weights[number], n)
        count = np.maximum(1, np.bincount(doc, minlength=n))
        out[first : first + n] = 1 / (1 + np.exp(-np.clip(total / np.sqrt(count) + model.bias, -35, 35)))
    return out


def score_column(text: Column, model: Model) -> Column:
    """The score as a column of any frame that has ``text``."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # Keeps nothing, but what another operator left goes: its memory is needed here.
        kept(("quality",), dict)
        for batch in batches:
            parts = [score(batch.slice(at, STEP).to_pylist(), model) for at in range(0, len(batch), STEP)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return scored(text)


def learnable(key: Column) -> Column:
    """Rows that a fit may learn from: a third of the keys is held out."""
    return F.coalesce(remainder(key, 3) != 1, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs, table(spark, sf_dir, "labels").filter(learnable(F.col("doc_id"))))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(spark, docs, sf_dir)
    scored = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
