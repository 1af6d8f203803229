"""Language identification: a byte convolutional network over fixed-length windows.

Filters of several widths slide over the bytes of a window, each filter keeps
its largest response, and a softmax over those gives the languages. It is
trained in numpy on a bounded sample of labelled windows. A text is cut into
windows that cover it whole; its language has the largest mean share.

Shares say which of the learned languages is nearest, not whether it is one of
them. That is told by a profile of byte triples of each language, from the same
labelled windows: a text's likeness is 1 where its bytes are as probable as those
of held-out windows of its language, and 0 where they are as improbable as the
same windows with their bytes shuffled.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without labelled rows every text is ``und``; ties go to the language that sorts
first; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.llm.common import LOWER, given_back, quoted, remainder, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled documents used by the fit, of each language, and windows taken of each document.
SAMPLE = 200
WINDOWS = 6
UNKNOWN = "und"
#: Classes of bytes in a profile: the most common bytes of the language, and all others.
CLASSES = 32
#: Triples by which a text is taken as typical beforehand, so that a few odd bytes don't decide on a short one.
PRIOR = 4

_LETTER = re.compile(r"[^\W\d_]")
_NUMBER = re.compile(rb"[0-9][0-9a-z]*")


@dataclass(frozen=True)
class Profile:
    classes: np.ndarray  # of the 256 bytes
    table: np.ndarray  # logarithm of the probability of a byte after two others, by their classes
    typical: float = 0.0
    noise: float = 0.0


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    filters: tuple[np.ndarray, ...]  # for each width: (width, 256, filters)
    shifts: tuple[np.ndarray, ...]
    dense: np.ndarray
    bias: np.ndarray
    profiles: tuple[Profile, ...] = ()  # for each language


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text, the last one filled with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = LOWER[np.frombuffer(raw, np.uint8)]
    return out.reshape(n, WINDOW)


def _responses(windows: np.ndarray, table: np.ndarray, shift: np.ndarray) -> np.ndarray:
    width = table.shape[0]
    span = windows.shape[1] - width + 1
    total = np.take(table[0], windows[:, :span], axis=0)
    for j in range(1, width):
        total += np.take(table[j], windows[:, j : j + span], axis=0)
    return total + shift


def _pooled(windows: np.ndarray, model: Model, paired: list) -> np.ndarray:
    """Largest response of each filter, never below 0. The place in the window comes first, so that the maximum runs over whole rows."""
    out = []
    single = np.ascontiguousarray(windows.T)
    codes = single[:-1].astype(np.int32) * 256 + single[1:]
    for parts, filters, shift in zip(paired, model.filters, model.shifts, strict=True):
        span = windows.shape[1] - filters.shape[0] + 1
        total = np.take(parts[0], codes[:span], axis=0)
        for j, part in enumerate(parts[1:], 1):
            total += np.take(part, (codes if len(part) > 256 else single)[2 * j : 2 * j + span], axis=0)
        out.append(np.maximum(total.max(axis=0) + shift, 0))
    return np.concatenate(out, axis=1)


def _pairs(model: Model) -> list[list[np.ndarray]]:
    """Tables of the summed weights of two neighbouring bytes: half the look-ups."""
    out = []
    for filters in model.filters:
        width, _, n = filters.shape
        parts = [(filters[j][:, None, :] + filters[j + 1][None, :, :]).reshape(65536, n) for j in range(0, width - 1, 2)]
        out.append(parts + ([filters[width - 1]] if width % 2 else []))
    return out


def _shares(pooled: np.ndarray, model: Model) -> np.ndarray:
    logits = pooled @ model.dense + model.bias
    logits -= logits.max(axis=1, keepdims=True)
    e = np.exp(logits)
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, target: np.ndarray, languages: tuple[str, ...], epochs: int = 6, rate: float = 0.02, batch: int = 64, seed: int = 7) -> Model:
    """Gradient steps with adaptive rates; only the position of each largest response takes part."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    model = Model(languages, tuple(filters), tuple(shifts), dense, bias)
    held = [np.full_like(p, 1e-4) for p in (*filters, *shifts, dense, bias)]
    every = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            x, y = windows[order[at : at + batch]], target[order[at : at + batch]]
            pooled, where = [], []
            for k in range(len(WIDTHS)):
                total = _responses(x, filters[k], shifts[k])
                where.append(total.argmax(axis=1))
                pooled.append(total.max(axis=1))
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            delta = _shares(hidden, model)
            delta[np.arange(len(y)), y] -= 1
            delta /= len(y)
            back = (delta @ dense.T) * (raw > 0)
            changes = []
            for k, width in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                change = np.zeros_like(filters[k])
                for j in range(width):
                    np.add.at(change[j], (x[np.arange(len(y))[:, None], where[k] + j], np.broadcast_to(every, where[k].shape)), part)
                changes.append(change)
            changes += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            changes += [hidden.T @ delta, delta.sum(axis=0)]
            for value, change, seen in zip((*filters, *shifts, dense, bias), changes, held, strict=True):
                seen += change * change
                value -= rate * change / np.sqrt(seen)
    return model


def _plain(raw: bytes) -> np.ndarray:
    """Bytes that a profile judges: numbers and keys are one digit each, so that a long one counts as one odd word."""
    return np.frombuffer(_NUMBER.sub(b"0", raw.translate(LOWER.tobytes())), np.uint8)


def _codes(raw: np.ndarray, profile: Profile) -> np.ndarray:
    c = profile.classes[raw].astype(np.int32)
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def _counted(pieces: list[np.ndarray], smooth: float = 8.0) -> Profile:
    """Probabilities of triples, smoothed by those of pairs and these by those of single bytes."""
    common = np.bincount(np.concatenate(pieces), minlength=256)
    classes = np.full(256, CLASSES - 1, np.uint8)
    own = np.argsort(-common, kind="stable")[: CLASSES - 1]
    classes[own] = np.arange(CLASSES - 1)
    profile = Profile(classes, np.zeros(0))
    codes = np.concatenate([_codes(x, profile) for x in pieces if len(x) > 2] or [np.zeros(0, np.int32)])
    three = np.bincount(codes, minlength=CLASSES**3).reshape((CLASSES,) * 3).astype(float)
    two = three.sum(axis=0)
    one = (two.sum(axis=0) + 0.5) / (two.sum() + 0.5 * CLASSES)
    pair = (two + smooth * one) / (two.sum(axis=1, keepdims=True) + smooth)
    triple = (three + smooth * pair) / (three.sum(axis=2, keepdims=True) + smooth)
    triple[:, :, CLASSES - 1] /= 256 - (CLASSES - 1)
    return replace(profile, table=np.log(triple).ravel().astype(np.float32))


def _evidence(raw: np.ndarray, profile: Profile, most: int = 1 << 20) -> tuple[float, int]:
    """Sum over all triples of a text, and their number."""
    total = 0.0
    for at in range(0, len(raw) - 2, most):
        total += float(profile.table[_codes(raw[at : at + most + 2], profile)].sum(dtype=float))
    return total, max(0, len(raw) - 2)


def profiled(pieces: list[list[np.ndarray]], seed: int = 7) -> Profile:
    """Profile of one language, from the windows of each of its documents; each half of the documents is judged by the other."""
    rng = np.random.default_rng(seed)
    halves = [pieces[::2], pieces[1::2] or pieces]
    means: tuple[list, list] = ([], [])
    for own, other in (halves, halves[::-1]):
        profile = _counted([x for doc in own for x in doc])
        for x in (x for doc in other for x in doc if len(x) > 2):
            for found, y in zip(means, (x, rng.permutation(x)), strict=True):
                found.append(_evidence(y, profile)[0] / (len(x) - 2))
    typical, noise = (float(np.median(x)) if x else 0.0 for x in means)
    return replace(_counted([x for doc in pieces for x in doc]), typical=typical, noise=noise)


def likeness(text: str, profile: Profile) -> float:
    """1 for a text like those of the profile's language, 0 for one like noise of the same bytes; it may lie outside of both."""
    total, n = _evidence(_plain(text.encode("utf-8", "replace")), profile)
    mean = (total + PRIOR * profile.typical) / (n + PRIOR)
    # Where shuffled text looks the same, as in one repeated letter, a natural unit stands for the distance.
    return 1 + (mean - profile.typical) / max(profile.typical - profile.noise, 1.0)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, windows: int = WINDOWS) -> Model | None:
    """Fit on at most ``sample`` documents of each labelled language, drawn by a hash of key and text.

    A first count by language (map-side combined) gives the share to draw; the
    drawn rows are cut to ``sample`` by their hash among those few.
    """
    rows = docs.select(quoted(lang).alias("lang"), quoted(text).alias("t"), F.xxhash64(quoted(key), quoted(text)).alias("o")).filter("lang is not null and t is not null and length(t) > 0")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    names = tuple(sorted(r["lang"] for r in counts))
    scale = 1 << 20
    draw = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(scale, int(scale * 1.5 * sample / r["count"]) + 1))])
    drawn = rows.filter(F.pmod(F.col("o"), F.lit(scale)) < F.try_element_at(draw, F.col("lang")))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, text, order in zip(frame["lang"], frame["t"], frame["o"], strict=True):
                if _LETTER.search(text):
                    all_of = windows_of(text.encode("utf-8", "replace"))
                    picked = all_of[np.unique(np.linspace(0, len(all_of) - 1, windows).astype(int))]
                    out.append((name, order, picked.tobytes()))
            yield pd.DataFrame(out, columns=["lang", "o", "w"])

    few = drawn.mapInPandas(cut, "lang string, o long, w binary").distinct().orderBy("o", "lang").limit(2 * sample * len(names)).collect()
    taken: dict[str, int] = {}
    data, target = [], []
    pieces: dict[str, list] = {name: [] for name in names}
    for r in few:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= sample:
            found = np.frombuffer(r["w"], np.uint8).reshape(-1, WINDOW)
            data.append(found)
            target += [names.index(r["lang"])] * len(found)
            pieces[r["lang"]].append([_plain(w.tobytes().rstrip(b"\0")) for w in found])
    if not data:
        return None
    # A language whose labelled texts have no letter is never found, so its profile is never asked.
    return replace(train(np.concatenate(data), np.array(target), names), profiles=tuple(profiled(pieces[n] or [[np.zeros(0, np.uint8)]]) for n in names))


def predict(texts: list, model: Model | None, paired: list | None = None, most: int = 96) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text; windows are handled a few at a time."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, scores
    paired = _pairs(model) if paired is None else paired
    total, count = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))

    def add(owners: list, held: list) -> None:
        x, own = np.concatenate(held), np.concatenate(owners)
        for at in range(0, len(x), most):
            np.add.at(total, own[at : at + most], _shares(_pooled(x[at : at + most], model, paired), model))

    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        if not text or not _LETTER.search(text):
            continue
        w = windows_of(text.encode("utf-8", "replace"))
        owners.append(np.full(len(w), i))
        held.append(w)
        count[i] = len(w)
        size += len(w)
        if size >= 4096:
            add(owners, held)
            owners, held, size = [], [], 0
    if held:
        add(owners, held)
    for i in np.flatnonzero(count):
        mean = total[i] / count[i]
        best = int(mean.argmax())
        names[i], scores[i] = model.languages[best], min(1.0, float(mean[best]))
    return names, scores


def language_column(text: Column, model: Model | None) -> Column:
    """struct(lang, score) as a column of any frame that has ``text``."""

    @F.pandas_udf("lang string, score double")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        paired = _pairs(model) if model is not None else None
        for batch in batches:
            names, scores = predict(list(batch), model, paired)
            yield pd.DataFrame({"lang": names, "score": scores})

    return named(text)


def known_column(text: Column, model: Model | None) -> Column:
    """struct(lang, score, likeness): as ``language_column``, with the likeness of the text to its language; 0 where there is none."""

    @F.pandas_udf("lang string, score double, likeness double")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        paired = _pairs(model) if model is not None else None
        for batch in batches:
            texts = list(batch)
            names, scores = predict(texts, model, paired)
            near = [0.0 if n == UNKNOWN else likeness(t, model.profiles[model.languages.index(n)]) for t, n in zip(texts, names, strict=True)]
            yield pd.DataFrame({"lang": names, "score": scores, "likeness": near})
        given_back()

    return named(text)


def learnable(key: Column) -> Column:
    """Rows that a fit may learn from: a quarter of the keys is held out."""
    return F.coalesce(remainder(key, 4) != 2, F.lit(False))


def fitted(docs: DataFrame) -> Model | None:
    return fit(docs.filter(learnable(F.col("doc_id"))))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), language_column(F.col("text"), fitted(docs)).alias("f"))
    return found.select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"))
