"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a written table in the shared folder: later jobs start from its files."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of))


def with_value(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Remembered(dict):
    """A dict that forgets what was not asked for lately: some ``most`` new keys, of some ``size`` characters, and as many older ones."""

    def __init__(self, most: int, size: float = math.inf):
        super().__init__()
        self.most, self.size, self.held, self.older = most, size, 0, {}

    def of(self, keys: list, learn: Callable[[set], None]) -> list:
        """Values of the keys; ``learn`` gets the unknown ones and stores what it can. None for the rest."""
        if len(self) > self.most or self.held > self.size:
            self.older, self.held = dict(self), 0
            self.clear()
        found = list(map(self.get, keys))
        absent = {k for k, v in zip(keys, found, strict=True) if v is None}
        if absent:
            self.held += sum(map(len, absent))
            known = absent & self.older.keys()
            self.update({k: self.older[k] for k in known})
            learn(absent - known)
            found = [self.get(k) if v is None else v for k, v in zip(keys, found, strict=True)]
        return found


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a worker keeps from one task to the next, for one operator at a time: what another one left is freed first."""
    if key not in _KEPT:
        _KEPT.clear()
        given_back()
        _KEPT[key] = make()
    return _KEPT[key]


def given_back() -> None:
    """Memory that this worker has freed goes back to the system, as other processes of its executor need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# Bytes of a text: 0 space, 1 part of a word, 2 other mark.
BYTE_KIND = np.full(256, 2, np.uint8)
BYTE_KIND[:33] = 0
BYTE_KIND[127] = 0
BYTE_KIND[128:] = 1
for _range in (range(48, 58), range(65, 91), range(97, 123)):
    BYTE_KIND[list(_range)] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUE = LOWER.astype(np.uint64) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SLICE = 1 << 20


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def text_batches(texts: Iterable[str | None], most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of neighbouring texts: first index, count, their bytes one after the other, offsets (count + 1).

    A zero byte, which is a space, stands between two texts. A group holds at
    most ``most`` bytes unless one text alone is longer.
    """
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if held and size + len(raw) > most:
            yield (first, len(held), *_joined(held))
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield (first, len(held), *_joined(held))


def _joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\0".join(held) + b"\0", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in held])
    return data, np.concatenate(([0], ends))


def tokens(data: np.ndarray, marks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash (ASCII letters lower-cased) of each word; with ``marks`` also of each run of other marks.

    The hash is a polynomial taken from a running sum over the bytes, computed
    in slices cut at spaces so that memory stays bounded.
    """
    kind = BYTE_KIND[data]
    if not marks:
        kind = np.where(kind == 1, kind, 0).astype(np.uint8)
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    kinds = kind[np.minimum(change, len(kind) - 1)] if len(kind) else kind
    keep = np.flatnonzero((kinds != 0) & (change < len(kind)))
    starts, ends = change[keep], change[np.minimum(keep + 1, len(change) - 1)]
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        low, high = starts[i], ends[j - 1]
        powers, inverse = _powers(int(high - low))
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUE[data[low:high]] * powers[: high - low], out=total[1:])
        a = starts[i:j] - low
        hashes[i:j] = (total[ends[i:j] - low] - total[a]) * inverse[a]
        i = j
    return starts, ends, mixed(hashes)
