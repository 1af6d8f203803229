"""Connection logs as a data source for batches and streams.

Each file is opened with its own ``#fields`` header, so files of several
layouts, other column orders and missing columns mix, and no line is read twice
to find a layout. Large files are read in splits. The stream follows growing
files: a batch takes the whole lines that were written since the last one.

Columns are those of the schema asked for, as text, null where a file or a line
has none; ``file`` and ``line_no`` tell lines apart. ``line_no`` grows in reading
order: the number of the file in order of the paths, then the byte at which the
line starts (in a stream that byte alone, as later files are not known).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from connlens.schemas import LOG_COLUMNS, LOG_TYPES
from connlens.session import ship_package
from connlens.sources.conn_log import HEADER, typed
from connlens.sources.files import listed, store

FORMAT = "connlens_log"
SPLIT_BYTES = 64 << 20
#: Bytes parsed at once, and read at once at the ends of a file.
CHUNK, EDGE = 4 << 20, 64 << 10
#: Place of the file's number above the bytes of a file.
FILE_SHIFT = 43


class Split(InputPartition):
    """Bytes of a file. Without ``whole`` the line that reaches over the start belongs to the split before."""

    def __init__(self, path: str, number: int, start: int, stop: int, whole: bool):
        super().__init__((path, start))
        self.path, self.number, self.start, self.stop, self.whole = path, number, start, stop, whole


def header_of(source, size: int) -> list[str] | None:
    """Column names of the ``#fields`` line among the lines before the first data line."""
    held, at = b"", 0
    while at < size:
        source.seek(at)
        held += source.read(EDGE)
        at = len(held)
        for line in held.split(b"\n")[: None if at >= size else -1]:
            if line.startswith(HEADER.encode()):
                return line.decode("utf-8", "replace").strip().split("\t")[1:]
            if line.strip() and not line.startswith(b"#"):
                return None
    return None


def _cell(lists: pa.ListArray, i: int) -> pa.Array:
    """The i-th text of each list, null where it is shorter."""
    first, last = lists.offsets[:-1].to_numpy(), lists.offsets[1:].to_numpy()
    at = np.where(first + i < last, first + i, -1)
    return lists.values.take(pa.array(at, mask=at < 0))


def _lines(source, split: Split, size: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(byte at which each line starts, lines) in pieces: the lines that start in the split, the last one read to its end."""
    at = split.start
    if not split.whole:
        # A line starts after the first line end from the byte before on.
        found = -1
        at -= 1
        while found < 0 and at < size:
            source.seek(at)
            more = source.read(CHUNK)
            found = more.find(b"\n")
            at += found + 1 if found >= 0 else len(more)
    held = b""
    source.seek(at)
    while at < split.stop:
        more = source.read(CHUNK)
        held += more
        cut = held.rfind(b"\n") + 1 if more else len(held)
        lines = held[:cut].split(b"\n")
        starts = at + np.cumsum([0, *[len(x) + 1 for x in lines]])[:-1]
        inside = int((starts < min(split.stop, at + cut)).sum())
        if inside:
            yield starts[:inside], lines[:inside]
        at, held = at + cut, held[cut:]
        if not more:
            return


class _Reading:
    """What batches and streams share: a split's lines as columns of the schema."""

    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.fieldNames()
        self.path = options["path"]
        self.fields = [f for f in options.get("fields", "").split(",") if f] or None
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.path)
        with where.open_input_file(split.path) as source:
            size = source.size()
            fields = self.fields or header_of(source, size)
            for starts, lines in _lines(source, split, size):
                lines = [x[:-1] if x.endswith(b"\r") else x for x in lines]
                kept = np.array([bool(x.strip()) and not x.startswith(b"#") for x in lines], bool)
                if not kept.any():
                    continue
                if fields is None:
                    raise ValueError(f"no {HEADER} line found in {split.path}")
                texts = pa.array([x.decode("utf-8", "replace") for x, k in zip(lines, kept, strict=True) if k], pa.string())
                cells = pc.split_pattern(texts, "\t")
                columns = []
                for name in self.names:
                    if name == "file":
                        columns.append(pa.array([split.path] * len(texts), pa.string()))
                    elif name == "line_no":
                        columns.append(pa.array(starts[kept] + (split.number << FILE_SHIFT), pa.int64()))
                    else:
                        columns.append(_cell(cells, fields.index(name)) if name in fields else pa.nulls(len(texts), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=self.names)

    def splits(self, path: str, number: int, start: int, stop: int) -> list[Split]:
        cuts = [*range(start, stop, self.split_bytes), stop]
        return [Split(path, number, a, b, a == start) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class LogReader(_Reading, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        _, files = listed(self.path)
        found = [s for i, f in enumerate(files) for s in self.splits(f.path, i, 0, f.size)]
        return found or [Split("", 0, 0, 0, True)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.path:
            yield from super().read(split)


class LogFollower(_Reading, DataSourceStreamReader):
    """Offsets name, for each file, the end of its last whole line. A file that has not grown for ``max_age`` seconds is let go."""

    def __init__(self, schema: T.StructType, options: dict):
        super().__init__(schema, options)
        self.max_age = float(options.get("max_age", "inf"))
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        try:
            where, files = listed(self.path)
        except FileNotFoundError:
            return {"files": "{}"}
        oldest, ends = time.time() - self.max_age, {}
        for f in files:
            if f.mtime is None or f.mtime.timestamp() >= oldest:
                size, end = self.known.get(f.path, (-1, 0))
                if size != f.size:
                    end = _last_line_end(where, f.path, f.size)
                ends[f.path] = (f.size, end)
        self.known = ends
        return {"files": json.dumps({path: end for path, (_, end) in ends.items()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, stop in sorted(after.items()):
            first = before.get(path, 0)
            # A file shorter than before was begun anew.
            out += self.splits(path, 0, first if first <= stop else 0, stop)
        return out

    def commit(self, end: dict) -> None:
        pass


def _last_line_end(where, path: str, size: int) -> int:
    with where.open_input_file(path) as source:
        stop = size
        while stop > 0:
            first = max(0, stop - EDGE)
            source.seek(first)
            found = source.read(stop - first).rfind(b"\n")
            if found >= 0:
                return first + found + 1
            stop = first
    return 0


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, line_no bigint, " + ", ".join(f"`{c}` string" for c in LOG_COLUMNS)

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> LogFollower:
        return LogFollower(schema, self.options)


def _asked(columns: Sequence[str] | None) -> tuple[list[str], str]:
    names = [source for source, (target, _) in LOG_TYPES.items() if columns is None or target in columns]
    return names, "file string, line_no bigint, " + ", ".join(f"`{c}` string" for c in names)


def _columns(raw: DataFrame, names: Sequence[str]) -> DataFrame:
    return raw.select("file", "line_no", *[typed(c, F.col(f"`{c}`")) for c in names])


def _options(fields: Sequence[str] | None, options: dict) -> dict:
    return {**options, **({"fields": ",".join(fields)} if fields else {})}


def scan_log(spark: SparkSession, path: str, columns: Sequence[str] | None = None, fields: Sequence[str] | None = None, **options) -> DataFrame:
    """Connections with ``file`` and ``line_no``; only ``columns`` are parsed. ``fields`` is the layout of files without a header."""
    ship_package(spark)
    spark.dataSource.register(LogSource)
    names, schema = _asked(columns)
    return _columns(spark.read.format(FORMAT).schema(schema).options(**_options(fields, options)).load(path), names)


def follow_logs(spark: SparkSession, path: str, columns: Sequence[str] | None = None, fields: Sequence[str] | None = None, **options) -> DataFrame:
    """The same as a stream over files that appear and grow."""
    ship_package(spark)
    spark.dataSource.register(LogSource)
    names, schema = _asked(columns)
    return _columns(spark.readStream.format(FORMAT).schema(schema).options(**_options(fields, options)).load(path), names)
