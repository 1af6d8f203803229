"""Token ids in files of independent zstandard frames that can be read one at a time.

A file holds, one after the other:

1. data frames, each an independent zstandard frame with the ids of some whole
   documents as little-endian 32-bit numbers;
2. a skippable frame with the list of documents (key, number of ids, frame),
   itself a zstandard frame with a checksum;
3. a skippable frame with the seek table of the public seekable format: for each
   frame its compressed and plain size and the low half of XXH64 of its plain
   bytes, then the number of frames, a descriptor and a magic number.

Any zstandard reader thus gets the ids of the file in order, and a reader that
wants some documents reads the end of the file, the list, and their frames only.
Documents are written in ascending order of their keys, a range of keys to each
task and one file to each task. A task names its file anew at every attempt and
returns the name, so files of lost or repeated attempts are never listed.

Defined results: a null or empty text is the end id alone; null keys come first,
and can't be asked for; rows with one key follow each other, smaller hash of the
text first, and a key asked for gives them all; an empty table gives no file;
extra columns are left out. A document longer than a frame has one to itself.
"""

from __future__ import annotations

import bisect
import contextlib
import gc
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from connlens.llm.common import quoted, table
from connlens.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Plain bytes after which a frame is closed, compression level.
FRAME = 1 << 18
LEVEL = 1
#: Chunks remembered by a worker.
REMEMBERED = 500_000
#: Texts encoded at once.
STEP = 400
#: Files whose bounds a search for keys holds in memory; there is one for each task that wrote.
MOST_FILES = 1_000_000

# Fixed values of the public formats: skippable frames, seek table.
LIST_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80
HEAD, ENTRY, FOOT = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<IBI")

_MARK = "\x01"
# European letters whose lower case is one letter, and printable marks after them: the two are never one token.
_USUAL = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\\[-`{-~]*)")


@contextlib.contextmanager
def uncollected():
    """Without the collector of cycles: many remembered chunks, which make none, would be walked over again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class WordIds:
    """Ids of whole texts as the tokenizers library gives them for a vocabulary that drops white space.

    No token reaches over a space or a line end, so the chunks between them are
    encoded on their own, each once for as long as it is remembered. New words
    of European letters are encoded by tiktoken with the same vocabulary (see
    ``ranked``), all other new chunks by the library: joined by a control
    character, which is a token of its own, and encoded in one call.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._encode([_MARK])[0]
        if len(mark) != 4:
            raise ValueError(f"{path} has no id of its own for a control character")
        self.mark = np.frombuffer(mark, "<u4")[0]
        self.words, self.line_end = ranked(path)
        self.marks: dict[str, bytes] = {"": b""}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_library(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        plain, marked = [c for c in chunks if _MARK not in c], [c for c in chunks if _MARK in c]
        if plain:
            yield from zip(plain, _cut(np.frombuffer(self._encode([f" {_MARK} ".join(plain)])[0], "<u4"), self.mark), strict=True)
        yield from zip(marked, self._encode(marked), strict=True)

    def _learn(self, absent: set[str]) -> None:
        found = [(c, _USUAL.fullmatch(c)) for c in absent]
        usual = [(c, m[1].lower(), m[2]) for c, m in found if m]
        words = list({word for _, word, _ in usual} - {""})
        ids = {"": b""}
        if words:
            joined = np.array(self.words.encode_ordinary("\n".join([word + _MARK for word in words])), "<u4")
            ids.update(zip(words, _cut(joined, self.line_end), strict=True))
        if len(self.marks) > REMEMBERED:
            self.marks = {"": b""}
        self.marks.update(self._by_library(list({marks for _, _, marks in usual} - self.marks.keys())))
        self.known.update({c: ids[word] + self.marks[marks] for c, word, marks in usual})
        self.known.update(self._by_library([c for c, m in found if not m]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        chunks = [text.replace("\n", " ").split(" ") for text in texts]
        absent = set().union(*chunks) - self.known.keys()
        if absent:
            again = absent & self.older.keys()
            self.known.update({c: self.older[c] for c in again})
            self._learn(absent - again)
        out = [b"".join(map(self.known.__getitem__, some)) for some in chunks]
        if len(self.known) > REMEMBERED:
            # What was not asked for lately is forgotten with the older half.
            self.known, self.older = {}, self.known
        return out


def _cut(ids: np.ndarray, mark: int) -> list[bytes]:
    """The runs of ids between the marks."""
    ends = (4 * np.flatnonzero(ids == mark)).tolist()
    raw = ids.tobytes()
    return [raw[i:j] for i, j in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True)]


def ranked(path: str):
    """tiktoken over the vocabulary of a tokenizer file with word ends, and the id that stands for a line end between two words.

    A word is its bytes and a control character; a token with a word end is its
    bytes and that character. Ids of the file number single bytes, single bytes
    with a word end, then results of merges in order of their priority, and every
    token comes from one merge: so taking the pair whose result has the smallest
    id is taking the first merge.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    # The printable stand-ins of bytes in such files: a byte that is printable itself, else the next character from 256 on.
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    end = model["end_of_word_suffix"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    vocabulary = model["vocab"]
    merged = [a.replace(end, "") + end if a.endswith(end) else a for a in merged]
    if len(set(merged)) < len(merged) or [vocabulary[token] for token in merged] != list(range(512, 512 + len(merged))):
        raise ValueError(f"{path}: tokens are not numbered by their merges")
    special = {token for token, number in vocabulary.items() if number >= 512 + len(merged)}
    ranks = {}
    for token, number in vocabulary.items():
        if token not in special:
            body = token.removesuffix(end) if number >= 256 else token
            ranks[bytes(byte_of[c] for c in body) + (_MARK.encode() if body != token else b"")] = number
    return tiktoken.Encoding("words", pat_str=rf"[^{_MARK}\n]+{_MARK}|\n", mergeable_ranks=ranks, special_tokens={}), ranks[b"\n"]


_READY: dict[str, WordIds] = {}


def ids_of(path: str) -> WordIds:
    if path not in _READY:
        _READY[path] = WordIds(path)
    return _READY[path]


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    named = urlparse(uri)
    return (fs.LocalFileSystem(), named.path) if named.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one file; documents are added in order."""

    def __init__(self, out, frame: int = FRAME, level: int = LEVEL):
        self.out, self.frame = out, frame
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[bytes] = []
        self.size = 0
        self.entries: list[bytes] = []
        self.keys: list[pa.Array] = []
        self.counts: list[int] = []
        self.frames: list[int] = []

    def add(self, keys: pa.Array, ids: Iterable[bytes]) -> None:
        self.keys.append(keys)
        for raw in ids:
            if self.held and self.size + len(raw) > self.frame:
                self._close_frame()
            self.held.append(raw)
            self.size += len(raw)
            self.counts.append(len(raw) // 4)
            self.frames.append(len(self.entries))

    def _close_frame(self) -> None:
        plain = b"".join(self.held)
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.entries.append(ENTRY.pack(len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._close_frame()
        sink = pa.BufferOutputStream()
        listed = pa.Table.from_arrays([pa.chunked_array(self.keys), pa.array(self.counts, pa.int64()), pa.array(self.frames, pa.int32())], names=["doc", "n", "frame"])
        with pa.ipc.new_stream(sink, listed.schema) as stream:
            stream.write_table(listed)
        packed = self.pack.compress(sink.getvalue().to_pybytes())
        self.out.write(HEAD.pack(LIST_MAGIC, len(packed)) + packed)
        entries = [*self.entries, ENTRY.pack(HEAD.size + len(packed), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = b"".join(entries) + FOOT.pack(len(entries), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(HEAD.pack(TABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Reads one file by its seek table. ``opened`` counts the data frames that were decompressed."""

    def __init__(self, source):
        self.source, size = source, source.size()
        self.opened = 0
        n, kind, magic = FOOT.unpack(self._at(size - FOOT.size, FOOT.size))
        if magic != SEEKABLE_MAGIC or kind != HAS_CHECKSUMS:
            raise ValueError("the file has no seek table at its end")
        entries = np.frombuffer(self._at(size - FOOT.size - n * ENTRY.size, n * ENTRY.size), "<u4").reshape(-1, 3).astype(np.int64)
        self.places = np.concatenate(([0], np.cumsum(entries[:, 0])))
        self.sizes, self.sums = entries[:, 1], entries[:, 2]
        listed = self._at(int(self.places[n - 1]), int(entries[-1, 0]))
        plain = zstandard.ZstdDecompressor().decompress(listed[HEAD.size :])
        self.documents = pa.ipc.open_stream(plain).read_all().combine_chunks()
        self.counts = self.documents["n"].to_numpy()
        self.frames = self.documents["frame"].to_numpy()

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def ids(self, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """(rows of the document list, their ids) for each frame that holds one of ``rows``; all rows by default."""
        rows = np.arange(len(self.counts)) if rows is None else np.unique(rows)
        for frame in np.unique(self.frames[rows]).tolist():
            plain = self.frame(frame)
            first, last = np.searchsorted(self.frames, [frame, frame + 1])
            ends = 4 * np.cumsum(self.counts[first:last])
            mine = rows[(rows >= first) & (rows < last)]
            yield mine, [plain[ends[i] - 4 * self.counts[first + i] : ends[i]] for i in (mine - first).tolist()]

    def frame(self, i: int) -> bytes:
        """Plain bytes of a data frame, after a check of their size and checksum."""
        packed = self._at(int(self.places[i]), int(self.places[i + 1] - self.places[i]))
        plain = zstandard.ZstdDecompressor().decompress(packed)
        if len(plain) != self.sizes[i] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} does not match its checksum")
        self.opened += 1
        return plain


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END, frame: int = FRAME, parts: int | None = None) -> DataFrame:
    """Write the files and, as Parquet beside them, the manifest, which is returned: (part, file, first, last, docs, tokens, frames, bytes)."""
    spark = docs.sparkSession
    rows = docs.select(quoted(key).alias("doc"), F.coalesce(quoted(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # Rows alike in key and text may be many: their place in the input deals them to several tasks.
    dealt = rows.withColumn("place", F.monotonically_increasing_id())
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartitionByRange(parts, "doc", "tie", "place").sortWithinPartitions("doc", "tie").select(F.spark_partition_id().alias("part"), "doc", "text")
    kind = rows.schema["doc"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("first", kind), T.StructField("last", kind)])
    for name in ("docs", "tokens", "frames", "bytes"):
        schema = schema.add(name, T.LongType())
    close = np.array([end], "<u4").tobytes()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = store(folder)
        encode, out, file = ids_of(tokenizer), None, None
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                if out is None:
                    part = batch.column(0)[0].as_py()
                    file = f"ids-{part:06d}-{uuid.uuid4().hex}.zst"
                    sink = where.open_output_stream(f"{path}/{file}", compression=None)
                    out, first = FrameWriter(sink, frame), batch.column(1)[0]
                with uncollected():
                    out.add(batch.column(1), [x + close for x in encode(batch.column(2).to_pylist())])
                last = batch.column(1)[batch.num_rows - 1]
        if out is not None:
            out.close()
            size = sink.tell()
            sink.close()
            # Null keys come first: the bounds that searches use are those of the other keys.
            listed = [k for column in out.keys for k in (column[0], column[-1]) if k.is_valid]
            bound = [listed[0].as_py() if first.is_valid and listed else None, last.as_py()]
            if not first.is_valid and listed:
                bound[0] = next(k for column in out.keys for k in column if k.is_valid).as_py()
            row = [part, file, *bound, len(out.counts), sum(out.counts), len(out.entries), size]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.string(), out.keys[0].type, out.keys[0].type, *[pa.int64()] * 4], strict=True)], names=schema.names)

    where, path = store(folder)
    where.create_dir(path, recursive=True)
    ordered.mapInArrow(written, schema).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, start, n, ids): every document of the files, ``start`` ids before it in all of them, ``ids`` as little-endian 32-bit numbers."""
    files = manifest(spark, folder)
    kind = files.schema["first"].dataType
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row for each task that wrote, so the window is short.
    based = files.select("part", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    dealt = based.repartitionByRange(max(1, files.count()), "part")
    schema = T.StructType([T.StructField("doc", kind), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = store(folder)
        for batch in batches:
            for file, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with where.open_input_file(f"{path}/{file}") as source:
                    reader = FrameReader(source)
                    starts = base + np.cumsum(reader.counts) - reader.counts
                    for held, ids in reader.ids():
                        some = slice(int(held[0]), int(held[-1]) + 1)
                        doc = reader.documents["doc"].slice(some.start, len(held)).combine_chunks()
                        yield pa.RecordBatch.from_arrays([doc, pa.array(starts[some]), pa.array(reader.counts[some]), pa.array(ids, pa.binary())], names=schema.names)

    return dealt.mapInArrow(rows, schema)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame, key: str) -> DataFrame:
    """(doc, n, ids) of the documents whose keys ``wanted`` holds: only the frames that hold one are read and decompressed."""
    files = manifest(spark, folder).filter("last is not null").orderBy("part").limit(MOST_FILES + 1).collect()
    if len(files) > MOST_FILES:
        raise ValueError(f"a search takes at most {MOST_FILES} files")
    names, firsts, lasts = [f["file"] for f in files], [f["first"] for f in files], [f["last"] for f in files]
    keys = wanted.select(quoted(key).alias("doc")).filter("doc is not null").distinct()
    kind = keys.schema["doc"].dataType

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, at = [], []
            for doc in batch.column(0).to_pylist():
                some = range(bisect.bisect_left(lasts, doc), bisect.bisect_right(firsts, doc))
                docs += [doc] * len(some)
                at += some
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column(0).type), pa.array(at, pa.int32())], names=["doc", "file"])

    def taken(group: pa.Table) -> pa.Table:
        where, path = store(folder)
        with where.open_input_file(f"{path}/{names[group['file'][0].as_py()]}") as source:
            reader = FrameReader(source)
            asked = pa.compute.is_in(reader.documents["doc"], value_set=group["doc"].combine_chunks())
            rows, ids = np.empty(0, int), []
            for held, some in reader.ids(np.flatnonzero(asked.to_numpy())):
                rows = np.concatenate((rows, held))
                ids += some
            return pa.Table.from_arrays([reader.documents["doc"].take(pa.array(rows)), pa.array(reader.counts[rows]), pa.array(ids, pa.binary())], names=["doc", "n", "ids"])

    at_file = keys.mapInArrow(placed, T.StructType([T.StructField("doc", kind), T.StructField("file", T.IntegerType())]))
    return at_file.groupBy("file").applyInArrow(taken, T.StructType([T.StructField("doc", kind), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())]))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read(spark, folder).select(F.col("doc").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
