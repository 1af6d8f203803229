"""Packing: the token ids of all documents joined end to end and cut into fixed windows.

Pass 1 tokenises each text once and writes its ids with the offset inside its
task. Pass 2 sums the totals of the tasks: an exclusive prefix sum over them
turns each local offset into a global one. Fixed windows of ``size`` tokens
then cut a document into pieces; a document that crosses a window's end leaves
a boundary record (``opens``/``closes`` false) on either side.

Defined results: a null or empty text is the end token alone; repeated rows are
packed once each; an empty table gives no piece; extra columns are left out.
Only the last sequence may be shorter than ``size``.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from connlens.llm.common import Remembered, kept, quoted, saved, table

SIZE = 2048
END = 1
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks.
RANKS = "byte_bpe_50k.tiktoken"
#: Tasks of pass 1 up to which their offsets are broadcast.
MOST_TASKS = 1_000_000
#: Chunks remembered by a worker, and their characters: a chunk without a space may be long.
REMEMBERED = 500_000
CHARACTERS = 4_000_000

# One space between two other characters: no token reaches over its left side.
_GAP = re.compile(r"(?<=\S) (?=\S)")
_SPACE = re.compile(r"\s")
_MARKS = ",.;:!?"
_USUAL = re.compile("[!-~¡-¬®-ɏ]+")
_USUAL_TEXT = re.compile("[!-~¡-¬®-ɏ \n]+")
_RUNS = ("  ", "\n\n", " \n", "\n ")
#: What the splitting pattern looks ahead for: a space before other spaces. Without such it says the same without this part,
#: and needs no backtracking.
_AHEAD = r"\s+(?!\S)|"


class Ids:
    """Ids of whole texts as the tokenizers library gives them, remembered by chunk.

    The vocabulary's splitting pattern starts a new token at every single
    space between two other characters, and makes a single line end between
    two others a token of its own. So the chunks between those are encoded
    apart, each with its space, and repeated chunks only once.

    ``ranks`` may name the same vocabulary as a rank file: printable European
    characters, on whose classes all libraries agree, are then encoded by
    tiktoken, which needs a fraction of the time for equal ids. A text of those
    alone, with single spaces and line ends, is encoded whole and nothing of it
    is remembered; of other texts, the chunks of such characters.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast, self.plain = _fast(ranks) if ranks else (None, None)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self._encode(["\n"])[0]
        self.line_end_id = np.frombuffer(self.line_end, "<u4")[0]
        self.marks = dict(zip(_MARKS, self._encode(list(_MARKS)), strict=True))
        self.first = Remembered(REMEMBERED // 10, CHARACTERS // 10)
        self.later = Remembered(REMEMBERED, CHARACTERS)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: Remembered, absent: set[str], before: str) -> None:
        """Encode many chunks at once: a line end between two chunks is a token of its own.

        A mark after letters is a token of its own, too, so "word," is "word" and ",".
        """
        absent = {c for c in absent if not _loose(c)}
        marked = {c: c[-1] for c in absent if c[-1] in _MARKS and c[:-1].isalpha()}
        some = [c for c in (absent - marked.keys()) | {c[:-1] for c in marked} if c not in known]
        usual = [c for c in some if _USUAL.fullmatch(c)] if self.fast else []
        for group, fast in ((usual, True), (list(set(some) - set(usual)) if usual else some, False)):
            if not group:
                continue
            joined = "\n".join([before + c for c in group])
            ids = np.array(self.fast.encode_ordinary(joined), "<u4") if fast else np.frombuffer(self._encode([joined])[0], "<u4")
            ends = np.flatnonzero(ids == self.line_end_id).tolist()
            raw = ids.tobytes()
            known.update(zip(group, [raw[4 * i : 4 * j] for i, j in zip([0, *[e + 1 for e in ends]], [*ends, len(ids)], strict=True)], strict=True))
        known.update({c: known[c[:-1]] + self.marks[m] for c, m in marked.items()})

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        whole = [self._whole(t) for t in texts]
        others = [t for t, ids in zip(texts, whole, strict=True) if ids is None]
        found = iter(self._by_chunks(others)) if others else iter(())
        return [next(found) if ids is None else ids for ids in whole]

    def _whole(self, text: str) -> bytes | None:
        """Ids of a text of usual characters alone; None for any other."""
        if self.plain is None or not _USUAL_TEXT.fullmatch(text) or any([x in text for x in _RUNS]) or any([s in text for s in self.special]):
            return None
        return np.array(array("I", self.plain.encode_ordinary(text)), "<u4").tobytes()

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        # Special tokens are found in the whole text before it is split.
        parts = [None if any([s in t for s in self.special]) else [line.split(" ") for line in t.split("\n")] for t in texts]
        starts = [line[0] for lines in parts if lines for line in lines]
        rest = [c for lines in parts if lines for line in lines for c in line[1:]]
        starts = self.first.of(starts, lambda absent: self._learn(self.first, absent, ""))
        rest = self.later.of(rest, lambda absent: self._learn(self.later, absent, " "))
        out, i, j = [], 0, 0
        for text, lines in zip(texts, parts, strict=True):
            made = []
            for line in lines or ():
                made.append([starts[i], *rest[j : j + len(line) - 1]])
                i += 1
                j += len(line) - 1
            if lines is None:
                out += self._encode([text])
            elif any([None in ids for ids in made]):
                chunks = _GAP.split(text)
                out.append(b"".join(self._encode([chunks[0]] + [" " + c for c in chunks[1:]])))
            else:
                out.append(self.line_end.join([b"".join(ids) for ids in made]))
        return out


def _loose(chunk: str) -> bool:
    """Empty, or a space within reach of its neighbours: the chunk can't stand alone."""
    return not chunk or _SPACE.match(chunk[0]) is not None or _SPACE.match(chunk[-1]) is not None


def _fast(ranks: str):
    """Encoders by the rank file: of any text, and of texts in which no space follows another."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    pattern = public_tokenizers.PATTERN
    return tuple(tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=known, special_tokens={}) for p in (pattern, pattern.replace(_AHEAD, "")))


def ids_of(path: str, ranks: str | None = None) -> Ids:
    return kept(("packing", path, ranks), lambda: Ids(path, ranks))


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END, ranks: str | None = None, step: int = 400) -> DataFrame:
    """(part, local, key, n, ids): ids as little-endian 32-bit numbers with the end token, ``local`` tokens before it in its task."""
    rows = docs.select(quoted(key).alias("doc"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("doc", rows.schema["doc"].dataType), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    close = np.array([end], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, local = ids_of(path, ranks), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                made = [x + close for x in ids(batch.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in made], np.int64)
                before = local + np.cumsum(n) - n
                local += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(before), batch.column(0), pa.array(n), pa.array(made, pa.binary())], names=schema.names)

    return saved(rows.mapInArrow(encode, schema), "tokens")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, ranks: str | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids (binary), doc_tokens, sequence_id, offset, opens, closes."""
    rows = tokenized(docs, path, key, text, end, ranks)
    # One row per task of pass 1: as many as it had partitions, whatever the input.
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # Sixteen bytes for each task of pass 1: broadcast up to a million tasks, so that the ids need not move.
    bases = F.broadcast(bases) if totals.limit(MOST_TASKS + 1).count() <= MOST_TASKS else bases
    placed = rows.join(bases, "part").withColumn("at", F.col("base") + F.col("local"))
    last = F.expr(f"(at + n - 1) div {size}")
    first = F.expr(f"at div {size}")

    def piece(sequence):
        start = F.greatest(sequence * size - F.col("at"), F.lit(0))
        stop = F.least((sequence + 1) * size - F.col("at"), F.col("n"))
        return F.struct(
            start.alias("start"), (stop - start).alias("length"), F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int")).alias("ids"),
            sequence.alias("sequence_id"), (F.col("at") + start - sequence * size).alias("offset"), (start == 0).alias("opens"), (stop == F.col("n")).alias("closes"),
        )

    cut = placed.select(F.col("doc"), F.col("n"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return cut.select(F.col("doc").alias(key), "p.start", "p.length", "p.ids", F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset", "p.opens", "p.closes")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "opens", "closes")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), tokenizer_path(), ranks=tokenizer_path(RANKS)))
