"""SentencePiece encoding and decoding by a prefix table of last tokens.

The result of the merges on a text is the one sequence of tokens in which every
two neighbours stay apart when merged alone. So each prefix has one last token:
among the vocabulary's tokens that end there (found by an automaton), the one
that is compatible with the last token of the prefix before it. One pass from
the left fills that table, and the ids are read back from the end.

No token of such a vocabulary holds a space mark after another character, so a
text is handled in units (marks, then other characters), and equal units once.

Defined results: a null or empty text has no ids and decodes to an empty text;
repeated rows get equal results; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from connlens.llm.common import Remembered, quoted, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Units, and pairs, remembered by a worker.
REMEMBERED = 350_000

_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """Vocabulary and prefix tables of one model file (merges, byte fallback, unchanged characters, a leading mark)."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.unknown = model.unk_id()
        self.byte = {int(self.surface[i][3:5], 16): i for i in range(len(self.surface)) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        normal = [i for i in range(len(self.surface)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id = {self.surface[i]: i for i in normal}
        self.score = {self.surface[i]: model.get_score(i) for i in normal}
        if any(MARK in t.lstrip(MARK) for t in self.id):
            raise ValueError("a token holds a space mark after another character; units are not apart")
        self.line_end_apart = not any("\n" in t for t in self.id)
        self.automaton = ahocorasick.Automaton()
        for token in self.id:
            self.automaton.add_word(token, (token, len(token)))
        self.automaton.make_automaton()
        self.shown = [self._shown(i) for i in range(len(self.surface))]
        self.whole = {t for t in self.id if self.merged(t) == [t]}
        self.inside = {t[i : i + 2] for t in self.id for i in range(len(t) - 1)}
        held = {c for t in self.id for c in t}
        self.stop = next(c for c in map(chr, [10, *range(0x110000)]) if c not in held)
        self.apart: dict[tuple[str, str], bool] = {}
        self.units = Remembered(REMEMBERED)

    def _shown(self, i: int) -> str:
        token = self.surface[i]
        if i == self.unknown:
            return " ⁇ "
        return token.replace(MARK, " ") if token in self.id else ""

    def merged(self, text: str) -> list[str]:
        """Merges on a short text: the best-scored neighbours first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) > REMEMBERED:
                self.apart = {}
            known = self.apart[pair] = self.merged(left + right) == [left, right]
        return known

    def last_tokens(self, text: str) -> list[str]:
        """Last token of every prefix of a non-empty text."""
        table: list[str | None] = [None] * len(text)
        apart = self.apart
        for end, (token, size) in self.automaton.iter(text):
            if table[end] is None:
                before = end - size
                if before < 0:
                    if token in self.whole:
                        table[end] = token
                else:
                    left = table[before] or text[before]
                    known = apart.get((left, token))
                    if known or known is None and self.compatible(left, token):
                        table[end] = token
        # A character outside the vocabulary stands alone.
        return [token or c for token, c in zip(table, text, strict=True)]

    def split(self, text: str) -> list[str]:
        """Tokens of a text, read back from its end."""
        table, out, end = self.last_tokens(text), [], len(text)
        while end:
            token = table[end - 1]
            out.append(token)
            end -= len(token)
        return out[::-1]

    def _learn(self, units: set[str]) -> None:
        """Prefix tables of many units at once, parted by a character that no token holds.

        No merge reaches over two neighbours that no token holds, so a last character is set apart where that is so.
        """
        known, ids, held = self.units, self.id, []
        odd = {u for u in units if self.stop in u}
        cut = {u for u in units - odd if len(u) > 1 and u[-2:] not in self.inside}
        some = [u for u in (units - odd - cut) | {u[:-1] for u in cut} | {u[-1] for u in cut} if u not in known]
        place = iter(some)
        for token in [*self.split(self.stop.join(some)), self.stop] if some else ():
            if token == self.stop:
                known[next(place)] = array("i", held).tobytes()
                held = []
            elif token in ids:
                held.append(ids[token])
            else:
                held += self._outside(token)
        known.update({u: known[u[:-1]] + known[u[-1]] for u in cut})
        for u in odd:
            known[u] = array("i", [i for t in self.split(u) for i in ([ids[t]] if t in ids else self._outside(t))]).tobytes()

    def _outside(self, character: str) -> list[int]:
        return [self.byte.get(b, self.unknown) for b in character.encode("utf-8")] if self.byte else [self.unknown]

    def _units(self, text: str) -> list[str]:
        """Marks and the characters up to the next mark; a line end outside the vocabulary is a unit, too."""
        out: list[str] = []
        for i, line in enumerate(text.replace(MARK, " ").split("\n") if self.line_end_apart else [text]):
            if i:
                out.append("\n")
            chunks = line.split(" ")
            if all(chunks):
                out.append(chunks[0] if i else MARK + chunks[0])
                out += [MARK + c for c in chunks[1:]]
            else:
                out += _UNIT.findall((line if i else MARK + line).replace(" ", MARK))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """32-bit ids of whole texts."""
        units, cuts = [], [0]
        for text in texts:
            units += self._units(text) if text else []
            cuts.append(len(units))
        ids = self.units.of(units, self._learn)
        return [b"".join(ids[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids: bytes put together, the leading space taken off."""
        bounds = self._byte_runs(ids)
        if not bounds:
            text = "".join([self.shown[i] for i in ids.tolist()])
        else:
            out, at, every = [], 0, ids.tolist()
            for start, stop in bounds:
                out += [self.shown[i] for i in every[at:start]]
                out.append(_text_of_bytes(bytes(self.byte_of[i] for i in every[start:stop])))
                at = stop
            text = "".join(out + [self.shown[i] for i in every[at:]])
        return text[1:] if text[:1] == " " and self.surface[ids[0]].startswith(MARK) else text

    def _byte_runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        if not self.byte or not len(ids):
            return []
        is_byte = (ids >= min(self.byte_of)) & (ids <= max(self.byte_of))
        change = np.flatnonzero(np.diff(is_byte.astype(np.int8), prepend=0, append=0))
        return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def _text_of_bytes(raw: bytes) -> str:
    """UTF-8, with one replacement character for each byte that is not part of a character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


_READY: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _READY:
        _READY[path] = Pieces(path)
    return _READY[path]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", step: int = 400) -> DataFrame:
    """(key, ids array<int>, decoded string) of every text, in one narrow pass."""
    rows = docs.select(quoted(key).alias(key), F.coalesce(quoted(text), F.lit("")).alias("text" if key != "text" else "text_"))
    schema = T.StructType([T.StructField(key, rows.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                ids = [np.frombuffer(x, np.int32) for x in pieces.encode(batch.column(1).to_pylist())]
                offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array([pieces.decode(x) for x in ids], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encoded(table(spark, sf_dir, "documents"), model_path())
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
