"""Token files, Merkle manifest and resampling against the libraries or plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from connlens.llm import merkle, resampling, token_files
from connlens.llm.places import placed
from connlens.llm.token_files import FrameReader, WordIds, tokenizer_path
from connlens.session import scratch_path

from .conftest import ODD

ALPHABET = " \n\tab'sé1.!, ▁日ß\x85 THE\x01\x1c\u0301\u200dΣσİ ﬁ가<|endoftext|>"


def scribbles(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def words():
    return WordIds(tokenizer_path())


def test_word_ids_equal_the_library(words):
    texts = [t or "" for t in ODD] + scribbles(3000) + ["x <|endoftext|> y<|startoftext|>,", "it's a don't we'll", "a, b. Word, <|ENDOFTEXT|>", "Straße ÀÉ İstanbul"]
    for _ in range(2):
        for text, made in zip(texts, words(texts), strict=True):
            assert np.frombuffer(made, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_ranked_words_equal_the_library(words):
    vocabulary = [w.replace("</w>", "") for w in words.tokenizer.get_vocab() if w.replace("</w>", "").isascii()]
    draw = random.Random(4)
    texts = vocabulary + ["".join(draw.choices(vocabulary, k=draw.randint(2, 4))) for _ in range(20_000)]
    assert words(texts) == words._encode(texts)


def test_word_ids_survive_forgetting(words, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 5)
    texts = scribbles(300, 3)
    for at in range(0, 300, 10):
        assert words(texts[at : at + 10]) == words._encode(texts[at : at + 10])


def test_token_files_give_back_every_id(spark, odd, words):
    folder = scratch_path(spark, "test-files")
    known = token_files.write(odd, folder, tokenizer_path(), frame=2000, parts=3)
    rows = odd.collect()
    expected = sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(words.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in rows)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n"]
        at += r["n"]
    assert [r["doc"] for r in got] == sorted((r["doc_id"] for r in rows), key=lambda d: (d is not None, d or 0))
    assert sorted((r["doc"] is not None, r["doc"] or 0, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == expected
    files = known.collect()
    assert sum(f["docs"] for f in files) == len(rows) and sum(f["tokens"] for f in files) == at and max(f["frames"] for f in files) > 1
    where, path = token_files.store(folder)
    for f in files:
        with where.open_input_file(f"{path}/{f['file']}") as source:
            assert source.size() == f["bytes"]
            # A plain reader that knows nothing of the lists gets all ids of the file in order.
            plain = zstandard.ZstdDecompressor().stream_reader(source.read(), read_across_frames=True).read()
            ids = b"".join(x for _, some in FrameReader(source).ids() for x in some)
            assert plain == ids and len(ids) == 4 * f["tokens"]


def test_fetch_opens_only_frames_asked_for(spark, odd):
    folder = scratch_path(spark, "test-files")
    token_files.write(odd, folder, tokenizer_path(), frame=1, parts=1)
    wanted = spark.createDataFrame([(4, "x"), (8, "x"), (8, "y"), (None, "x"), (77, "x")], "doc_id long, n string")
    all_rows = {(r["doc"], r["ids"]) for r in token_files.read(spark, folder).collect()}
    got = token_files.fetch(spark, folder, wanted, "doc_id").collect()
    assert sorted(r["doc"] for r in got) == [4, 8, 8] and all((r["doc"], r["ids"]) in all_rows and len(r["ids"]) == 4 * r["n"] for r in got)
    where, path = token_files.store(folder)
    file = token_files.manifest(spark, folder).first()["file"]
    with where.open_input_file(f"{path}/{file}") as source:
        reader = FrameReader(source)
        held = list(reader.ids(np.array([2, 5])))
        assert reader.opened == 2 and [r.tolist() for r, _ in held] == [[2], [5]]


def test_damaged_frame_is_found(spark, odd):
    folder = scratch_path(spark, "test-files")
    token_files.write(odd, folder, tokenizer_path(), parts=1)
    where, path = token_files.store(folder)
    file = f"{path}/{token_files.manifest(spark, folder).first()['file']}"
    with where.open_input_file(file) as source:
        raw = bytearray(source.read())
    raw[40] ^= 1
    with where.open_output_stream(file, compression=None) as out:
        out.write(bytes(raw))
    with where.open_input_file(file) as source, pytest.raises((ValueError, zstandard.ZstdError)):
        FrameReader(source).frame(0)


def test_token_files_of_an_empty_table(spark, none):
    folder = scratch_path(spark, "test-files")
    assert token_files.write(none, folder, tokenizer_path()).count() == 0
    assert token_files.read(spark, folder).count() == 0
    assert token_files.fetch(spark, folder, none, "doc_id").count() == 0


def test_store_names_file_systems():
    assert isinstance(token_files.store("/a/b")[0], fs.LocalFileSystem) and token_files.store("file:/a/b")[1] == "/a/b" and token_files.store("file:///a/b")[1] == "/a/b"


def test_places_within_groups(spark):
    draw = random.Random(7)
    rows = [(draw.choice(["a", None, "b"] + ["hot"] * 9), draw.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, size_ int").repartition(5)
    got = placed(df, [F.col("v").desc()], within="g").collect()
    for g in ("a", None, "b", "hot"):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["pos"])
        assert [r["pos"] for r in mine] == list(range(len(mine))) and [r["v"] for r in mine] == sorted((v for x, v, _ in rows if x == g), reverse=True)
        assert all(r["size"] == len(mine) for r in mine)
    assert sorted(r["pos"] for r in placed(df, [F.col("v")]).collect()) == list(range(500))
    assert placed(df.limit(0), [F.col("v")]).count() == 0


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def raised(nodes):
    return [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def siblings(nodes, at):
    out = []
    while len(nodes) > 1:
        out += [("l" if at % 2 else "r", nodes[at ^ 1])] if at ^ 1 < len(nodes) else [("-", None)]
        nodes, at = raised(nodes), at // 2
    return nodes[0], out


def test_merkle_equals_plain_trees(spark):
    draw = random.Random(9)
    groups = {None: 1, "": 3, "a": 33, "b": 8, "é": 2, "z": 70}
    rows = [(g, draw.randrange(60) if draw.random() < 0.9 else None, f"{draw.random()}", "x") for g, n in groups.items() for _ in range(n)]
    rows += [rows[50], rows[50]]
    df = spark.createDataFrame([(g, k, h(t), e) for g, k, t, e in rows], "lang string, doc_id long, leaf string, tree string").withColumnRenamed("tree", "more")
    ordered = {g: sorted(((k is not None, k or 0, h(t)) for x, k, t, _ in rows if x == g)) for g in groups}
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = []
    for g in names:
        tops.append(siblings([leaf for *_, leaf in ordered[g]], 0)[0])
    root = siblings(tops, 0)[0]
    expected = []
    for g in names:
        leaves = [leaf for *_, leaf in ordered[g]]
        for i, (has, k, leaf) in enumerate(ordered[g]):
            subroot, own = siblings(leaves, i)
            proof = own + siblings(tops, names.index(g))[1]
            expected.append((str(g), k if has else None, leaf, subroot, root, "".join(s for s, _ in proof), [d for _, d in proof if d]))
    for step in (2, 3, 10):
        got = merkle.manifest(df, "lang", ["doc_id"], "leaf", step=step).withColumn("back", merkle.folded(F.col("leaf"), F.col("sides"), F.col("siblings"))).collect()
        assert sorted([(str(r["lang"]), r["doc_id"], r["leaf"], r["subroot"], r["root"], r["sides"], r["siblings"]) for r in got], key=str) == sorted(expected, key=str)
        assert all(r["back"] == root and r["more"] == "x" for r in got)


def test_merkle_leaf_and_few_rows(spark, odd, none):
    rows = odd.withColumn("leaf", merkle.leaf_column(F.col("doc_id"), F.col("text")))
    for r in rows.collect():
        text = "-" if r["text"] is None else f"{len(r['text'].encode())}:{r['text']}"
        assert r["leaf"] == h("-" if r["doc_id"] is None else f"{len(str(r['doc_id']))}:{r['doc_id']}", text)
    assert merkle.manifest(rows, "lang", ["doc_id"], "leaf").count() == rows.count()
    assert merkle.manifest(none.withColumn("leaf", F.lit("")), "lang", ["doc_id"], "leaf").count() == 0
    one = merkle.manifest(rows.filter("doc_id = 4"), "lang", ["doc_id"], "leaf").first()
    assert one["subroot"] == one["root"] == one["leaf"] and one["sides"] == "" and one["siblings"] == []


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_runs(text, runs):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + j]).encode()) for j in range(1, runs + 1) for i in range(len(w) - j + 1)]


def drawn(rows, target, runs, buckets, percent, least):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for c in plain_runs(text, runs):
                counts[c % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for d, text in rows:
        noise = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        made = plain_runs(text, runs)
        weight = sum(gain[c % buckets] for c in made)
        out.append([d, len(plain_words(text)), len(made), weight, weight + math.floor(-1000 * math.log(-math.log((noise + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    wanted = percent * len(able) // 100
    return sorted(([*r, None] for r in out), key=str), [(r[4], r[0]) for r in able[:wanted]]


@pytest.mark.parametrize("runs, accuracy, percent", [(1, 10_000, 10), (2, 10, 37), (1, 3, 100)])
def test_resampling_equals_plain_python(spark, odd, runs, accuracy, percent):
    draw = random.Random(runs)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows += [(100 + i, " ".join(f"{draw.choice('AbÉ')}{draw.randrange(50)}" for _ in range(draw.randrange(60)))) for i in range(300)] + [(900, "same " * 30)] * 40
    target = [None, "", " ".join(f"b{i % 20}" for i in range(200))]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string")
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resampling.resample(docs, goal, runs=runs, buckets=500, percent=percent, accuracy=accuracy).collect()
    every, best = drawn(rows, target, runs, 500, percent, 20)
    assert sorted(([*r[:5], None] for r in got), key=str) == every
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(best) + 1)) and [(r["score"], r["doc"]) for r in ranked] == best


def test_resampling_of_none_and_towards_none(spark, odd, none):
    assert resampling.resample(none, odd).count() == 0
    got = resampling.resample(odd, none).collect()
    assert len(got) == odd.count() and sum(r["rank"] is not None for r in got) == sum(len(plain_words(t["text"])) >= 20 for t in odd.collect()) * 10 // 100


def test_bracket_is_widened_until_it_holds_the_rank(spark):
    df = spark.createDataFrame([(int(x),) for x in np.random.default_rng(1).zipf(1.5, 3000)], "score long")
    values = sorted((r["score"] for r in df.collect()), reverse=True)
    for wanted in (1, 2, 50, 1500, 2999, 3000):
        low, high, above = resampling.bracket(df, wanted, 3000, accuracy=20)
        assert low <= values[wanted - 1] <= high and above == sum(v > high for v in values) < wanted
