"""Packing, pieces, secrets, licenses: against the libraries, SQL or plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from connlens.llm import licenses, packing, pieces, secrets
from connlens.llm.packing import Ids, tokenizer_path
from connlens.llm.trigrams import ANY, trigram_query

from .conftest import ODD

ALPHABET = " \n\tab'sé1.!  ▁日ß\x85 THE the"


def scribbles(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("ranks", [None, tokenizer_path(packing.RANKS)])
def test_remembered_ids_equal_the_library(ranks):
    ids = Ids(tokenizer_path(), ranks)
    texts = [t or "" for t in ODD] + scribbles(2000) + ["x <|endoftext|> y", "it's a don't", "a\n\nb", "a\nb c\nd"]
    for _ in range(2):
        for text, made in zip(texts, ids(texts), strict=True):
            assert np.frombuffer(made, "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_ids_survive_forgetting():
    ids = Ids(tokenizer_path())
    ids.later.most = ids.first.most = 5
    texts = scribbles(300, 3)
    for at in range(0, 300, 10):
        for text, made in zip(texts[at : at + 10], ids(texts[at : at + 10]), strict=True):
            assert np.frombuffer(made, "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_usual_texts_are_encoded_whole_and_leave_nothing_remembered():
    ids = Ids(tokenizer_path(), tokenizer_path(packing.RANKS))
    draw = random.Random(5)
    usual = "abcdefghijklmnop's'll'd're éßłÿƒ12²½¿«.,;!?-_()<|>$±§ \n \n"
    texts = ["".join(draw.choice(usual) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += [" ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 12))) for _ in range(300)) for _ in range(200)]
    texts += ["", " ", "\n", " a", "a ", "\na", "a\n", "shon 's 'S s's\n's", "naïve œuvre\nÇa va, 3²", "<|endoftext|>", "a <|endoftext|> b"]
    for text, made in zip(texts, ids(texts), strict=True):
        assert np.frombuffer(made, "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids, text
    plain = [re.sub(r"\s+", " ", t.replace("<|endoftext|>", "")) for t in texts[:1000] + texts[3000:]]
    fresh = Ids(tokenizer_path(), tokenizer_path(packing.RANKS))
    fresh(plain)
    assert not fresh.first and not fresh.later


def test_long_chunks_are_forgotten_by_their_characters():
    ids = Ids(tokenizer_path())
    ids.first.size = ids.later.size = 2000
    texts = ["日" * 300 + f"{i} " + "本" * 300 + str(i) for i in range(40)]
    for text in texts:
        (made,) = ids([text])
        assert np.frombuffer(made, "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
        for known in (ids.first, ids.later):
            assert sum(map(len, known)) <= 2800 and sum(map(len, known.older)) <= 2800


def test_packing_covers_every_id_once(spark, odd):
    size = 64
    rows = packing.pack(odd, tokenizer_path(), size=size).collect()
    whole = Ids(tokenizer_path()).tokenizer
    expected = sorted((i is None, i or 0, tuple(whole.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in [(r["doc_id"], r["text"]) for r in odd.collect()])
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    stream = []
    for number in sorted(by_sequence):
        parts = sorted(by_sequence[number], key=lambda r: r["offset"])
        at = 0
        for p in parts:
            assert p["offset"] == at and len(p["ids"]) == 4 * p["length"]
            at += p["length"]
            stream.append(p)
        assert at == size or number == max(by_sequence)
    found, held = [], []
    for p in stream:
        assert p["start"] == len(held) and p["opens"] == (not held)
        held += np.frombuffer(p["ids"], "<u4").tolist()
        if p["closes"]:
            assert p["doc_tokens"] == len(held)
            found.append((p["doc_id"] is None, p["doc_id"] or 0, tuple(held)))
            held = []
    assert not held and sorted(found) == expected


def test_empty_tables(spark, none):
    assert packing.pack(none, tokenizer_path()).count() == 0
    assert pieces.encoded(none, pieces.model_path()).count() == 0
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0
    assert licenses.scan(none).count() == 0


def test_pieces_equal_the_library(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    own = pieces.pieces_of(pieces.model_path())
    texts = [t or "" for t in ODD] + scribbles(3000, 2) + [" " * n for n in range(1, 40)] + ["\n" * 5, "a\nb"]
    for text, made in zip(texts, own.encode(texts), strict=True):
        ids = library.encode(text)
        assert np.frombuffer(made, np.int32).tolist() == ids, text
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids), text
    bad = [[200, 130, 131], [3 + 0xE6, 3 + 0x97], [0, 5], [259, 300]]
    assert [own.decode(np.array(b, np.int32)) for b in bad] == [library.decode(b) for b in bad]
    rows = pieces.encoded(odd, pieces.model_path()).collect()
    assert sorted((r["ids"], r["decoded"]) for r in rows) == sorted((library.encode(r["text"] or ""), library.decode(library.encode(r["text"] or ""))) for r in odd.collect())


SECRETS = [
    'Token = "abcdef123" secret: abc api_key=zzzzzz api-key=zzzzzz', "token=token=abcdefgh passwd:'x.y/z=1' é password := q12345", "AKIA" + "Z9" * 8 + " AKIAshort AKIA" + "A" * 15,
    "0123456789abcdef01234567 " + "f" * 23 + " " + "ab" * 40, "𝒳é token: " + "a1b2c3d4" * 4, "Kelvin toKen=abcdefg", "ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY-----", "token=abcdef " * 700,
]


def plain_spans(text):
    out = []
    for no, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.regex.replace("(?i:", "(?ai:"), text):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), no, m.end(), rule.kind))
    return sorted(out)


def test_secrets_equal_a_plain_scan(spark, odd):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(SECRETS)] + [(2, SECRETS[2], "s")], "doc_id long, text string, spans string").unionByName(odd.select("doc_id", "text", F.lit("s").alias("spans")))
    found = secrets.digest(secrets.scan(docs)).collect()
    expected = []
    for r in docs.collect():
        spans = plain_spans(r["text"] or "")
        base = ",".join(f"{k}:{a}:{b}" for a, n, b, k in spans if n < 3)
        expected.append((r["doc_id"], *[sum(1 for s in spans if s[1] == n) for n in range(3)], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_redaction_leaves_no_secret_and_all_else(spark, odd):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert all(not plain_spans(t) for t in out.values())
    assert out[0].endswith("secret: abc [SECRET] api-key=zzzzzz") and out[5] == SECRETS[5]
    assert sorted(map(str, secrets.redact(odd).collect())) == sorted(map(str, odd.collect()))


BODY = ["MIIEpAIBAAKCAQEA" + f"{i}+/Q" * 12 for i in range(8)]
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
#: Text before the key, the key whole, text after it.
KEYS = [
    ("a ", "\n".join([BEGIN, *BODY, "Zm9vYg==", END]), "\nthe end"), ("", "\n".join([BEGIN, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-256-CBC,0A1B", "", *BODY, END]), ""),
    ("cut off\n", "\n".join([BEGIN, *BODY, "Zm9vYg=="]), "\n\nThe quick brown fox - it runs."), ("", "\n".join([BEGIN, "Zm9v", "YmFy"]), ""),
    ('{"k": "', "\\n".join([BEGIN, *BODY, END]), '\\n"}'), ("key: |\n  ", "\n  ".join([BEGIN, *BODY, "Zm9v"]), "\nnext: 1"), ('"', f"{BEGIN} {' '.join(BODY)}", ', more"'), ("", BEGIN, " starts a key, they say"),
    ("x", "\n".join([BEGIN, BODY[0], "AKIA" + "Z" * 16 + BODY[1], "0123456789abcdef" * 2 + BODY[2], "Zm9v"]), "\n"),
]


def test_a_private_key_is_masked_whole(spark):
    docs = spark.createDataFrame([(i, a + key + b) for i, (a, key, b) in enumerate(KEYS)] + [(99, 'token = "' + KEYS[0][1] + '"')], "doc_id long, text string")
    spans = {r["doc"]: [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == "private"] for r in secrets.scan(docs).collect()}
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    for i, (a, key, b) in enumerate(KEYS):
        assert spans[i] == [(len(a), len(a + key))] and out[i] == a + "[SECRET]" + b, i
    assert out[99] == 'token = "[SECRET]"'


def test_key_marks_without_an_end_take_linear_time(spark):
    many = [(0, BEGIN * 20000), (1, BEGIN + "\n" * 200000 + "a b"), (2, BEGIN + "Zm9v " * 100000 + "-"), (3, "\n".join([BEGIN] + ["Zm9v" * (1 + i % 9) for i in range(50000)]))]
    out = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert out[0] == "[SECRET]" * 20000 and out[3] == "[SECRET]"


def test_trigram_queries():
    assert trigram_query("[0-9a-f]{24,}") == ANY and trigram_query("a.c") == ANY
    assert trigram_query("AKIA[A-Z0-9]+") == frozenset([frozenset({"aki", "kia"})])
    assert trigram_query("(foo1|bar)x?") == frozenset([frozenset({"foo", "oo1"}), frozenset({"bar"})])


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_trigram_query_holds_in_every_match(rule):
    for text in SECRETS:
        for m in re.finditer(rule.regex, text):
            low = m.group().lower()
            assert any(all(t in low for t in clause) for clause in trigram_query(rule.regex))


LICENSES = ["Under the MIT License. under-the mit  LICENSE!", "cc by nc cc by nc", "Apache License, Version 2.0", "under the mit licenses", "CĆ BY NC", "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files", "licensed under the mit license " * 300, "cc by Knc"]


def test_licenses_equal_a_plain_search(spark, odd):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(LICENSES)] + [(1, LICENSES[1], 1)], "doc_id long, text string, n_words int").unionByName(odd.select("doc_id", "text", F.lit(1).alias("n_words")))
    found = {(r["doc_id"], r["n_words"]): r for r in licenses.digest(licenses.scan(docs)).collect()}
    assert licenses.scan(docs).count() == docs.count()
    for r in docs.collect():
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lower)
        places = [(label, i) for label, phrase in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        got = found[r["doc_id"], len(words)]
        starts = [i for _, i in places]
        assert (got["n_base"], got["first_word"], got["last_word"]) == (len(places), min(starts, default=None), max(starts, default=None))
        assert got["base_labels"] == ",".join(sorted({label for label, _ in places}))
        assert set(got["base_labels"].split(",")) - {""} <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1
    assert found[5, len(LICENSES[5].split())]["labels"] == "mit"
