"""Classifiers on held-out rows, surrogates by their properties."""

import re

import numpy as np
from pyspark.sql import functions as F

from connlens.llm import language, quality, surrogates


def test_quality_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op7_quality(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(8, 1), (7, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    out = odd.withColumn("score_", quality.score_column(F.col("text"), model)).collect()
    assert len(out) == odd.count() and all(0 <= r["score_"] <= 1 for r in out)
    empty = {r["score_"] for r in out if not (r["text"] or "").strip()}
    assert len(empty) == 1
    assert none.withColumn("s", quality.score_column(F.col("text"), model)).count() == 0
    blank = quality.fit(odd, labels.limit(0))
    assert quality.score(["a", None], blank).tolist() == [0.5, 0.5]


def test_language_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = language.op4_language(spark, sf).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95


def test_language_of_odd_rows(spark, odd, none):
    model = language.fit(odd)
    assert model is not None and model.languages == ("en",)
    out = odd.withColumn("f", language.language_column(F.col("text"), model)).collect()
    for r in out:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert r["f"]["lang"] == ("en" if letter else "und") and 0 <= r["f"]["score"] <= 1
    assert language.fit(none) is None and language.predict(["abc", None], None)[0] == ["und", "und"]


def test_all_labelled_languages_are_learned(spark):
    docs = spark.createDataFrame([(i, f"text of number {i}", f"l{i:03d}") for i in range(205)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == tuple(f"l{i:03d}" for i in range(205)) and len(model.profiles) == 205


def test_windows_cover_a_text():
    raw = bytes(range(97, 123)) * 50
    assert language.windows_of(raw).tobytes().rstrip(b"\0") == raw


PRIVATE = [
    "Mail Ann.Lee9@mail.example.com, or ann.lee9@MAIL.example.com; not a@b", "Call +1 (017) 555-7713 or +1 017 555 7713 now", "Cards 4539578763621486 and 4539 5787 6362 1486, 4539578763621487", "Hosts 10.0.0.1, 10.0.0.2 and 1.2.3.4.5",
    "Mr John Smith met Mrs Smith and Mr. Smith; Herr Weiß", "Господин Иванов и Госпожа Анна Иванова", "555-12-3456 in 2024-01-02, v1.2, 12345", None, "", "nothing here",
]


def test_surrogates(spark):
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(PRIVATE)] + [(0, PRIVATE[0], "m")], "doc_id long, text string, mentions string")
    rows = surrogates.replaced(docs).collect()
    assert len(rows) == docs.count() and rows[0].asDict()["mentions"] == "m"
    out = {r["doc_id"]: r for r in rows}
    assert out[7]["text"] is None and out[8]["text"] == "" and out[9]["text"] == PRIVATE[9]
    found = {i: [(m["kind"], m["original"], m["value"]) for m in out[i]["mentions_"]] for i in out}
    one, two = found[0]
    assert one[2].lower() == two[2].lower() and one[2][0].isupper() and one[2].endswith(".com") and one[2] != one[1]
    one, two = found[1]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", one[2]) and re.sub(r"\D", "", one[2]) == re.sub(r"\D", "", two[2])

    def right(number):
        digits = [int(c) for c in number if c.isdigit()][::-1]
        return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0

    a, b, c = (m[2] for m in found[2])
    assert a == b.replace(" ", "") and right(a) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", b) and c != a
    assert len({m[2] for m in found[3]}) == len(found[3]) == 2
    john, smith_f, smith, weiss = found[4]
    assert john[2].split()[2] == smith[2].split()[1] and john[2].split()[1] in surrogates.GIVEN["m", "latin"] and weiss[2].startswith("Herr ")
    assert all(re.fullmatch(r"[А-Яа-яё ]+", m[2]) for m in found[5])
    assert [m[0] for m in found[6]] == ["social"] and "2024-01-02, v1.2, 12345" in out[6]["text"]
    for i, text in enumerate(PRIVATE):
        for _, original, value in found[i]:
            assert original not in out[i]["text"] and value in out[i]["text"], text


def test_surrogates_stay_distinct_where_space_is_short(spark):
    # A fifth of the three-digit forms are originals or taken, so some draws meet.
    few = spark.range(0, 100).select(F.lit("phone").alias("type"), F.format_string("%03d", "id").alias("norm"))
    rows = surrogates.assigned(few).collect()
    values = {r["value"] for r in rows}
    assert len(values) == 100 and not values & {r["norm"] for r in rows} and max(r["attempt"] for r in rows) > 0


def test_no_number_of_entities_fills_a_type(spark, monkeypatch):
    """More originals than values of their own length: the rest must grow."""
    monkeypatch.setitem(surrogates.GIVEN, ("m", "latin"), ["Adam"])
    monkeypatch.setitem(surrogates.SYLLABLES, "latin", ["ba", "be"])
    number = spark.range(0, 95).select(F.lit("phone").alias("type"), F.format_string("1+%02d", "id").alias("norm"))
    given = spark.range(0, 60).select(F.lit("given-m-latin").alias("type"), F.format_string("Name%d", "id").alias("norm"))
    rows = surrogates.assigned(number.unionByName(given)).collect()
    values = {(r["type"], r["value"]) for r in rows}
    assert len(rows) == len(values) == 95 + 60 and not values & {(r["type"], r["norm"]) for r in rows}
    assert all(v.startswith("1+") for t, v in values if t == "phone")


def test_a_grown_surrogate_is_shown_whole(spark, monkeypatch):
    docs = spark.createDataFrame([("Call +1 23 45 or +1 23 45, mail A@b.co",)], "text string")
    real = surrogates.assigned
    monkeypatch.setattr(surrogates, "assigned", lambda found, key: real(found, key).withColumn("attempt", F.lit(8)))
    row = surrogates.replaced(docs).first()
    values = [m["value"] for m in row["mentions"]]
    assert values[0] == values[1] and re.fullmatch(r"\+1 \d\d \d{4}", values[0]) and re.fullmatch(r"[a-z]{2}[A-Z]@[a-z]\.co", values[2])
    assert row["text"] == f"Call {values[0]} or {values[1]}, mail {values[2]}"


def test_drawn_again_entities_are_looked_up(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "see 10.0.0.1 and 10.0.0.2"), (2, "10.0.0.1"), (3, "plain")], "doc_id long, text string")
    plain = {m["original"]: m["value"] for r in surrogates.replaced(docs).collect() for m in r["mentions"]}
    real = surrogates.assigned
    monkeypatch.setattr(surrogates, "assigned", lambda found, key: real(found, key).withColumn("attempt", F.when(F.col("norm") == "10.0.0.1", 3).otherwise(0)))
    again = [(r["doc_id"], m["original"], m["value"]) for r in surrogates.replaced(docs).collect() for m in r["mentions"]]
    assert len(again) == 3 and len({v for _, o, v in again if o == "10.0.0.1"}) == 1
    for _, original, value in again:
        assert (value == plain[original]) == (original == "10.0.0.2")


def test_untitled_mentions_get_the_surrogate_of_their_name(spark):
    texts = [
        "Mr John Smith came. Smith said so, and John Smith left; Smith's hat, SMITH, Smithson.", "Mr J. Smith and Mr McDonald; Mr O'Brien met Ms Smith-Jones. McDonald, O'Brien and Jones sat.", "Mr Παπαδόπουλος here. Παπαδόπουλος there",
        "Herr von Goethe; Goethe schrieb. John Smith of another text stays", "Mr 王伟 and Mr J.R. Tolkien",
    ]
    rows = surrogates.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    out = [r["text"] for r in rows]
    john, smith = rows[0]["mentions"][0]["value"].split()[1:]
    assert out[0] == f"Mr {john} {smith} came. {smith} said so, and {john} {smith} left; {smith}'s hat, {smith.upper()}, Smithson."
    assert [m["original"] for m in rows[0]["mentions"]] == ["Mr John Smith", "Smith", "John", "Smith", "Smith", "SMITH"]
    assert not re.search(r"J\.|Smith|Jones|McDonald|Brien", out[1])
    a, b, c = re.fullmatch(r"Mr \w+\. \w+ and Mr (\w+); Mr (\w+) met Ms \w+-(\w+)\. \1, \2 and \3 sat\.", out[1]).groups()
    word = re.fullmatch(r"Mr ([Α-ω]+) here\. \1 there", out[2])
    assert len({a, b, c}) == 3 and word and "Παπ" not in out[2]
    assert re.fullmatch(r"Herr von (\w+); \1 schrieb\. John Smith of another text stays", out[3]) and "Goethe" not in out[3]
    assert re.fullmatch(r"Mr [\u4e00-\u9fff]+ and Mr \w+\.\w+\. \w+", out[4]) and "王伟" not in out[4] and "Tolkien" not in out[4]


def test_surrogates_of_an_empty_table(spark, none):
    assert surrogates.replaced(none).count() == 0


def test_memory_of_scores_stays_near_the_texts():
    import tracemalloc

    from connlens.llm import common

    texts = [" ".join(f"w{(i * j) % 977}" for j in range(1, 1200)) for i in range(700)]
    model = quality.Model(np.linspace(-1, 1, 1 << 18, dtype=np.float32), 0.1, 18)
    whole = sum(map(len, texts))
    apart = np.concatenate([quality.score([t], model) for t in texts])
    tracemalloc.start()
    scores = quality.score(texts, model)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole > 3 << 20 and scores.tolist() == apart.tolist()
    assert most < 80 << 20

    first = common.kept(("one", 1), list)
    assert common.kept(("one", 1), list) is first
    common.kept(("two",), dict)
    assert common.kept(("one", 1), list) is not first


def test_freed_memory_goes_back_when_another_operator_begins(monkeypatch):
    from connlens.llm import common

    calls = []
    real = common.given_back
    monkeypatch.setattr(common, "given_back", lambda: (calls.append(dict(common._KEPT)), real()))
    first = common.kept(("three",), list)
    assert common.kept(("three",), list) is first and calls == [{}]
    common.kept(("four",), dict)
    # What the first one left is gone before the memory is given back.
    assert calls == [{}, {}]
