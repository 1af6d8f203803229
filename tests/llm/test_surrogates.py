"""Surrogates of whole tables against a plain second version of detection, normal forms and rewriting."""

import re

import pytest
import regex

from connlens.llm import surrogates
from connlens.llm.surrogates import ANY, KINDS, MALE, FEMALE, SYLLABLES, UNIT, UNTITLED

ANY_, UNIT_, UNTITLED_ = regex.compile(ANY), regex.compile(UNIT), regex.compile(UNTITLED)
TITLE = regex.compile(rf"(?:{surrogates._TITLE})\.?\x20{surrogates._PARTICLE}")


def kind_of(m):
    """The first kind that matches a mention whole, as a plain list of expressions says."""
    if "@" in m:
        return "email"
    return next(k for k, r in (*[(k, r) for k, r in KINDS if k != "phone"], ("phone", ".*")) if regex.fullmatch(r.replace(r"(?<![\d.])", "").replace(r"(?<![\d-])", "").replace(r"(?<!\d)", ""), m))


def plain(w):
    return w.title() if len(w) > 2 and w == w.upper() != w.lower() else w


def norm_of(m, kind):
    digits = re.sub("[^0-9]", "", m)
    country = re.match(r"\+(\d{1,3})(?!\d)", m)
    if kind == "phone" and country:
        return country[1] + "+" + digits[len(country[1]) :]
    return {"email": m.lower(), "address": m}.get(kind, digits)


def words_of(m):
    """(type, unit) of each unit of a titled name."""
    title = TITLE.match(m)[0]
    units = UNIT_.findall(m[len(title) :])
    last = len(UNIT_.findall(m.split(" ")[-1]))
    word = title.rstrip(". ").split(".")[0].split(" ")[0]
    gender = "f" if word in FEMALE else "m" if word in MALE else "n"
    out = []
    for i, w in enumerate(units):
        script = next((s for s in SYLLABLES if s != "latin" and regex.search(rf"\p{{{s.capitalize()}}}", w)), "latin")
        part = "initial" if w.endswith(".") else "family" if i >= len(units) - last else f"given-{gender}"
        out.append((f"{part}-{script}", plain(w)))
    return out


def expected(text):
    """(kind, original) of every mention in order, untitled names among them."""
    titled = list(ANY_.finditer(text))
    known = {w for m in titled if kind_of(m[0]) == "name" for _, w in words_of(m[0])}
    out, at = [], 0
    for m in [*titled, None]:
        gap = text[at : m.start() if m else len(text)]
        out += [("name", u[0]) for u in UNTITLED_.finditer(gap) if len(u[0]) > 1 and plain(u[0]) in known]
        if m:
            out.append((kind_of(m[0]), m[0]))
            at = m.end()
    return out


def judged(before, after):
    """Check rewritten rows; the values of every entity."""
    values: dict[tuple, set] = {}
    for row in after:
        text = before[row["doc_id"]]
        if text is None:
            assert row["text"] is None and row["mentions"] == []
            continue
        assert [(m["kind"], m["original"]) for m in row["mentions"]] == expected(text), text[:200]
        rest = row["text"]
        for m in row["mentions"]:
            assert m["value"] in rest, (m, text[:200])
            rest = rest[rest.index(m["value"]) + len(m["value"]) :]
            if m["kind"] != "name":
                values.setdefault((m["kind"], m["kind"], norm_of(m["original"], m["kind"])), set()).add(norm_of(m["value"], m["kind"]))
                assert m["original"] not in row["text"]
            elif TITLE.match(m["original"]):
                title = TITLE.match(m["original"])[0]
                shown = UNIT_.findall(m["value"][len(title) :])
                own = UNIT_.findall(m["original"][len(title) :])
                assert m["value"].startswith(title) and len(shown) == len(own)
                for (kind, w), value, mine in zip(words_of(m["original"]), shown, own, strict=True):
                    values.setdefault(("name", kind, w), set()).add(value.title() if mine != w else value)
    return values


def checked(values):
    assert all(len(v) == 1 for v in values.values())
    found: dict[tuple, set] = {}
    for (space, kind, norm), (value,) in values.items():
        found.setdefault((space, value.lower()), set()).add((kind, norm))
    assert all(len(owners) == 1 for owners in found.values())
    originals = {(space, norm.lower()) for space, _, norm in values}
    assert not originals & found.keys()


def test_whole_table_equals_the_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    values = judged({r["doc_id"]: r["text"] for r in docs.collect()}, surrogates.replaced(docs).collect())
    checked(values)
    assert len(values) > 50


def test_many_names_stay_distinct_and_coreferent(spark):
    given, family = [f"G{a}{b}na" for a in "aeiou" for b in "bdfgk"], [f"F{a}{b}{c}mann" for a in "aeiou" for b in "lmnrs" for c in "aeiou"]
    texts = [f"{('Mr', 'Mrs', 'Dr')[i % 3]} {given[i % 25]} {family[i % 125]} met {('Mme', 'Sr.')[i % 2]} {family[i * 7 % 125]}." for i in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    values = judged(dict(enumerate(texts)), surrogates.replaced(docs).collect())
    checked(values)
    # A family name is one entity, whoever bears it; a given name is one for each gender.
    assert sum(kind.startswith("family") for _, kind, _ in values) == 125 and sum(kind.startswith("given") for _, kind, _ in values) == 75


def test_man_and_woman_of_one_family(spark):
    row = surrogates.replaced(spark.createDataFrame([("Mr Smith and Mrs Smith; Dr Jones, Mme Leroy and Sr. Gómez.",)], "text string")).first()
    a, b, *others = re.fullmatch(r"Mr (\w+) and Mrs (\w+); Dr (\w+), Mme (\w+) and Sr\. (\w+)\.", row["text"]).groups()
    assert a == b and len({a, *others}) == 4 and not re.search("Smith|Jones|Leroy|Gómez", row["text"])


def test_odd_rows_and_clashing_columns(spark, odd):
    rows = surrogates.replaced(odd.withColumnRenamed("score", "mentions")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    assert all(r["mentions"] == "s" or r["mentions"] is None for r in rows) and all(r["mentions_"] == [] for r in rows)


@pytest.mark.parametrize("n", [20_000])
def test_very_long_texts(spark, n):
    local = "a" * n
    text = f"{local}@b.co and +1 234 567 8901, " + "10.0.0.1 " * 2000 + "Mr Smith, " + "Smith, " * 2000
    row = surrogates.replaced(spark.createDataFrame([(text,)], "text string")).first()
    assert len(row["mentions"]) == 2 + 2000 + 1 + 2000 and local not in row["text"] and "Smith" not in row["text"] and "10.0.0.1 " not in row["text"]


def test_drawn_again_values_reach_every_copy(spark, monkeypatch):
    """With neither side small enough to broadcast, copies and null texts are dealt to many tasks."""
    monkeypatch.setattr(surrogates, "FEW", 0)
    monkeypatch.setitem(surrogates.SYLLABLES, "latin", ["ba", "be"])
    texts = [f"Mr N{chr(97 + i % 20)}{chr(97 + i // 20)}o spoke" for i in range(60)] + ["Mr Nabo spoke"] * 40 + [None] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    values = judged(dict(enumerate(texts)), surrogates.replaced(docs).collect())
    checked(values)
    assert len(values) == 60
