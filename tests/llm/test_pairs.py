"""Similarity join, components and vector searches against brute force; the pipeline stage by stage."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from connlens.llm import collisions, jaccard, neighbours, topk
from connlens.llm.components import components


def shingle_set(text):
    words = [w.encode() for w in re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *[root[j] for j in near[i]]]) for i in range(len(rows))]
    classes = {}
    for i, r in enumerate(root):
        classes.setdefault(r, []).append(rows[i][0])
    least = {r: min([d for d in ids if d is not None], default=None) for r, ids in classes.items()}
    return sorted(((rows[i][0], least[root[i]], len(near[i])) for i in range(len(rows))), key=str)


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"w{draw.randrange(10**6)}"
    return " ".join(out)


def test_jaccard_equals_brute_force(spark, odd):
    draw = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for g in range(6):
        words = [f"g{g}x{draw.randrange(500)}" for _ in range(120)]
        rows += [(1000 + 100 * g + i, edited(draw, words, draw.randrange(4))) for i in range(25)] + [(2000 + g, " ".join(words))] * 2
    shared = " ".join(f"s{i}" for i in range(40))
    rows += [(5000 + i, shared + " " + " ".join(f"u{i}y{j}" for j in range(60))) for i in range(40)]
    rows += [(6000, "One, two"), (6001, "one two!"), (6002, "two one")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    got = sorted(((r["doc"], r["class_id"], r["n_links"]) for r in jaccard.similar(docs).collect()), key=str)
    assert got == brute(rows)
    kept = jaccard.one_of_each(docs).collect()
    assert kept[0].asDict().keys() == {"doc_id", "text", "node"}
    classes = {c for _, c, n in brute(rows) if n}
    alone = sum(1 for _, _, n in brute(rows) if not n)
    assert len(kept) == len(classes) + alone


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    draw = random.Random(6)
    words = [f"v{i}" for i in range(150)]
    rows = [(i, edited(draw, words, draw.randrange(5))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r["doc"], r["class_id"], r["n_links"]) for r in jaccard.similar(docs).collect()), key=str) == brute(rows)


def test_jaccard_of_an_empty_table(spark, none):
    assert jaccard.similar(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_signature_and_posterior():
    a, b = (" ".join(f"t{i}" for i in r) for r in (range(300), range(20, 300)))
    (x, y), _ = jaccard.signatures([a, b])
    share = np.mean(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16))
    assert abs(share - 276 / 296) < 0.08
    keep = jaccard.least_matches(0.8, 1e-6)
    n, m = 32, keep[0]
    steps = np.linspace(0, 1, 200_001)[1:-1]
    for matches, kept in ((m, True), (m - 1, False)):
        density = steps**matches * (1 - steps) ** (n - matches)
        assert (density[steps >= 0.8].sum() / density.sum() >= 1e-6) == kept


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(200, 200), (301, 300), (300, 301)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, n=400, d=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(2)
    x[50:60] = x[40]  # ties
    rows = [(i, [float(v) for v in x[i]], 1, "s") for i in range(n)]
    rows += [(500, None, 1, "s"), (520, [float("nan")] * d, 1, "s"), (540, [1.0, None] + [0.0] * (d - 2), 1, "s"), (560, [float("inf")] * d, 1, "s"), (None, [1.0] * d, 1, "s"), (580, [0.0] * d, 1, "s"), (600, [], 1, "s"), (620, [2.0], 1, "s"), (20, rows[20][1], 1, "s")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")


def reference(rows, every, k, integer, zero):
    live = [(i, v) for i, v, *_ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))]
    pad = max(len(v) for _, v in live)
    made = [(i, [math.floor(64 * c) if integer else c for c in v] + [0] * (pad - len(v))) for i, v in live]
    out = []
    for a, (i, q) in enumerate(made):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(made) if a != b)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("segment, pivots, scouts", [(8192, 64, 4096), (50, 8, 30), (50, 0, 0), (30, 3, 3)])
def test_exact_search(spark, monkeypatch, segment, pivots, scouts):
    rows, df = vectors(spark)
    real = topk.searched
    monkeypatch.setattr(topk, "searched", lambda *a: real(*a, queries=7))
    monkeypatch.setattr(topk, "segment_size", lambda *a: segment)
    monkeypatch.setattr(topk, "STEP", 16)
    got = sorted(tuple(r) for r in topk.exact_top(df, 20, 20, pivots=pivots, scouts=scouts).collect())
    assert got == reference(rows, 20, 20, True, True)


@pytest.mark.parametrize("largest, kind", [(64, np.float32), (600, np.float32), (5000, np.float64), (10**9, np.int64)])
def test_exact_search_in_every_type(spark, largest, kind):
    draw = random.Random(8)
    rows = [(i, [float(draw.randrange(-largest, largest)) / 64 for _ in range(4)]) for i in range(80)]
    assert topk._kind(largest, 4) in (kind, np.float32)
    got = sorted(tuple(r) for r in topk.exact_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20).collect())
    assert got == reference(rows, 20, 20, True, True)


def test_bounds_rule_out_most_pairs_of_separate_clusters():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16)) * 60
    x = np.floor(np.vstack([c + rng.normal(size=(500, 16)) * 4 for c in centres])).astype(np.float64)
    q, ids = x[::100], np.arange(len(x))
    bounds = topk.Bounds(x[rng.permutation(len(x))[:32]], float((x * x).sum(axis=1).max()))
    floors = np.full(len(q), -np.inf)
    places, scores, evaluated = topk.searched_segment(x, bounds.distances(x, True).T.copy(), ids, ids, q, ids[::100], floors, 20, bounds)
    assert evaluated < 0.5 * len(q) * len(x)
    for i, one in enumerate(q):
        every = x @ one
        every[i * 100] = -np.inf
        assert sorted(scores[i].tolist(), reverse=True) == sorted(every.tolist(), reverse=True)[:20] and (every[places[i]] == scores[i]).all()


def test_window_counts_equal_plain_counts():
    rng = np.random.default_rng(2)
    for n, arrays_, least in ((200, 9, 5), (64, 70, 40), (1, 3, 3), (1000, 17, 12)):
        projected, centres = rng.normal(size=(n, arrays_)), rng.normal(size=(6, arrays_))
        rank = collisions.ranks(projected)
        arrays = collisions.Arrays(projected, rank, boundaries=16)
        ends, counts, old = (np.arange(min(16, n) + 1) * n) // min(16, n), arrays.counters(6), None
        for half in (0.3, 0.5, 1.1):
            low, high = arrays.windows(centres, np.full(6, half))
            arrays.add(counts, low, high, old)
            old = low, high
            plain = np.stack([((rank >= ends[low[:, i]]) & (rank < ends[high[:, i]])).sum(axis=1) for i in range(6)])
            inside = np.stack([(np.abs(projected - c) <= half).sum(axis=1) for c in centres])
            assert (plain >= inside).all()
            over = arrays.reached(counts, least)
            assert all(arrays.members(over[i]).tolist() == np.flatnonzero(plain[i] >= least).tolist() for i in range(6))
        assert all(len(c) >= min(n, 10) for c in collisions.candidates(arrays, centres, least, min(n, 10), 0.1, 1.2))


def test_search_of_few_and_none(spark):
    _, df = vectors(spark)
    few = df.filter("vec_id in (0, 1, 2)")
    assert topk.exact_top(few, 20, 20).count() == 2 and neighbours.nearest(few, 20, 20).count() == 2
    assert topk.exact_top(df.limit(0), 20, 20).count() == 0 and neighbours.nearest(df.limit(0), 20, 20).count() == 0


def test_fewer_pivots_than_ranks(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 22)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r)[1:3] for r in topk.exact_top(df, 20, 20, pivots=3).collect())
    assert got == list(enumerate([21, *range(19, 0, -1)], 1))


def test_approximate_search_has_recall_and_exact_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = {}
    for r in neighbours.nearest(df, 20, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, x = np.array(list(data)), np.stack(list(data.values()))
    hits = []
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [-f[2] for f in found] == sorted(-f[2] for f in found)
        assert all(abs(data[q] @ data[v] - s) < 1e-12 for _, v, s in found)
        scores = x @ data[q]
        scores[ids == q] = -np.inf
        hits.append(len(set(ids[np.argsort(-scores)[:20]].tolist()) & {f[1] for f in found}) / 20)
    assert len(got) == sum(1 for i in data if i % 20 == 0) and np.mean(hits) >= 0.9


def test_approximate_search_takes_odd_rows(spark):
    rows, df = vectors(spark)
    got = sorted(tuple(r)[:3] for r in neighbours.nearest(df, 20, 20, verify=1.0).collect())
    assert got == sorted(r[:3] for r in reference(rows, 20, 20, False, False))


def test_pipeline_stages(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in stages["quality"](spark, docs, sf).select("doc_id").collect()}
    assert len(good - kept) <= 0.02 * len(good) and len(bad & kept) <= 0.05 * len(bad)
    left = stages["language"](spark, docs, sf)
    assert left.columns == docs.columns and left.count() >= 0.99 * docs.count()
    one = stages["near_duplicates"](spark, docs, sf)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, c, _ in brute_small(rows)})
    assert stages["secrets"](spark, docs, sf).count() == docs.count()


FOREIGN = [
    "La Repubblica italiana è uno Stato situato nell'Europa meridionale e il suo territorio coincide in gran parte con una regione geografica.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Все люди рождаются свободными и равными в своем достоинстве и правах.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
    "12 345 a 99 81 b 72635 c 9172 x 22 91 3 8 45 0912 7712 y 17 4", "".join(chr(33 + i * i * 7 % 91) for i in range(400)), "xQ#9~k" * 60,
]


def test_language_stage_rejects_other_languages_and_noise(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {r["doc_id"] for r in docs.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1"), "doc_id").collect()}
    odd = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language"](spark, docs.unionByName(odd), sf).select("doc_id").collect()}
    assert not {i for i in kept if i < 0} and len(clean) > 100 and len(clean - kept) <= 0.005 * len(clean)


def brute_small(rows):
    """Classes of many texts: only texts that share a shingle are compared."""
    sets = {d: shingle_set(t) for d, t in rows}
    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    pairs = {}
    for ids in by.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    root = {d: d for d in sets}
    linked = [(a, b) for (a, b), n in pairs.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return [(d, root[d], 0) for d in sets]


def test_pipeline_takes_odd_rows(spark, odd, none, sf_dir):
    labels = f"{sf_dir}"
    for docs in (odd.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit("x").alias("_score")), none.withColumn("n_chars", F.lit(1).cast("long"))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, labels).columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, labels).count()
