"""Similarity join on word shingles: MinHash candidates pruned by a Bayesian posterior, the rest verified exactly.

1. Equal texts are one node. Each text gets a MinHash signature, written once.
2. Nodes that agree on a band of values are linked to the band's smallest node;
   the components of those links are groups of candidates.
3. A group is cut into blocks; each pair of blocks is one piece of work. There
   the signatures of a pair are compared a stretch at a time, and the pair is
   dropped as soon as the posterior probability that its Jaccard similarity
   reaches the threshold falls below ``tolerance``. What is left is verified on
   the whole shingle sets. A piece of work returns, for each node, its number
   of links and one representative, never the pairs.
4. The components of the verified links are the classes.

A pair at the threshold itself is missed by all bands with probability
(1 - threshold**ROWS)**BANDS, 3e-6 at 0.8, and dropped wrongly with about
``tolerance`` at each of a few stretches.

Shingles are five words in a row, words being runs of letters and digits with
A-Z lower-cased; a text of one to four words is one shingle. Defined results: a
null text, or one without a word, has no link, its class is its own id; equal
texts are linked; a class id is the smallest id of its documents (null if none
has an id); repeated rows count as documents of their own; an empty table gives
an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.llm.common import fresh, given_back, mixed, quoted, saved, table, text_batches, tokens
from connlens.llm.components import components
from connlens.operators.spread import spread_join

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
STRETCH = 32
TOLERANCE = 1e-6
#: Nodes of a block: a piece of work reads two blocks.
BLOCK = 192
#: Keys of rows up to which they are broadcast (a digest and an id each), so that texts need not move.
FEW_KEYS = 200_000
#: Share of all rows from which the copies of one text are dealt to several tasks.
MANY_COPIES = 0.005
#: Rows put into one call of the worker function, some pieces of work together.
BUNDLE = 1000

_DRAWN = np.random.default_rng(20)
_FLIP = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHTS = [np.uint64(w) for w in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a batch of texts in order of the texts, and the text of each."""
    starts, _, word = tokens(data, marks=False)
    doc = np.searchsorted(offsets, starts, "right") - 1
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    hashes = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for j, w in enumerate(_WEIGHTS):
        hashes += word[j : j + len(hashes)] * w
    whole = np.flatnonzero(doc[: len(hashes)] == doc[WORDS - 1 :][: len(hashes)])
    hashes, owner = mixed(hashes[whole]), doc[whole]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        first = np.cumsum(count) - count
        single = [mixed(np.array([sum(int(word[first[i] + j]) * (int(_WEIGHTS[j]) + 2 * j + 2) for j in range(count[i])) & (1 << 64) - 1], np.uint64))[0] for i in short]
        hashes, owner = np.concatenate((hashes, np.array(single, np.uint64))), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def signatures(texts: list) -> tuple[list[bytes | None], list[int]]:
    """BANDS * ROWS MinHash values of 16 bits for each text, None for a text without a shingle."""
    out, sizes = [], []
    for _, n, data, offsets in text_batches(texts, 2 << 20):
        hashes, owner = shingles(data, offsets)
        count = np.bincount(owner, minlength=n)
        has = np.flatnonzero(count)
        values = np.empty((len(has), len(_FLIP)), np.uint16)
        if len(has):
            first = (np.cumsum(count) - count)[has]
            for k, (flip, times) in enumerate(zip(_FLIP, _TIMES, strict=True)):
                values[:, k] = mixed(np.minimum.reduceat((hashes ^ flip) * times, first)) >> np.uint64(48)
        raw = dict(zip(has.tolist(), (v.tobytes() for v in values), strict=True))
        out += [raw.get(i) for i in range(n)]
        sizes += count.tolist()
    return out, sizes


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each stretch, the fewest equal values that keep a pair.

    With a flat prior the posterior of the similarity after m of n equal
    values is Beta(m + 1, n - m + 1); its mass above the threshold is that of
    at most m successes in n + 1 draws.
    """
    out = []
    for n in range(STRETCH, BANDS * ROWS + 1, STRETCH):
        mass = 0.0
        for m in range(n + 1):
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
        out.append(m)
    return out


def linked(sigs: tuple[np.ndarray, np.ndarray], sets: tuple[list, list], same: bool, threshold: float, keep: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of the first block, row of the second) that reach the threshold."""
    left, right = sigs
    if not len(left) or not len(right):
        return np.empty(0, int), np.empty(0, int)
    first = np.zeros((len(left), len(right)), np.uint8)
    for k in range(STRETCH):
        first += left[:, k][:, None] == right[:, k][None, :]
    i, j = np.nonzero(first >= keep[0])
    if same:
        i, j = i[i < j], j[i < j]
    m = first[i, j].astype(np.int32)
    for s in range(1, len(keep)):
        m = m + (left[i, s * STRETCH : (s + 1) * STRETCH] == right[j, s * STRETCH : (s + 1) * STRETCH]).sum(axis=1)
        stay = m >= keep[s]
        i, j, m = i[stay], j[stay], m[stay]
    good = np.zeros(len(i), bool)
    for at, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = sets[0][a], sets[1][b]
        if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            good[at] = both / (len(x) + len(y) - both) >= threshold
    return i[good], j[good]


def _sets(texts: list) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, n, data, offsets in text_batches(texts, 2 << 20):
        hashes, owner = shingles(data, offsets)
        cuts = np.cumsum(np.bincount(owner, minlength=n))
        out += [np.unique(hashes[cuts[i - 1] if i else 0 : cuts[i]]) for i in range(n)]
    return out


def _verify(frame: pd.DataFrame, threshold: float, keep: list[int]) -> pd.DataFrame:
    """Links of the nodes of one bundle of pieces of work."""
    out = []
    for (_, a, b), piece in frame.groupby(["root", "a", "b"], sort=False):
        one = piece["block"].to_numpy() == a
        sides = [piece[one], piece[~one]] if a != b else [piece, piece]
        sigs = tuple(np.frombuffer(b"".join(s["sig"]), np.uint16).reshape(-1, BANDS * ROWS) for s in sides)
        first = _sets(list(sides[0]["text"]))
        i, j = linked(sigs, (first, first if a == b else _sets(list(sides[1]["text"]))), a == b, threshold, keep)
        nodes = [list(s["node"]) for s in sides]
        copies = [s["copies"].to_numpy() for s in sides]
        for own, other, x, y in ((0, 1, i, j), (1, 0, j, i)):
            if not len(x):
                continue
            links = np.bincount(x, copies[other][y], len(nodes[own]))
            least: dict[int, bytes] = {}
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                least[p] = min(least.get(p, nodes[other][q]), nodes[other][q])
            out += [(nodes[own][p], int(links[p]), q) for p, q in least.items()]
        # The smallest partners alone need not hold a component together; a forest does.
        out += _joined(nodes, i, j)
    return pd.DataFrame(out, columns=["node", "links", "other"])


def _joined(nodes: list[list], i: np.ndarray, j: np.ndarray) -> list[tuple]:
    """Links without a count that hold the pieces of a forest together."""
    root: dict[bytes, bytes] = {}

    def top(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(nodes[0][p]), top(nodes[1][q])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((nodes[0][p], 0, nodes[1][q]))
    return out


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc, class_id, n_links, node, leads): one row per input row.

    n_links other rows reach the threshold with it; ``node`` is the digest of
    its text; ``leads`` marks the row, or equal rows, that stand for the class.
    """
    rows = docs.select(quoted(key).alias("doc"), F.coalesce(quoted(text), F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    schema = f"node binary, doc {rows.schema['doc'].dataType.simpleString()}, n long, sig binary"

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n = signatures(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["node", "doc", "n", "sig"])
        given_back()

    signs = saved(rows.select("node", "doc", "text").mapInArrow(signed, schema), "signatures").filter("n > 0")
    nodes = saved(signs.groupBy("node").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "nodes")

    each = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    bands = nodes.select("node", "sig", each).select("node", "band", F.expr(f"substring(sig, band * {2 * ROWS} + 1, {2 * ROWS})").alias("value"))
    shared = bands.groupBy("band", "value").agg(F.min("node").alias("least"), F.count("*").alias("m")).filter("m > 1").drop("m")
    groups = components(bands.join(shared, ["band", "value"]).select(F.col("node").alias("a"), F.col("least").alias("b")))

    sized = groups.groupBy("root").agg(F.count("*").alias("m")).select("root", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = groups.join(sized, "root").join(nodes, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # The smallest id takes part in the join, so that many copies of one text do not meet in one task.
    texts = _kept(rows.select(F.col("node").alias("n2"), F.col("doc").alias("d2"), "text"), members.select(F.col("node").alias("n3"), F.col("doc").alias("d3")), ("n2", "d2"), ("n3", "d3"))
    full = members.join(texts, (F.col("node") == F.col("n2")) & F.col("doc").eqNullSafe(F.col("d2"))).groupBy("node", "root", "block", "blocks", "copies", "sig").agg(F.first("text").alias("text"))
    work = full.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "root", "block", "copies", "sig", "text", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"))
    total = sized.agg(F.sum(F.col("blocks") * F.col("blocks")).alias("n")).first()["n"] or 0
    bundles = max(1, math.ceil(total * BLOCK / BUNDLE))
    keep = least_matches(threshold, tolerance)
    found = work.groupBy(F.pmod(F.xxhash64("root", "a", "b"), F.lit(bundles)).alias("bundle")).applyInPandas(lambda frame: _verify(frame, threshold, keep), "node binary, links long, other binary")
    found = saved(found, "links")

    classes = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "doc", "copies").join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    leader = known.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("absent"), "doc", "node")).alias("leader"))
    of_node = known.join(leader, "root").select("node", "leader", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    facts = nodes.agg(F.sum("copies").alias("n")).first()
    hot = nodes.filter(F.col("copies") >= max(2, MANY_COPIES * (facts["n"] or 0))).select("node").collect()
    out = spread_join(rows.select("doc", "node"), of_node, "node", "left", hot=[bytes(r["node"]) for r in hot])
    has = F.col("n_links").isNotNull()
    leads = ~has | ((F.col("node") == F.col("leader.node")) & F.col("doc").eqNullSafe(F.col("leader.doc")))
    return out.select("doc", F.when(has, F.col("leader.doc")).otherwise(F.col("doc")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "node", leads.alias("leads"))


def _few(keys: DataFrame) -> bool:
    return keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS


def _kept(rows: DataFrame, keys: DataFrame, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """The rows whose (digest, id) is among the keys when those are few enough to be sent to the rows, else all rows."""
    if not _few(keys):
        return rows
    return rows.join(F.broadcast(keys), (F.col(own[0]) == F.col(other[0])) & F.col(own[1]).eqNullSafe(F.col(other[1])), "left_semi")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class that has links, all columns as they are; every other row stays.

    Only the keys of the rows that go are joined, so the rows that stay are not
    moved while those are few. A class of rows alike in key and text keeps one
    of them; a null text, or one without a word, stays, as does every row of an
    empty or clean table.
    """
    found = saved(similar(docs, key, text, **options).filter("n_links > 0").groupBy(F.col("node").alias("_node"), F.col("doc").alias("_doc")).agg(F.max("leads").alias("_leads"), F.count("*").alias("_n")), "judged")
    digest = fresh(docs, "_digest")
    rows = docs.withColumn(digest, F.unhex(F.md5(F.coalesce(quoted(text), F.lit("")))))

    def joined(keys: DataFrame, how: str) -> DataFrame:
        same = (rows[digest] == keys["_node"]) & quoted(key).eqNullSafe(keys["_doc"])
        return rows.join(F.broadcast(keys) if _few(keys) else keys, same, how)

    stay = joined(found.filter("not _leads or _n > 1").select("_node", "_doc"), "left_anti")
    repeated = found.filter("_leads and _n > 1").select("_node", "_doc")
    if repeated.limit(1).count():
        stay = stay.unionByName(joined(repeated, "left_semi").dropDuplicates([digest, key]))
    return stay.drop(digest)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "class_id", "n_links")


def _sql() -> str:
    """All pairs that share a shingle, then the smallest id reached over links."""
    hundred = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{hundred}'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + {WORDS - 1}], ' ')) AS g FROM d, range(1, greatest(len(w) - {WORDS - 2}, least(len(w), 1) + 1)) r(i)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n u ON x = u.doc_id JOIN n v ON y = v.doc_id WHERE c / (u.n + v.n - c) >= {THRESHOLD}),
    r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
    SELECT d.doc_id, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links FROM d"""


SQL = _sql()
