"""Merkle manifest of a dataset: a root, one tree for each group, and a proof for every row.

A leaf is the SHA-256 of its row's fields. Rows of a group stand in the order
of their keys; every two consecutive nodes (a last one alone, too) become the
hash of their digests, until one is left, the group's root. The groups' roots,
in the order of the groups, become the dataset's root in the same way.

Only every ``STEP`` levels are written. A proof needs the nodes between: each
aligned subtree of at most 2**STEP stored nodes is regenerated in one task from
those nodes, its siblings are emitted, and it is dropped. Proofs go from the
top down: a subtree gets the rest of its root's proof from the layer above.

Defined results: a null field hashes as ``-``; null keys come first, rows with
one key stand in the order of their leaves; null is a group of its own, before
all others; repeated rows are leaves of their own; an empty table has no root
and an empty result; extra columns are no part of a leaf unless named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.llm.common import quoted, remainder, saved, table
from connlens.llm.places import placed

#: Levels between two that are written.
STEP = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "tree long, pos long, size long, digest string"
_PROOFS = "tree long, pos long, subroot string, sides string, siblings array<string>"


def digest_of(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """Text of a field in a leaf: its length in bytes and itself, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_column(*values: Column) -> Column:
    return digest_of(*[field(v) for v in values])


def depth(size: Column) -> Column:
    """Levels above the leaves of a tree."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(digests: list[str], rounds: int) -> list[list[str]]:
    """The digests of an aligned subtree, then those of each level above them."""
    levels = [digests]
    for _ in range(rounds):
        below = levels[-1]
        levels.append([_hash("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def _rounds(size: int, height: int, step: int) -> int:
    return min(step, (size - 1).bit_length() - height)


def _raised(height: int, step: int):
    """Nodes of an aligned subtree to its root."""

    def raised(group: pa.Table) -> pa.Table:
        tree, pos, size = (group[c][0].as_py() for c in ("tree", "pos", "size"))
        digests = group.sort_by("pos")["digest"].to_pylist()
        top = _levels(digests, _rounds(size, height, step))[-1][0]
        return pa.table({"tree": [tree], "pos": [pos >> step], "size": [size], "digest": [top]})

    return raised


def layers(nodes: DataFrame, deepest: int, step: int = STEP) -> list[DataFrame]:
    """The nodes at heights 0, step, 2 * step, ... as written tables; a tree that ends between two has its root in the next."""
    out = [nodes]
    for height in range(0, deepest, step):
        below = out[-1].select("tree", "pos", "size", "digest").filter(depth(F.col("size")) > height)
        above = below.groupBy("tree", F.shiftright("pos", step).alias("_block")).applyInArrow(_raised(height, step), _NODES)
        out.append(saved(above, "merkle-layer"))
    return out


def roots(made: list[DataFrame], step: int = STEP) -> DataFrame:
    """(tree, digest) of each tree, from the layer in which it ends."""
    ends = [n.filter((depth(F.col("size")) <= i * step) & (depth(F.col("size")) > (i - 1) * step if i else F.lit(True))) for i, n in enumerate(made)]
    out = ends[0].select("tree", "digest")
    for n in ends[1:]:
        out = out.unionByName(n.select("tree", "digest"))
    return out


def _extracted(height: int, step: int):
    """Nodes of an aligned subtree, and what follows above its root, to the proofs of the nodes."""

    def extracted(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        rounds = max(0, _rounds(nodes["size"][0].as_py(), height, step)) if nodes.num_rows else 0
        levels = _levels(nodes["digest"].to_pylist(), rounds)[:-1]
        rest_sides, rest, subroot = (above[c][0].as_py() if above.num_rows else None for c in ("sides", "siblings", "subroot"))
        # A subtree is aligned, so places inside it decide the sides.
        sides, flat, offsets = [], [], [0]
        for j in range(nodes.num_rows):
            own = ""
            for r, level in enumerate(levels):
                at = j >> r
                if at % 2:
                    own += "l"
                    flat.append(level[at - 1])
                elif at + 1 < len(level):
                    own += "r"
                    flat.append(level[at + 1])
                else:
                    own += "-"
            flat += rest
            offsets.append(len(flat))
            sides.append(own + rest_sides)
        siblings = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.string()))
        columns = [nodes["tree"], nodes["pos"], pa.array([subroot] * len(sides), pa.string()), pa.array(sides, pa.string()), siblings]
        return pa.Table.from_arrays(columns, names=["tree", "pos", "subroot", "sides", "siblings"])

    return extracted


def proofs(made: list[DataFrame], rests: DataFrame, step: int = STEP) -> DataFrame:
    """(tree, pos, subroot, sides, siblings) of every leaf.

    ``sides`` has a letter for each level: the sibling stands on the left (l),
    on the right (r), or there is none (-). ``rests`` (tree, subroot, sides,
    siblings) is what follows above the root of each tree.
    """
    out, levels = None, depth(F.col("size"))
    for i in range(len(made) - 1, -1, -1):
        height = i * step
        # The leaves of a tree of one row are its root.
        nodes = made[i].select("tree", "pos", "size", "digest").filter((levels > height) | F.lit(i == 0))
        ending = nodes.filter((F.col("pos") == 0) & (levels <= height + step)).select("tree")
        blocks = rests.join(ending, "tree", "left_semi").select("tree", F.lit(0).cast("long").alias("pos"), "subroot", "sides", "siblings")
        blocks = blocks if out is None else blocks.unionByName(out)
        found = nodes.groupBy("tree", F.shiftright("pos", step).alias("_block")).cogroup(blocks.groupBy("tree", "pos")).applyInArrow(_extracted(height, step), _PROOFS)
        out = found if i == 0 else saved(found, "merkle-proofs")
    return out


def folded(leaf: Column, sides: Column, siblings: Column) -> Column:
    """The root that a proof leads to from ``leaf``."""

    def up(state: Column, side: Column) -> Column:
        own, other = state["digest"], F.get(siblings, state["at"])
        joined = F.when(side == "l", F.concat(other, own)).when(side == "r", F.concat(own, other)).otherwise(own)
        return F.struct(F.sha2(joined, 256).alias("digest"), (state["at"] + F.when(side == "-", 0).otherwise(1)).alias("at"))

    letters = F.filter(F.split(sides, ""), lambda s: s != "")
    return F.aggregate(letters, F.struct(leaf.alias("digest"), F.lit(0).alias("at")), up, lambda state: state["digest"])


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str, step: int = STEP) -> DataFrame:
    """``rows`` with subroot, root, sides and siblings of their leaf's proof."""
    spark = rows.sparkSession
    leaves = placed(rows, [quoted(c).asc_nulls_first() for c in [*order, leaf]], within=group)
    groups = placed(leaves.filter("pos = 0").select(quoted(group).alias("_of"), F.col("size").alias("_leaves")), [F.col("_of").asc_nulls_first()])
    # One row for each group, a few bytes beside its name.
    numbers = saved(groups.select("_of", F.col("pos").alias("tree"), "size", "_leaves"), "merkle-groups")
    facts = numbers.agg(F.count("*").alias("n"), F.max("_leaves").alias("most")).first()
    if not facts["n"]:
        return rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("subroot", "root", "sides")], F.array().cast("array<string>").alias("siblings"))
    known = numbers.select("_of", "tree")
    known = F.broadcast(known) if facts["n"] <= MOST_GROUPS else known
    named = saved(leaves.join(known, quoted(group).eqNullSafe(F.col("_of"))).drop("_of").withColumnRenamed(leaf, "digest"), "merkle-leaves")
    made = layers(named, (facts["most"] - 1).bit_length(), step)
    subroots = roots(made, step)
    # The groups' roots are the leaves of one more tree.
    tops = saved(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(facts["n"]).cast("long").alias("size"), "digest"), "merkle-subroots")
    upper = layers(tops, (facts["n"] - 1).bit_length(), step)
    root = roots(upper, step).first()["digest"]
    none = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit("").alias("subroot"), F.lit("").alias("sides"), F.array().cast("array<string>").alias("siblings"))
    above = proofs(upper, none, step).join(tops.select("pos", "digest"), "pos")
    rests = saved(above.select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "sides", "siblings"), "merkle-rests")
    found = proofs(made, rests, step)
    joined = named.withColumnRenamed("digest", leaf).drop("size").join(found, ["tree", "pos"])
    return joined.drop("tree", "pos").withColumn("root", F.lit(root))


#: Groups whose numbers are broadcast.
MOST_GROUPS = 1_000_000


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(remainder(F.col("doc_id"), 7) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    values = [F.col(c) for c in FIELDS]
    other = [c + 1 if name == "n_chars" else c for name, c in zip(FIELDS, values, strict=True)]
    rows = docs.select("doc_id", "lang", leaf_column(*values).alias("leaf"), F.when(tampered, leaf_column(*other)).alias("other"))
    found = manifest(rows, "lang", ["doc_id"], "leaf")
    proof = found.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("sides"), F.col("siblings")))
    return proof.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "siblings"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    """The trees level by level, each level a step of a recursion; crc32 bit by bit."""
    bits = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda c, b: {bits}, 4294967295::BIGINT), 4294967295)"

    def leaf(chars: str) -> str:
        return "sha256(concat(" + ", ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(strlen({v}::VARCHAR), ':', {v}) END" for v in ("doc_id", "source", "lang", chars, "text")) + "))"

    def tree(name: str, base: str) -> str:
        return f"""{name} AS ({base} UNION ALL SELECT g, h + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, h, pos // 2, n)"""

    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS u, doc_id, lang, {leaf('n_chars')} AS leaf,
      CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS other FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
    langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents) x),
    {tree('low(g, h, pos, n, digest)', 'SELECT g, 0, pos, p.n, leaf FROM p JOIN langs ON p.lang IS NOT DISTINCT FROM langs.lang').replace('FROM low(g, h, pos, n, digest)', 'FROM low')},
    {tree('top(g, h, pos, n, digest)', 'SELECT 0::BIGINT, 0, langs.g, langs.n, low.digest FROM langs JOIN low ON low.g = langs.g AND low.n = 1').replace('FROM top(g, h, pos, n, digest)', 'FROM top')},
    heights AS (SELECT DISTINCT 0 AS stage, g, h, n FROM low WHERE n > 1 UNION ALL SELECT DISTINCT 1, g, h, n FROM top WHERE n > 1),
    steps AS (SELECT u, k.stage, k.h, CASE WHEN s.digest IS NULL THEN '-' WHEN ((p.pos >> k.h) & 1) = 1 THEN 'l' || s.digest ELSE 'r' || s.digest END AS e
      FROM p JOIN langs l ON p.lang IS NOT DISTINCT FROM l.lang JOIN heights k ON k.stage = 0 AND k.g = l.g LEFT JOIN low s ON s.g = l.g AND s.h = k.h AND s.pos = xor(p.pos >> k.h, 1)
      UNION ALL SELECT u, k.stage, k.h, CASE WHEN s.digest IS NULL THEN '-' WHEN ((l.g >> k.h) & 1) = 1 THEN 'l' || s.digest ELSE 'r' || s.digest END
      FROM p JOIN langs l ON p.lang IS NOT DISTINCT FROM l.lang JOIN heights k ON k.stage = 1 LEFT JOIN top s ON s.h = k.h AND s.pos = xor(l.g >> k.h, 1)),
    proof AS (SELECT u, list(e ORDER BY stage, h) AS es FROM steps GROUP BY u),
    r AS (SELECT p.doc_id, p.leaf, low.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, coalesce(es, []) AS es, other
      FROM p JOIN langs l ON p.lang IS NOT DISTINCT FROM l.lang JOIN low ON low.g = l.g AND low.n = 1 LEFT JOIN proof USING (u)),
    f AS (SELECT *, list_reduce(es, lambda a, s: sha256(CASE s[1] WHEN 'l' THEN s[2:] || a WHEN 'r' THEN a || s[2:] ELSE a END), other) AS folded_root FROM r)
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(es, lambda s: CASE WHEN s = '-' THEN '' ELSE s[2:] END), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""


SQL = _sql()
