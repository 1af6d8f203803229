"""Secret scan over a trigram inverted index.

Each rule's expression gives a Boolean trigram query. The index holds the
postings (trigram, document) of the trigrams that some query names; joined with
the queries' clauses, a document that meets all trigrams of a clause becomes a
candidate of its rule. Only candidates are verified with the expression; rules
without mandatory trigrams are run on every text.

Defined results: a null text is empty and has no span; spans count code points,
the end is exclusive; equal spans of one kind are one; repeated rows are scanned
alike and stay as many; an empty table gives an empty result; extra columns are
left out by ``scan`` and kept by ``redact``. Texts may have any length: the
work on one text grows with its length alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.llm.common import fresh, quoted, saved, table, with_value
from connlens.llm.trigrams import ANY, trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    least: int = 1  # characters that ``group`` must have
    group: int = 0


#: The first three kinds, in this order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # A run of 24 or more is a whole run, so this finds what [0-9a-f]+ of that length finds.
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE = (
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    # Up to the END line; where that is missing, to the last long run or whole line of base64 characters. No class takes a dash
    # of the marks, so each try ends before the next mark and a long text stays linear.
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[ \t\r\n\\rn]*(?:Proc-Type|DEK-Info):[ \t]*[A-Za-z0-9,-]*){0,2}(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----|(?:[A-Za-z0-9+/=\\ \t\r\n]*[A-Za-z0-9+/]{32}={0,2})?(?:[ \t\r\n]*[A-Za-z0-9+/=\\][A-Za-z0-9+/=\\\r\n]*[A-Za-z0-9+/=](?m:$))?)"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE
#: Candidates up to which they are broadcast: a hash, an id and the names of some rules each.
FEW = 200_000
#: Matches whose starts are summed one after the other before a step over whole groups of them.
GROUP = 256


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, text, h): h tells rows apart that share a key; equal rows have equal results."""
    rows = docs.select(quoted(key).alias("doc"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    return rows.withColumn("h", F.xxhash64("doc", "text"))


def postings(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc, h, trigram) for the trigrams of ``vocabulary`` that a lower-cased text holds."""
    held = with_value(F.lower("text"), lambda low: F.filter(F.array(*[F.lit(t) for t in vocabulary]), lambda t: F.contains(low, t)))
    return rows.select("doc", "h", F.explode(held).alias("trigram"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(doc, h, kinds): rules whose trigram query a document meets."""
    clauses = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(sorted(trigram_query(r.regex), key=sorted)) for t in sorted(c) if c]
    if not clauses:
        return None
    asked = rows.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, size int")
    found = postings(rows, sorted({c[2] for c in clauses}))
    # The clauses are as many as the rules' trigrams, whatever the input.
    met = found.join(F.broadcast(asked), "trigram").groupBy("doc", "h", "kind", "clause", "size").agg(F.count_distinct("trigram").alias("n"))
    return saved(met.filter("n = size").groupBy("doc", "h").agg(F.collect_set("kind").alias("kinds")), "candidates")


def sent(found: DataFrame) -> DataFrame:
    """Candidates for a join with their texts: while they are few they are sent to the texts, which then don't move."""
    return F.broadcast(found) if found.limit(FEW + 1).count() <= FEW else found


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct(start, stop, keep)> of all leftmost matches, the starts as running sums over gaps and matches."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)).alias("w"), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)).alias("p"),
        F.split(text, rule.regex, -1).alias("g"),
    )

    def sizes(x: Column) -> Column:
        return F.transform(x["w"], lambda w, i: F.struct(
            (F.length(F.get(x["g"], i)) + F.when(i > 0, F.length(F.get(x["w"], i - 1))).otherwise(0)).alias("step"),
            F.length(w).alias("n"), (F.length(F.get(x["p"], i)) >= rule.least).alias("keep")))

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("long"), lambda a, s: a + s["step"])

    def placed(groups: Column) -> Column:
        sums = F.transform(groups, lambda g: F.struct(total(g).alias("step")))
        return with_value(sums, lambda s: F.flatten(F.transform(groups, lambda g, c: with_value(
            F.struct(g.alias("g"), total(F.slice(s, 1, c)).alias("base")),
            lambda b: F.transform(b["g"], lambda m, i: with_value(
                b["base"] + total(F.slice(b["g"], 1, i + 1)), lambda at: F.struct(at.alias("start"), (at + m["n"]).alias("stop"), m["keep"].alias("keep"))))))))

    def body(x: Column) -> Column:
        groups = F.sequence(F.lit(0), F.floor((F.size(x["w"]) - 1) / GROUP).cast("int"))
        return with_value(sizes(x), lambda items: with_value(F.transform(groups, lambda c: F.slice(items, c * GROUP + 1, GROUP)), placed))

    none = F.array().cast("array<struct<start:bigint,stop:bigint,keep:boolean>>")
    return with_value(found, lambda x: F.when(F.size(x["w"]) > 0, body(x)).otherwise(none))


def verified(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` with array<struct(start, no, stop, kind)> in order of start, then rule."""
    scanned = [r for r in rules if trigram_query(r.regex) == ANY]
    indexed = [r for r in rules if r not in scanned]
    found = candidates(rows, tuple(indexed))
    if found is None:
        joined = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    else:
        # No null key on either side, so the join needs no null-safe comparison.
        side = sent(found.select(F.col("h").alias("h2"), F.col("doc").alias("doc2"), "kinds"))
        joined = rows.join(side, (F.col("h") == F.col("h2")) & F.col("doc").eqNullSafe(F.col("doc2")), "left").drop("h2", "doc2")
    none = F.array().cast("array<struct<start:bigint,no:int,stop:bigint,kind:string>>")

    def of(no: int, rule: Rule) -> Column:
        gate = F.col("text").rlike(rule.regex) if rule in scanned else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        kept = F.filter(_spans(F.col("text"), rule), lambda s: s["keep"])
        shaped = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["stop"].alias("stop"), F.lit(rule.kind).alias("kind")))
        return F.when(gate, shaped).otherwise(none)

    return joined.withColumn("spans", F.array_sort(F.concat(*[of(i, r) for i, r in enumerate(rules)])))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, spans): one row per input row, spans as array<struct(start, no, stop, kind)>."""
    return verified(keyed(docs, key, text), rules).select("doc", "spans")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mask``; all columns and rows stay, a null text stays null.

    The candidates come from the index; a candidate's kinds are replaced one
    after the other, whole keys first and the rest in the rules' order: the mask
    of a shorter secret would hide where a key starts or cut its body.
    """

    def masked(least: int):
        return lambda x: F.array_join(F.transform(x["g"], lambda g, i: F.concat(g, F.coalesce(F.when(F.length(F.get(x["p"], i)) >= least, F.lit(mask)).otherwise(F.get(x["w"], i)), F.lit("")))), "")

    h, side = fresh(docs, "_h"), "_h_side"
    rows = keyed(docs, key, text)
    scanned = [r for r in rules if trigram_query(r.regex) == ANY]
    found = candidates(rows, tuple(r for r in rules if r not in scanned))
    plain = docs.withColumn(h, F.xxhash64(quoted(key), F.coalesce(quoted(text), F.lit(""))))
    kinds = fresh(plain, "_kinds")
    if found is None:
        joined = plain.withColumn(kinds, F.lit(None).cast("array<string>"))
    else:
        while side.lower() in {c.lower() for c in plain.columns}:
            side += "_"
        other = sent(saved(found.groupBy(F.col("h").alias(side)).agg(F.array_distinct(F.flatten(F.collect_set("kinds"))).alias(kinds)), "candidates"))
        joined = plain.join(other, plain[h] == other[side], "left").drop(side)
    for rule in sorted(rules, key=lambda r: r.kind != "private"):
        value = quoted(text)
        gate = value.rlike(rule.regex) if rule in scanned else F.coalesce(F.array_contains(quoted(kinds), rule.kind), F.lit(False))
        parts = F.struct(
            F.split(value, rule.regex, -1).alias("g"), F.regexp_extract_all(value, F.lit(rule.regex), F.lit(0)).alias("w"),
            F.regexp_extract_all(value, F.lit(rule.regex), F.lit(rule.group)).alias("p"),
        )

        joined = joined.withColumn(text, F.when(gate, with_value(parts, masked(rule.least))).otherwise(value))
    return joined.select(*[quoted(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    spans, base = F.col("spans"), [r.kind for r in BASE]

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number(k) for k in base]
    own = F.filter(spans, lambda s: s["kind"].isin(base))
    return found.select(F.col("doc").alias("doc_id"), *count, F.sha2(shown(own), 256).alias("base_sha256"), shown(spans).alias("spans"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


def _sql() -> str:
    """The same spans by plain scans of every text."""
    letters = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    parts = []
    for no, rule in enumerate(RULES):
        regex = rule.regex.replace("(?i:(password|passwd|secret|token|api_?key))", letters).replace("'", "''")
        parts.append(f"""
        SELECT doc_id, {no} AS no, '{rule.kind}' AS kind, w, g, i,
               list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS start, length(w[i]) AS n
        FROM (SELECT doc_id, regexp_extract_all(t, '{regex}') AS w, regexp_extract_all(t, '{regex}', {rule.group}) AS p, string_split_regex(t, '{regex}') AS g FROM d), range(1, len(w) + 1) r(i)
        WHERE length(p[i]) >= {rule.least}""")
    shown = "kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({" UNION ALL ".join(parts)}),
    a AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
          string_agg({shown}, ',' ORDER BY start, no) FILTER (no < 3) AS base, string_agg({shown}, ',' ORDER BY start, no) AS spans FROM s GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


SQL = _sql()
