"""License scan by diagonal voting.

Every rolling run of three words of every text is joined, by its hash, with the
places of equal runs in the templates. A match votes for the diagonal (place in
the text minus place in the template); neighbouring diagonals are merged, and a
merged span names its template's label when enough of the template's runs are
in it. A phrase stands whole where a diagonal holds all its runs.

Defined results: a null text is empty, a text of fewer than three words has no
run and no label; repeated rows give equal rows, as many; an empty table gives
an empty result; extra columns are left out. Texts may have any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from connlens.llm.common import quoted, table, with_value

RUN = 3
#: Share of a template's runs that a span must hold.
ENOUGH = 0.8
#: Words inserted or left out between two diagonals that are still one span.
DRIFT = 3

#: Phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Lines of well-known licenses.
MORE = (
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl", "mozilla public license version 2 0"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0 universal"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
)
#: Words: what is left between these characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates(spark: SparkSession, base=BASE, more=MORE) -> DataFrame:
    """(run, at, template, label, runs, base): every run of every template; as many rows as the templates have words."""
    rows = []
    for no, (label, text) in enumerate((*base, *more)):
        words = text.split()
        n = len(words) - RUN + 1
        if n < 1:
            raise ValueError(f"a template needs {RUN} words: {text!r}")
        rows += [(" ".join(words[i : i + RUN]), i, no, label, n, no < len(base)) for i in range(n)]
    return spark.createDataFrame(rows, "run string, at int, template int, label string, runs int, base boolean")


def scan(docs: DataFrame, base=BASE, more=MORE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_words, spans): one row per input row; spans as array<struct(template, label, first, share, base)>.

    ``first`` is where the span starts, ``share`` how much of the template it
    holds, ``whole`` the places where the whole template stands.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(key).alias("doc"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    # Only A-Z are to be lower-cased. Of all other characters the Kelvin sign alone would become an ASCII letter.
    lower = F.lower(F.replace(F.col("text"), F.lit("K"), F.lit("ĸ")))
    words = F.filter(F.split(lower, BETWEEN, -1), lambda w: w != "")
    ends = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("run")))

    def runs(w):
        each = F.transform(F.slice(w, 1, F.greatest(F.size(w) - RUN + 1, F.lit(0))), lambda x, i: F.struct(i.alias("pos"), F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, RUN)]).alias("run")))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.concat(ends, each).alias("runs"))

    # The row at place -1 keeps a text without a match.
    placed = rows.select("doc", F.xxhash64("doc", "text").alias("h"), with_value(words, runs).alias("r"))
    placed = placed.select("doc", "h", "r.n_words", F.explode("r.runs").alias("x")).select("doc", "h", "n_words", "x.pos", "x.run", F.xxhash64("x.run").alias("hash"))
    known = templates(spark, base, more).withColumnRenamed("run", "template_run").withColumn("template_hash", F.xxhash64("template_run"))
    # The templates are a fixed list, whatever the input.
    met = placed.join(F.broadcast(known), (F.col("hash") == F.col("template_hash")) & (F.col("run") == F.col("template_run")) & (F.col("pos") >= 0), "left")
    met = met.filter("pos = -1 or template is not null")

    of_template = ["doc", "h", "n_words", "template"]
    votes = met.groupBy(*of_template, "label", "runs", "base", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("held"), F.count("*").alias("rows"))
    along = W.partitionBy(*of_template).orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT).cast("int"), F.lit(1))
    marked = votes.withColumn("new", new).withColumn("span", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = F.when(F.size("held") == F.col("runs"), F.col("diagonal"))
    merged = marked.groupBy(*of_template, "label", "runs", "base", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n"), F.min("diagonal").alias("first"),
        F.count(whole).alias("whole"), F.min(whole).alias("whole_first"), F.max(whole).alias("whole_last"), F.max("rows").alias("rows"),
    )
    shaped = F.when(F.col("template").isNotNull(), F.struct("template", "label", "base", "first", (F.col("n") / F.col("runs")).alias("share"), "whole", "whole_first", "whole_last"))
    copies = F.max(F.when(F.col("template").isNull(), F.col("rows")))
    by_text = merged.groupBy("doc", "h", "n_words").agg(F.sort_array(F.collect_list(shaped)).alias("spans"), copies.alias("copies"))
    return by_text.select("doc", "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def digest(found: DataFrame, enough: float = ENOUGH) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"] & (s["whole"] > 0))
    good = F.filter(spans, lambda s: s["share"] >= enough)

    def names(x):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")

    return found.select(
        F.col("doc").alias("doc_id"), "n_words", F.aggregate(base, F.lit(0).cast("long"), lambda a, s: a + s["whole"]).alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["whole_first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["whole_last"])).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(good).alias("labels"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


def _sql() -> str:
    """The same by counting, for each place in a text, the template's words that stand there."""
    rows = []
    for no, (label, text) in enumerate((*BASE, *MORE)):
        listed = ", ".join(f"'{w}'" for w in text.split())
        rows.append(f"({no}, '{label}', {'true' if no < len(BASE) else 'false'}, [{listed}])")
    return f"""
    WITH t(template, label, base, w) AS (VALUES {", ".join(rows)}),
    d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
    u AS (SELECT template, label, base, len(w) - {RUN - 1} AS runs, i - 1 AS spot, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM t, range(1, len(w) - {RUN - 2}) r(i)),
    e AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d, range(1, len(w) - {RUN - 2}) r(i)),
    v AS (SELECT doc_id, template, label, base, runs, pos - spot AS diagonal, list(DISTINCT spot) AS held FROM e JOIN u USING (a, b, c) GROUP BY ALL),
    n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER p <= {DRIFT} THEN 0 ELSE 1 END AS new FROM v WINDOW p AS (PARTITION BY doc_id, template ORDER BY diagonal)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM n),
    m AS (SELECT doc_id, template, label, base, span, len(list_distinct(flatten(list(held)))) / runs AS share, count(*) FILTER (len(held) = runs) AS whole,
                 min(diagonal) FILTER (len(held) = runs) AS f, max(diagonal) FILTER (len(held) = runs) AS l FROM s GROUP BY doc_id, template, label, base, runs, span),
    g AS (SELECT doc_id, coalesce(sum(whole) FILTER (base), 0)::BIGINT AS n_base, (min(f) FILTER (base))::BIGINT AS first_word, (max(l) FILTER (base))::BIGINT AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND whole > 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= {ENOUGH}) AS labels,
                 max(share) AS score FROM m GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


SQL = _sql()
