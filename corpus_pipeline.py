"""A training corpus in five stages, each on all that the one before kept.

Every stage is given (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connlens.llm import jaccard, language, packing, quality, secrets
from connlens.llm.common import fresh, quoted, saved, table
from connlens.session import shipped

#: A document is rejected when it is less like its language than this (1: as its labelled texts, 0: as noise), or has no letter.
LEAST_LANGUAGE = 0.4
#: A document is rejected when its score is below this.
LEAST_QUALITY = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; a null text counts as empty and is judged by the bias alone."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "_score")
    return docs.withColumn(score, quality.score_column(F.col("text"), model)).filter(quoted(score) >= LEAST_QUALITY).drop(score)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; other languages, noise, null texts and texts without a letter go."""
    found = fresh(docs, "_found")
    named = docs.withColumn(found, language.known_column(F.col("text"), language.fit(docs)))
    return named.filter((quoted(found)["lang"] != language.UNKNOWN) & (quoted(found)["likeness"] >= LEAST_LANGUAGE)).drop(found)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id."""
    return jaccard.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret masked and the length brought up to date where one was."""
    text, before = quoted("text"), fresh(docs, "_before")
    masked = secrets.redact(docs.withColumn(before, F.length(text)))
    changed = F.length(text) != quoted(before)
    out = masked.withColumn("n_chars", F.when(changed, F.length(text).cast("long")).otherwise(quoted("n_chars"))) if "n_chars" in docs.columns else masked
    return out.drop(before)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows of tokens."""
    return packing.digest(packing.pack(docs, packing.tokenizer_path(), ranks=packing.tokenizer_path(packing.RANKS)))


STAGES: list[tuple[str, Callable[..., DataFrame]]] = [
    ("quality", shipped(good_quality)),
    ("language", shipped(known_language)),
    ("near_duplicates", shipped(one_of_each)),
    ("secrets", shipped(without_secrets)),
    ("packing", shipped(packed)),
]

#: Neither the two classifiers nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir) if name == STAGES[-1][0] else saved(stage(spark, docs, sf_dir), name)
    return docs
