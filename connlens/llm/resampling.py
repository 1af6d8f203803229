"""Importance resampling: documents drawn so that they look like a target corpus.

Every run of ``runs`` or fewer words is hashed into a bucket. The logarithm of
the target's share of a bucket over the corpus's share is the bucket's gain; the
gains are one array, bounded by the number of buckets, and a document's weight is
the sum of the entries of its features. With Gumbel noise from a hash of its key
added, the highest scores are a draw without replacement.

The cutoff is found without a sort of all scores: a quantile sketch proposes a
bracket around the wanted rank, exact counts of the scores outside validate it
or widen it, and only the bracket is sorted.

1. The buckets of each document's features are written, two bytes a feature.
2. Bucket counts of corpus and target are summed by tasks, then by bucket.
3. The written buckets are looked up in the array of gains and summed.

Defined results: a null text has no feature and weight 0; so has an empty one;
a null key is hashed as the empty text; repeated rows are scored alike and take
a rank each; ties go to the smaller key, null first; an empty corpus gives an
empty result, an empty target gains from the smoothing alone; extra columns are
left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from connlens.llm.common import BYTE_KIND, LOWER, quoted, saved, table, text_batches
from connlens.llm.places import placed

BUCKETS = 10_000
RUNS = 1
#: Percent of the documents with at least this many words that are drawn.
PERCENT, LEAST_WORDS = 10, 20
SEED = 2024
#: Accuracy of the sketch: a bracket takes a few times this part of the scores.
ACCURACY = 10_000
#: Bytes up to which features are hashed together, byte by byte; longer ones are hashed on their own.
TOGETHER = 48

_CRC = np.zeros(256, np.uint32)
for _byte in range(256):
    _value = _byte
    for _ in range(8):
        _value = (_value >> 1) ^ (0xEDB88320 if _value & 1 else 0)
    _CRC[_byte] = _value


def crc32_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of many stretches of a byte array, a byte of all of them at a time."""
    order = np.argsort(-np.minimum(sizes, TOGETHER + 1).astype(np.int16), kind="stable")
    at, left = starts[order], sizes[order]
    out = np.full(len(order), 0xFFFFFFFF, np.uint32)
    ends = np.searchsorted(-left, -np.arange(TOGETHER), "left") if len(left) else np.zeros(TOGETHER, int)
    long = int(np.searchsorted(-np.minimum(left, TOGETHER + 1), -TOGETHER, "left"))
    for i in range(TOGETHER):
        active = int(ends[i])
        if active <= long:
            break
        some = out[long:active]
        out[long:active] = _CRC[(some ^ data[at[long:active] + i]) & np.uint32(0xFF)] ^ (some >> np.uint32(8))
    out = ~out
    for i in range(long):
        out[i] = zlib.crc32(data[at[i] : at[i] + left[i]])
    found = np.empty(len(order), np.uint32)
    found[order] = out
    return found


def buckets_of(texts: list, runs: int = RUNS, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of all features) of each text."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    for _, n, raw, offsets in text_batches(texts):
        data = LOWER[raw]
        word = BYTE_KIND[data] == 1
        change = np.flatnonzero(np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = change[::2], change[1::2]
        sizes = ends - starts
        doc = np.searchsorted(offsets, starts, "right") - 1
        count = np.bincount(doc, minlength=n)
        if runs > 1:
            # The words one after the other, a space behind each.
            starts = np.cumsum(sizes + 1) - (sizes + 1)
            plain = np.full(int((sizes + 1).sum()), 32, np.uint8)
            plain[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = data[word]
            data = plain
        found, owner = [crc32_spans(data, starts, sizes) % np.uint32(buckets)], [doc]
        for j in range(1, runs):
            whole = np.flatnonzero(doc[j:] == doc[: max(0, len(doc) - j)])
            last = whole + j
            found.append(crc32_spans(data, starts[whole], starts[last] + sizes[last] - starts[whole]) % np.uint32(buckets))
            owner.append(doc[whole])
        made, of = np.concatenate(found).astype(kind), np.concatenate(owner)
        if runs > 1:
            made = made[np.argsort(of, kind="stable")]
        cuts = np.cumsum(np.bincount(of, minlength=n))
        for i in range(n):
            yield int(count[i]), made[cuts[i - 1] if i else 0 : cuts[i]]


def featured(rows: DataFrame, key: str | None, text: str, runs: int, buckets: int) -> DataFrame:
    """(doc, n_words, n_features, buckets): the buckets of all features as one binary value."""
    rows = rows.select((quoted(key) if key else F.lit(None).cast("long")).alias("doc"), quoted(text).alias("text"))
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", T.BinaryType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(buckets_of(batch.column(1).to_pylist(), runs, buckets))
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return rows.mapInArrow(made, schema)


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _stacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: one row a bucket from each task, then one a bucket."""
    kind = _kind(buckets)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_stacked(batch.column(0), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    sums = features.select("buckets").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    buckets, s_all, t_all = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weighted(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc, n_words, n_features, weight)."""
    kind = _kind(len(gains))
    schema = T.StructType([*features.schema.fields[:3], T.StructField("weight", T.LongType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.concatenate(([0], np.cumsum(gains[_stacked(batch.column(3), kind)])))
            ends = np.cumsum(batch.column(2).to_numpy())
            weight = sums[ends] - sums[np.concatenate(([0], ends[:-1]))] if len(ends) else ends
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=schema.names)

    return features.mapInArrow(scored, schema)


def bracket(scores: DataFrame, wanted: int, n: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, above): the score of rank ``wanted`` from above lies in [low, high], and ``above`` scores are over high."""
    margin = 2.0 / accuracy
    ends = scores.agg(F.min("score").alias("least"), F.max("score").alias("most")).first()
    while True:
        around = [max(0.0, 1 - wanted / n - margin), min(1.0, 1 - wanted / n + margin)]
        low, high = scores.agg(F.percentile_approx("score", around, accuracy).alias("p")).first()["p"]
        low, high = (ends["least"] if around[0] == 0 else low), (ends["most"] if around[1] == 1 else high)
        counts = scores.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score") >= low).alias("reached")).first()
        if counts["above"] < wanted <= counts["reached"]:
            return low, high, counts["above"]
        margin *= 4


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", runs: int = RUNS, buckets: int = BUCKETS,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, accuracy: int = ACCURACY,
) -> DataFrame:
    """(doc, n_words, n_features, weight, score, rank): ``rank`` from 1 for the rows drawn, null for the others."""
    features = saved(featured(docs, key, text, runs, buckets), "features")
    gains = gains_of(bucket_counts(features, buckets), bucket_counts(featured(target, None, target_text, runs, buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scores = saved(weighted(features, gains).withColumn("score", (F.col("weight") + noise).cast("long")), "scores")
    eligible = F.col("n_words") >= least_words
    n = scores.filter(eligible).count()
    wanted = percent * n // 100
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scores.select("*", none)
    low, high, above = bracket(scores.filter(eligible), wanted, n, accuracy)
    best_first = [F.col("score").desc(), F.col("doc").asc_nulls_first()]
    over = placed(scores.filter(eligible & (F.col("score") > high)), best_first).select(*scores.columns, (F.col("pos") + 1).alias("rank"))
    inside = placed(scores.filter(eligible & F.col("score").between(low, high)), best_first)
    inside = inside.select(*scores.columns, F.when(F.col("pos") < wanted - above, F.col("pos") + above + 1).alias("rank"))
    rest = scores.filter(~(eligible & (F.col("score") >= low))).select("*", none)
    return over.unionByName(inside).unionByName(rest)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")


def _sql() -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"list_filter(string_split_regex({lowered}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    number = "instr('0123456789ABCDEF', substr(hex(w), {at}, 1)) - 1"
    byte = f"16 * ({number.format(at='2 * i + 1')}) + {number.format(at='2 * i + 2')}"
    bits = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    crc = f"xor(list_reduce(list_transform(range(strlen(w)), lambda i: ({byte})::BIGINT), lambda c, b: {bits}, 4294967295::BIGINT), 4294967295)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS u, doc_id, {words} AS ws FROM documents), b AS (SELECT {words} AS ws FROM benchmark),
    f AS (SELECT u, unnest(ws) AS w FROM d), g AS (SELECT unnest(ws) AS w FROM b),
    k AS (SELECT w, {crc} % {BUCKETS} AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g) x),
    s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (w) GROUP BY bucket),
    z AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM f)::DOUBLE + {BUCKETS}) / ((s::DOUBLE + 1) * ((SELECT count(*) FROM g)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
    v AS (SELECT u, sum(gain)::BIGINT AS weight FROM f JOIN k USING (w) JOIN z USING (bucket) GROUP BY u),
    r AS (SELECT u, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256(concat('{SEED}:', doc_id)), 1, 8))::BIGINT AS h FROM d LEFT JOIN v USING (u)),
    e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
    o AS (SELECT u, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, u) AS rank, count(*) OVER () AS n FROM e WHERE n_features >= {LEAST_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM e LEFT JOIN o USING (u)"""


SQL = _sql()
