"""Target-distribution importance resampling with hashed n-gram features.

Features of a text are all runs of 1 to ``ORDER`` consecutive words, each put in
one of ``BUCKETS`` buckets by its CRC-32. A bucket's gain is the scaled log
ratio of its smoothed share in the target texts to its share in the corpus; a
document's weight sums the gains of its features, a hash of its id adds Gumbel
noise, and the highest scores are a sample without replacement.

Per batch of whole texts everything runs in Arrow kernels: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` turn texts
into word indices; shifted indices paired and encoded again are the distinct
n-grams; only those get a CRC, each continuing that of its first words; ``take``
brings gains back to the positions and a segmented sum gives weights.

Counts cover all rows: each task adds its batches up and hands over one row a
bucket, so the driver reads ``BUCKETS`` rows whatever the input's size. Ranks
need no window over the table: rows above the k-th magnitude are numbered by
their integer score, equal output rows count as one with a number of copies.

Edge cases: a null text has no words and weight 0; a null id is hashed as the
empty string and comes after every other id among ties; repeated rows are
documents of their own with following ranks; an empty table (documents or
target) counts no features; input columns other than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import value_bucket
from . import common

#: What separates words: ASCII other than digits and small letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Longest run of words, hash buckets, and the scale of gains and scores.
ORDER, BUCKETS, SCALE = 3, 10_000, 1000
#: Fewest words of a document that can be drawn, and the percentage drawn.
MIN_WORDS, PERCENT = 20, 5
#: Bytes of text handled at once (a longer text is handled alone, whole).
PIECE_BYTES = 4 << 20


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, nulls empty, in slices of about ``PIECE_BYTES``."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE_BYTES, side="right"))
        hi = max(hi, lo + 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def features(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Words per text, and per n-gram length (parent text of every position,
    index of the n-gram there, CRC-32 of every distinct n-gram)."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=NOT_WORD)
    words, parent = pc.list_flatten(parts), pc.list_parent_indices(parts)
    full = pc.not_equal(words, "")
    words, parent = pc.filter(words, full), pc.filter(parent, full).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = words.dictionary_encode()
    w = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = encoded.dictionary.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()
    spaced = np.empty(len(vocabulary), object)
    spaced[:] = [b" " + v for v in vocabulary]
    crc = np.fromiter(map(zlib.crc32, vocabulary), np.int64, len(vocabulary))
    out = [(parent, w, crc)]
    gram = w
    for n in range(2, order + 1):
        # Position i holds the n-gram of words i .. i+n-1 where they belong to one text.
        inside = parent[:len(parent) - n + 1] == parent[n - 1:] if len(parent) >= n else np.zeros(0, bool)
        first, last = gram[:len(inside)][inside], w[n - 1:][inside] if len(inside) else np.zeros(0, np.int64)
        pairs = pa.array(first * len(vocabulary) + last).dictionary_encode()
        distinct = pairs.dictionary.to_numpy(zero_copy_only=False)
        a, b = np.divmod(distinct, len(vocabulary)) if len(distinct) else (distinct, distinct)
        crc = np.fromiter(map(zlib.crc32, spaced[b], crc[a].tolist()), np.int64, len(distinct))
        index = pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out.append((parent[:len(inside)][inside], index, crc))
        gram = np.zeros(len(inside), np.int64)
        gram[inside] = index
    return np.bincount(parent, minlength=len(texts)), out


def bucket_counts(df: DataFrame, text: str, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts per bucket; buckets without any are absent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                for _, index, crc in features(piece, order)[1]:
                    seen = np.bincount(index, minlength=len(crc))
                    total += np.bincount(crc % buckets, weights=seen, minlength=buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return df.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """One whole-number gain a bucket from two tables of ``bucket_counts``."""
    rows = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").fillna(0, ["s", "t"]).collect()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in rows:
        s[r.bucket], t[r.bucket] = r.s, r.t
    ratio = ((t + 1.0) * (float(s.sum()) + buckets)) / ((s + 1.0) * (float(t.sum()) + buckets))
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio.tolist()], np.int64)


def weights(df: DataFrame, key: str, text: str, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """(key, n_words, n_features, weight) of every document."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("id", df.schema[key].dataType), *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for piece in pieces(batch.column(1)):
                n_words, grams = features(piece, order)
                n_features, weight = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
                for parent, index, crc in grams:
                    sums = np.concatenate([[0], np.cumsum(gain[crc % len(gain)][index])])
                    ends = np.cumsum(np.bincount(parent, minlength=len(piece)))
                    starts = np.concatenate([[0], ends[:-1]])
                    weight += sums[ends] - sums[starts]
                    n_features += ends - starts
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(piece)), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]], names=schema.names)
                lo += len(piece)

    return df.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema) \
        .withColumnRenamed("id", key)


def ranked(df: DataFrame, key: str, score: str, eligible: str, percent: int, out: str = "rank") -> DataFrame:
    """Add ``out``: 1, 2, 3... for the floor(percent of the eligible rows) highest
    scores, ties to the smaller key; null for the rest. Rows that agree in
    every column are numbered as copies of one."""
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    rows = common.written(rows.withColumn("_magnitude", F.when(F.col(eligible), -value_bucket(F.col(score).cast("double")))), "scores")
    # The coarse histogram has a bounded number of bars: magnitudes in 64 steps a doubling.
    bars = sorted(rows.where("_magnitude is not null").groupBy("_magnitude").agg(F.sum("_copies").alias("n")).collect())
    k = percent * sum(n for _, n in bars) // 100
    edge, before = None, 0
    for bar, n in bars:
        if before >= k:
            break
        edge, before = bar, before + n
    if edge is None:
        return rows.select(*df.columns, F.lit(None).cast("long").alias(out), F.explode(F.sequence(F.lit(1), "_copies")).alias("_i")).drop("_i")
    near = F.coalesce(F.col("_magnitude") <= F.lit(edge), F.lit(False))
    top = rows.where(near)
    per_score = top.groupBy(score).agg(F.sum("_copies").alias("_n"))
    earlier = Window.orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_score.select(score, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rest = [c for c in df.columns if c not in (key, score)]
    ties = Window.partitionBy(score).orderBy(F.col(key).asc_nulls_last(), *rest).rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumn("_ahead", F.coalesce(F.sum("_copies").over(ties), F.lit(0))).join(offsets, score) \
        .withColumn("_ahead", F.col("_before") + F.col("_ahead")).drop("_before")
    every = top.unionByName(rows.where(~near).withColumn("_ahead", F.lit(k)))
    numbered = every.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).withColumn("_r", F.col("_ahead") + F.col("_i"))
    return numbered.select(*df.columns, F.when(F.col("_r") <= k, F.col("_r")).cast("long").alias(out))


def resample(df: DataFrame, target: DataFrame, key: str, text: str, target_text: str, seed: int = 42, percent: int = PERCENT,
             min_words: int = MIN_WORDS, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document of ``df``."""
    gain = gains(bucket_counts(df, text, order, buckets), bucket_counts(target, target_text, order, buckets), buckets)
    rows = weights(df, key, text, gain, order)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = rows.withColumn("score", F.col("weight") + noise).withColumn("_eligible", F.col("n_words") >= min_words)
    return ranked(scored, key, "score", "_eligible", percent).drop("_eligible")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to resemble ``benchmark``: 5 % of those with at least 20 words."""
    target = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return resample(common.documents(spark, sf_dir), target, "doc_id", "text", "text") \
        .select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def _crc_table() -> str:
    """SQL for the 256 entries of the CRC-32 table, in order."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "i"
    for _ in range(8):
        table = f"list_transform([{table}], lambda c: {step})[1]"
    return f"SELECT list({table} ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)"


#: DuckDB SQL for the CRC-32 of the string ``x``, given the table ``t``.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'),
      lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""

ORACLE = rf"""
WITH crc AS ({_crc_table()}),
texts AS (SELECT row_number() OVER () AS r, doc_id, text, true AS corpus FROM documents
          UNION ALL SELECT row_number() OVER (), NULL, text, false FROM benchmark),
w AS (SELECT r, doc_id, corpus, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{NOT_WORD}'), lambda x: x <> '') AS ws FROM texts),
f AS (SELECT r, corpus, unnest(ws) AS x FROM w
      UNION ALL SELECT r, corpus, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) > 1
      UNION ALL SELECT r, corpus, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w WHERE len(ws) > 2),
h AS (SELECT x, {CRC_SQL} % {BUCKETS} AS bucket FROM (SELECT DISTINCT x FROM f), crc),
c AS (SELECT r, corpus, bucket, count(*) AS n FROM f JOIN h USING (x) GROUP BY ALL),
st AS (SELECT b AS bucket, coalesce(sum(n) FILTER (WHERE corpus), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT corpus), 0)::DOUBLE AS t
       FROM (SELECT unnest(range({BUCKETS})) AS b) LEFT JOIN c ON bucket = b GROUP BY 1),
g AS (SELECT bucket, floor({SCALE} * ln(((t + 1) * ((SELECT sum(s) FROM st) + {BUCKETS})) / ((s + 1) * ((SELECT sum(t) FROM st) + {BUCKETS}))))::BIGINT AS gain FROM st),
d AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN g USING (bucket) WHERE corpus GROUP BY r),
e AS (SELECT w.r, w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        ('0x' || substr(sha256('42:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS u FROM w LEFT JOIN d USING (r) WHERE corpus),
k AS (SELECT *, weight + floor(-{SCALE} * ln(-ln((u + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM e),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_words, n_features, weight) AS place FROM k WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= (SELECT {PERCENT} * count(*) // 100 FROM p) THEN place END AS rank, n_words
FROM k LEFT JOIN p USING (r)"""
