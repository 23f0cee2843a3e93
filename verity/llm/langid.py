"""Language ID by compression.

Every language has a zstandard raw-content dictionary of its learned text. A
text is compressed, in segments that keep the dictionary in play to its end,
once with each dictionary; the language with the fewest bytes wins, and the
text is rejected when the runner-up is almost as small. Text is compared by its
letters: lower-cased, everything else one space.

Learning takes a bounded sample: per language the ``SAMPLE_DOCS`` documents
with the smallest hash of their id, ``SHARE`` normalised bytes of each. Only
documents whose ``crc32(doc_id as text) % 3`` is not 1 and whose ``lang`` is
not null are learned from. Predictions read the whole text and nothing else.

Edge cases: a null text, one without a letter, or a table with nothing to learn
from gives ``und`` with score 0, which counts as rejected; ties go to the first
language in order and are rejected (no margin); repeated rows count once in the
sample; a null id is never learned from nor held out; input columns named like
an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The sample's bounds, per language: documents, and bytes of each.
SAMPLE_DOCS, SHARE = 128, 512
#: Bytes compressed at once, zstandard's level and shortest match.
SEGMENT, LEVEL, MIN_MATCH = 2048, 7, 4
#: A prediction stands if the runner-up needs at least this share more of its bytes.
MARGIN = 0.003
UND = "und"

PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])

_NO_LETTER = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> bytes:
    """Lower-case words separated by one space; empty without a letter."""
    words = _NO_LETTER.sub(" ", (text or "").lower())
    return words.encode() if any(map(str.isalpha, words)) else b""


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content per language, from the bounded sample."""
    rows = df.select(F.col(key).alias("k"), F.col(lang).alias("l")).where(~held_out("k") & F.col("k").isNotNull() & F.col("l").isNotNull())
    # Ranks per language; Spark keeps only the first of each before the shuffle.
    chosen = rows.withColumn("r", F.expr("dense_rank() OVER (PARTITION BY l ORDER BY xxhash64(k), k)")) \
        .where(F.col("r") <= SAMPLE_DOCS).select("k", "l").distinct()
    # Broadcast: SAMPLE_DOCS ids a language.
    texts = df.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.substring(F.col(text), 1, 4 * SHARE).alias("t")) \
        .join(F.broadcast(chosen), ["k", "l"]).groupBy("l", "k").agg(F.min("t").alias("t"))
    shares: dict[str, list[bytes]] = {}
    for r in texts.orderBy("l", "k").collect():  # at most SAMPLE_DOCS x 4 SHARE characters a language
        shares.setdefault(r.l, []).append(normalised(r.t)[:SHARE])
    return {name: b" ".join(parts) for name, parts in shares.items() if any(parts)}


class Classifier:
    """``predict(text) -> (language, score, rejected)``."""

    def __init__(self, dictionaries: dict[str, bytes], margin: float = MARGIN):
        import zstandard as zstd

        self.margin = margin
        self.compressors = {}
        for name, content in sorted(dictionaries.items()):
            params = zstd.ZstdCompressionParameters.from_level(
                LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            raw = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            self.compressors[name] = zstd.ZstdCompressor(dict_data=raw, compression_params=params)

    def sizes(self, words: bytes) -> dict[str, int]:
        segments = [words[i:i + SEGMENT] for i in range(0, len(words), SEGMENT)]
        return {name: sum(len(c.compress(s)) for s in segments) for name, c in self.compressors.items()}

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        words = normalised(text)
        if not words or not self.compressors:
            return UND, 0.0, True
        ranked = sorted(self.sizes(words).items(), key=lambda x: x[1])
        if len(ranked) == 1:
            return ranked[0][0], 1.0, False
        score = (ranked[1][1] - ranked[0][1]) / ranked[1][1]
        return ranked[0][0], score, score < self.margin


def classify(df: DataFrame, text: str, dictionaries: dict[str, bytes]) -> DataFrame:
    """Add lang_pred, score (the margin, 0 to 1) and rejected."""
    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(dictionaries)
        for texts in batches:
            yield pd.DataFrame([classifier.predict(t) for t in texts], columns=PREDICTION.names)

    out = common.without(df, *PREDICTION.names, "_pred").withColumn("_pred", predict(F.col(text)))
    return out.select(*[c for c in out.columns if c != "_pred"], "_pred.*")


def op7_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = common.documents(spark, sf_dir)
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return classify(rows, "text", learn(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
