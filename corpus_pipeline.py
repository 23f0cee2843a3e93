"""Corpus pipeline: language ID, quality rules, line dedup, near-dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; every stage but the last returns the columns of ``documents``. ``run``
writes each stage's result as Parquet in the cluster's shared checkpoint folder
and gives it to the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm import common, langid, linededup, neardup, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Near-dedup of the pipeline: words of a shingle and similarity in percent.
SHINGLE, SIMILARITY = 5, 80
VOCABULARY = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells with a margin. Learns from the
    documents at hand by the operator's rule; null and letterless texts go."""
    out = langid.classify(docs.select(*COLUMNS), "text", langid.learn(docs))
    return out.where(~F.col("rejected")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    counts = common.written(quality.measured(docs.select(*COLUMNS), "text"), "counted")
    return quality.judged(counts, "lang", "source").where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text."""
    out = linededup.drop_lines(docs.select(*COLUMNS), "source", "text")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.
    Repeated rows are one document. A row without an id is known by its text's
    hash and ranks after all ids."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(*COLUMNS).withColumn("_text", text) \
        .withColumn("_id", F.coalesce("doc_id", F.lit(2**62) + F.pmod(text, F.lit(2**61))))
    found = neardup.near_duplicates(rows, "_id", "text", k=SHINGLE, num=SIMILARITY, den=100)
    one = rows.join(found.where("kept").select("_id").distinct(), "_id", "left_semi")
    return one.dropDuplicates(["_id", "_text"]).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality_rules),
    ("lines", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: SQL cannot express compression, robust estimates or tokenisation; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
