"""Merge replay against the tiktoken library, and the query's edge cases."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from verity.llm import bpe, common

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_replay_equals_greedy_library(library):
    rng = random.Random(5)
    parts = ["a", "aa", "aaa", "é", "漢", "😀", " ", "\n", "\t", "the", "ing", "1", "23", "…", "'s", "ß", "x" * 50, "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)] + ["", "a" * 5000, "漢" * 3000]
    enc = bpe.Encoder(PATH, public_tokenizers.PATTERN, memo_words=500)
    for block in (texts[:700], texts[700:]):  # the memo starts anew in between
        for text, ids in zip(block, enc.block(block)):
            assert ids == library.encode_ordinary(text)
            assert enc.decode(ids) == text.encode()


def test_lower_merge_arising_midway_goes_first():
    """Merging 'ab' gives 'abc' a lower rank than the remaining 'ab' has."""
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"abc": 1, b"ab": 2, b"cab": 0}
    table = bpe.Merges(ranks)
    got = bpe.replay([b"abcab", b"ab", b"zab"], ranks, table)
    assert got == [greedy(w, ranks) for w in (b"abcab", b"ab", b"zab")]


def greedy(word, ranks):
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("wide", [0.1, 3, 150])
def test_random_vocabularies_against_greedy(monkeypatch, wide):
    monkeypatch.setattr(bpe, "WIDE", wide)
    rng = random.Random(9)
    for _ in range(60):
        tokens = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(rng.randint(2, 25))}
        order = rng.sample(sorted(tokens), len(tokens))
        ranks = {t: i for i, t in enumerate(order)} | {bytes([i]): i + 1000 for i in range(256)}
        words = [bytes(rng.choices(b"abc", k=rng.randint(1, 14))) for _ in range(40)]
        assert bpe.replay(words, ranks, bpe.Merges(ranks)) == [greedy(w, ranks) for w in words]


def test_query_edge_cases(spark, library, tmp_path):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("n_tokens", T.StringType()), T.StructField("ids_sha256", T.StringType())])
    long = "The quick ééé 漢字 " * 20_000
    rows = [(1, None, "x", None), (2, "", "x", "y"), (3, long, None, None), (3, long, None, None), (None, "a b", "", "")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = bpe.op1_byte_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    empty = tmp_path / "none"
    spark.createDataFrame([], schema).write.parquet(str(empty / "documents.parquet"))
    assert bpe.op1_byte_bpe(spark, str(empty)).count() == 0


def test_encode_decode_columns(spark):
    df = spark.createDataFrame([(1, "Hello wörld", "kept"), (2, None, "kept")], "k int, text string, ids string")
    enc = bpe.encode(df, "text", PATH, public_tokenizers.PATTERN)
    back = bpe.decode(enc, "ids", PATH, "bytes").orderBy("k").collect()
    assert [bytes(r["bytes"]).decode() for r in back] == ["Hello wörld", ""]
    assert common.without(enc, "ids").columns == ["k", "text"]
