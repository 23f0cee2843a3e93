"""Packing against a sequential brute force, and the fast tokenizer against the library."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from verity.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("ids", T.StringType()), T.StructField("offset", T.StringType())])


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_every_code_point_as_the_library(library):
    encode = packing.tokenizer(PATH)
    for lo in range(0, 0x110000, 64):
        cs = [chr(c) for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c} {c}{c}1{c}  {c}x." for c in cs)
        assert encode(text).tolist() == library(text)


def test_text_the_fast_path_cannot_take(library):
    for text in (" a" * 10 + "\n" * 300_000 + " b", "<|endoftext|> and <|im_end|>", "a" * 100_000, "x<|endoftext|>" + "\n" * 300_000):
        assert packing.tokenizer(PATH)(text).tolist() == library(text)


def test_added_tokens_inside_texts(library):
    """Strings of every added token, whole, cut, doubled, nested and beside blanks, as the library's default settings give them."""
    import json
    import random

    with open(PATH, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    rng = random.Random(2)
    encode = packing.tokenizer(PATH)
    assert added
    for token, number in added.items():
        assert encode(f"a{token}b").tolist() == [*library("a"), number, *library("b")]
        bits = [token, token[:-1], token[1:], token[:3] + token, " ", "\n\n", "word", "é", "'s", "1 2"]
        for _ in range(300):
            text = "".join(rng.choices(bits, k=rng.randint(0, 9)))
            assert encode(text).tolist() == library(text), text


def check(rows, pieces, library, window=2048):
    """Pieces cover every document, and sequences gaplessly; only the last is short."""
    docs = {}
    for r in pieces:
        docs.setdefault(r.doc_id, []).append(r)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t)
    at_sequence = {}
    for i, ps in docs.items():
        if len(texts[i]) > 1:
            continue
        ids = [*library(texts[i][0] or ""), 1]
        ps.sort(key=lambda r: r.start)
        assert ps[0].start == 0 and sum(p.length for p in ps) == len(ids) == ps[0].doc_tokens
        for p, q in zip(ps, ps[1:]):
            assert p.start + p.length == q.start
        for p in ps:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
    for p in pieces:
        assert 1 <= p.length and p.offset + p.length <= window
        at_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert docs.keys() == texts.keys() and sorted(at_sequence) == list(range(len(at_sequence)))
    for s, spans in at_sequence.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) == window or s == len(at_sequence) - 1


def test_documents_table(spark, library):
    from tests.conftest import SF_SMALL

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check(rows, packing.op4_concat_packing(spark, SF_SMALL).collect(), library)


def test_many_partitions_and_edge_cases(spark, library):
    rows = [(i, "word " * (i * 37 % 900), None, "x") for i in range(60)]
    rows += [(100, None, None, None), (101, "", None, None), (102, "long text " * 30_000, None, None), (103, "twice", None, None), (103, "twice", None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    pieces = packing.digests(df, PATH).collect()
    check(rows, pieces, library)
    assert [p.doc_tokens for p in pieces if p.doc_id in (100, 101)] == [1, 1]
    assert sum(p.length for p in pieces if p.doc_id == 103) == 2 * len([*library("twice"), 1])
    assert packing.digests(spark.createDataFrame([], DOCS), PATH).count() == 0
    null_key = packing.digests(spark.createDataFrame([(None, "a", None, None)], DOCS), PATH).collect()
    assert null_key[0].doc_id is None and null_key[0].length == 2
