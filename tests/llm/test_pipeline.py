"""The corpus pipeline, stage by stage, and the registration of all fourteen queries."""

from __future__ import annotations

import random
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from tests.conftest import SF_SMALL
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute as brute_near
from tests.llm.test_quality import counts
from verity.llm import common, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_registered():
    found, sql = entry.queries(), entry.oracle_sql()
    assert "pipeline" in found and "pipeline" not in sql
    for n in range(1, 14):
        assert len([k for k in found if re.match(rf"op{n}_", k)]) == 1
    assert [name for name, _ in cp.STAGES] == ["language", "quality", "lines", "near_dedup", "packing"]


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_oracles(spark, duck, key):
    from check_oracle import compare

    line, ok = compare(spark, duck, key, queries.QUERIES[key], queries.ORACLES[key], SF_SMALL)
    assert ok, line


def test_stages_on_documents(spark):
    docs = common.documents(spark, SF_SMALL)
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.written(stage(spark, docs, SF_SMALL), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == list(cp.COLUMNS) and after.keys() <= before.keys()
        if name == "quality":
            assert all(not counts(r.text)[5] for r in after.values())
            assert {i for i, r in before.items() if counts(r.text)[5]}.isdisjoint(after)
        if name == "lines":
            want = {i: t for i, _, _, _, t in brute_lines([(r.doc_id, r.source, r.text) for r in before.values()])}
            assert {i: r.text for i, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "near_dedup":
            assert set(after) == {i for i, _, _, kept in brute_near([(r.doc_id, r.text) for r in before.values()], 5, 80, 100) if kept}
    pieces = cp.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {p.doc_id for p in pieces} == set(after)


def test_stages_take_odd_rows(spark):
    rng = random.Random(2)
    words = ["the", "and", "der", "und", "que", "les"]
    rows = [(i, " ".join(rng.choices(words, k=60)) if i % 5 else None, None if i % 3 else "en", None, None) for i in range(40)]
    rows += [(50, "repeated " * 3 + " ".join(words * 9), "en", "s", 1)] * 3 + [(None, " ".join(f"w{i}" for i in range(50)), "en", "s", 1)] * 2
    for df in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for name, stage in cp.STAGES:
            out = stage(spark, df, "").collect()
            if name == "near_dedup" and out:
                assert sum(r.doc_id == 50 for r in out) == 1 and sum(r.doc_id is None for r in out) == 1
