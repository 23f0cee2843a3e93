"""The n-gram join against all pairs, and its filters against their definitions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_neardup import brute, corpus
from verity.llm import ngramjoin


def joined(df, **how):
    return sorted(map(repr, map(tuple, ngramjoin.jaccard_join(df, "doc_id", "text", **how).collect())))


@pytest.mark.parametrize("seed, k, num, hub_rounds, pack", [(1, 5, 80, 3, 2_000_000), (2, 3, 60, 0, 300), (3, 2, 90, 1, 2_000)])
def test_against_all_pairs(rows_of, monkeypatch, seed, k, num, hub_rounds, pack):
    monkeypatch.setattr(ngramjoin, "HUB_ROUNDS", hub_rounds)
    monkeypatch.setattr(ngramjoin, "PACKED", pack)
    monkeypatch.setattr(ngramjoin, "GROUPED", pack // 2)
    rows = corpus(seed, 60)
    df = rows_of(("doc_id", "text", "rep", "place"), [(i, t, "x", None) for i, t in rows]).repartition(4)
    assert joined(df, k=k, num=num) == sorted(repr(r[:3]) for r in brute(rows, k, num, 100))


def test_links_are_all_pairs_of_classes_without_hub_rounds(rows_of, monkeypatch):
    """With no component to spare a comparison, every linked pair of different texts is among the links."""
    monkeypatch.setattr(ngramjoin, "HUB_ROUNDS", 0)
    rows = corpus(4, 40)
    df = rows_of(("doc_id", "text"), rows)
    docs = ngramjoin.sized(df, "doc_id", "text", 5)
    classes = docs.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("n_first").alias("n_first")) \
        .withColumn("rep", F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long"))
    found, _ = ngramjoin.links(df, "doc_id", "text", classes, 5, 80, 100)
    sets = {frozenset(ngramjoin.shingles(t, 5).tolist()) for _, t in rows} - {frozenset()}
    want = sum(100 * len(a & b) >= 80 * len(a | b) for a in sets for b in sets if a != b) // 2
    assert found.distinct().count() == want > 20


def test_partial_overlaps_sum_to_the_intersection(spark):
    rng = random.Random(7)
    sets = {r: sorted(rng.sample(range(400), rng.randint(1, 80))) for r in range(12)}
    df = spark.createDataFrame([(r, len(s), len(s), s) for r, s in sets.items()], "rep long, n long, m long, places array<long>")
    bounds = [40, 41, 200, 390]
    parts, cut = ngramjoin.segments(df, bounds)
    for r in cut.collect():
        assert list(r.lengths) == [sum(lo <= x < hi for x in sets[r.rep]) for lo, hi in zip([0, *bounds], [*bounds, 400])]
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    got = {(r.a, r.b): r.overlap for r in ngramjoin.overlaps(pairs, parts).collect()}
    for a in sets:
        for b in sets:
            if a < b:
                assert got.get((a, b), 0) == len(set(sets[a]) & set(sets[b]))


def test_fragments_hold_about_equal_numbers_of_occurrences(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(r, sorted({(rng.randint(0, 5) << ngramjoin.HASH_BITS) | rng.getrandbits(ngramjoin.HASH_BITS) for _ in range(300)}))
                                for r in range(40)], "rep long, places array<long>")
    bounds = ngramjoin.cuts(df, 8)
    held = Counter(sum(x >= b for b in bounds) for r in df.collect() for x in r.places)
    assert len(bounds) == 7 and max(held.values()) < 1.3 * min(held.values())


def test_first_fragment_never_rules_out_a_shared_ngram(rows_of, monkeypatch):
    """shared is at least the true number, and exact when every class is packed once."""
    for pack, exact in ((10**9, True), (200, False)):
        monkeypatch.setattr(ngramjoin, "PACKED", pack)
        rows = corpus(5, 30)
        end = int(ngramjoin._first_end())
        df = rows_of(("doc_id", "text"), rows).coalesce(1)
        got = {r.owner: r.shared for r in ngramjoin.shared_first(ngramjoin.packed(df, "text", 5, 7)).collect()}
        whole = {xxhash.xxh3_128_digest(ngramjoin.shingles(t, 5).tobytes()): {x for x in ngramjoin.shingles(t, 5).tolist() if x < end}
                 for _, t in rows if len(ngramjoin.shingles(t, 5))}
        owners = Counter(x for s in whole.values() for x in s)
        for digest, s in whole.items():
            true = sum(owners[x] > 1 for x in s)
            shared = got.get(ngramjoin.class_number(digest), 0)
            assert shared == true if exact else shared >= true


def test_repeated_rows_null_ids_and_empty_table(rows_of):
    same = "a b c d e f g"
    rows = [(1, same), (1, same), (None, same), (None, "x y z"), (None, "X y z"), (5, same.upper()), (1, "other words"), (9, None), (8, " ")]
    assert joined(rows_of(("doc_id", "text"), rows)) == sorted(map(repr, [
        (1, 3, 1), (1, 3, 1), (None, 3, 1), (None, 1, None), (None, 1, None), (5, 3, 1), (1, 1, 1), (9, 0, 9), (8, 0, 8)]))
    assert joined(rows_of(("doc_id", "text"), [])) == []
