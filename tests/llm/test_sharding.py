"""Hash tree: movement under growth and weights, balance, slots, edge cases."""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from verity.llm import sharding


def keys(spark, n=20_000):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def test_growth_moves_only_into_the_new_shard(spark):
    df = sharding.place(sharding.place(keys(spark), "doc_id", sharding.topology(16)), "doc_id", sharding.topology(16, 1), "grown")
    rows = df.collect()
    counts = Counter(r.shard for r in rows)
    assert sorted(counts) == list(range(16)) and max(counts.values()) < 1.15 * min(counts.values())
    moved = [r for r in rows if r.shard != r.grown]
    assert {r.grown for r in moved} == {16} and 0.8 < len(moved) / (len(rows) / 17) < 1.2


def test_changed_weight_confines_movement(spark):
    """A heavier shard takes keys within its rack, its rack within its region, its region from the others;
    keys never move between nodes whose weights stay."""
    tree = sharding.topology(16)
    heavier = {r: {k: dict(s) for k, s in ks.items()} for r, ks in tree.items()}
    heavier["region1"]["rack2"][5] = 3.0
    rows = sharding.place(sharding.place(keys(spark), "doc_id", tree), "doc_id", heavier, "after").collect()
    region, rack = lambda s: s // 4, lambda s: s // 2
    moved = [r for r in rows if r.shard != r.after]
    assert moved and all(region(r.after) == 1 for r in moved)
    for r in moved:
        if region(r.shard) == 1:
            assert rack(r.after) == 2
            if rack(r.shard) == 2:
                assert r.after == 5
    share = Counter(r.after for r in rows)[5] / len(rows)
    assert abs(share - 3 / 18) < 0.015


def test_query_slots_sizes_and_edge_cases(spark, tmp_path):
    rows = [(i, f"text {i} é" if i % 7 else None, "x", "y") for i in range(900)] + [(5, "again", "", ""), (5, "again", "", ""), (None, None, "", ""), (None, "a", "", ""), (901, "z" * 300_000, "", ""), (902, "", "", "")]
    spark.createDataFrame(rows, "doc_id long, text string, shard string, slot string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op10_hash_tree_sharding(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = {}
    for r in got:
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = sharding.place(spark.createDataFrame([(5, "other")], "doc_id long, shard string"), "doc_id", sharding.topology(16)).first()
    assert again.shard == next(r.shard for r in got if r.doc_id == 5)
    (tmp_path / "e").mkdir()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e/documents.parquet"))
    assert sharding.op10_hash_tree_sharding(spark, str(tmp_path / "e")).agg(F.count("*")).first()[0] == 0
