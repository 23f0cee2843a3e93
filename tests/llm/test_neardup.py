"""Near-duplicates against all pairs, SuperMinHash against its definition."""

from __future__ import annotations

import random

import numpy as np

from verity.llm import neardup


def brute(rows, k, num, den):
    sets = [(i, frozenset(neardup.shingles(t, k).tolist())) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(x)] = root(y)
    label = {}
    for x, (i, _) in enumerate(sets):
        label[root(x)] = min(label.get(root(x), i), i)
    return sorted((i, len(s), label[root(x)], label[root(x)] == i) for x, (i, s) in enumerate(sets))


def corpus(seed, n=90):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 300))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):  # near copies of one text, with few to many edits
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w[rng.randint(0, 6):]))
    rows += [" ".join([*passage, *(word() for _ in range(rng.randint(3, 40)))]) for _ in range(n)]  # a shared passage
    rows += [" ".join(word() for _ in range(rng.randint(0, 50))) for _ in range(n)]
    rows += rows[::9] + ["", "  \n", None, "One two", "one TWO", "one\ttwo", "w " * 40_000]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def test_against_all_pairs(rows_of):
    for seed, k, num in ((1, 3, 85), (2, 5, 80)):
        rows = corpus(seed)
        df = rows_of(("doc_id", "text", "label", "rep"), [(i, t, "x", None) for i, t in rows]).repartition(5)
        got = neardup.near_duplicates(df, "doc_id", "text", k=k, num=num, den=100).collect()
        assert sorted(map(tuple, got)) == brute(rows, k, num, 100)


def test_residual_join_alone_is_exact(rows_of, monkeypatch):
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 0)
    rows = corpus(3, n=40)
    df = rows_of(("doc_id", "text"), rows)
    assert sorted(map(tuple, neardup.near_duplicates(df, "doc_id", "text", k=3, num=85, den=100).collect())) == brute(rows, 3, 85, 100)


def test_repeated_rows_null_ids_and_empty_table(rows_of):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z"), (5, "A B c D")]
    got = neardup.near_duplicates(rows_of(("doc_id", "text"), rows), "doc_id", "text", k=3, num=85).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [
        (1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (5, 2, 1, False)]))
    assert neardup.near_duplicates(rows_of(("doc_id", "text"), []), "doc_id", "text").count() == 0


def test_signature_is_superminhash():
    """Against the sequential definition: per element a permutation by swaps, offers of level + rank."""
    rng = np.random.default_rng(6)
    for n, block in ((1, 8192), (5, 2), (40, 7), (700, 64), (3000, 8192)):
        elements = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        slots = 32
        want = [2**64 - 1] * slots
        for e in elements:
            perm = list(range(slots))
            for j in range(slots):
                x = int(neardup._mix(np.array([e]) + np.uint64(int(neardup._GOLD) * (j + 1) % 2**64))[0])
                k = j + (x & 0xFFFFFF) % (slots - j)
                perm[j], perm[k] = perm[k], perm[j]
                want[perm[j]] = min(want[perm[j]], (j << 40) | (x >> 24))
        assert neardup.signature(elements, slots, block).tolist() == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
        a, b = np.unique(pool[:300]), np.unique(pool[100:])
        errors.append((neardup.signature(a, 128) == neardup.signature(b, 128)).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + rng.randrange(50)) for i in range(50)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {(r.node, r.label) for r in got} == {(x, root(x)) for x in linked}
