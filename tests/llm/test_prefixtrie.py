"""The prefix trie against a dictionary of prefixes, in one block and in many levels of small ones."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from verity.llm import prefixtrie


def brute(sequences):
    """sequences: {conv_id: [(key, chars), ...]}"""
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (p[-1][1] if p else 0) + sum(saved[x] for x in children[p])
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p))
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else -10**9, len(cs), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(ends(p).encode()).hexdigest()) for p, cs in members.items())


def built(df):
    return sorted((r.conv_id, r.depth, -10**9 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in prefixtrie.prefix_trie(df).collect())


def grown(seed, n):
    """Many copies of one sequence, its prefixes and extensions, and others."""
    rng = random.Random(seed)
    trunk = [(rng.randint(0, 3), 5) for _ in range(12)]
    out = {}
    for c in rng.sample(range(-50, 10 * n), n):
        s = trunk[:rng.randint(0, 12)] if rng.random() < 0.6 else []
        s = s + [(rng.randint(0, 2), 5) for _ in range(rng.choice([0, 0, 1, 2, 7]))]
        out[c] = [(k, 3 + k) for k, _ in s] if rng.random() < 0.8 else [(k, 3 + k) for k, _ in trunk]
    return out


@pytest.mark.parametrize("seed, n, block", [(1, 120, 16_384), (2, 120, 7), (3, 90, 2), (4, 1, 2)])
def test_against_a_dictionary_of_prefixes(spark, monkeypatch, seed, n, block):
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    sequences = grown(seed, n)
    df = spark.createDataFrame([(c, [k for k, _ in s], [w for _, w in s]) for c, s in sequences.items()], "conv_id long, turns array<long>, chars array<long>")
    assert built(df) == brute(sequences)


def test_extents_against_a_scan():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 33):
        lcp = rng.integers(0, 4, n)
        at, depth = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        left, right = prefixtrie.extents(lcp, at, depth)
        for a, d, lo, hi in zip(at, depth, left, right):
            assert (lcp[lo + 1:hi + 1] >= d).all() and lo <= a <= hi
            assert (lo == 0 or lcp[lo] < d) and (hi == n - 1 or lcp[hi + 1] < d)


def test_one_very_long_conversation_and_its_copy(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 2)
    s = [(i * 7919 % 1000, i % 5) for i in range(3000)]
    sequences = {1: s, 2: s, 3: s[:2999], 4: [], 5: s[:10], 6: s}
    df = spark.createDataFrame([(c, [k for k, _ in s], [w for _, w in s]) for c, s in sequences.items()], "conv_id long, turns array<long>, chars array<long>")
    got = built(df)
    assert len(got) == 3001
    assert [r for r in got if r[1] > 2990 or r[1] < 12] == [r for r in brute_chain(sequences, s) if r[1] > 2990 or r[1] < 12]


def brute_chain(sequences, s):
    """As brute, for prefixes of one chain, without hashing every prefix."""
    depth = {c: len(x) for c, x in sequences.items()}
    rows = []
    below = 0
    for d in range(len(s), -1, -1):
        cs = [c for c in depth if depth[c] >= d]
        below += (len(cs) - 1) * (s[d - 1][1] if d else 0)
        up = min(c for c in depth if depth[c] >= d - 1) if d else -10**9
        ends = ",".join(str(c) for c in sorted(cs) if depth[c] == d)
        rows.append((min(cs), d, up, len(cs), int(d < len(s)), 1, below, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows)


def test_rebuilt_conversations(spark):
    """Family heads, nulls, repeated turns and absent first conversations."""
    rng = random.Random(9)
    rows = []
    for c in [-150, -100, -1, 0, 3, 7, 42, 99, 100, 101, 199, 305, 306]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, rng.choice(["user", None, "assistant"]), rng.choice(["hi", "", None, "é" * 9, "x" * 40_000]), "clash"))
    rows += [(42, None, "user", "null turn", "y"), (99, 1, "user", "again", None), (99, 1, "user", "again", None), (None, 1, "user", "lost", "z")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns string")
    digest = lambda r, t: int(hashlib.md5(f"{len(r or '')}:{r or ''}{t or ''}".encode()).hexdigest()[:15], 16)
    own = defaultdict(list)
    for c, t, r, x, _ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, digest(r, x), len(x or "")))
    own = {c: [x[2:] for x in sorted(s)] for c, s in own.items()}
    want = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        want[c] = own.get(first, [])[:h] + s[h:]
    got = {r.conv_id: list(zip(r.turns, r.chars)) for r in prefixtrie.rebuilt(df, "conv_id", "turn", "role", "text").collect()}
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert prefixtrie.prefix_trie(prefixtrie.rebuilt(df, "conv_id", "turn", "role", "text")).collect() == []
