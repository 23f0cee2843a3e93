"""Importance resampling against a plain count of n-grams."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from verity.llm import resample


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, min_words=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in grams(x)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * all_s) / ((s[b] + 1.0) * all_t)))
    rows = []
    for i, x in docs:
        words, features = grams(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in features)
        rows.append([i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:4]))
    drawn = drawn[:percent * len(drawn) // 100]
    left = Counter()
    out = []
    for place, r in enumerate(drawn, 1):
        out.append((*r, place))
        left[tuple(r)] += 1
    for r in rows:
        if left[tuple(r)]:
            left[tuple(r)] -= 1
        else:
            out.append((*r, None))
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Alpha", "beta", "γάμμα", "d3", "Ünï", "x"]) + rng.choice(["", "-y", "_z", "\x00q", "7"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]
    rows += [rows[3]] * 9 + [(None, None), (None, "a b " * 30), (7001, ""), (7002, "  --  "), (7003, "long text, " * 30_000), (7004, "ÀÉ z" * 25)]
    rng.shuffle(rows)
    return rows, [" ".join(word() for _ in range(30)) for _ in range(12)] + [None, ""]


def test_against_plain_counts(rows_of, monkeypatch):
    rows, target = corpus(5)
    for piece in (1 << 22, 700):  # whole batches, and pieces of a few texts
        monkeypatch.setattr(resample, "PIECE_BYTES", piece)
        df = rows_of(("doc_id", "text", "score", "rank", "_eligible"), [(i, t, "x", None, "y") for i, t in rows]).repartition(3)
        for percent in (5, 60, 100):
            got = resample.resample(df, rows_of(("id", "text"), list(enumerate(target)), longs=("id",)), "doc_id", "text", "text", percent=percent)
            assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows, target, percent)))


def test_empty_tables(rows_of):
    none, some = rows_of(("doc_id", "text"), []), rows_of(("doc_id", "text"), [(1, "word " * 40), (2, None)])
    assert resample.resample(none, some, "doc_id", "text", "text").collect() == []
    got = resample.resample(some, none, "doc_id", "text", "text", percent=100).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in got] == [(1, 117, 1), (2, 0, None)]


def test_crc_of_every_distinct_run():
    _, found = resample.features(pa.array(["b a b a", "", "a", "Ä a-b"]))
    texts = [["b", "a", "b", "a"], [], ["a"], ["Ä", "a", "b"]]
    for n, (parent, index, crc) in enumerate(found, 1):
        want = [(i, zlib.crc32(" ".join(ws[k:k + n]).encode())) for i, ws in enumerate(texts) for k in range(len(ws) - n + 1)]
        assert list(zip(parent.tolist(), crc[index].tolist())) == want
        assert len(set(crc.tolist())) == len(crc)
