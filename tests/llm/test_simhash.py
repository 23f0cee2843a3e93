"""Fingerprints, edited texts and the radius search against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash
from pyspark.sql import types as T

from verity.llm import simhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
signed = lambda x: x - 2**64 if x >= 2**63 else x


def long_hash(value, seed=42):
    """Spark's xxhash64 of one long."""
    return xxhash.xxh64_intdigest((value % 2**64).to_bytes(8, "little"), seed)


def int_hash(value, seed):
    return xxhash.xxh64_intdigest((value % 2**32).to_bytes(4, "little"), seed)


def fingerprint(text):
    words = [w for w in SPACE.split(text) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    terms = h if len(h) < 2 else [long_hash(b, long_hash(a)) for a, b in zip(h, h[1:])]
    pairs = [(t, int_hash(1, long_hash(t))) for t in terms]
    out = ""
    for half in (1, 0):
        bits = 0
        for i in range(64):
            if 2 * sum(p[half] >> i & 1 for p in pairs) > len(pairs):
                bits |= 1 << i
        out += f"{bits:016x}"
    return out


def check(rows, got, asked=1):
    order = sorted([(i, t or "") for i, t, *_ in rows if i is not None], reverse=True)
    likeness = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
    prints = [fingerprint(t) for _, t in order]
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        e = t[:len(t) - cut] + after[:cut]
        f, fe = prints[k], fingerprint(e)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, fe, likeness(f, fe), likeness(f, prints[(k + 1) % len(order)]),
                     sum(likeness(f, o) >= 1 - simhash.RADIUS / 128 for o in prints) - 1 if i % asked == 0 else None))
    order = lambda r: (*r[:-1], -1 if r[-1] is None else r[-1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_documents_table(spark):
    from tests.conftest import SF_SMALL

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check(rows, simhash.op2_simhash(spark, SF_SMALL).collect(), simhash.ASKED)


def test_buckets_edge_cases_and_near_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 7)
    rng = random.Random(2)
    base = [rng.choice(["alpha", "beta", "γάμμα", "delta", "漢字", "e", "zeta\n"]) + str(rng.randint(0, 40)) for _ in range(400)]
    rows = [(i * i, " ".join(base[:i] + base[i + 1:]), "x", "y") for i in range(40)]  # near copies
    rows += [(5000 + i, " ".join(rng.choices(base, k=rng.randint(0, 9))), None, None) for i in range(40)]
    rows += [(9000, None, None, None), (9001, "", None, None), (9002, "one", None, None), (9003, "w " * 20_000, None, None)]
    rows += [(9004, "twice the same", None, None)] * 2
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("row", T.StringType()), T.StructField("lo", T.StringType())])
    got = simhash.compared(spark.createDataFrame(rows, schema).repartition(5), "doc_id", "text").collect()
    check(rows, got)
    assert any(r.n_near > 2 for r in got)
    assert simhash.compared(spark.createDataFrame([], schema), "doc_id", "text").count() == 0
    check(rows[:1], simhash.compared(spark.createDataFrame(rows[:1], schema), "doc_id", "text").collect())
    loose = simhash.compared(spark.createDataFrame([(None, "a b", "", ""), (None, "c d", "", ""), (3, "e f", "", "")], schema), "doc_id", "text")
    assert sorted(r.fingerprint for r in loose.collect()) == sorted(fingerprint(t) for t in ("a b", "c d", "e f"))


def test_buckets_follow_the_counts(spark, monkeypatch):
    """One far id, negative ids, and an id on a third of the rows: no bucket takes the table."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 20)
    rows = [(i, f"text {i} of many") for i in range(1000)] + [(-7 - 3 * i, f"below {i}") for i in range(100)]
    rows += [(10**15, "far away"), (-(2**63), "lowest"), (2**63 - 1, "highest"), (500, None)] + [(400, f"repeated {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = simhash.id_buckets(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    sizes, ids = {}, {}
    for r in got:
        sizes[r._bucket] = sizes.get(r._bucket, 0) + 1
        ids.setdefault(r._bucket, []).append(r.doc_id)
    assert max(sizes.values()) <= 60  # parts of one id are dealt by hash
    assert max(n for b, n in sizes.items() if 400 not in ids[b]) <= 20
    spans = [(min(ids[b]), max(ids[b])) for b in sorted(ids)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    out = simhash.compared(df, "doc_id", "text").collect()
    assert len(out) == len(rows) and all(r.n_near is not None for r in out)
    few = {r[0]: r[1] for r in rows if r[0] not in (400, 500)}
    after = {r.doc_id: r for r in out}
    chain = sorted(few, reverse=True)
    for i, j in zip(chain, chain[1:]):
        if i not in (401, 501):
            cut = len(few[i]) // 3
            e = few[i][:len(few[i]) - cut] + few[j][:cut]
            assert after[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()


def test_search_counts_without_pair_rows(spark):
    """Near copies of one text: exact counts; the join's finds go straight into partial counts."""
    rng = random.Random(8)
    prints = {(rng.getrandbits(63), rng.getrandbits(62))}
    base = next(iter(prints))
    while len(prints) < 700:
        flips = rng.sample(range(120), rng.randint(0, 5))
        lo, hi = base
        for f in flips:
            lo, hi = (lo ^ 1 << f, hi) if f < 60 else (lo, hi ^ 1 << (f - 60))
        prints.add((lo, hi))
    prints = sorted(prints)
    df = spark.createDataFrame([(*p, 1 + k % 3) for k, p in enumerate(prints)], "lo long, hi long, _copies long")
    got = simhash.near_counts(df.drop("_copies"), df)
    bits = lambda p, q: bin(p[0] ^ q[0]).count("1") + bin(p[1] ^ q[1]).count("1")
    want = {p: sum(1 + k % 3 for k, q in enumerate(prints) if bits(p, q) <= simhash.RADIUS) - 1 for p in prints}
    assert {(r.lo, r.hi): r.n_near for r in got.collect()} == want
