"""Score-bounded retrieval against every pair, and how many pairs it leaves out."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verity.operators import retrieval as RT


def brute(items, queries, n, others):
    tok = lambda t: Counter(re.findall(r"\w{2,}", (t or "").lower()))
    mems, out = {}, []
    for m, i, t in items:
        mems.setdefault(m, []).append((i, tok(t)))
    for m, q, t in queries:
        its = mems.get(m, [])
        df = Counter(w for _, c in its for w in c)
        idf = {w: math.log((1 + len(its)) / (1 + f)) + 1 for w, f in df.items()}
        unit = lambda c: (lambda v, l: {w: x / l for w, x in v.items()})(
            (v := {w: k * idf[w] for w, k in c.items() if w in idf}), math.sqrt(sum(x * x for x in v.values())) or 1)
        qv = unit(tok(t))
        found = sorted(((round(sum(qv.get(w, 0) * x for w, x in unit(c).items()), 12), i) for i, c in its if not others or i != q), reverse=True)[:n]
        out += [(q, r, i, round(s, 9)) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("others", [False, True])
def test_against_every_pair(spark, others):
    """A memory with most items, near copies, ties, items and queries without known terms, short memories."""
    rng = random.Random(11 + others)
    words = [f"w{int(rng.paretovariate(0.7)) % 200}" for _ in range(4000)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    base = text(40)
    items = [("hot", i, text(rng.randint(1, 60))) for i in range(160)]
    items += [("hot", 200 + i, base + " " + text(rng.randint(0, 3))) for i in range(30)] + [("hot", 300 + i, base) for i in range(5)]
    items += [("tiny", 400, "one two"), ("tiny", 401, None), ("tiny", 402, ""), ("none", 403, "a b c")]
    queries = [("hot", i, text(rng.randint(1, 50))) for i in range(0, 60)] + [("hot", 300, base), ("hot", 61, "unknownword"), ("hot", 62, None)]
    queries += [("tiny", 400, "two three"), ("tiny", 401, "zzz"), ("absent", 500, "one"), ("none", 403, "x")]
    d = spark.createDataFrame(items, "mem string, i long, text string").repartition(3)
    q = spark.createDataFrame(queries, "mem string, q long, text string")
    for n in (1, 4):
        got = RT.retrieve(d, q, "mem", "i", "text", "q", "text", n, others=others).collect()
        assert sorted(map(tuple, got)) == brute(items, queries, n, others)


def test_a_tenth_of_the_related_items_is_scored(spark):
    """At sf0.1 few of the items that share a term with a query are kept."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("source").alias("mem"), "doc_id", "text")
    q = d.where(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "q")
    postings, terms, lengths = RT.index(d, "mem", "doc_id", "text")
    vectors = RT._query_vectors(q, terms, "mem", "q", "text")
    related = RT._scores(vectors, postings, lengths, "mem", True).count()
    kept, tails = RT.candidates(postings, lengths, vectors, "mem", 3, others=True)
    n = kept.count()
    print(f"scored in full {n} of {related}; per query {n / q.count():.1f}; tail terms {tails.count()} of {vectors.count()}")
    assert n * 10 <= related


def test_empty_tables(spark):
    d = spark.createDataFrame([], "mem string, i long, text string")
    q = spark.createDataFrame([("m", 1, "some text")], "mem string, q long, text string")
    assert RT.retrieve(d, q, "mem", "i", "text", "q", "text").collect() == []
    assert RT.retrieve(q.withColumnRenamed("q", "i"), d.withColumnRenamed("i", "q"), "mem", "i", "text", "q", "text").collect() == []


def test_blocks_of_items_and_queries(spark, monkeypatch):
    """Many blocks a memory, more terms than a block holds densely, copies across blocks."""
    monkeypatch.setattr(RT, "ITEMS", 16)
    monkeypatch.setattr(RT, "QUERIES", 8)
    rng = random.Random(5)
    text = lambda k: " ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(k))
    items = [("m", i, text(rng.randint(1, 60))) for i in range(120)]
    items += [("m", 200 + i, items[0][2]) for i in range(20)] + [("o", i, text(9)) for i in range(5)]
    queries = [("m", i, items[i][2]) for i in range(0, 120, 6)] + [("o", 1, items[141][2])]
    d = spark.createDataFrame(items, "mem string, i long, text string").repartition(3)
    q = spark.createDataFrame(queries, "mem string, q long, text string")
    got = RT.retrieve(d, q, "mem", "i", "text", "q", "text", 3, others=True).collect()
    assert sorted(map(tuple, got)) == brute(items, queries, 3, True)


def test_index_joins_without_a_shuffle(spark):
    """Postings are dealt by term once: a join on terms reads them in their buckets."""
    d = spark.createDataFrame([("m", i, f"one two w{i} one") for i in range(40)] + [("m", 3, "one more")], "mem string, i long, text string")
    postings, terms, _ = RT.index(d, "mem", "i", "text")
    plan = postings.join(terms.hint("merge"), ["mem", "term"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert postings.where("_i = 3").agg(F.sum("_c")).first()[0] == 6
