"""Counts against a word-by-word brute force; the MCD verdict against numpy."""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.llm import quality as q

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.sub("", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def texts():
    rng = random.Random(3)
    vocabulary = ["a", "bé", "漢", "x|y", "d&", "$5", "\x0b", "line\n", "\n", "\t\t", "e f", "😀"]
    out = ["", " ", "\n\n", None, "one", "same same " * 40, "a b c d e f g h", ("a b c d e f g h i j k l " * 3).strip(), "w " * 60_000]
    return out + [" ".join(rng.choices(vocabulary[:rng.randint(2, 12)], k=rng.randint(0, 120))) for _ in range(300)]


def test_counts_against_brute_force(spark):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])
    given = texts()
    got = q.measured(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(given)], schema), "text")
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(given[r.i]), given[r.i]


def quantile_bin(x, p):
    b = np.sort(np.floor(x * q.BINS))
    return b[max(0, math.ceil(p * len(b)) - 1)]


def factor(v):
    return np.linalg.cholesky(v + np.diag(np.square(q.FLOORS)))


def brute_mcd(x):
    quartiles = [[quantile_bin(x[:, i], p) for p in (0.25, 0.5, 0.75)] for i in range(q.N)]
    starts = [(np.array([m / q.BINS for _, m, _ in quartiles]), factor(np.diag([((c - a) / (1.349 * q.BINS)) ** 2 for a, _, c in quartiles]))),
              (x.mean(0), factor(np.cov(x.T, bias=True)))]
    best = []
    for m, f in starts:
        for _ in range(q.STEPS):
            d = np.square(np.linalg.solve(f, (x - m).T)).sum(0)
            near = x[np.floor(np.log(np.maximum(d, 1e-12)) * q.BINS) <= quantile_bin(np.log(np.maximum(d, 1e-12)), q.COVER)]
            m, f = near.mean(0), factor(np.cov(near.T, bias=True))
        best.append((np.log(np.diag(f)).sum(), m, f))
    return min(best, key=lambda b: b[0])[1:]


def vector(r):
    n = max(r.n_words, 1)
    rate = lambda c: math.log1p(100 * c / n)
    return [math.log(n), math.log(max(r.word_chars, 1) / n), rate(r.n_symbols), rate(r.n_dup_lines), rate(r.n_repeat_words)]


COLUMNS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, " \
          "n_dup_lines long, n_repeat_words long, base_failed boolean, kept string"


def some(rng, rows, lang, source, n, junk_share=0.08):
    for _ in range(n):
        words = int(rng.lognormal(5, 0.6)) + 20
        junk = rng.random() < junk_share
        rows.append((len(rows), lang, source, words, int(words * (9 if junk else rng.normal(4.5, 0.2))),
                     words * 2 if junk else int(rng.poisson(0.5)), 0, 0, False, "clash"))


def mixture(fine, coarse, n):
    (m, v), (m0, v0), w = fine, coarse, n / (n + q.PRIOR)
    return w * m + (1 - w) * m0, w * v + (1 - w) * v0 + w * (1 - w) * np.outer(m - m0, m - m0)


def test_verdict_against_numpy(spark):
    """A hot group, small ones, one of a single row: each estimate mixed with its language's and that of all."""
    rng = np.random.default_rng(4)
    rows = []
    for lang, source, n in (("en", "hot", 900), ("en", "s1", 70), ("en", "s2", 60), ("de", None, 30), (None, "x", 5), ("fr", "one", 1)):
        some(rng, rows, lang, source, n)
        rows.append((len(rows), lang, source, 3, 9, 0, 0, 0, True, "clash"))
    rows.append((len(rows), "xx", "failed", 3, 9, 0, 0, 0, True, "clash"))
    got = {r.doc_id: r for r in q.judged(spark.createDataFrame(rows, COLUMNS), "lang", "source").collect()}
    assert len(got) == len(rows)
    good = [r for r in got.values() if not r.base_failed]
    assert all(not r.kept and r.distance is None for r in got.values() if r.base_failed)

    def estimate(rs):
        m, f = brute_mcd(np.array([vector(r) for r in rs]))
        return m, f @ f.T - np.diag(np.square(q.FLOORS))

    whole = estimate(good)
    removed = 0
    for lang in {r.lang for r in good}:
        of_lang = [r for r in good if r.lang == lang]
        coarse = mixture(estimate(of_lang), whole, len(of_lang))
        for source in {r.source for r in of_lang}:
            rs = [r for r in of_lang if r.source == source]
            m, v = mixture(estimate(rs), coarse, len(rs))
            x = np.array([vector(r) for r in rs])
            want = np.square(np.linalg.solve(factor(v), (x - m).T)).sum(0) / q.CONSISTENCY
            np.testing.assert_allclose([r.distance for r in rs], want, rtol=1e-6)
            assert [r.kept for r in rs] == (want <= q.CUTOFF).tolist()
            removed += sum(not r.kept and r.n_symbols >= r.n_words for r in rs)
            assert all(r.kept for r in rs if r.n_symbols < r.n_words)
    assert removed > 60


def test_no_size_switches_a_verdict(spark):
    """A text's verdict stays, and its distance hardly moves, as its group grows from 99 to 101 rows."""
    others = []
    some(np.random.default_rng(6), others, "en", "big", 400)
    probes = [(10**6, "en", "g", 200, 900, 1, 0, 0, False, "p"), (10**6 + 1, "en", "g", 200, 1800, 400, 0, 0, False, "p"),
              (10**6 + 2, "en", "g", 150, 700, 12, 2, 9, False, "p")]
    found = []
    for n in (99, 100, 101):
        group = []
        some(np.random.default_rng(7), group, "en", "g", n - len(probes))
        group = [(10**5 + i, *r[1:]) for i, r in enumerate(group)]
        got = {r.doc_id: r for r in q.judged(spark.createDataFrame(others + group + probes, COLUMNS), "lang", "source").collect()}
        found.append([(got[p[0]].kept, got[p[0]].distance) for p in probes])
    assert [k for k, _ in found[0]] == [k for k, _ in found[1]] == [k for k, _ in found[2]] == [True, False, True]
    for a, _, b in zip(*found):
        assert abs(a[1] - b[1]) < 0.1 * a[1]


def test_documents_and_empty_table(spark, tmp_path):
    from tests.conftest import SF_SMALL

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = q.op8_mcd_quality(spark, SF_SMALL).collect()
    assert {r.doc_id for r in got} == docs.keys()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(docs[r.doc_id])
        assert not (r.kept and r.base_failed)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert q.op8_mcd_quality(spark, str(tmp_path)).count() == 0


def test_no_python_in_the_plan(spark):
    from tests.conftest import SF_SMALL

    plan = q.op8_mcd_quality(spark, SF_SMALL).select(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
