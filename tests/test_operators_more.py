"""Invariants and edge cases for chunking, trimming, URLs, answer modes and
pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from verity.functions import answers as A
from verity.operators import composition as CM
from verity.operators import context as CX
from verity.operators import web as W


def test_granular_chunks_lose_nothing(spark):
    texts = [("Un. Deux! Trois? " * 40) + "fin sans point", "x" * 500, "word " * 300 + "。" + "y" * 90, "", "  ", None, "Short.", "A. " * 21]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in CX.chunk_granular(df, "id", "t", 20).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append(r.chunk)
    for i, t in enumerate(texts):
        chunks = got.get(i, [])
        assert all((len(c) + 3) // 4 <= 20 for c in chunks)
        assert "".join(chunks) == (t or "").strip()
    for chunks in got.values():  # the last two are balanced
        if len(chunks) > 1 and len(chunks[-1]) < 40:
            assert len(chunks[-2]) + len(chunks[-1]) > 40


def test_trim_records_respects_budgets(spark):
    import __spark_entry__ as entry
    from tests.conftest import SF_SMALL
    r = entry.queries()["d15_trim_record_statistics"](spark, SF_SMALL).first()
    assert r.over_limit == 0 and r.reduced_bytes <= r.original_bytes


def test_lenient_url_cleanup(spark):
    df = spark.createDataFrame([("see en.wikipedia.org/wiki/Foo_(bar)), and [www.x.org/a]].",)], "t string")
    got = [(r.u.original, r.u.url) for r in df.select(F.explode(W.extract_urls_lenient(F.col("t"))).alias("u")).collect()]
    assert ("en.wikipedia.org/wiki/Foo_(bar)),", "https://en.wikipedia.org/wiki/Foo_(bar)") in got
    assert any(u == "https://www.x.org/a" for _, u in got)


def test_url_variants_order_and_dedupe(spark):
    urls = ["https://a.org/it%2527s?q=1", "http://x.org/a+b%zz?c=%C3%A9 d#e", "no scheme (x)"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.v for r in df.select(W.url_variants(F.col("u")).alias("v")).collect()]
    assert got[0][:3] == ["https://a.org/it%2527s?q=1", "https://a.org/it%27s?q=1", "https://a.org/it's?q=1"]
    assert got[1] == [urls[1], "http://x.org/a+b%zz?c=é d#e", "http://x.org/a%2Bb%25zz?c=%C3%A9%20d#e"]
    assert got[2] == [urls[2], "no%20scheme%20(x)"]


def test_article_blocks_and_tables(spark):
    pages = ["<main><h1>T</h1><p>a &amp; b<p>c<table><tr><th>K<th>V</tr><tr><td> 1</td><td>2 </td></tr></table></main><p>out</p>",
             '<div role="main">bare</div><p>whole</p>', "<p>no block</p>"]
    df = spark.createDataFrame([(p,) for p in pages], "h string")
    got = [r.t for r in df.select(W.extract_article_blocks(F.col("h")).alias("t")).collect()]
    assert got == ["T a & b c K | V K | V 1 | 2", "whole", "no block"]


def test_answer_modes(spark):
    rows = [("```python\nprint(1)\n```",), ("so \\boxed{42} done",), ("We argue. In conclusion the value is certainly forty two.",)]
    df = spark.createDataFrame(rows, "t string")
    out = [(r.m, r.a) for r in df.select(A.answer_mode(F.col("t")).alias("m"), A.clean_answer(F.col("t")).alias("a")).collect()]
    assert out[0] == ("code", "```python\nprint(1)\n```")
    assert out[1] == ("math", "The final answer is $\\boxed{42}$")
    assert out[2] == ("generic", "the value is certainly forty two.")


def test_pipeline_text_and_repeat(spark):
    df = spark.createDataFrame([(1, "<think>x</think>Answer: B.")], "id long, text string")
    seq = CM.run_pipeline(df, "strip_think&final_answer&normalize").first().text
    assert seq == "b"
    par = CM.run_pipeline(df, "final_answer|plain").select("branch").collect()
    assert sorted(r.branch for r in par) == ["final_answer", "plain"]
    assert CM.repeat(df, 4).count() == 4


def test_mcq_letter_priority(spark):
    rows = [("blah **Answer:** c",), ("Option B is it",), ("(D) seems right",), ("**zzz",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r.x for r in df.select(A.mcq_letter(F.col("t")).alias("x")).collect()] == ["C", "B", "D", "z"]


def test_context_reduction_is_dealt_over_tasks_by_size(spark, monkeypatch):
    """Twice the text, twice the tasks: no task's share grows with the table."""
    from verity import session
    from verity.plans.q_context import reduce_context

    monkeypatch.setattr(session, "TASK_BYTES", 1000)
    rows = [(i, "alpha beta", f"alpha w{i} beta gamma. " * 40) for i in range(60)]
    parts, texts = [], []
    for n in (30, 60):
        df = spark.createDataFrame(rows[:n], "k long, q string, c string")
        out = reduce_context(df, "k", "q", "c", 300, 600)
        parts.append(out.rdd.getNumPartitions())
        texts.append({r.k: r.context for r in out.collect()})
        assert len(texts[-1]) == n and all(0 < len(t) <= 300 for t in texts[-1].values())
    assert session.parts_for(df, "q", "c") >= 50
    assert parts[1] - parts[0] >= 20 and all(texts[1][k] == t for k, t in texts[0].items())
