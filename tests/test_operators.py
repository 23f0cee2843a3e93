"""Hand-made frames for ties, nulls, empties and unicode, plus pair-free
operators checked against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from verity.functions import answers as A
from verity.functions.text import parse_link_list
from verity.operators import confidence as CF
from verity.operators import context as CX
from verity.operators import curate as CU
from verity.operators import evaluate as EV
from verity.operators import joins as J
from verity.operators import privacy as PV
from verity.operators import ranking as RK
from verity.operators import vote as V
from verity.streaming import streams as ST


def test_majority_vote_ties_empty_and_single(spark):
    rows = [
        (1, 1, "Answer: B"), (1, 2, "Answer: A"), (1, 3, "answer: b."), (1, 4, "Answer: a"),  # tie -> first seen (b)
        (2, 1, ""), (2, 2, "   "),                                                        # nothing usable -> first
        (3, 1, "The answer is 42"),                                                        # single candidate
    ]
    df = spark.createDataFrame(rows, "question_id long, pos long, text string")
    out = {r.question_id: r for r in V.majority_vote(df).collect()}
    assert out[1].answer == "b" and out[1].n_votes == 2 and out[1].response == "Answer: B"
    assert out[2].answer is None and out[2].n_votes == 0 and out[2].response == ""
    assert out[3].answer == "42" and out[3].n_candidates == 1


def test_category_accuracy_null_types_and_na(spark):
    rows = [(1, "TRUE", None), (2, "FALSE", "Temporal reasoning"), (3, "TRUE", "temporal reasoning | Bogus"),
            (4, "", "Tabular reasoning|Temporal reasoning")]
    df = spark.createDataFrame(rows, "idx long, grader_decision string, reasoning_types string")
    out = {r.category: r for r in EV.category_accuracy(df).collect()}
    assert out["Temporal Reasoning"].n_total == 3 and out["Temporal Reasoning"].n_correct == 1
    assert out["Numerical Reasoning"].accuracy_text == "N/A" and out["Numerical Reasoning"].accuracy is None
    assert out["Temporal Reasoning+"].n_total == 1


def test_empty_grade_differs_from_null(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "FALSE")], "idx long, grader_decision string")
    kept = sorted(r.idx for r in CU.filter_empty_grades(df).collect())
    assert kept == [2, 3]


def test_link_literals_with_apostrophes(spark):
    df = spark.createDataFrame([("[\"https://a.org/it's\", 'https://b.org/x']",), ("'https://c.org'",), ("not a list",)],
                               "s string")
    out = [r.a for r in df.select(parse_link_list(F.col("s")).alias("a")).collect()]
    assert out[0] == ["https://a.org/it's", "https://b.org/x"]
    assert out[1] == ["https://c.org"]
    assert out[2] is None


def test_truncate_bytes_inside_two_byte_letter(spark):
    df = spark.createDataFrame([("abé",), ("abcdé  x",), ("ok",)], "t string")
    out = [r.x for r in df.select(CX.truncate_bytes(F.col("t"), 3).alias("x")).collect()]
    assert out == ["ab", "abc", "ok"]
    out6 = [r.x for r in df.select(CX.truncate_bytes(F.col("t"), 6).alias("x")).collect()]
    assert out6 == ["abé", "abcdé", "ok"]


def test_trace_shorter_than_window(spark):
    rows = [(7, i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "trace_id long, pos long, token_confidence double")
    s = CF.trace_statistics(df, window=16).collect()[0]
    assert s.num_groups == 0 and s.bottom_10_percent == 0.0 and s.lowest_group == 0.0 and s.num_tokens == 5


def test_conversation_without_start(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t0, "provider_call"), (1, 2, t0 + dt.timedelta(seconds=1), "start"),
            (1, 3, t0 + dt.timedelta(seconds=2), "provider_call"), (1, 4, t0 + dt.timedelta(seconds=3), "final"),
            (1, 5, t0 + dt.timedelta(seconds=4), "error")]
    df = spark.createDataFrame(rows, "request_id long, event_id long, ts timestamp, kind string")
    conv, rej = ST.conversations_batch(df)
    c = conv.collect()
    assert len(c) == 1 and c[0].n_calls == 1 and c[0].end_kind == "final" and c[0].duration_ms == 2000.0
    assert sorted(r.event_id for r in rej.collect()) == [1, 5]


def test_identical_strategy_texts_tie(spark):
    q = spark.createDataFrame([(1, "solve the equation")], "idx long, q string")
    s = spark.createDataFrame([(1, 0, "solve it"), (1, 1, "solve it"), (1, 2, "other words")], "idx long, seg long, t string")
    out = sorted((r.seg, r.score) for r in CX.tfidf_scores(q, s, "idx", "seg", "q", "t").collect())
    assert out[0][1] == out[1][1] > out[2][1] == 0.0


def test_global_rank_matches_row_number(spark):
    random.seed(3)
    rows = [(i, random.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long")
    got = {r.id: r.rank for r in RK.global_rank(df, ["v", "id"], "rank").collect()}
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}
    assert got == want


def test_sample_percent_exact_size(spark):
    df = spark.createDataFrame([(i,) for i in range(37)], "idx long")
    assert CU.sample_percent(df, 10.0).count() == 4
    assert CU.sample_percent(df, 0.1).count() == 1


def test_pairwise_wins_brute_force(spark):
    random.seed(5)
    rows = [(q, p, float(random.choice([0.1, 0.2, 0.3]))) for q in range(4) for p in range(1, 7)]
    df = spark.createDataFrame(rows, "question_id long, pos long, v double")
    got = {(r.question_id, r.pos): r.wins for r in V.pairwise_wins(df, "question_id", "pos", "v").collect()}
    want = {}
    for q, grp in itertools.groupby(rows, key=lambda r: r[0]):
        grp = list(grp)
        for a in grp:
            w = 0
            for b in grp:
                if a is b:
                    continue
                w += 1 if a[2] >= b[2] else 0      # pair (a, b): a wins ties as first
                w += 1 if a[2] > b[2] else 0       # pair (b, a): b wins ties
            want[(q, a[1])] = w
    assert got == want


def test_farthest_other_brute_force(spark):
    random.seed(9)
    rows = [(q, a, random.choice([0.0, 0.1, 0.2, 0.3])) for q in range(6) for a in range(random.randint(1, 6))]
    df = spark.createDataFrame(rows, "q long, agent long, t double")
    got = {(r.q, r.agent): r.verifier for r in J.farthest_other(df, "q", "agent", "t").collect()}
    for q, grp in itertools.groupby(rows, key=lambda r: r[0]):
        grp = list(grp)
        for a in grp:
            others = [b for b in grp if b[1] != a[1]] or [a]
            best = sorted(others, key=lambda b: (-abs(b[2] - a[2]), b[1]))[0]
            assert got[(q, a[1])] == best[1], (q, a)


def test_rolling_mean_matches_window(spark):
    from pyspark.sql import Window
    random.seed(2)
    rows = [("p" + str(i % 2), i, float(random.randint(1, 100))) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    got = {r.o: round(r.rolling_mean, 9) for r in CF.rolling_mean_last_n(df, "k", ["o"], "v", 10).collect()}
    w = Window.partitionBy("k").orderBy("o").rowsBetween(-9, 0)
    want = {r.o: round(r.m, 9) for r in df.select("o", F.avg("v").over(w).alias("m")).collect()}
    assert got == want


def test_anonymize_restore_round_trip(spark):
    txt = "Mail bob.x@mail1.example.com from 10.0.0.1, call +1 (555) 555-1234; again bob.x@mail1.example.com"
    df = spark.createDataFrame([(1, txt), (2, "nothing here")], "doc_id long, text string")
    m = PV.entity_map(PV.detect_entities(df, "doc_id", "text"), "doc_id")
    anon = {r.doc_id: r.anonymized for r in PV.anonymize(df, "doc_id", "text").collect()}
    assert "<EMAIL_ADDRESS_0>" in anon[1] and anon[1].count("<EMAIL_ADDRESS_0>") == 2 and "@" not in anon[1]
    back = {r.doc_id: r.restored for r in PV.restore(PV.anonymize(df, "doc_id", "text"), m, "doc_id").collect()}
    assert back == {1: txt, 2: "nothing here"}


def test_chunks_respect_budget(spark):
    random.seed(1)
    words = ["alpha", "beta", "gamma", "délta", "x" * 700]
    texts = [" ".join(random.choice(words) + random.choice(["", ".", "!"]) for _ in range(random.randint(1, 400)))
             for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    chunks = df.select(F.explode(CX.chunk_text(F.col("t"), 512)).alias("c")).collect()
    assert all(len(r.c.encode()) <= 512 * 1.5 + 700 for r in chunks)
    assert all(r.c == r.c.strip() and r.c for r in chunks)


def test_select_segments_never_exceeds_budget(spark):
    rows = [(1, i, float(i % 3), "w" * (100 * (i + 1))) for i in range(6)]
    df = spark.createDataFrame(rows, "idx long, o long, score double, t string")
    out = CX.select_segments(df, "idx", "o", "t", 450).collect()[0]
    assert len(out.context.encode()) <= 450


def test_batch_packing_stream_brute_force(spark, tmp_path):
    import datetime as dt
    random.seed(4)
    t = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        t += dt.timedelta(minutes=random.choice([1, 5, 30, 90]))
        rows.append(("g" + str(i % 2), i, t))
    df = spark.createDataFrame(rows, "group_key string, event_id long, ts timestamp")
    path = str(tmp_path / "req")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = ST.run_to_table(ST.batch_packing_stream(stream, "group_key", 3, "1 hour"), "t-l4").collect()
    # Rows are handled once the watermark (an hour behind the last row) has
    # passed them; a batch also closes when the watermark shows its time is up.
    end, hour = rows[-1][2] - dt.timedelta(hours=1), dt.timedelta(hours=1)
    want = []
    for g in ("g0", "g1"):
        cur = []
        n = 0
        for r in [r for r in rows if r[0] == g and r[2] <= end]:
            if cur and r[2] - cur[0] >= hour:
                want.append((g, n, len(cur)))
                n, cur = n + 1, []
            cur.append(r[2])
            if len(cur) == 3:
                want.append((g, n, 3))
                n, cur = n + 1, []
        if cur and cur[0] + hour <= end:
            want.append((g, n, len(cur)))
    assert sorted((r.group_key, r.batch_no, r.size) for r in got) == sorted(want)


@pytest.mark.parametrize("text,expect", [
    ("<think>a</think>ok <think>bb", 1), ("no think", 0), ("<think>" + "x" * 40 + "</think>", 10)])
def test_reasoning_tokens(spark, text, expect):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(A.reasoning_tokens(F.col("t")).alias("n")).first().n == expect
