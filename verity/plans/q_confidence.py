"""Catalog entries for confidence over token traces and logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import confidence as CF
from ..operators.ranking import rank_within
from .catalog import Ctx, register

WINDOW = 16        # fixture window (traces average ~67 tokens)
MIN_LENGTH = 20
WARMUP_TRACES = 16  # traces with trace_id < 16 calibrate the threshold

# DuckDB stages: x (doubles), m (max), lz (log partition), lp (log-softmax).
_LP_SQL = """
    s1 AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
    s2 AS (SELECT vec_id, label, x, list_max(x) AS m FROM s1),
    s3 AS (SELECT vec_id, label, x, m, ln(list_reduce(list_transform(x, lambda v: exp(v - m)), lambda a, b: a + b)) AS lz FROM s2),
    s4 AS (SELECT vec_id, label, list_transform(x, lambda v: v - m - lz) AS lp FROM s3)"""


@register("i1_entropy", f"""
    WITH {_LP_SQL}
    SELECT vec_id, round(-list_reduce(list_transform(lp, lambda v: exp(v) * v), lambda a, b: a + b), 9) AS entropy FROM s4""")
def i1(c: Ctx) -> DataFrame:
    e = c.t.embeddings
    return e.select("vec_id", F.round(CF.entropy_nats(F.col("embedding")), 9).alias("entropy"))


@register("i2_topk_confidence", f"""
    WITH {_LP_SQL}
    SELECT vec_id, round(-list_reduce(list_slice(list_sort(lp, 'DESC'), 1, 5), lambda a, b: a + b)
                         / len(list_slice(list_sort(lp, 'DESC'), 1, 5)), 9) AS topk_confidence FROM s4""")
def i2(c: Ctx) -> DataFrame:
    return c.t.embeddings.select("vec_id", F.round(CF.topk_confidence(F.col("embedding"), 5), 9).alias("topk_confidence"))


@register("i3_entropy_varentropy", f"""
    WITH {_LP_SQL},
    h AS (SELECT vec_id, lp, -list_reduce(list_transform(lp, lambda v: exp(v) * v), lambda a, b: a + b) / ln(2) AS h FROM s4)
    SELECT vec_id, round(h, 9) AS entropy,
           round(list_reduce(list_transform(lp, lambda v: exp(v) * pow(v / ln(2) + h, 2)), lambda a, b: a + b), 9) AS varentropy
    FROM h""")
def i3(c: Ctx) -> DataFrame:
    ev = CF.with_entropy_varentropy(c.t.embeddings.select("vec_id", "embedding"), "embedding")
    return ev.select("vec_id", F.round("entropy", 9).alias("entropy"), F.round("varentropy", 9).alias("varentropy"))


@register("i4_top2_margin", f"""
    WITH {_LP_SQL},
    m AS (SELECT label, CASE WHEN len(lp) > 1 THEN exp(list_sort(lp, 'DESC')[1]) - exp(list_sort(lp, 'DESC')[2]) ELSE 1.0 END AS margin FROM s4)
    SELECT label, count(*) AS n_steps, round(avg(margin), 9) AS confidence FROM m GROUP BY 1""")
def i4(c: Ctx) -> DataFrame:
    m = c.t.embeddings.select("label", CF.top2_margin(F.col("embedding")).alias("margin"))
    return m.groupBy("label").agg(F.count(F.lit(1)).alias("n_steps"), F.round(F.avg("margin"), 9).alias("confidence"))


@register("i5_group_confidence", f"""
    SELECT trace_id, pos, token_confidence, round(g, 9) AS group_confidence FROM (
      SELECT *, avg(token_confidence) OVER (PARTITION BY trace_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS g
      FROM v_trace_tokens) WHERE pos >= {WINDOW - 1}""")
def i5(c: Ctx) -> DataFrame:
    g = CF.group_confidence(c.v("v_trace_tokens"), WINDOW)
    return g.withColumn("group_confidence", F.round("group_confidence", 9))


_STATS_SQL = f"""
    g AS (SELECT trace_id, pos, g AS gc FROM (
            SELECT *, avg(token_confidence) OVER (PARTITION BY trace_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS g
            FROM v_trace_tokens) WHERE pos >= {WINDOW - 1}),
    ng AS (SELECT trace_id, count(*) AS num_groups FROM g GROUP BY 1),
    r AS (SELECT g.*, ng.num_groups, row_number() OVER (PARTITION BY g.trace_id ORDER BY gc, pos) AS rk FROM g JOIN ng USING (trace_id)),
    gs AS (SELECT trace_id, avg(CASE WHEN rk <= greatest(1, floor(num_groups / 10)) THEN gc END) AS b10, min(gc) AS lowest,
                  arg_max(gc, pos) AS cur, first(num_groups) AS num_groups FROM r GROUP BY 1),
    ts AS (SELECT trace_id, avg(token_confidence) AS avgc, count(*) AS num_tokens FROM v_trace_tokens GROUP BY 1),
    stats AS (SELECT ts.trace_id, round(avgc, 9) AS average_confidence, round(coalesce(b10, 0.0), 9) AS bottom_10_percent,
                     round(coalesce(lowest, 0.0), 9) AS lowest_group, round(coalesce(cur, 0.0), 9) AS current_group,
                     num_tokens, CAST(coalesce(gs.num_groups, 0) AS BIGINT) AS num_groups
              FROM ts LEFT JOIN gs USING (trace_id))"""


@register("i6_trace_statistics", f"WITH {_STATS_SQL} SELECT * FROM stats")
def i6(c: Ctx) -> DataFrame:
    return CF.trace_statistics(c.v("v_trace_tokens"), WINDOW)


@register("i7_threshold_calibration", f"""
    WITH {_STATS_SQL}
    SELECT quantile_cont(average_confidence, 0.9) AS threshold_low, quantile_cont(average_confidence, 0.1) AS threshold_high
    FROM stats WHERE trace_id < {WARMUP_TRACES}""")
def i7(c: Ctx) -> DataFrame:
    stats = CF.trace_statistics(c.v("v_trace_tokens"), WINDOW)
    return CF.calibrate_threshold(stats.where(F.col("trace_id") < WARMUP_TRACES))


def _threshold(c: Ctx) -> DataFrame:
    """One row, one column."""
    return i7(c).select("threshold_low")


_ET_SQL = f"""
    {_STATS_SQL},
    th AS (SELECT quantile_cont(average_confidence, 0.9) AS t FROM stats WHERE trace_id < {WARMUP_TRACES}),
    online AS (SELECT * FROM v_trace_tokens WHERE trace_id >= {WARMUP_TRACES}),
    og AS (SELECT trace_id, pos, g FROM (
             SELECT *, avg(token_confidence) OVER (PARTITION BY trace_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS g
             FROM online) WHERE pos >= {WINDOW - 1}),
    st AS (SELECT trace_id, min(pos) AS stop_pos FROM og, th WHERE pos >= {MIN_LENGTH} AND g < th.t GROUP BY 1),
    nt AS (SELECT trace_id, count(*) AS num_tokens FROM online GROUP BY 1),
    et AS (SELECT nt.trace_id, st.stop_pos, CAST(coalesce(st.stop_pos, nt.num_tokens) AS BIGINT) AS kept_tokens,
                  st.stop_pos IS NOT NULL AS terminated_early FROM nt LEFT JOIN st USING (trace_id))"""


def _early(c: Ctx) -> DataFrame:
    online = c.v("v_trace_tokens").where(F.col("trace_id") >= WARMUP_TRACES)
    return CF.early_termination(online, _threshold(c), WINDOW, MIN_LENGTH)


@register("i8_early_termination", f"WITH {_ET_SQL} SELECT * FROM et")
def i8(c: Ctx) -> DataFrame:
    return _early(c)


@register("i10_run_summary", f"""
    WITH {_ET_SQL},
    wu AS (SELECT count(*) AS n, sum(num_tokens) AS tok FROM stats WHERE trace_id < {WARMUP_TRACES})
    SELECT wu.n + (SELECT count(*) FROM et) AS total_traces, wu.n AS warmup_traces, (SELECT count(*) FROM et) AS online_traces,
           (SELECT CAST(sum(CASE WHEN terminated_early THEN 1 ELSE 0 END) AS BIGINT) FROM et) AS early_terminations,
           CAST(wu.tok + (SELECT sum(kept_tokens) FROM et) AS BIGINT) AS total_tokens
    FROM wu""")
def i10(c: Ctx) -> DataFrame:
    tok = c.v("v_trace_tokens")
    warm = tok.where(F.col("trace_id") < WARMUP_TRACES).agg(
        F.count_distinct("trace_id").alias("warmup_traces"), F.count(F.lit(1)).alias("_wt"))
    on = _early(c).agg(F.count(F.lit(1)).alias("online_traces"),
                       F.sum(F.col("terminated_early").cast("int")).cast("bigint").alias("early_terminations"),
                       F.sum("kept_tokens").alias("_ot"))
    j = warm.withColumn("_k", F.lit(1)).join(on.withColumn("_k", F.lit(1)), "_k")  # two one-row aggregates
    return j.select((F.col("warmup_traces") + F.col("online_traces")).alias("total_traces"), "warmup_traces",
                    "online_traces", "early_terminations", (F.col("_wt") + F.col("_ot")).cast("bigint").alias("total_tokens"))


def _i9_sql(warmup: int, threshold: float) -> str:
    return f"""
    WITH t AS (SELECT question_id, pos, answer,
                      count(*) OVER (PARTITION BY question_id, answer ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
                      row_number() OVER (PARTITION BY question_id ORDER BY pos) AS t FROM v_candidates),
    m AS (SELECT *, max(c) OVER (PARTITION BY question_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM t)
    SELECT question_id, CAST(coalesce(min(CASE WHEN t > {warmup} AND top / t >= {threshold} THEN t END), count(*)) AS BIGINT) AS traces_used,
           min(CASE WHEN t > {warmup} AND top / t >= {threshold} THEN t END) IS NOT NULL AS consensus_reached
    FROM m GROUP BY 1"""


@register("i9_online_consensus", _i9_sql(3, 0.95))
def i9(c: Ctx) -> DataFrame:
    return CF.online_consensus(c.v("v_candidates"), "question_id", "pos", "answer", 3, 0.95)


@register("i9_online_consensus_half", _i9_sql(3, 0.5))
def i9_half(c: Ctx) -> DataFrame:
    return CF.online_consensus(c.v("v_candidates"), "question_id", "pos", "answer", 3, 0.5)


@register("i11_prompt_temperature", """
    WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 0)) AS tok FROM documents),
    k AS (SELECT doc_id, tok, count(*) AS k FROM w GROUP BY 1, 2),
    n AS (SELECT doc_id, sum(k) AS n FROM k GROUP BY 1),
    h AS (SELECT k.doc_id, first(n.n) AS num_tokens, -sum(k.k / n.n * ln(k.k / n.n)) AS h FROM k JOIN n USING (doc_id) GROUP BY 1)
    SELECT doc_id, num_tokens, round(h, 9) AS token_entropy,
           round(greatest(0.1, least(2.0, 0.7 * greatest(0.5, least(2.0, num_tokens / 100.0)) * greatest(0.5, least(1.5, h / 4.0)))), 9) AS temperature
    FROM h""")
def i11(c: Ctx) -> DataFrame:
    w = c.t.documents.select("doc_id", F.explode(tx.split_words(F.col("text"))).alias("tok"))
    return CF.prompt_temperature(w, "doc_id", "tok", 0.7)


@register("i12_top_alternatives", f"""
    WITH {_LP_SQL},
    e AS (SELECT vec_id, unnest(range(0, len(lp))) AS token_index, unnest(lp) AS logprob FROM s4),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logprob DESC, token_index) AS rk FROM e)
    SELECT vec_id, rk - 1 AS alt_rank, token_index, round(logprob, 9) AS logprob FROM r WHERE rk > 1 AND rk <= 4""")
def i12(c: Ctx) -> DataFrame:
    return CF.top_alternatives(c.t.embeddings, "vec_id", "embedding", 3)


_SWITCH_TEXT = "CASE WHEN doc_id % 4 = 0 THEN replace(text, '. ', '. However, ') ELSE text END"


@register("i13_thought_switches", f"""
    WITH d AS (SELECT doc_id, {_SWITCH_TEXT} AS t FROM documents)
    SELECT doc_id,
           CAST((length(t) - length(replace(t, 'Wait,', ''))) / 5 + (length(t) - length(replace(t, 'Alternatively,', ''))) / 14
                + (length(t) - length(replace(t, 'However,', ''))) / 8 + (length(t) - length(replace(t, 'Additionally,', ''))) / 13 AS BIGINT) AS n_switches,
           coalesce(least(nullif(strpos(t, 'Wait,'), 0), nullif(strpos(t, 'Alternatively,'), 0), nullif(strpos(t, 'However,'), 0),
                          nullif(strpos(t, 'Additionally,'), 0)), 0) AS first_switch_pos
    FROM d""")
def i13(c: Ctx) -> DataFrame:
    d = c.t.documents
    t = F.when(F.col("doc_id") % 4 == 0, F.replace(F.col("text"), F.lit(". "), F.lit(". However, "))).otherwise(F.col("text"))
    s = CF.thought_switches(t)
    return d.select("doc_id", s["n_switches"].alias("n_switches"), s["first_switch_pos"].alias("first_switch_pos"))


@register("i14_rolling_latency", """
    SELECT event_type, ts, event_id, value,
           round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS rolling_mean
    FROM events""")
def i14(c: Ctx) -> DataFrame:
    e = c.t.events.select("event_type", "ts", "event_id", "value")
    r = CF.rolling_mean_last_n(e, "event_type", ["ts", "event_id"], "value", 10)
    return r.withColumn("rolling_mean", F.round("rolling_mean", 9))


@register("i15_call_numbers", """
    SELECT request_id, event_id, row_number() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS call_number
    FROM v_requests WHERE kind = 'provider_call'""")
def i15(c: Ctx) -> DataFrame:
    r = c.v("v_requests").where(F.col("kind") == "provider_call")
    return rank_within(r.select("request_id", "event_id", "ts"), "request_id", ["ts", "event_id"], "call_number").drop("ts")


@register("i15_first_appearance_ids", """
    WITH f AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_id) - 1 AS instance_id FROM f""")
def i15_first(c: Ctx) -> DataFrame:
    f = c.t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    w = Window.partitionBy("user_id").orderBy("first_id")
    return f.select("user_id", "event_type", (F.row_number().over(w) - 1).alias("instance_id"))
