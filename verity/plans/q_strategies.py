"""Catalog entries for strategy ledgers and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import strategies as ST
from .catalog import Ctx, register

AS_OF = "2024-02-01 00:00:00"

def _as_of():
    return F.lit(AS_OF).cast("timestamp")

_LEDGER_SQL = """
    a AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY ts, event_id) AS i,
                 count(*) OVER (PARTITION BY strategy_id) AS n FROM v_attempts),
    led AS (SELECT strategy_id, min(problem_type) AS problem_type, count(*) AS total_attempts,
                   CAST(sum(CAST(success AS INTEGER)) AS BIGINT) AS success_count, min(ts) AS created_at, max(ts) AS last_used,
                   round(sum(0.1 * pow(0.9, n - i) * CAST(success AS DOUBLE)) + pow(0.9, max(n)) * 0.5, 9) AS confidence,
                   sum(CAST(success AS INTEGER)) / count(*) AS success_rate
            FROM a GROUP BY 1)"""

_SCORE_SQL = ("0.7 * success_rate + 0.3 * greatest(0.0, 1.0 - least(1.0, "
              f"floor((epoch(TIMESTAMP '{AS_OF}') - epoch(last_used)) / 86400.0) / 30.0))")


def _ledger(c: Ctx) -> DataFrame:
    return ST.ledger(c.v("v_attempts"))


@register("h11_strategy_ledger", f"WITH {_LEDGER_SQL} SELECT * FROM led")
def h11(c: Ctx) -> DataFrame:
    return _ledger(c)


@register("h9_effectiveness", """
    SELECT strategy_id, problem_type, CAST(sum(CAST(success AS INTEGER)) AS BIGINT) AS success_count,
           CAST(sum(1 - CAST(success AS INTEGER)) AS BIGINT) AS failure_count, count(*) AS total_uses,
           round(avg(confidence), 9) AS avg_confidence, round(sum(CAST(success AS INTEGER)) / count(*), 9) AS success_rate
    FROM v_attempts GROUP BY 1, 2""")
def h9(c: Ctx) -> DataFrame:
    return ST.effectiveness(c.v("v_attempts"))


@register("h10_top_strategies", """
    WITH e AS (SELECT strategy_id, problem_type, CAST(sum(CAST(success AS INTEGER)) AS BIGINT) AS success_count,
                      CAST(sum(1 - CAST(success AS INTEGER)) AS BIGINT) AS failure_count, count(*) AS total_uses,
                      round(avg(confidence), 9) AS avg_confidence, round(sum(CAST(success AS INTEGER)) / count(*), 9) AS success_rate
               FROM v_attempts GROUP BY 1, 2)
    SELECT * FROM e WHERE total_uses >= 2 ORDER BY success_rate DESC, total_uses DESC, strategy_id LIMIT 5""")
def h10(c: Ctx) -> DataFrame:
    return ST.top_strategies(ST.effectiveness(c.v("v_attempts")), 5, 2)


@register("h10_counts_by_type", """
    SELECT problem_type, count(DISTINCT strategy_id) AS n_strategies, count(*) AS n_uses,
           round(sum(CAST(success AS INTEGER)) / count(*), 9) AS success_rate
    FROM v_attempts GROUP BY 1""")
def h10_types(c: Ctx) -> DataFrame:
    a = c.v("v_attempts")
    return a.groupBy("problem_type").agg(
        F.count_distinct("strategy_id").alias("n_strategies"), F.count(F.lit(1)).alias("n_uses"),
        F.round(F.sum(F.col("success").cast("int")) / F.count(F.lit(1)), 9).alias("success_rate"))


@register("h8_effective_strategies", f"""
    WITH {_LEDGER_SQL}
    , same AS (SELECT * FROM led WHERE problem_type IN ('type_1', 'unknown')),
    good AS (SELECT * FROM same WHERE confidence >= 0.6)
    SELECT * FROM good
    UNION ALL SELECT * FROM (SELECT * FROM same ORDER BY confidence DESC, strategy_id LIMIT 2) WHERE NOT EXISTS (SELECT 1 FROM good)""")
def h8(c: Ctx) -> DataFrame:
    return ST.effective_strategies(_ledger(c), "type_1", 0.6, 2)


@register("h8_effective_strategies_qualified", f"""
    WITH {_LEDGER_SQL}
    , same AS (SELECT * FROM led WHERE problem_type IN ('type_2', 'unknown')),
    good AS (SELECT * FROM same WHERE confidence >= 0.25)
    SELECT * FROM good
    UNION ALL SELECT * FROM (SELECT * FROM same ORDER BY confidence DESC, strategy_id LIMIT 2) WHERE NOT EXISTS (SELECT 1 FROM good)""")
def h8_q(c: Ctx) -> DataFrame:
    return ST.effective_strategies(_ledger(c), "type_2", 0.25, 2)


@register("h12_coerce_problem_type", """
    SELECT doc_id, CASE WHEN replace(source, 'src', '') IN ('1', '2') THEN 'word_problem'
                        WHEN source = 'src3' THEN 'coding_problem' ELSE 'general_problem' END AS problem_type
    FROM documents""")
def h12(c: Ctx) -> DataFrame:
    d = c.t.documents
    raw = (F.when(F.col("source").isin("src1", "src2"), F.lit("word_problem"))
            .when(F.col("source") == "src3", F.lit("coding_problem")).otherwise(F.col("source")))
    return d.select("doc_id", ST.coerce_problem_type(raw).alias("problem_type"))


_EXAMPLE_SQL = "CASE WHEN event_id % 5 = 0 THEN '  ' ELSE 'reasoning ' || (event_id % 50) END"

def _example():
    return F.when(F.col("event_id") % 5 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("reasoning "), (F.col("event_id") % 50).cast("string")))


@register("h13_last_examples", f"""
    SELECT strategy_id, event_id, example, recency_rank FROM (
      SELECT strategy_id, event_id, example,
             row_number() OVER (PARTITION BY strategy_id ORDER BY ts DESC, event_id DESC) AS recency_rank
      FROM (SELECT strategy_id, event_id, ts, {_EXAMPLE_SQL} AS example FROM v_attempts) WHERE length(trim(example)) > 0)
    WHERE recency_rank <= 5""")
def h13(c: Ctx) -> DataFrame:
    a = c.v("v_attempts").withColumn("example", _example())
    return ST.last_examples(a, "strategy_id", "example", ["ts", "event_id"], 5) \
        .select("strategy_id", "event_id", "example", "recency_rank")


@register("h13_distinct_examples", f"""
    SELECT strategy_id, example, min(event_id) AS first_seen
    FROM (SELECT strategy_id, event_id, {_EXAMPLE_SQL} AS example FROM v_attempts) GROUP BY 1, 2""")
def h13_distinct(c: Ctx) -> DataFrame:
    a = c.v("v_attempts").withColumn("example", _example())
    return ST.distinct_examples(a, "strategy_id", "example", "event_id")


@register("h17_prune", f"""
    WITH {_LEDGER_SQL}
    SELECT * FROM led WHERE total_attempts < 5 OR success_rate >= 0.2""")
def h17(c: Ctx) -> DataFrame:
    return ST.prune(_ledger(c), min_rate=0.2, min_attempts=5)


@register("h19_cap_per_type", f"""
    WITH {_LEDGER_SQL}
    SELECT * FROM (SELECT *, {_SCORE_SQL} AS score FROM led) s
    QUALIFY row_number() OVER (PARTITION BY problem_type ORDER BY score DESC, strategy_id) <= 10""")
def h19(c: Ctx) -> DataFrame:
    return ST.cap_per_type(_ledger(c), _as_of(), 10)


@register("h20_select_for_inference", f"""
    WITH {_LEDGER_SQL}
    SELECT *, {_SCORE_SQL} AS score FROM led
    WHERE problem_type = 'type_2' AND success_rate >= 0.4 AND total_attempts >= 5
    QUALIFY row_number() OVER (ORDER BY {_SCORE_SQL} DESC, strategy_id) <= 3""")
def h20(c: Ctx) -> DataFrame:
    return ST.select_for_inference(_ledger(c), F.lit("type_2"), _as_of())


@register("h20_select_for_inference_lenient", f"""
    WITH {_LEDGER_SQL}
    SELECT *, {_SCORE_SQL} AS score FROM led
    WHERE problem_type = 'type_2' AND success_rate >= 0.2 AND total_attempts >= 5
    QUALIFY row_number() OVER (ORDER BY {_SCORE_SQL} DESC, strategy_id) <= 3""")
def h20_lenient(c: Ctx) -> DataFrame:
    return ST.select_for_inference(_ledger(c), F.lit("type_2"), _as_of(), min_rate=0.2)


_REPLY_SQL = "replace(text, 'Decision: TRUE', 'Decision: yes')"


@register("h21_effective_from_reply", f"""
    SELECT completion_id, contains(upper(trim(CASE WHEN regexp_matches(r, '(?s)<think>.*?</think>')
                                              THEN regexp_extract(r, '(?s)^.*</think>(.*)$', 1) ELSE r END)), 'YES') AS is_effective
    FROM (SELECT completion_id, {_REPLY_SQL} AS r FROM v_completions)""")
def h21(c: Ctx) -> DataFrame:
    reply = F.replace("text", F.lit("Decision: TRUE"), F.lit("Decision: yes"))
    return c.v("v_completions").select("completion_id", ST.effective_from_reply(reply).alias("is_effective"))


@register("h22_engine_counters", """
    SELECT count(*) AS total_queries,
           CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) AS BIGINT) AS strategy_applications,
           CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS strategies_created,
           CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS strategies_refined,
           CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS strategies_merged,
           max(CAST(regexp_extract('strategy_' || user_id, '^strategy_(\\d+)$', 1) AS BIGINT)) AS last_strategy_id
    FROM events""")
def h22(c: Ctx) -> DataFrame:
    e = c.t.events
    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    sid = F.regexp_extract(F.concat(F.lit("strategy_"), F.col("user_id").cast("string")), r"^strategy_(\d+)$", 1)
    return e.agg(F.count(F.lit(1)).alias("total_queries"),
                 n(F.col("event_type").isin("click", "view")).alias("strategy_applications"),
                 n(F.col("event_type") == "signup").alias("strategies_created"),
                 n(F.col("event_type") == "purchase").alias("strategies_refined"),
                 n(F.col("event_type") == "error").alias("strategies_merged"),
                 F.max(sid.cast("bigint")).alias("last_strategy_id"))


@register("h23_refinement_queue", """
    SELECT strategy_id, event_id, attempt_no FROM (
      SELECT strategy_id, event_id, row_number() OVER (PARTITION BY strategy_id ORDER BY ts, event_id) AS attempt_no FROM v_attempts)
    WHERE attempt_no % 10 = 0""")
def h23(c: Ctx) -> DataFrame:
    return ST.refinement_queue(c.v("v_attempts"), "strategy_id", ["ts", "event_id"], 10) \
        .select("strategy_id", "event_id", "attempt_no")


@register("h24_gap_priority", """
    WITH g AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'signup' THEN 'medium' ELSE 'low' END AS priority,
                      CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' THEN 1 ELSE 2 END AS priority_rank FROM events)
    SELECT *, row_number() OVER (ORDER BY priority_rank, event_id) AS search_order FROM g""")
def h24(c: Ctx) -> DataFrame:
    e = c.t.events.select("event_id", F.when(F.col("event_type") == "error", "HIGH")
                          .when(F.col("event_type") == "signup", "medium").otherwise("low").alias("priority"))
    return ST.gap_priority_order(e, "priority", "event_id")


@register("h25_draft_stop", """
    WITH d AS (SELECT question_id, pos AS iteration, confidence * 2 AS completeness FROM v_candidates),
    l AS (SELECT *, lag(completeness) OVER (PARTITION BY question_id ORDER BY iteration) AS prev FROM d)
    SELECT question_id, min(iteration) AS stop_iteration FROM l
    WHERE completeness > 0.9 OR (prev IS NOT NULL AND completeness - prev < 0.03 AND completeness > 0.7)
    GROUP BY 1""")
def h25(c: Ctx) -> DataFrame:
    d = c.v("v_candidates").select("question_id", F.col("pos").alias("iteration"),
                                   (F.col("confidence") * 2).alias("completeness"))
    return ST.draft_stop(d, "question_id", "iteration", "completeness")


@register("t23_classify_problem_type", """
    WITH r AS (SELECT doc_id, lower(trim(CASE WHEN doc_id % 3 = 0 THEN 'Word_Problem'
                                           WHEN doc_id % 3 = 1 THEN 'I think this is a coding_problem or planning_task'
                                           ELSE text END)) AS t FROM documents)
    SELECT doc_id, CASE WHEN t IN ('arithmetic_calculation', 'algebraic_equation', 'statistical_analysis', 'logical_reasoning',
                                   'word_problem', 'coding_problem', 'algorithm_design', 'creative_writing', 'text_summarization',
                                   'information_retrieval', 'planning_task', 'decision_making', 'knowledge_question',
                                   'language_translation', 'sequence_completion', 'general_problem') THEN t
                        WHEN contains(t, 'arithmetic_calculation') THEN 'arithmetic_calculation'
                        WHEN contains(t, 'algebraic_equation') THEN 'algebraic_equation'
                        WHEN contains(t, 'statistical_analysis') THEN 'statistical_analysis'
                        WHEN contains(t, 'logical_reasoning') THEN 'logical_reasoning'
                        WHEN contains(t, 'word_problem') THEN 'word_problem'
                        WHEN contains(t, 'coding_problem') THEN 'coding_problem'
                        WHEN contains(t, 'algorithm_design') THEN 'algorithm_design'
                        WHEN contains(t, 'creative_writing') THEN 'creative_writing'
                        WHEN contains(t, 'text_summarization') THEN 'text_summarization'
                        WHEN contains(t, 'information_retrieval') THEN 'information_retrieval'
                        WHEN contains(t, 'planning_task') THEN 'planning_task'
                        WHEN contains(t, 'decision_making') THEN 'decision_making'
                        WHEN contains(t, 'knowledge_question') THEN 'knowledge_question'
                        WHEN contains(t, 'language_translation') THEN 'language_translation'
                        WHEN contains(t, 'sequence_completion') THEN 'sequence_completion'
                        WHEN contains(t, 'general_problem') THEN 'general_problem'
                        ELSE 'general_problem' END AS problem_type
    FROM r""")
def t23(c: Ctx) -> DataFrame:
    d = c.t.documents
    reply = (F.when(F.col("doc_id") % 3 == 0, F.lit("Word_Problem"))
              .when(F.col("doc_id") % 3 == 1, F.lit("I think this is a coding_problem or planning_task"))
              .otherwise(F.col("text")))
    return d.select("doc_id", ST.classify_problem_type(reply).alias("problem_type"))
