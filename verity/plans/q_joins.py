"""Catalog entries for joins and T35."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from .catalog import Ctx, register

_BLOCK_SQL = ("'<<<BEGIN DOC [' || doc_index || ']>>>' || chr(10) || 'Source: Wikipedia | URL: ' || url || chr(10) || "
              "'Title: ' || title || chr(10) || article || chr(10) || '<<<END DOC [' || doc_index || ']>>>' || chr(10)")
_CTX_SQL = f"ctx AS (SELECT idx, string_agg({_BLOCK_SQL}, chr(10) ORDER BY doc_index) AS context FROM v_contexts GROUP BY idx)"


@register("c3_build_context", f"WITH {_CTX_SQL} SELECT * FROM ctx")
def c3(c: Ctx) -> DataFrame:
    return J.build_context(c.v("v_contexts"), "idx", "newline")


@register("c3_build_context_blank", f"""
    SELECT idx, string_agg({_BLOCK_SQL} || chr(10), '' ORDER BY doc_index) AS context FROM v_contexts GROUP BY idx""")
def c3_blank(c: Ctx) -> DataFrame:
    return J.build_context(c.v("v_contexts"), "idx", "blank")


@register("c1_augment", f"WITH {_CTX_SQL} SELECT q.idx, q.prompt, ctx.context FROM v_questions q JOIN ctx USING (idx)")
def c1(c: Ctx) -> DataFrame:
    return J.augment(c.v("v_questions"), J.build_context(c.v("v_contexts")), "idx")


@register("c2_augment_allow_missing", f"""
    WITH {_CTX_SQL} SELECT r.idx, r.prompt, r.model_answer, ctx.context FROM v_results r JOIN ctx USING (idx)""")
def c2(c: Ctx) -> DataFrame:
    ans = c.v("v_results").select("idx", "prompt", "model_answer")
    matched, _ = J.augment_allow_missing(ans, J.build_context(c.v("v_contexts")), "idx")
    return matched


@register("c2_unmatched_answers", f"""
    WITH {_CTX_SQL} SELECT r.idx FROM v_results r WHERE r.idx NOT IN (SELECT idx FROM ctx)""")
def c2_missing(c: Ctx) -> DataFrame:
    ans = c.v("v_results").select("idx")
    _, missing = J.augment_allow_missing(ans, J.build_context(c.v("v_contexts")), "idx")
    return missing


@register("c4_merged_context", f"""
    WITH {_CTX_SQL}
    SELECT q.idx, q.prompt, ctx.context AS Context FROM v_questions q JOIN ctx USING (idx)""")
def c4(c: Ctx) -> DataFrame:
    # The merged file carries the rendered context in place of the nested documents.
    nested = c.v("v_contexts").groupBy("idx").agg(F.collect_list(F.struct("doc_index", "url")).alias("wiki_content"))
    q = c.v("v_questions").join(nested, "idx")
    return q.join(J.build_context(c.v("v_contexts")), "idx").withColumnRenamed("context", "Context") \
        .drop("wiki_content").select("idx", "prompt", "Context")


@register("c5_c6_pair_counts", """
    WITH k AS (SELECT question_id, answer, count(*) AS k FROM v_candidates GROUP BY 1, 2)
    SELECT question_id, CAST(sum(k) AS BIGINT) AS n_candidates, CAST(sum(k) * (sum(k) - 1) AS BIGINT) AS ordered_pairs,
           CAST(sum(k) * (sum(k) - 1) / 2 AS BIGINT) AS unordered_pairs, CAST(sum(k * (k - 1) / 2) AS BIGINT) AS agreeing_pairs
    FROM k GROUP BY 1""")
def c5(c: Ctx) -> DataFrame:
    return J.pair_counts(c.v("v_candidates"), "question_id", F.col("answer"))


@register("c7_best_peer_strategy", """
    WITH s AS (SELECT question_id, answer AS agent, candidate_id, confidence FROM v_candidates),
    pa AS (SELECT question_id, agent, count(*) AS k FROM s GROUP BY 1, 2),
    pairs AS (SELECT a.question_id, a.agent, b.candidate_id, b.agent AS peer_agent, b.confidence
              FROM pa a JOIN s b ON a.question_id = b.question_id AND a.agent <> b.agent),
    best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY question_id, agent ORDER BY confidence DESC, candidate_id) = 1),
    cnt AS (SELECT question_id, agent, count(*) AS n FROM pairs GROUP BY 1, 2)
    SELECT pa.question_id, pa.agent, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_peer_strategies, best.candidate_id AS best_peer_strategy,
           best.peer_agent AS best_peer_agent, best.confidence AS best_peer_score
    FROM pa LEFT JOIN best USING (question_id, agent) LEFT JOIN cnt USING (question_id, agent)""")
def c7(c: Ctx) -> DataFrame:
    s = c.v("v_candidates").select("question_id", F.col("answer").alias("agent"), "candidate_id", "confidence")
    return J.best_peer_strategy(s, "question_id", "agent", "confidence", "candidate_id")


@register("c8_verifier_assignment", """
    WITH a AS (SELECT question_id, candidate_id AS id, temperature AS t FROM v_candidates),
    p AS (SELECT x.question_id, x.id, y.id AS vid, abs(x.t - y.t) AS d FROM a x JOIN a y ON x.question_id = y.question_id AND x.id <> y.id),
    b AS (SELECT question_id, id, vid FROM p QUALIFY row_number() OVER (PARTITION BY question_id, id ORDER BY d DESC, vid) = 1)
    SELECT a.question_id, a.id AS candidate_id, coalesce(b.vid, a.id) AS verifier FROM a LEFT JOIN b USING (question_id, id)""")
def c8(c: Ctx) -> DataFrame:
    # Only the V_candidates columns C8 needs, projected straight from events
    # (the view's per-user position is not used here).
    agents = c.t.events.select(F.col("user_id").alias("question_id"), F.col("event_id").alias("candidate_id"),
                               ((F.col("event_id") % 4) / 10).alias("temperature"))
    return J.farthest_other(agents, "question_id", "candidate_id", "temperature")


_SIG_SQL = "array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 0))), ' ')"


@register("t35_prompt_signature", f"SELECT doc_id, {_SIG_SQL} AS signature FROM documents")
def t35(c: Ctx) -> DataFrame:
    return c.t.documents.select("doc_id", J.prompt_signature(F.col("text")).alias("signature"))


_C10_SQL = f"""
    WITH d AS (SELECT doc_id, {_SIG_SQL} AS signature, CAST(0.6 AS DOUBLE) + (doc_id % 3) / CAST(10 AS DOUBLE) AS temperature,
                      CAST(0.9 AS DOUBLE) + (doc_id % 2) * CAST(0.05 AS DOUBLE) AS top_p FROM documents),
    cache AS (SELECT signature, doc_id AS entry_id, temperature AS ct, top_p AS cp FROM d WHERE doc_id % 2 = 0
              QUALIFY row_number() OVER (PARTITION BY signature ORDER BY doc_id) = 1),
    req AS (SELECT * FROM d WHERE doc_id % 2 = 1)
    SELECT req.signature, req.doc_id, req.temperature, req.top_p,
           coalesce(abs(req.temperature - ct) < 0.1 AND abs(req.top_p - cp) < 0.1, false) AS cache_hit,
           CASE WHEN abs(req.temperature - ct) < 0.1 AND abs(req.top_p - cp) < 0.1 THEN entry_id END AS cached_entry
    FROM req LEFT JOIN cache USING (signature)"""


@register("c10_prompt_cache_lookup", _C10_SQL)
def c10(c: Ctx) -> DataFrame:
    d = c.t.documents.select("doc_id", J.prompt_signature(F.col("text")).alias("signature"),
                             (F.lit(0.6) + (F.col("doc_id") % 3) / 10.0).alias("temperature"),
                             (F.lit(0.9) + (F.col("doc_id") % 2) * 0.05).alias("top_p"))
    cache = d.where(F.col("doc_id") % 2 == 0).groupBy("signature").agg(
        F.min(F.struct("doc_id", "temperature", "top_p")).alias("_e")) \
        .select("signature", F.col("_e.doc_id").alias("entry_id"), F.col("_e.temperature").alias("temperature"),
                F.col("_e.top_p").alias("top_p"))
    req = d.where(F.col("doc_id") % 2 == 1)
    return J.cache_lookup(req, cache, "signature").select("signature", "doc_id", "temperature", "top_p",
                                                          "cache_hit", "cached_entry")


@register("c11_suffix_key_match", """
    WITH k AS (SELECT doc_id, right(text, 100) AS s FROM documents)
    SELECT a.doc_id, min(b.doc_id) AS match_id FROM k a LEFT JOIN k b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id""")
def c11(c: Ctx) -> DataFrame:
    return J.suffix_key_match(c.t.documents, "doc_id", "text", 100)


@register("c12_membership_semi_join", """
    SELECT strategy_id, event_id FROM v_attempts
    WHERE strategy_id IN (SELECT strategy_id FROM v_attempts WHERE problem_type IN ('type_3', 'type_4') AND success)""")
def c12(c: Ctx) -> DataFrame:
    a = c.v("v_attempts")
    ids = a.where(F.col("problem_type").isin("type_3", "type_4") & F.col("success")).select("strategy_id")
    return a.join(ids, "strategy_id", "left_semi").select("strategy_id", "event_id")
