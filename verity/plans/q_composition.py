"""Catalog entries for composition, messages and JSON parsing
(T18, T22, T27-T29, T36, T37) and small aggregates (F19, F20, G16, H26,
H27)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as tx
from ..operators import composition as CM
from ..operators import joins as J
from ..operators import ranking
from ..operators import verify as VF
from . import sqlx as S
from .catalog import Ctx, register


@register("m1_approach_by_name", f"SELECT completion_id, {S.strip_think('text')} AS text FROM v_completions")
def m1(c: Ctx) -> DataFrame:
    return CM.apply_approach(c.v("v_completions").select("completion_id", "text"), "strip_think")


@register("m2_pipeline_sequential", f"""
    SELECT completion_id, {S.normalize_answer(S.extract_final_answer(S.strip_think('text')))} AS text FROM v_completions""")
def m2(c: Ctx) -> DataFrame:
    return CM.run_pipeline(c.v("v_completions").select("completion_id", "text"), "strip_think&final_answer&normalize")


@register("m2_pipeline_parallel", f"""
    SELECT completion_id, {S.extract_final_answer('text')} AS text, 'final_answer' AS branch FROM v_completions
    UNION ALL SELECT completion_id, {S.normalize_plain('text')} AS text, 'plain' AS branch FROM v_completions""")
def m2_par(c: Ctx) -> DataFrame:
    return CM.run_pipeline(c.v("v_completions").select("completion_id", "text"), "final_answer|plain")


@register("m3_repeat_n", "SELECT idx, prompt, unnest(range(0, 3)) AS sample_id FROM v_questions")
def m3(c: Ctx) -> DataFrame:
    return CM.repeat(c.v("v_questions"), 3)


_TAGGED = ("CASE WHEN turn % 5 = 1 THEN text || ' <approach>moa</approach>' "
           "WHEN turn = 0 AND conv_id % 4 = 0 THEN '<approach>bon</approach> ' || text ELSE text END")


def _tagged_turns(c: Ctx) -> DataFrame:
    t = c.t.conversations
    text = (F.when(F.col("turn") % 5 == 1, F.concat(F.col("text"), F.lit(" <approach>moa</approach>")))
             .when((F.col("turn") == 0) & (F.col("conv_id") % 4 == 0), F.concat(F.lit("<approach>bon</approach> "), F.col("text")))
             .otherwise(F.col("text")))
    return t.select("conv_id", "turn", "role", text.alias("text"))


_FLAT_SQL = f"""
    t0 AS (SELECT conv_id, turn, role, {_TAGGED} AS text FROM conversations),
    t1 AS (SELECT conv_id, turn, role,
                  CASE WHEN regexp_matches(text, '<approach>(.*?)</approach>')
                       THEN {S.py_strip("regexp_replace(text, '<approach>(.*?)</approach>', '', 'g')")} ELSE text END AS content,
                  CASE WHEN regexp_matches(text, '<approach>(.*?)</approach>') THEN regexp_extract(text, '<approach>(.*?)</approach>', 1) END AS tag
           FROM t0),
    flat AS (SELECT conv_id,
                    coalesce(arg_max(CASE WHEN role = 'system' THEN content END, CASE WHEN role = 'system' THEN turn END), '') AS system_prompt,
                    string_agg(CASE WHEN role = 'user' THEN 'User: ' || content WHEN role = 'assistant' THEN 'Assistant: ' || content END,
                               chr(10) ORDER BY turn) AS initial_query,
                    CASE WHEN count(CASE WHEN role = 'system' THEN 1 END) > 0
                         THEN arg_max(CASE WHEN role = 'system' THEN tag END, CASE WHEN role = 'system' THEN turn END)
                         ELSE arg_min(CASE WHEN role = 'user' THEN tag END, CASE WHEN role = 'user' AND tag IS NOT NULL THEN turn END) END AS approach
             FROM t1 GROUP BY conv_id)"""


@register("t27_flatten_conversation", f"WITH {_FLAT_SQL} SELECT * FROM flat")
def t27(c: Ctx) -> DataFrame:
    return CM.flatten_conversation(_tagged_turns(c))


@register("m4_approach_per_request", f"""
    WITH {_FLAT_SQL}
    SELECT conv_id, coalesce(approach, CASE WHEN conv_id % 3 = 0 THEN 'cot' END, 'none') AS approach FROM flat""")
def m4(c: Ctx) -> DataFrame:
    f = CM.flatten_conversation(_tagged_turns(c))
    col = F.when(F.col("conv_id") % 3 == 0, F.lit("cot"))
    return f.select("conv_id", CM.choose_approach(F.col("approach"), col, "none").alias("approach"))


@register("t28_transcript_messages", f"""
    WITH {_FLAT_SQL},
    m AS (SELECT conv_id, string_split(regexp_replace(initial_query, '(^|\\n)(User|Assistant): ', '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(1)) AS parts FROM flat),
    p AS (SELECT conv_id, list_filter(parts, lambda x: length(x) > 0) AS parts FROM m)
    SELECT conv_id, generate_subscripts(parts, 1) - 1 AS msg_pos, lower(split_part(unnest(parts), chr(2), 1)) AS role,
           regexp_replace(split_part(unnest(parts), chr(2), 2), '\\n\\z', '') AS content FROM p""")
def t28(c: Ctx) -> DataFrame:
    f = CM.flatten_conversation(_tagged_turns(c))
    m = f.select("conv_id", F.posexplode(CM.split_transcript(F.col("initial_query"))).alias("msg_pos", "m"))
    return m.select("conv_id", "msg_pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


_RESP_SQL = ("'{\"id\": \"r' || event_id || '\", \"choices\": [{\"index\": 0, \"message\": {\"role\": \"assistant\", \"content\": \"' || "
             "event_type || '\"}}, {\"index\": 1, \"message\": {\"content\": \"other\"}}], \"usage\": {\"prompt_tokens\": ' || (event_id % 100) || "
             "', \"completion_tokens\": ' || (event_id % 37) || '}}'")


@register("t29_response_contents", f"""
    SELECT event_id, json_extract_string(r, '$.choices[0].message.content') AS content,
           CAST(json_extract_string(r, '$.usage.prompt_tokens') AS BIGINT) AS prompt_tokens,
           CAST(json_extract_string(r, '$.usage.completion_tokens') AS BIGINT) AS completion_tokens
    FROM (SELECT event_id, {_RESP_SQL} AS r FROM events)""")
def t29(c: Ctx) -> DataFrame:
    e = c.t.events
    r = F.concat(F.lit('{"id": "r'), F.col("event_id").cast("string"),
                 F.lit('", "choices": [{"index": 0, "message": {"role": "assistant", "content": "'), F.col("event_type"),
                 F.lit('"}}, {"index": 1, "message": {"content": "other"}}], "usage": {"prompt_tokens": '),
                 (F.col("event_id") % 100).cast("string"), F.lit(', "completion_tokens": '),
                 (F.col("event_id") % 37).cast("string"), F.lit("}}"))
    x = CM.response_contents(r)
    return e.select("event_id", x["content"].alias("content"), x["prompt_tokens"].alias("prompt_tokens"),
                    x["completion_tokens"].alias("completion_tokens"))


_FEW_SQL = ("'Examples:' || chr(10) || '<output>[{\"question\": \"Q' || user_id || '\", \"answer\": \"' || event_type || "
            "'\"}, {\"question\": \"R' || event_id || '\", \"answer\": \"' || (event_id % 7) || '\"}]</output>'")


@register("t36_few_shot_pairs", f"""
    SELECT event_id, generate_subscripts(p, 1) - 1 AS pair_no, unnest(p).question AS question, unnest(p).answer AS answer
    FROM (SELECT event_id, from_json(trim(regexp_extract(t, '(?s)<output>(.*?)(?:</output>|\\z)', 1)),
                                     '[{{"question": "VARCHAR", "answer": "VARCHAR"}}]') AS p
          FROM (SELECT event_id, {_FEW_SQL} AS t FROM events))""")
def t36(c: Ctx) -> DataFrame:
    e = c.t.events
    t = F.concat(F.lit('Examples:\n<output>[{"question": "Q'), F.col("user_id").cast("string"), F.lit('", "answer": "'),
                 F.col("event_type"), F.lit('"}, {"question": "R'), F.col("event_id").cast("string"), F.lit('", "answer": "'),
                 (F.col("event_id") % 7).cast("string"), F.lit('"}]</output>'))
    p = e.select("event_id", F.posexplode(CM.few_shot_pairs(t)).alias("pair_no", "p"))
    return p.select("event_id", "pair_no", F.col("p.question").alias("question"), F.col("p.answer").alias("answer"))


_VEC_SQL = """
    v AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ', ') AS csv
          FROM embeddings),
    t AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN '[' || csv || ']' WHEN vec_id % 3 = 1 THEN csv ELSE csv || ', x' END AS txt FROM v)"""


@register("t37_parse_vector", f"""
    WITH {_VEC_SQL}
    SELECT vec_id, CASE WHEN starts_with(trim(txt), '[') THEN CAST(json(trim(txt)) AS DOUBLE[])
                        WHEN list_bool_and(list_transform(string_split(txt, ','), lambda s: TRY_CAST(trim(s) AS DOUBLE) IS NOT NULL))
                        THEN list_transform(string_split(txt, ','), lambda s: TRY_CAST(trim(s) AS DOUBLE)) END AS vector
    FROM t""")
def t37(c: Ctx) -> DataFrame:
    e = c.t.embeddings
    csv = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string")), ", ")
    txt = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("["), csv, F.lit("]"))).when(F.col("vec_id") % 3 == 1, csv) \
        .otherwise(F.concat(csv, F.lit(", x")))
    return e.select("vec_id", CM.parse_vector(txt).alias("vector"))


_JSON_TEXT = (
    "CASE event_id % 8 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' "
    "WHEN 1 THEN 'Result ' || props || ' and {\"k\": 0}' WHEN 2 THEN 'no json here' "
    "WHEN 3 THEN 'x {\"a\": ' || props || ', \"b\": \"}\"} y' WHEN 4 THEN 'open { then ```json' || chr(10) || props || '```' "
    "WHEN 5 THEN '{''k'': ''' || event_id || ''', name: ''x'',, }' WHEN 6 THEN 'see `' || props || '`' ELSE '{ } {}' END")


def _json_sql() -> str:
    rest = "substring(t, strpos(t, '{'))"
    parts = f"string_split({rest}, '}}')"
    opened = "(length(p) - length(replace(p, '{', '')))"
    step = (f"{{'n': a.n + length(p) + 1, 'open': a.open + {opened} - 1, "
            f"'fin': CASE WHEN a.fin = 0 AND a.open + {opened} - 1 = 0 THEN a.n + length(p) + 1 ELSE a.fin END}}")
    end = (f"coalesce((list_reduce(list_slice({parts}, 1, len({parts}) - 1), lambda a, p: {step}, "
           f"{{'n': 0::BIGINT, 'open': 0::BIGINT, 'fin': 0::BIGINT}})).fin, 0)")
    span = "regexp_extract(t, '(?s)(\\{.*\\})', 1)"
    for pattern, to in CM.JSON_REPAIRS:
        span = f"regexp_replace({span}, {S.q(pattern)}, {S.q(re.sub(r'[$]([0-9])', chr(92) + chr(92) + r'1', to))}, 'g')"
    cs = [(1, f"CASE WHEN strpos(t, '{{') > 0 AND {end} > 0 THEN substring({rest}, 1, {end}) END"),
          (2, f"regexp_extract(t, {S.q(CM.NESTED_OBJECT_RE)}, 0)"),
          *[(3, S.py_strip(f"regexp_extract(t, {S.q(p)}, 1)")) for p in CM.CODE_BLOCK_RES], (4, span)]
    cols = ", ".join(f"{c} AS c{i}" for i, (_, c) in enumerate(cs))
    ok = lambda c: f"(json_valid({c}) AND starts_with({c}, '{{') AND NOT regexp_matches({c}, '^\\{{\\s*\\}}$'))"
    which = "CASE " + " ".join(f"WHEN {ok(f'c{i}')} THEN {i}" for i in range(len(cs))) + " END"
    ks, js = ("CASE w " + " ".join(f"WHEN {i} THEN {v(i)}" for i in range(len(cs))) + f" ELSE {other} END"
              for v, other in ((lambda i: str(cs[i][0]), "5"), (lambda i: f"c{i}", S.q(CM.DEFAULT_STRUCTURE))))
    return f"""
    WITH a AS (SELECT event_id, {_JSON_TEXT} AS t FROM events), b AS (SELECT event_id, {cols} FROM a), c AS (SELECT *, {which} AS w FROM b)
    SELECT event_id, {ks} AS strategy, {js} AS json FROM c"""


@register("t18_json_from_text", _json_sql())
def t18(c: Ctx) -> DataFrame:
    n, p = F.col("event_id") % 8, F.col("props")
    t = (F.when(n == 0, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```"))).when(n == 1, F.concat(F.lit("Result "), p, F.lit(' and {"k": 0}')))
          .when(n == 2, F.lit("no json here")).when(n == 3, F.concat(F.lit('x {"a": '), p, F.lit(', "b": "}"} y')))
          .when(n == 4, F.concat(F.lit("open { then ```json\n"), p, F.lit("```")))
          .when(n == 5, F.concat(F.lit("{'k': '"), F.col("event_id").cast("string"), F.lit("', name: 'x',, }")))
          .when(n == 6, F.concat(F.lit("see `"), p, F.lit("`"))).otherwise(F.lit("{ } {}")))
    j = CM.json_from_text(F.col("t"))
    return c.t.events.select("event_id", t.alias("t")).select("event_id", j["strategy"].alias("strategy"), j["json"].alias("json"))


_KV_TEXT = ("'STRATEGY: s' || strategy_id || chr(10) || 'score: ' || CASE WHEN event_id % 4 = 0 THEN 'high' ELSE CAST(event_id % 10 AS VARCHAR) || '.5' END "
            "|| chr(10) || 'notes without colon' || chr(10) || 'Score : ' || (event_id % 3)")


@register("t22_key_value_blocks", f"""
    WITH t AS (SELECT event_id, {_KV_TEXT} AS t FROM v_attempts),
    e AS (SELECT event_id, list_filter(list_transform(list_filter(string_split(t, chr(10)), lambda l: contains(l, ':')),
                 lambda l: {{'k': upper({S.py_strip("split_part(l, ':', 1)")}), 'v': {S.py_strip("substring(l, strpos(l, ':') + 1)")}}}),
                 lambda x: length(x.k) > 0) AS kv FROM t)
    SELECT event_id, list_filter(kv, lambda x: x.k = 'STRATEGY')[-1].v AS strategy,
           coalesce(TRY_CAST(nullif(regexp_extract(list_filter(kv, lambda x: x.k = 'SCORE')[-1].v, '([0-9]*\\.?[0-9]+)', 1), '') AS DOUBLE), 0.5) AS score
    FROM e""")
def t22(c: Ctx) -> DataFrame:
    a = c.v("v_attempts")
    t = F.concat(F.lit("STRATEGY: s"), F.col("strategy_id").cast("string"), F.lit("\nscore: "),
                 F.when(F.col("event_id") % 4 == 0, F.lit("high")).otherwise(F.concat((F.col("event_id") % 10).cast("string"), F.lit(".5"))),
                 F.lit("\nnotes without colon\nScore : "), (F.col("event_id") % 3).cast("string"))
    kv = CM.key_values(t)
    return a.select("event_id", CM.kv_get(kv, "STRATEGY").alias("strategy"),
                    CM.score_value(A.nonempty(CM.kv_get(kv, "SCORE"))).alias("score"))


@register("m5_round_robin_assignment", """
    SELECT doc_id, ['control', 'variant_a', 'variant_b'][((row_number() OVER (ORDER BY doc_id) - 1) % 3) + 1] AS variant FROM documents""")
def m5_rr(c: Ctx) -> DataFrame:
    r = ranking.global_rank(c.t.documents.select("doc_id"), ["doc_id"], "rank")
    return CM.assign_round_robin(r, "rank", ["control", "variant_a", "variant_b"]).select("doc_id", "variant")


@register("m5_weighted_assignment", """
    SELECT doc_id, CASE WHEN ((doc_id * 48271 + 11) % 2147483647) / 2147483647.0 < 0.5 THEN 'control'
                        WHEN ((doc_id * 48271 + 11) % 2147483647) / 2147483647.0 < 0.8 THEN 'variant_a' ELSE 'variant_b' END AS variant
    FROM documents""")
def m5_w(c: Ctx) -> DataFrame:
    return CM.assign_weighted(c.t.documents.select("doc_id"), "doc_id", {"control": 5, "variant_a": 3, "variant_b": 2})


@register("f19_usage_sums", """
    SELECT request_id, CAST(sum(CASE WHEN kind = 'provider_call' THEN 1 ELSE 0 END) AS BIGINT) AS llm_calls,
           CAST(sum(event_id % 37) AS BIGINT) AS completion_tokens, CAST(sum(event_id % 100 + event_id % 37) AS BIGINT) AS total_tokens
    FROM v_requests GROUP BY 1""")
def f19(c: Ctx) -> DataFrame:
    r = c.v("v_requests")
    return r.groupBy("request_id").agg(
        F.sum(F.when(F.col("kind") == "provider_call", 1).otherwise(0)).cast("bigint").alias("llm_calls"),
        F.sum(F.col("event_id") % 37).cast("bigint").alias("completion_tokens"),
        F.sum(F.col("event_id") % 100 + F.col("event_id") % 37).cast("bigint").alias("total_tokens"))


@register("f20_verification_metrics", """
    WITH s AS (SELECT solution_id, count(*) AS n, max(attempt) - coalesce(max(CASE WHEN assessment <> 'CORRECT' THEN attempt END), 0) >= 5 AS ok,
                      sum(CASE WHEN assessment = 'CORRECT' THEN 1 ELSE 0 END) AS n_correct
               FROM v_verifications GROUP BY 1)
    SELECT solution_id % 10 AS batch, count(*) AS n_solutions, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_verified,
           round(sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(*), 9) AS verification_rate,
           round(sum(n) / greatest(sum(n_correct), 1), 9) AS verifications_per_correct,
           round(coalesce(sum(CASE WHEN ok THEN n_correct END) / nullif(sum(CASE WHEN ok THEN n END), 0), 0.0), 9) AS consensus_quality
    FROM s GROUP BY 1""")
def f20(c: Ctx) -> DataFrame:
    v = c.v("v_verifications")
    streak = VF.verified_by_streak(v, passes=5)
    sc = v.groupBy("solution_id").agg(F.sum(F.when(F.col("assessment") == "CORRECT", 1).otherwise(0)).alias("n_correct"))
    s = streak.join(sc, "solution_id").withColumn("batch", F.col("solution_id") % 10)
    ok = F.col("is_verified")
    return s.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_solutions"), F.sum(F.when(ok, 1).otherwise(0)).cast("bigint").alias("n_verified"),
        F.round(F.sum(F.when(ok, 1).otherwise(0)) / F.count(F.lit(1)), 9).alias("verification_rate"),
        F.round(F.sum("n_verifications") / F.greatest(F.sum("n_correct"), F.lit(1)), 9).alias("verifications_per_correct"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(ok, F.col("n_correct"))).cast("double"),
                                        F.sum(F.when(ok, F.col("n_verifications")))), F.lit(0.0)), 9).alias("consensus_quality"))


@register("g16_word_overlap_match", """
    WITH w AS (SELECT idx, list_distinct(list_filter(regexp_split_to_array(lower(prompt), '\\s+'), lambda x: length(x) > 0)) AS a,
                      list_distinct(list_filter(regexp_split_to_array(lower(model_answer), '\\s+'), lambda x: length(x) > 0)) AS b
               FROM v_results)
    SELECT idx, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0.0), 9) AS jaccard,
           coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0.0) > 0.7 AS is_match
    FROM w""")
def g16(c: Ctx) -> DataFrame:
    r = c.v("v_results")
    a = tx.split_words(F.lower("prompt"))
    b = tx.split_words(F.lower("model_answer"))
    j = F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))
    return r.select("idx", F.round(j, 9).alias("jaccard"), (j > 0.7).alias("is_match"))


@register("h26_prompt_statistics", """
    WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations),
    u AS (SELECT array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 0))), ' ') AS signature,
                 CASE WHEN next_role = 'assistant' THEN 1.0 ELSE 0.0 END AS success FROM t WHERE role = 'user')
    SELECT signature, count(*) AS uses, round(avg(success), 9) AS success_rate FROM u GROUP BY 1""")
def h26(c: Ctx) -> DataFrame:
    t = c.t.conversations
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = t.withColumn("next_role", F.lead("role").over(w)).where(F.col("role") == "user")
    u = u.select(J.prompt_signature(F.col("text")).alias("signature"),
                 F.when(F.col("next_role") == "assistant", 1.0).otherwise(0.0).alias("success"))
    return u.groupBy("signature").agg(F.count(F.lit(1)).alias("uses"), F.round(F.avg("success"), 9).alias("success_rate"))


# Fixed values for the fixture: steering strength per pattern label; others default 1.0.
_STRENGTH = {0: 0.5, 1: 1.5, 2: 2.0}


@register("h27_vectors_by_pattern", """
    WITH s(label, strength) AS (VALUES (0, 0.5), (1, 1.5), (2, 2.0))
    SELECT e.label, count(*) AS n_vectors, CAST(coalesce(s.strength, 1.0) AS DOUBLE) AS strength
    FROM embeddings e LEFT JOIN s USING (label) GROUP BY e.label, s.strength""")
def h27(c: Ctx) -> DataFrame:
    e = c.t.embeddings
    s = c.spark.createDataFrame(list(_STRENGTH.items()), "label int, strength double")
    g = e.groupBy("label").agg(F.count(F.lit(1)).alias("n_vectors"))
    return g.join(F.broadcast(s), "label", "left").select("label", "n_vectors",
                                                          F.coalesce("strength", F.lit(1.0)).alias("strength"))
