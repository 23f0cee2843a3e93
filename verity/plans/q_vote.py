"""Catalog entries for voting and selection and T12."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import vote as V
from . import sqlx as S
from .catalog import Ctx, register


def _general_sql(x: str) -> dict[str, str]:
    """DuckDB twin of ``answers.extract_general``."""
    cs = [f"nullif({S.py_strip(S.last_match(x, '(?i)' + p))}, '')" for p, _ in A.GENERAL_PATTERNS]
    v = f"coalesce({', '.join(cs)})"
    boxed = f"({cs[0]} IS NOT NULL OR {cs[1]} IS NOT NULL)"
    as_int = f"CASE WHEN regexp_matches({v}, '^[0-9]+\\z') THEN TRY_CAST({v} AS DOUBLE) END"
    as_float = f"TRY_CAST({v} AS DOUBLE)"
    is_set = f"(starts_with({v}, '{{') AND ends_with({v}, '}}') AND contains({v}, ','))"
    kind = (f"CASE WHEN {v} IS NULL THEN NULL WHEN NOT {boxed} THEN 'str' WHEN {as_int} IS NOT NULL THEN 'int' "
            f"WHEN {as_float} IS NOT NULL THEN CASE WHEN {as_float} = floor({as_float}) THEN 'int' ELSE 'float' END "
            f"WHEN {is_set} THEN 'set' ELSE 'str' END")
    inner = f"regexp_replace(regexp_replace({v}, '^\\{{', ''), '\\}}\\z', '')"
    ints = (f"list_sort(list_distinct(list_transform(list_filter(list_transform(string_split({inner}, ','), "
            f"lambda s: {S.py_strip('s')}), lambda s: regexp_matches(s, '^[0-9]+\\z')), lambda s: CAST(s AS INTEGER))))")
    return {
        "kind": kind,
        "num": f"CASE WHEN ({kind}) = 'int' THEN coalesce({as_int}, CAST(floor({as_float}) AS DOUBLE)) WHEN ({kind}) = 'float' THEN {as_float} END",
        "num_set": f"CASE WHEN ({kind}) = 'set' THEN {ints} END",
        "text": v,
    }


_GEN = _general_sql("text")


@register("t12_extract_general", f"""
    SELECT completion_id, {_GEN['kind']} AS kind, {_GEN['num']} AS num, {_GEN['num_set']} AS num_set, {_GEN['text']} AS text
    FROM (SELECT completion_id, CASE WHEN completion_id % 6 = 1 THEN replace(text, '\\boxed{{' || (completion_id % 1000) || '}}', '\\boxed{{1, 3,2,x}}')
                                     WHEN completion_id % 6 = 2 THEN replace(text, '\\boxed{{' || (completion_id % 1000) || '}}', '\\boxed{{2.50}}')
                                     WHEN completion_id % 6 = 3 THEN replace(text, '\\boxed{{', 'boxed ') ELSE text END AS text
          FROM v_completions)""")
def t12(c: Ctx) -> DataFrame:
    comp = c.v("v_completions")
    n = F.col("completion_id")
    boxed = F.concat(F.lit("\\boxed{"), (n % 1000).cast("string"), F.lit("}"))
    text = (F.when(n % 6 == 1, F.replace(F.col("text"), boxed, F.lit("\\boxed{1, 3,2,x}")))
             .when(n % 6 == 2, F.replace(F.col("text"), boxed, F.lit("\\boxed{2.50}")))
             .when(n % 6 == 3, F.replace(F.col("text"), F.lit("\\boxed{"), F.lit("boxed ")))
             .otherwise(F.col("text")))
    g = A.with_general_answer(comp.select("completion_id", text.alias("text")), "text", "g")
    return g.select("completion_id", F.col("g.kind").alias("kind"), F.col("g.num").alias("num"),
                    F.col("g.num_set").alias("num_set"), F.col("g.text").alias("text"))


_NORM = S.normalize_answer(S.extract_final_answer("text"))


@register("g1_majority_vote", f"""
    WITH c AS (SELECT question_id, completion_id AS pos, text, {_NORM} AS ans FROM v_completions),
    v AS (SELECT question_id, ans, count(*) AS n, min(pos) AS first_pos, arg_min(text, pos) AS resp
          FROM c WHERE length(ans) > 0 GROUP BY question_id, ans),
    w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first_pos) = 1),
    a AS (SELECT question_id, count(*) AS n_candidates, arg_min(text, pos) AS first_resp FROM c GROUP BY question_id)
    SELECT a.question_id, w.ans AS answer, coalesce(w.n, 0) AS n_votes, a.n_candidates,
           coalesce(w.resp, a.first_resp) AS response
    FROM a LEFT JOIN w USING (question_id)""")
def g1(c: Ctx) -> DataFrame:
    comp = c.v("v_completions").withColumnRenamed("completion_id", "pos")
    return V.majority_vote(comp, "question_id", "pos", "text")


_TRACE_ANS = S.last_sentence("answer")


@register("g2_consensus", f"""
    WITH c AS (SELECT question_id, pos, {_TRACE_ANS} AS ans FROM v_candidates),
    g AS (SELECT question_id, ans, count(*) AS n, min(pos) AS first_pos FROM c GROUP BY 1, 2),
    t AS (SELECT question_id, sum(n) AS n_total FROM g GROUP BY 1),
    w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first_pos) = 1)
    SELECT w.question_id, w.ans AS answer, w.n AS n_votes, CAST(t.n_total AS BIGINT) AS n_total,
           round(w.n / t.n_total, 6) AS consensus_ratio, w.n / t.n_total >= 0.95 AS has_consensus
    FROM w JOIN t USING (question_id)""")
def g2(c: Ctx) -> DataFrame:
    return V.consensus(c.v("v_candidates"), "question_id", "pos", A.last_sentence(F.col("answer")), 0.95)


_G3_SQL = f"""
    WITH c AS (SELECT question_id, pos, {_TRACE_ANS} AS answer, confidence FROM v_candidates),
    g AS (SELECT question_id, answer, count(*) AS n, avg(confidence) AS avg_confidence, min(pos) AS first_pos FROM c GROUP BY 1, 2),
    t AS (SELECT question_id, count(*) AS total FROM c GROUP BY 1),
    s AS (SELECT g.*, g.n / t.total AS share, g.avg_confidence * 0.7 + g.n / t.total * 0.3 AS score FROM g JOIN t USING (question_id))"""


@register("g3_weighted_vote", _G3_SQL + """
    SELECT question_id, answer, round(round(score, 12), 6) AS best_score, num_unique_answers
    FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS num_unique_answers FROM s)
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, first_pos) = 1""")
def g3(c: Ctx) -> DataFrame:
    return V.weighted_vote(c.v("v_candidates"), "question_id", "pos", A.last_sentence(F.col("answer")), "confidence")


@register("g3_answer_distribution", _G3_SQL + """
    SELECT question_id, answer, n, round(avg_confidence, 9) AS avg_confidence, first_pos, round(share, 9) AS share,
           round(score, 9) AS score FROM s""")
def g3_dist(c: Ctx) -> DataFrame:
    d = V.answer_distribution(c.v("v_candidates"), "question_id", "pos", A.last_sentence(F.col("answer")), "confidence")
    return d.select("question_id", "answer", "n", F.round("avg_confidence", 9).alias("avg_confidence"), "first_pos",
                    F.round("share", 9).alias("share"), F.round("score", 9).alias("score"))


@register("g4_score_sum_vote", """
    WITH g AS (SELECT question_id, answer, sum(confidence) AS s, min(pos) AS first_pos FROM v_candidates GROUP BY 1, 2)
    SELECT question_id, answer, round(s, 6) AS total_score FROM g
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(s, 12) DESC, first_pos) = 1""")
def g4(c: Ctx) -> DataFrame:
    return V.score_sum_vote(c.v("v_candidates"), "question_id", "pos", F.col("answer"), "confidence")


@register("g5_max_confidence_vote", """
    WITH g AS (SELECT question_id, answer, max(confidence) AS mx, count(*) AS n, min(pos) AS first_pos FROM v_candidates GROUP BY 1, 2)
    SELECT question_id, answer, mx AS max_confidence, n AS n_votes FROM g
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY mx DESC, n DESC, first_pos) = 1""")
def g5(c: Ctx) -> DataFrame:
    return V.max_confidence_vote(c.v("v_candidates"), "question_id", "pos", F.col("answer"), "confidence")


_G6_IN = f"""
    c AS (SELECT e.user_id AS question_id, e.event_id AS pos, 'solution ' || e.event_id AS sol, e.value / 500 AS conf,
                 ({S.extract_aime('t.text')}) % 4 AS num
          FROM events e JOIN v_completions t ON t.completion_id = e.event_id)"""


@register("g6_numeric_vote", f"""
    WITH {_G6_IN},
    nn AS (SELECT * FROM c WHERE num IS NOT NULL),
    g AS (SELECT question_id, num, count(*) AS n, min(pos) AS first_pos,
                 arg_max(sol, (conf, -pos)) AS best_sol, max(conf) AS best_conf FROM nn GROUP BY 1, 2),
    t AS (SELECT question_id, sum(n) AS n_numeric FROM g GROUP BY 1),
    w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first_pos) = 1),
    q AS (SELECT DISTINCT question_id FROM c),
    j AS (SELECT q.question_id, w.num, w.n, w.best_sol, w.best_conf, coalesce(t.n_numeric >= 2 AND w.n >= 2, false) AS ok
          FROM q LEFT JOIN w USING (question_id) LEFT JOIN t USING (question_id))
    SELECT question_id, CASE WHEN ok THEN num END AS answer, CASE WHEN ok THEN n END AS n_votes,
           CASE WHEN ok THEN best_sol END AS solution, CASE WHEN ok THEN best_conf END AS confidence, NOT ok AS fallback
    FROM j""")
def g6(c: Ctx) -> DataFrame:
    e = c.t.events.select(
        F.col("user_id").alias("question_id"), F.col("event_id").alias("pos"),
        F.concat(F.lit("solution "), F.col("event_id").cast("string")).alias("sol"),
        (F.col("value") / 500).alias("conf"))
    t = c.v("v_completions").select(F.col("completion_id").alias("pos"), "text")
    cands = e.join(t, "pos")
    return V.numeric_vote(cands, "question_id", "pos", A.extract_aime(F.col("text")) % 4, "conf", "sol")


_G8_TEXT = "CASE WHEN completion_id % 4 = 0 THEN regexp_replace(text, '[0-9]+', '', 'g') ELSE text END"


@register("g8_math_majority", f"""
    WITH c AS (SELECT question_id, completion_id AS pos,
                      TRY_CAST(regexp_extract_all(right({_G8_TEXT}, 100), {S.q(A.NUMBER_RE)}, 0)[-1] AS DOUBLE) AS ans FROM v_completions),
    g AS (SELECT question_id, ans, count(*) AS n, min(pos) AS first_pos FROM c GROUP BY 1, 2),
    t AS (SELECT question_id, sum(n) AS n_total FROM g GROUP BY 1),
    w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first_pos) = 1)
    SELECT w.question_id, w.ans AS answer, w.n AS n_votes, CAST(t.n_total AS BIGINT) AS n_total
    FROM w JOIN t USING (question_id)""")
def g8(c: Ctx) -> DataFrame:
    comp = c.v("v_completions").withColumnRenamed("completion_id", "pos")
    text = F.when(F.col("pos") % 4 == 0, F.regexp_replace("text", "[0-9]+", "")).otherwise(F.col("text"))
    return V.consensus(comp, "question_id", "pos", A.last_number(text, 100)).select("question_id", "answer", "n_votes", "n_total")


@register("g9_rating_argmax", f"""
    WITH r AS (SELECT question_id, completion_id AS pos, {S.rating_absolute('text')} AS rating FROM v_completions)
    SELECT question_id, pos, rating, pos AS completion_id FROM r
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rating DESC, pos) = 1""")
def g9(c: Ctx) -> DataFrame:
    comp = c.v("v_completions").withColumn("pos", F.col("completion_id"))
    return V.rating_argmax(comp, "question_id", "pos", A.rating_absolute(F.col("text")), "completion_id")


@register("g10_pairwise_wins", """
    WITH c AS (SELECT question_id, pos, confidence AS v FROM v_candidates),
    w AS (SELECT a.question_id, a.pos,
                 CAST(sum(CASE WHEN a.v > b.v THEN 2 WHEN a.v = b.v THEN 1 ELSE 0 END) AS BIGINT) AS wins
          FROM c a JOIN c b ON a.question_id = b.question_id AND a.pos <> b.pos GROUP BY 1, 2),
    allc AS (SELECT c.question_id, c.pos, coalesce(w.wins, 0) AS wins FROM c LEFT JOIN w USING (question_id, pos)),
    best AS (SELECT question_id, pos AS best_pos FROM allc QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY wins DESC, pos) = 1)
    SELECT allc.question_id, allc.pos, allc.wins, allc.pos = best.best_pos AS is_best FROM allc JOIN best USING (question_id)""")
def g10(c: Ctx) -> DataFrame:
    return V.pairwise_wins(c.v("v_candidates"), "question_id", "pos", "confidence")


@register("g11_best_across_rounds", """
    SELECT question_id, pos, confidence AS rating, candidate_id FROM v_candidates
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, pos) = 1""")
def g11(c: Ctx) -> DataFrame:
    return V.rating_argmax(c.v("v_candidates"), "question_id", "pos", F.col("confidence"), "candidate_id")


_G13_ANS = S.normalize_plain(S.extract_answer_uncertain("text"))


@register("g13_majority_longest", f"""
    WITH c AS (SELECT question_id, completion_id AS pos, {_G13_ANS} AS ans, text FROM v_completions),
    g AS (SELECT question_id, ans, count(*) AS n, min(pos) AS first_pos,
                 arg_max(pos, (length(text), -pos)) AS long_pos, max(length(text)) AS long_len FROM c GROUP BY 1, 2)
    SELECT question_id, ans AS answer, n AS n_votes, long_pos AS pos, long_len AS response_length FROM g
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first_pos) = 1""")
def g13(c: Ctx) -> DataFrame:
    comp = c.v("v_completions").withColumn("pos", F.col("completion_id"))
    ans = A.normalize_answer_plain(A.extract_answer_uncertain(F.col("text")))
    return V.majority_longest(comp, "question_id", "pos", ans, "text")


def _solutions(c: Ctx) -> DataFrame:
    cand = c.v("v_candidates")
    return cand.withColumn("is_verified", F.col("candidate_id") % 3 == 0)


@register("g17_consensus_counts", """
    SELECT question_id, answer, count(*) AS n_verified, count(*) >= 2 AS is_consensus
    FROM v_candidates WHERE candidate_id % 3 = 0 GROUP BY 1, 2""")
def g17(c: Ctx) -> DataFrame:
    return V.consensus_counts(_solutions(c), "question_id", "is_verified", "answer")


@register("g18_best_solution", """
    WITH s AS (SELECT question_id, pos, CAST(candidate_id % 3 = 0 AS INTEGER) AS v,
                      CASE WHEN candidate_id % 3 = 0 THEN confidence ELSE temperature END AS score FROM v_candidates)
    SELECT question_id, pos, v = 1 AS from_verified, score FROM s
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY v DESC, score DESC, pos) = 1""")
def g18(c: Ctx) -> DataFrame:
    return V.best_solution(_solutions(c), "question_id", "pos", "is_verified", "confidence", "temperature")


@register("g19_genselect_join", f"""
    WITH n AS (SELECT question_id, count(*) AS n FROM v_candidates GROUP BY 1),
    s AS (SELECT question_id, {S.selected_candidate("('BEST CANDIDATE: ' || (question_id % 9))", 'n')} AS idx FROM n)
    SELECT c.question_id, c.pos, c.candidate_id, c.answer FROM s JOIN v_candidates c ON c.question_id = s.question_id AND c.pos = s.idx + 1""")
def g19(c: Ctx) -> DataFrame:
    cand = c.v("v_candidates")
    n = cand.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("BEST CANDIDATE: "), (F.col("question_id") % 9).cast("string"))
    sel = n.select("question_id", A.selected_candidate(text, F.col("n")).alias("idx"))
    return V.select_by_index(sel, cand.select("question_id", "pos", "candidate_id", "answer"), "question_id", "idx", "pos")


@register("g20_synthesis_input", """
    SELECT question_id, count(*) AS n_solutions, string_agg(answer, ', ' ORDER BY pos) AS answers_text
    FROM v_candidates WHERE pos <= 3 GROUP BY 1""")
def g20(c: Ctx) -> DataFrame:
    return V.synthesis_input(c.v("v_candidates"), "question_id", "pos", "answer", 3)
