"""Catalog entries for verification tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import verify as VF
from .catalog import Ctx, register


@register("h1_verification_scores", """
    SELECT solution_id, count(*) AS n_verifications, CAST(sum(CASE WHEN assessment = 'CORRECT' THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
           round(round(avg(confidence), 12), 9) AS avg_confidence,
           round(sum(CASE WHEN assessment = 'CORRECT' THEN 1 ELSE 0 END) / count(*), 6) AS verification_score
    FROM v_verifications GROUP BY 1""")
def h1(c: Ctx) -> DataFrame:
    return VF.verification_scores(c.v("v_verifications"))


@register("h1_assessment_summary", """
    SELECT assessment, count(*) AS n, round(round(avg(confidence), 12), 9) AS avg_confidence FROM v_verifications GROUP BY 1""")
def h1_summary(c: Ctx) -> DataFrame:
    return VF.assessment_summary(c.v("v_verifications"))


@register("h2_verified_by_streak", """
    SELECT solution_id, count(*) AS n_verifications,
           CAST(max(attempt) - coalesce(max(CASE WHEN assessment <> 'CORRECT' THEN attempt END), 0) AS BIGINT) AS consecutive_correct,
           max(attempt) - coalesce(max(CASE WHEN assessment <> 'CORRECT' THEN attempt END), 0) >= 5 AS is_verified
    FROM v_verifications GROUP BY 1""")
def h2(c: Ctx) -> DataFrame:
    return VF.verified_by_streak(c.v("v_verifications"), passes=5)


# The pass-run fixture uses k = 2: with ~40% failures a 5-pass run inside
# 10 attempts is rare, and both outcomes should be exercised.
_H3_SQL = """
    r AS (SELECT solution_id, attempt, assessment,
                 attempt - coalesce(max(CASE WHEN assessment <> 'CORRECT' THEN attempt END)
                     OVER (PARTITION BY solution_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS run
          FROM v_verifications WHERE attempt <= 10),
    s AS (SELECT solution_id, min(CASE WHEN run >= 2 THEN attempt END) AS hit, max(attempt) AS n, arg_max(run, attempt) AS last_run
          FROM r GROUP BY 1),
    runs AS (SELECT solution_id, CAST(coalesce(hit, n) AS BIGINT) AS attempts_used,
                    CAST(CASE WHEN hit IS NOT NULL THEN 2 ELSE last_run END AS BIGINT) AS consecutive_passes,
                    hit IS NOT NULL AS passes_threshold FROM s)"""


@register("h3_pass_run", f"WITH {_H3_SQL} SELECT * FROM runs")
def h3(c: Ctx) -> DataFrame:
    return VF.pass_run(c.v("v_verifications"), k=2, max_attempts=10)


@register("h4_verification_summary", f"""
    WITH {_H3_SQL}
    SELECT solution_id % 10 AS batch, count(*) AS n_solutions, CAST(sum(CASE WHEN passes_threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_passed,
           CAST(sum(attempts_used) AS BIGINT) AS n_verifications, sum(CASE WHEN passes_threshold THEN 1 ELSE 0 END) >= 2 AS consensus
    FROM runs GROUP BY 1""")
def h4(c: Ctx) -> DataFrame:
    runs = VF.pass_run(c.v("v_verifications"), k=2, max_attempts=10).withColumn("batch", F.col("solution_id") % 10)
    return VF.verification_summary(runs, "batch")


@register("c9_latest_feedback", """
    WITH st AS (SELECT solution_id, max(attempt) - coalesce(max(CASE WHEN assessment <> 'CORRECT' THEN attempt END), 0) >= 5 AS ok
                FROM v_verifications GROUP BY 1),
    l AS (SELECT solution_id, attempt, assessment, confidence FROM v_verifications
          QUALIFY row_number() OVER (PARTITION BY solution_id ORDER BY attempt DESC) = 1)
    SELECT l.* FROM l JOIN st USING (solution_id) WHERE NOT st.ok AND l.assessment IN ('INCORRECT', 'INCOMPLETE')""")
def c9(c: Ctx) -> DataFrame:
    v = c.v("v_verifications")
    return VF.latest_feedback(v, VF.verified_by_streak(v, passes=5))


@register("h5_improvement_queue", """
    WITH st AS (SELECT solution_id, max(attempt) - coalesce(max(CASE WHEN assessment <> 'CORRECT' THEN attempt END), 0) >= 5 AS ok
                FROM v_verifications GROUP BY 1),
    l AS (SELECT solution_id, assessment FROM v_verifications
          QUALIFY row_number() OVER (PARTITION BY solution_id ORDER BY attempt DESC) = 1)
    SELECT l.solution_id FROM l JOIN st USING (solution_id) WHERE NOT st.ok AND l.assessment IN ('INCORRECT', 'INCOMPLETE')""")
def h5(c: Ctx) -> DataFrame:
    v = c.v("v_verifications")
    return VF.latest_feedback(v, VF.verified_by_streak(v, passes=5)).select("solution_id")


@register("h6_population_top", """
    SELECT question_id, candidate_id, confidence, temperature, rank FROM (
      SELECT question_id, candidate_id, confidence, temperature,
             row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, temperature DESC, candidate_id) AS rank
      FROM v_candidates) WHERE rank <= 5""")
def h6(c: Ctx) -> DataFrame:
    cand = c.v("v_candidates").select("question_id", "candidate_id", "confidence", "temperature")
    return VF.population_top(cand, "question_id", "confidence", "temperature", "candidate_id", 5)


@register("h7_aggregation_groups_best", """
    WITH n AS (SELECT question_id, count(*) AS n FROM v_candidates GROUP BY 1),
    r AS (SELECT c.question_id, c.candidate_id, n.n,
                 row_number() OVER (PARTITION BY c.question_id ORDER BY c.confidence DESC, c.candidate_id) AS member_rank
          FROM v_candidates c JOIN n USING (question_id))
    SELECT question_id, 'best' AS group_kind, candidate_id, member_rank FROM r WHERE least(floor(n / 4), 3) > 0 AND member_rank <= 4""")
def h7(c: Ctx) -> DataFrame:
    g = VF.aggregation_groups(c.v("v_candidates"), "question_id", "answer", "confidence", "candidate_id", 4)
    return g.where(F.col("group_kind") == "best")


@register("h7_aggregation_groups_diverse", """
    WITH n AS (SELECT question_id, count(*) AS n FROM v_candidates GROUP BY 1),
    a AS (SELECT c.*, n.n, row_number() OVER (PARTITION BY c.question_id, c.answer ORDER BY c.confidence DESC, c.candidate_id) AS ar
          FROM v_candidates c JOIN n USING (question_id)),
    r AS (SELECT question_id, candidate_id, n,
                 row_number() OVER (PARTITION BY question_id ORDER BY CAST(ar > 1 AS INTEGER), confidence DESC, candidate_id) AS member_rank
          FROM a)
    SELECT question_id, 'diverse' AS group_kind, candidate_id, member_rank FROM r WHERE least(floor(n / 4), 3) > 1 AND member_rank <= 4""")
def h7_div(c: Ctx) -> DataFrame:
    g = VF.aggregation_groups(c.v("v_candidates"), "question_id", "answer", "confidence", "candidate_id", 4)
    return g.where(F.col("group_kind") == "diverse")


@register("h7_aggregation_groups_random", """
    WITH n AS (SELECT question_id, count(*) AS n FROM v_candidates GROUP BY 1),
    r AS (SELECT c.question_id, c.candidate_id, n.n,
                 row_number() OVER (PARTITION BY c.question_id ORDER BY (c.candidate_id * 48271 + 7) % 2147483647, c.candidate_id) AS member_rank
          FROM v_candidates c JOIN n USING (question_id))
    SELECT question_id, 'random' AS group_kind, candidate_id, member_rank FROM r WHERE least(floor(n / 4), 3) > 2 AND member_rank <= 4""")
def h7_random(c: Ctx) -> DataFrame:
    g = VF.aggregation_groups(c.v("v_candidates"), "question_id", "answer", "confidence", "candidate_id", 4)
    return g.where(F.col("group_kind") == "random")
