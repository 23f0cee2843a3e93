"""Catalog entries for reports and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from .catalog import Ctx, register

_CATS_SQL = """cats(category, kind, ord) AS (VALUES
  ('Multiple Constraints', 'base', 1), ('Numerical Reasoning', 'base', 2), ('Post Processing', 'base', 3),
  ('Tabular Reasoning', 'base', 4), ('Temporal Reasoning', 'base', 5),
  ('Multiple Constraints+', 'multi', 6), ('Numerical Reasoning+', 'multi', 7), ('Post Processing+', 'multi', 8),
  ('Tabular Reasoning+', 'multi', 9), ('Temporal Reasoning+', 'multi', 10))"""


@register("f1_overall_accuracy", """
    SELECT count(*) AS n_total, CAST(coalesce(sum(CASE WHEN grader_decision = 'TRUE' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_correct,
           round(coalesce(sum(CASE WHEN grader_decision = 'TRUE' THEN 1 ELSE 0 END) / nullif(count(*), 0), 0.0), 6) AS accuracy
    FROM v_results""")
def f1(c: Ctx) -> DataFrame:
    return ev.overall_accuracy(c.v("v_results"))


@register("f2_accuracy_by_type", """
    SELECT reasoning_types, count(*) AS n_total, CAST(sum(CASE WHEN grader_decision = 'TRUE' THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
           round(sum(CASE WHEN grader_decision = 'TRUE' THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
    FROM v_results GROUP BY reasoning_types""")
def f2(c: Ctx) -> DataFrame:
    return ev.accuracy_by_type(c.v("v_results"))


@register("f3_category_accuracy", f"""
    WITH {_CATS_SQL},
    rec AS (SELECT idx, grader_decision = 'TRUE' AS ok, lower(trim(unnest(string_split(coalesce(reasoning_types, ''), '|')))) AS k
            FROM v_results),
    known AS (SELECT DISTINCT rec.idx, rec.ok, c.category FROM rec JOIN cats c ON c.kind = 'base' AND lower(c.category) = rec.k),
    per AS (SELECT idx, count(*) AS n FROM known GROUP BY idx),
    rows AS (SELECT category, ok FROM known
             UNION ALL SELECT category || '+', ok FROM known JOIN per USING (idx) WHERE per.n >= 2),
    agg AS (SELECT category, count(*) AS n_total, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS n_correct FROM rows GROUP BY category)
    SELECT c.category, c.kind, CAST(coalesce(a.n_total, 0) AS BIGINT) AS n_total, CAST(coalesce(a.n_correct, 0) AS BIGINT) AS n_correct,
           CASE WHEN coalesce(a.n_total, 0) > 0 THEN round(a.n_correct / a.n_total, 6) END AS accuracy,
           CASE WHEN coalesce(a.n_total, 0) = 0 THEN 'N/A' ELSE printf('%.2f%%', a.n_correct * 100.0 / a.n_total) END AS accuracy_text
    FROM cats c LEFT JOIN agg a USING (category)""")
def f3(c: Ctx) -> DataFrame:
    return ev.category_accuracy(c.v("v_results"))


@register("f4_multi_category_accuracy", f"""
    WITH {_CATS_SQL},
    rec AS (SELECT idx, grader_decision = 'TRUE' AS ok, lower(trim(unnest(string_split(coalesce(reasoning_types, ''), '|')))) AS k
            FROM v_results),
    known AS (SELECT DISTINCT rec.idx, rec.ok, c.category FROM rec JOIN cats c ON c.kind = 'base' AND lower(c.category) = rec.k),
    per AS (SELECT idx, count(*) AS n FROM known GROUP BY idx),
    rows AS (SELECT category || '+' AS category, ok FROM known JOIN per USING (idx) WHERE per.n >= 2),
    agg AS (SELECT category, count(*) AS n_total, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS n_correct FROM rows GROUP BY category)
    SELECT c.category, CAST(coalesce(a.n_total, 0) AS BIGINT) AS n_total, CAST(coalesce(a.n_correct, 0) AS BIGINT) AS n_correct,
           CASE WHEN coalesce(a.n_total, 0) = 0 THEN 'N/A' ELSE printf('%.2f%%', a.n_correct * 100.0 / a.n_total) END AS accuracy_text
    FROM cats c LEFT JOIN agg a USING (category) WHERE c.kind = 'multi'""")
def f4(c: Ctx) -> DataFrame:
    return ev.category_accuracy(c.v("v_results")).where(F.col("kind") == "multi") \
        .select("category", "n_total", "n_correct", "accuracy_text")


@register("f5_accuracy_grouping_sets", """
    SELECT CASE WHEN grouping(reasoning_types) = 1 THEN 'overall' ELSE 'type' END AS level, reasoning_types,
           count(*) AS n_total, CAST(sum(CASE WHEN grader_decision = 'TRUE' THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
           round(sum(CASE WHEN grader_decision = 'TRUE' THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
    FROM v_results GROUP BY GROUPING SETS ((), (reasoning_types))""")
def f5(c: Ctx) -> DataFrame:
    return ev.accuracy_overall_and_by_type(c.v("v_results"))


@register("f6_token_totals", """
    SELECT CAST(sum(coalesce(q_in_tokens, 0)) AS BIGINT) AS question_input_tokens,
           CAST(sum(coalesce(q_out_tokens, 0)) AS BIGINT) AS question_output_tokens,
           CAST(sum(coalesce(q_in_tokens, 0)) + sum(coalesce(q_out_tokens, 0)) AS BIGINT) AS total_tokens
    FROM v_results""")
def f6(c: Ctx) -> DataFrame:
    return ev.token_totals(c.v("v_results"), {"question_input_tokens": "q_in_tokens",
                                              "question_output_tokens": "q_out_tokens"})


# F7 runs on the full-context result shape: rag tokens from the context,
# eval tokens from the answer; rows without context have no rag tokens (null).
def _rag_results(c: Ctx) -> DataFrame:
    r = c.v("v_results")
    return r.select(
        F.when(F.col("context") == "", F.lit(None)).otherwise(F.length("context")).cast("bigint").alias("rag_input_tokens"),
        F.when(F.col("context") == "", F.lit(None)).otherwise(F.floor(F.length("context") / 4)).cast("bigint").alias("rag_output_tokens"),
        F.col("q_in_tokens").alias("eval_input_tokens"), F.col("q_out_tokens").alias("eval_output_tokens"))


@register("f7_rag_eval_token_totals", """
    WITH r AS (SELECT CASE WHEN context = '' THEN NULL ELSE length(context) END AS rag_in,
                      CASE WHEN context = '' THEN NULL ELSE floor(length(context) / 4) END AS rag_out,
                      q_in_tokens AS ev_in, q_out_tokens AS ev_out FROM v_results)
    SELECT CAST(sum(coalesce(rag_in, 0)) AS BIGINT) AS rag_input_tokens, CAST(sum(coalesce(rag_out, 0)) AS BIGINT) AS rag_output_tokens,
           CAST(sum(coalesce(ev_in, 0)) AS BIGINT) AS eval_input_tokens, CAST(sum(coalesce(ev_out, 0)) AS BIGINT) AS eval_output_tokens,
           CAST(sum(coalesce(rag_in, 0)) + sum(coalesce(rag_out, 0)) + sum(coalesce(ev_in, 0)) + sum(coalesce(ev_out, 0)) AS BIGINT) AS total_tokens
    FROM r""")
def f7(c: Ctx) -> DataFrame:
    return ev.token_totals(_rag_results(c), {
        "rag_input_tokens": "rag_input_tokens", "rag_output_tokens": "rag_output_tokens",
        "eval_input_tokens": "eval_input_tokens", "eval_output_tokens": "eval_output_tokens"})


# Detector outputs enter as a table (the model call is outside); the fixture
# derives a response text per sample and blanks every 50th answer.
def detection_samples(c: Ctx) -> DataFrame:
    r = c.v("v_results")
    resp = (F.when(F.col("is_hallucination"), "The answer is hallucinated")
             .when(F.col("idx") % 7 == 0, "The claim is not supported").otherwise("The answer is supported"))
    return r.select(F.col("idx").alias("sample_id"),
                    F.when(F.col("idx") % 50 == 7, F.lit("")).otherwise(F.col("model_answer")).alias("answer"),
                    "context", resp.alias("detector_response"),
                    F.when(F.col("grader_decision") == "", F.lit(None)).otherwise(F.col("grader_decision")).alias("grader_decision"))


DETECTIONS_SQL = """
    det_in AS (SELECT idx AS sample_id, CASE WHEN idx % 50 = 7 THEN '' ELSE model_answer END AS answer, context,
                      CASE WHEN is_hallucination THEN 'The answer is hallucinated' WHEN idx % 7 = 0 THEN 'The claim is not supported'
                           ELSE 'The answer is supported' END AS resp,
                      nullif(grader_decision, '') AS grader_decision
               FROM v_results),
    det AS (SELECT sample_id, grader_decision,
                   CASE WHEN length(trim(answer)) = 0 THEN true ELSE contains(resp, 'hallucinated') OR contains(resp, 'not supported') END AS is_hallucination,
                   CAST(CASE WHEN length(trim(answer)) = 0 THEN 0.0 WHEN length(trim(context)) > 0 THEN 0.9
                        WHEN contains(resp, 'hallucinated') OR contains(resp, 'not supported') THEN 0.5 ELSE 0.3 END AS DOUBLE) AS confidence,
                   CASE WHEN length(trim(answer)) = 0 THEN 'empty_answer' ELSE resp END AS detector_response,
                   CASE WHEN length(trim(answer)) = 0 THEN length(context) > 0 ELSE length(trim(context)) > 0 END AS has_context
            FROM det_in)"""


def detections(c: Ctx) -> DataFrame:
    return ev.detection_verdicts(detection_samples(c))


@register("t39_hallucination_verdict", f"""
    WITH {DETECTIONS_SQL}
    SELECT sample_id, is_hallucination, confidence, detector_response, has_context FROM det""")
def t39(c: Ctx) -> DataFrame:
    return detections(c).select("sample_id", "is_hallucination", "confidence", "detector_response", "has_context")


@register("f8_detection_summary", f"""
    WITH {DETECTIONS_SQL}
    SELECT count(*) AS total_samples, CAST(sum(CASE WHEN is_hallucination THEN 1 ELSE 0 END) AS BIGINT) AS hallucinations_detected,
           round(sum(CASE WHEN is_hallucination THEN 1 ELSE 0 END) / count(*), 6) AS hallucination_rate,
           CAST(sum(CASE WHEN has_context THEN 1 ELSE 0 END) AS BIGINT) AS samples_with_context,
           CAST(count(*) - sum(CASE WHEN has_context THEN 1 ELSE 0 END) AS BIGINT) AS samples_without_context,
           CAST(sum(CASE WHEN confidence > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS high_confidence_samples,
           CAST(count(*) - sum(CASE WHEN confidence > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS low_confidence_samples
    FROM det""")
def f8(c: Ctx) -> DataFrame:
    return ev.detection_summary(detections(c))


_CM_SQL = f"""
    WITH {DETECTIONS_SQL},
    m AS (SELECT count(*) AS n,
                 sum(CASE WHEN grader_decision <> 'TRUE' AND is_hallucination THEN 1 ELSE 0 END) AS tp,
                 sum(CASE WHEN grader_decision = 'TRUE' AND is_hallucination THEN 1 ELSE 0 END) AS fp,
                 sum(CASE WHEN grader_decision = 'TRUE' AND NOT is_hallucination THEN 1 ELSE 0 END) AS tn,
                 sum(CASE WHEN grader_decision <> 'TRUE' AND NOT is_hallucination THEN 1 ELSE 0 END) AS fn
          FROM det WHERE grader_decision IS NOT NULL),
    b AS (SELECT n, tp, fp, tn, fn,
                 coalesce((tp + tn) / nullif(n, 0), 0.0) AS acc, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p,
                 coalesce(tp / nullif(tp + fn, 0), 0.0) AS r,
                 coalesce((tn + tp) / nullif(n, 0), 0.0) AS acc_a, coalesce(tn / nullif(tn + fn, 0), 0.0) AS p_a,
                 coalesce(tn / nullif(tn + fp, 0), 0.0) AS r_a FROM m)"""


@register("f9_confusion_matrix", _CM_SQL + """
    SELECT CAST(n AS BIGINT) AS n_labelled, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn,
           CAST(fn AS BIGINT) AS fn, round(acc, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
           round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1
    FROM b""")
def f9(c: Ctx) -> DataFrame:
    return ev.confusion_matrix(detections(c)).select(
        "n_labelled", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1")


@register("f10_confusion_matrix_alt", _CM_SQL + """
    SELECT CAST(n AS BIGINT) AS n_labelled, round(acc_a, 6) AS accuracy_alt, round(p_a, 6) AS precision_alt,
           round(r_a, 6) AS recall_alt, round(coalesce(2 * p_a * r_a / nullif(p_a + r_a, 0), 0.0), 6) AS f1_alt
    FROM b""")
def f10(c: Ctx) -> DataFrame:
    return ev.confusion_matrix(detections(c)).select(
        "n_labelled", "accuracy_alt", "precision_alt", "recall_alt", "f1_alt")


@register("f11_field_completeness", """
    WITH a AS (SELECT count(*) AS n_total,
                      sum(CASE WHEN length(prompt) > 0 THEN 1 ELSE 0 END) AS prompt,
                      sum(CASE WHEN length(model_answer) > 0 THEN 1 ELSE 0 END) AS llm_response,
                      sum(CASE WHEN length(grader_decision) > 0 THEN 1 ELSE 0 END) AS ground_truth,
                      sum(CASE WHEN length(context) > 0 THEN 1 ELSE 0 END) AS context FROM v_results)
    SELECT field, CAST(n_present AS BIGINT) AS n_present, n_total, round(coalesce(n_present * 100 / nullif(n_total, 0), 0.0), 6) AS pct_present
    FROM (SELECT n_total, 'prompt' AS field, prompt AS n_present FROM a UNION ALL
          SELECT n_total, 'llm_response', llm_response FROM a UNION ALL
          SELECT n_total, 'ground_truth', ground_truth FROM a UNION ALL
          SELECT n_total, 'context', context FROM a)""")
def f11(c: Ctx) -> DataFrame:
    return ev.field_completeness(c.v("v_results"), {
        "prompt": "prompt", "llm_response": "model_answer", "ground_truth": "grader_decision", "context": "context"})


@register("f12_length_stats", """
    SELECT field, CAST(min(len) AS BIGINT) AS min_len, CAST(max(len) AS BIGINT) AS max_len, round(avg(len), 6) AS mean_len,
           round(quantile_cont(len, 0.5), 6) AS median_len
    FROM (SELECT 'prompt' AS field, length(coalesce(prompt, '')) AS len FROM v_results
          UNION ALL SELECT 'llm_response', length(coalesce(model_answer, '')) FROM v_results)
    GROUP BY field""")
def f12(c: Ctx) -> DataFrame:
    return ev.length_stats(c.v("v_results"), {"prompt": "prompt", "llm_response": "model_answer"})


@register("f13_label_distribution", """
    WITH s AS (SELECT l.toxic = 1 AS gt, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE d.text END AS context
               FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    m AS (SELECT count(*) AS n_total, count(gt) AS gt_labelled, CAST(coalesce(sum(CASE WHEN gt THEN 1 ELSE 0 END), 0) AS BIGINT) AS gt_true,
                 CAST(coalesce(sum(CASE WHEN length(context) > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS with_context FROM s)
    SELECT n_total, gt_labelled, gt_true, gt_labelled - gt_true AS gt_false,
           round(coalesce(gt_true * 100 / nullif(gt_labelled, 0), 0.0), 6) AS gt_true_pct,
           with_context, n_total - with_context AS without_context,
           round(coalesce(with_context * 100 / nullif(n_total, 0), 0.0), 6) AS with_context_pct
    FROM m""")
def f13(c: Ctx) -> DataFrame:
    d = c.t.documents.select("doc_id", "text").join(c.t.labels.select("doc_id", "toxic"), "doc_id", "left")
    s = d.select((F.col("toxic") == 1).alias("gt"),
                 F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text")).alias("context"))
    return ev.label_distribution(s, "gt", "context")


@register("f16_run_comparison", """
    WITH runs AS (SELECT answer AS model, 'naive' AS method, grader_decision FROM v_results WHERE idx % 2 = 0
                  UNION ALL SELECT answer, 'rag', grader_decision FROM v_results WHERE idx % 2 = 1)
    SELECT model, method, count(*) AS n_total, CAST(sum(CASE WHEN grader_decision = 'TRUE' THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
           round(sum(CASE WHEN grader_decision = 'TRUE' THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
    FROM runs GROUP BY model, method""")
def f16(c: Ctx) -> DataFrame:
    r = c.v("v_results")
    naive = r.where(F.col("idx") % 2 == 0).select(F.col("answer").alias("model"), F.lit("naive").alias("method"), "grader_decision")
    rag = r.where(F.col("idx") % 2 == 1).select(F.col("answer").alias("model"), F.lit("rag").alias("method"), "grader_decision")
    runs = naive.unionByName(rag)
    ok = ev.is_correct(F.col("grader_decision")).cast("long")
    return runs.groupBy("model", "method").agg(F.count(F.lit(1)).alias("n_total"), F.sum(ok).alias("n_correct")) \
        .withColumn("accuracy", ev.r6(ev.safe_div(F.col("n_correct"), F.col("n_total"))))


@register("f17_log_stats", """
    SELECT count(DISTINCT CAST(ts AS DATE)) AS log_files_count, count(*) AS total_entries,
           min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day
    FROM events""")
def f17(c: Ctx) -> DataFrame:
    e = c.t.events.select(F.to_date("ts").alias("log_date"))
    return e.agg(F.count_distinct("log_date").alias("log_files_count"), F.count(F.lit(1)).alias("total_entries"),
                 F.min("log_date").alias("first_day"), F.max("log_date").alias("last_day"))


@register("f17_log_entries_per_day", """
    SELECT CAST(ts AS DATE) AS log_date, count(*) AS n_entries FROM events GROUP BY 1""")
def f17_days(c: Ctx) -> DataFrame:
    return c.t.events.groupBy(F.to_date("ts").alias("log_date")).agg(F.count(F.lit(1)).alias("n_entries"))


@register("f18_solution_overview", """
    SELECT question_id, count(*) AS total_solutions, CAST(sum(length(answer)) AS BIGINT) AS total_chars,
           round(sum(length(answer)) / count(*), 6) AS avg_chars,
           CAST(sum(CASE WHEN confidence >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS verified_solutions
    FROM v_candidates GROUP BY question_id""")
def f18(c: Ctx) -> DataFrame:
    cand = c.v("v_candidates")
    return cand.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("total_solutions"), F.sum(F.length("answer")).cast("bigint").alias("total_chars"),
        ev.r6(F.sum(F.length("answer")) / F.count(F.lit(1))).alias("avg_chars"),
        F.sum(F.when(F.col("confidence") >= 0.5, 1).otherwise(0)).cast("bigint").alias("verified_solutions"))
