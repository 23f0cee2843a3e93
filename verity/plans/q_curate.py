"""Catalog entries for sources, sinks and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import curate as cu
from ..sources import records as rec
from .catalog import Ctx, register

_RESULT_COLS = ("idx, prompt, answer, model_answer, q_in_tokens, q_out_tokens, grader_decision, "
                "is_hallucination, context, reasoning_types")


@register("a1_read_records", f"SELECT {_RESULT_COLS} FROM v_results")
def a1(c: Ctx) -> DataFrame:
    df = c.v("v_results")
    path = rec.scratch_path(c.spark, "a1")
    rec.write_records(df, path, "json", "errorifexists")
    return rec.read_records(c.spark, path, df.schema)


@register("a2_read_csv_strings", "SELECT CAST(idx AS VARCHAR) AS idx, prompt FROM v_questions")
def a2(c: Ctx) -> DataFrame:
    df = c.v("v_questions")
    path = rec.scratch_path(c.spark, "a2")
    rec.write_records(df, path, "csv", "errorifexists")
    return rec.read_csv_strings(c.spark, path, ["idx", "prompt"])


@register("a3_write_records", "SELECT idx, prompt FROM v_questions UNION ALL SELECT idx, prompt FROM v_questions")
def a3(c: Ctx) -> DataFrame:
    df = c.v("v_questions")
    path = rec.scratch_path(c.spark, "a3")
    rec.write_records(df, path, "parquet", "errorifexists")
    rec.write_records(df, path, "parquet", "ignore")      # exists: skipped
    rec.write_records(df, path, "parquet", "append")      # resumed run appends
    return c.spark.read.parquet(path)


@register("a7_slice_records", f"SELECT {_RESULT_COLS} FROM v_results WHERE idx >= 5 AND idx < 15")
def a7(c: Ctx) -> DataFrame:
    return cu.slice_records(c.v("v_results"), "idx", start=5, end=20, limit=10)


@register("a8_select_columns", "SELECT idx, prompt, answer, grader_decision, reasoning_types FROM v_results")
def a8(c: Ctx) -> DataFrame:
    return cu.select_columns(c.v("v_results"), drop=["model_answer", "context", "q_in_tokens", "q_out_tokens",
                                                     "is_hallucination"])


@register("a9_resume", """
    SELECT idx, prompt FROM v_results WHERE idx NOT IN (SELECT idx FROM v_results WHERE idx < (SELECT count(*) / 2 FROM v_results))""")
def a9(c: Ctx) -> DataFrame:
    r = c.v("v_results").select("idx", "prompt")
    half = c.t.documents.agg((F.count(F.lit(1)) / 2).alias("half"))  # one row
    done = r.join(F.broadcast(half)).where(F.col("idx") < F.col("half")).drop("half")
    return cu.resume(r, done, "idx")


@register("a9_resume_max_index", """
    SELECT idx, prompt FROM v_results WHERE idx > (SELECT max(idx) FROM v_results WHERE idx % 3 = 0 AND idx < 500)""")
def a9_max(c: Ctx) -> DataFrame:
    r = c.v("v_results").select("idx", "prompt")
    done = r.where((F.col("idx") % 3 == 0) & (F.col("idx") < 500))
    return cu.resume(r, done, "idx", mode="max_index")


@register("a10_sample_percent", """
    SELECT idx, prompt FROM v_results
    QUALIFY row_number() OVER (ORDER BY (idx * 48271 + 42) % 2147483647, idx)
            <= (SELECT greatest(1, CAST(ceil(count(*) * 10 / 100.0) AS BIGINT)) FROM v_results)""")
def a10(c: Ctx) -> DataFrame:
    return cu.sample_percent(c.v("v_results").select("idx", "prompt"), 10.0, seed=42, key="idx")


def _raw_samples(c: Ctx) -> DataFrame:
    """Records in the reference's mixed field names (some blank prompts)."""
    r = c.v("v_results")
    return r.select(
        F.col("idx").alias("_pos"),
        F.when(F.col("idx") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("  "), F.col("prompt"))).alias("Prompt"),
        F.when(F.col("idx") % 13 == 0, F.lit(None)).otherwise(F.col("model_answer")).alias("llm_response"),
        F.col("answer").alias("Answer"), F.col("context").alias("Context"),
        F.col("grader_decision").alias("GraderDecision"), F.col("reasoning_types").alias("ReasoningTypes"))


_A11_SQL = """
    raw AS (SELECT idx AS pos, CASE WHEN idx % 11 = 0 THEN '' ELSE '  ' || prompt END AS q,
                   CASE WHEN idx % 13 = 0 THEN NULL ELSE model_answer END AS a, answer AS gt, context AS ctx,
                   grader_decision AS dec, reasoning_types AS rt FROM v_results)"""


@register("a11_normalize_samples", f"""
    WITH {_A11_SQL}
    SELECT CAST(pos + 1 AS VARCHAR) AS sample_id, trim(q) AS question, trim(a) AS answer,
           coalesce(trim(CASE WHEN length(ctx) > 0 THEN ctx END), '') AS context,
           CASE WHEN gt IS NULL THEN NULL ELSE gt NOT IN ('', '0', 'false', 'False') END AS ground_truth,
           gt IS NOT NULL AS has_label, CASE WHEN length(dec) > 0 THEN dec END AS evaluation_decision,
           CASE WHEN length(rt) > 0 THEN rt END AS reasoning_type
    FROM raw WHERE length(q) > 0 AND length(a) > 0""")
def a11(c: Ctx) -> DataFrame:
    valid, _ = cu.normalize_samples(_raw_samples(c))
    return valid.select("sample_id", "question", "answer", "context", "ground_truth", "has_label",
                        F.col("metadata")["evaluation_decision"].alias("evaluation_decision"),
                        F.col("metadata")["reasoning_type"].alias("reasoning_type"))


@register("a11_normalize_errors", f"""
    WITH {_A11_SQL}
    SELECT pos AS position, 'Sample ' || pos || ': Missing question/answer' AS error
    FROM raw WHERE NOT (coalesce(length(q), 0) > 0 AND coalesce(length(a), 0) > 0)""")
def a11_err(c: Ctx) -> DataFrame:
    _, errors = cu.normalize_samples(_raw_samples(c))
    return errors


@register("a12_drop_bad_records", """
    SELECT idx, prompt FROM v_results WHERE idx NOT IN (SELECT idx FROM v_results WHERE idx % 97 = 3)""")
def a12(c: Ctx) -> DataFrame:
    r = c.v("v_results").select("idx", "prompt")
    bad = r.where(F.col("idx") % 97 == 3).select("idx")
    return cu.drop_bad_records(r, bad, "idx")


@register("a13_filter_output_tokens", """
    SELECT idx, q_out_tokens FROM v_results WHERE q_out_tokens IS NULL OR q_out_tokens <= 4000""")
def a13(c: Ctx) -> DataFrame:
    return cu.filter_output_tokens(c.v("v_results").select("idx", "q_out_tokens"), "q_out_tokens", 4000)


@register("a13_output_token_counts", """
    SELECT count(*) AS n_input, CAST(sum(CASE WHEN q_out_tokens > 4000 THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
           count(*) - CAST(sum(CASE WHEN q_out_tokens > 4000 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept
    FROM v_results""")
def a13_counts(c: Ctx) -> DataFrame:
    return cu.output_token_filter_counts(c.v("v_results"), "q_out_tokens", 4000)


@register("a14_filter_empty_grades", "SELECT idx, grader_decision FROM v_results WHERE grader_decision IS NULL OR grader_decision <> ''")
def a14(c: Ctx) -> DataFrame:
    return cu.filter_empty_grades(c.v("v_results").select("idx", "grader_decision"))


@register("a15_skip_incomplete", """
    SELECT idx FROM v_results WHERE length(trim(prompt)) > 0 AND length(trim(model_answer)) > 0 AND length(trim(context)) > 0""")
def a15(c: Ctx) -> DataFrame:
    return cu.skip_incomplete(c.v("v_results"), ["prompt", "model_answer", "context"]).select("idx")


@register("a16_over_budget", """
    SELECT idx, CAST(floor(length(prompt) / 4) + floor(length(model_answer) / 4) + floor(length(context) / 4) AS BIGINT) AS total_tokens
    FROM v_results
    WHERE floor(length(prompt) / 4) + floor(length(model_answer) / 4) + floor(length(context) / 4) > 1500""")
def a16(c: Ctx) -> DataFrame:
    return cu.over_budget(c.v("v_results"), 2000, ["prompt", "model_answer", "context"], "idx")


_LINKS_SQL = "from_json(replace(wiki_links, '''', '\"'), '[\"VARCHAR\"]')"


@register("a17_filter_link_count", f"""
    SELECT idx, wiki_links FROM v_links WHERE len({_LINKS_SQL}) = 7""")
def a17(c: Ctx) -> DataFrame:
    lk = c.v("v_links")
    return cu.filter_link_count(lk, tx.parse_link_list(F.col("wiki_links")), 7)


@register("a18_count_records", "SELECT count(*) AS n_records FROM v_results")
def a18(c: Ctx) -> DataFrame:
    return c.v("v_results").agg(F.count(F.lit(1)).alias("n_records"))


@register("a19_daily_log", """
    SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS log_date, count(*) AS n_entries FROM events GROUP BY 1""")
def a19(c: Ctx) -> DataFrame:
    path = rec.scratch_path(c.spark, "a19")
    rec.write_daily_log(c.t.events, path, "ts")
    back = c.spark.read.json(path)
    return back.groupBy(F.col("log_date").cast("string").alias("log_date")).agg(F.count(F.lit(1)).alias("n_entries"))


@register("a21_load_benchmark", "SELECT item_id, text FROM benchmark")
def a21(c: Ctx) -> DataFrame:
    return rec.load_benchmark(c.spark, f"{c.sf_dir}/benchmark.parquet")


@register("f14_total_links", f"""
    SELECT CAST(sum(coalesce(len({_LINKS_SQL}), 0)) AS BIGINT) AS total_links,
           CAST(sum(CASE WHEN {_LINKS_SQL} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS parse_failures
    FROM v_links""")
def f14(c: Ctx) -> DataFrame:
    arr = tx.parse_link_list(F.col("wiki_links"))
    return c.v("v_links").agg(F.sum(F.coalesce(F.size(arr), F.lit(0))).cast("bigint").alias("total_links"),
                              F.sum(F.when(arr.isNull(), 1).otherwise(0)).cast("bigint").alias("parse_failures"))


@register("j1_sort_first_n", "SELECT idx, prompt FROM v_results ORDER BY idx LIMIT 25")
def j1(c: Ctx) -> DataFrame:
    return c.v("v_results").select("idx", "prompt").orderBy("idx").limit(25)


@register("j3_append_results", """
    SELECT idx, prompt, NULL::VARCHAR AS grader_decision FROM v_results WHERE idx % 2 = 0
    UNION ALL SELECT idx, prompt, grader_decision FROM v_results WHERE idx % 2 = 1""")
def j3(c: Ctx) -> DataFrame:
    r = c.v("v_results")
    previous = r.where(F.col("idx") % 2 == 0).select("idx", "prompt")
    new = r.where(F.col("idx") % 2 == 1).select("idx", "prompt", "grader_decision")
    return previous.unionByName(new, allowMissingColumns=True)


@register("j4_distinct_reasoning_types", "SELECT DISTINCT reasoning_types FROM v_results")
def j4_types(c: Ctx) -> DataFrame:
    return c.v("v_results").select("reasoning_types").distinct()


@register("j4_distinct_words", """
    SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(prompt), '\\s+')) AS w FROM v_questions) WHERE length(w) > 0""")
def j4_words(c: Ctx) -> DataFrame:
    q = c.v("v_questions")
    return q.select(F.explode(tx.split_words(F.lower("prompt"))).alias("word")).distinct()


@register("j4_distinct_urls", """
    SELECT DISTINCT u AS url FROM (SELECT unnest(from_json(replace(wiki_links, '''', '"'), '["VARCHAR"]')) AS u FROM v_links)""")
def j4_urls(c: Ctx) -> DataFrame:
    return c.v("v_links").select(F.explode(tx.parse_link_list(F.col("wiki_links"))).alias("url")).distinct()


@register("j5_word_set_overlap", """
    WITH w AS (SELECT idx, list_distinct(list_filter(regexp_split_to_array(lower(prompt), '\\s+'), lambda x: length(x) > 0)) AS a,
                      list_distinct(list_filter(regexp_split_to_array(lower(context), '\\s+'), lambda x: length(x) > 0)) AS b
               FROM v_results)
    SELECT idx, CAST(len(list_intersect(a, b)) AS BIGINT) AS n_intersect,
           CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n_union
    FROM w""")
def j5(c: Ctx) -> DataFrame:
    r = c.v("v_results")
    a = tx.split_words(F.lower("prompt"))
    b = tx.split_words(F.lower("context"))
    return r.select("idx", F.size(F.array_intersect(a, b)).cast("bigint").alias("n_intersect"),
                    F.size(F.array_union(a, b)).cast("bigint").alias("n_union"))
