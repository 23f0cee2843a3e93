"""Catalog entries for text, token and parsing jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as tx
from . import sqlx as S
from .catalog import Ctx, register


@register("t1_count_tokens", """
    SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens_chars4,
           CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 0)) AS BIGINT) AS tokens_words
    FROM documents""")
def t1(c: Ctx) -> DataFrame:
    d = c.t.documents
    return d.select("doc_id", tx.chars_div4(F.col("text")).alias("tokens_chars4"),
                    tx.word_count(F.col("text")).alias("tokens_words"))


@register("t2_record_size_report", """
    SELECT idx, count(*) AS n_articles, CAST(sum(length(article)) AS BIGINT) AS n_chars,
           CAST(sum(floor(length(article) / 4)) AS BIGINT) AS n_tokens
    FROM v_contexts GROUP BY idx""")
def t2(c: Ctx) -> DataFrame:
    ctx = c.v("v_contexts")
    return ctx.groupBy("idx").agg(F.count(F.lit(1)).alias("n_articles"),
                                  F.sum(F.length("article")).cast("bigint").alias("n_chars"),
                                  F.sum(tx.chars_div4(F.col("article"))).cast("bigint").alias("n_tokens"))


@register("t3_reasoning_tokens", f"SELECT completion_id, {S.reasoning_tokens('text')} AS reasoning_tokens FROM v_completions")
def t3(c: Ctx) -> DataFrame:
    return c.v("v_completions").select("completion_id", A.reasoning_tokens(F.col("text")).alias("reasoning_tokens"))


@register("t4_strip_thinking", f"""
    SELECT completion_id, {S.strip_think('text')} AS without_blocks, {S.after_last_close('text')} AS after_last_close,
           {S.after_first_close('text')} AS after_first_close, {S.clean_reasoning_tags('text')} AS cleaned,
           {S.thinking_text('text')} AS thinking
    FROM v_completions""")
def t4(c: Ctx) -> DataFrame:
    t = F.col("text")
    return c.v("v_completions").select(
        "completion_id", A.strip_think_blocks(t).alias("without_blocks"),
        A.after_last_think_close(t).alias("after_last_close"), A.after_first_think_close(t).alias("after_first_close"),
        A.clean_reasoning_tags(t).alias("cleaned"), A.thinking_text(t).alias("thinking"))


@register("t5_tagged_section", f"SELECT completion_id, {S.tagged_section('text', 'think')} AS section FROM v_completions")
def t5(c: Ctx) -> DataFrame:
    return c.v("v_completions").select("completion_id", A.tagged_section(F.col("text"), "think").alias("section"))


@register("t6_normalize_answer", f"""
    SELECT completion_id, {S.normalize_answer(S.extract_final_answer('text'))} AS normalized FROM v_completions""")
def t6(c: Ctx) -> DataFrame:
    return c.v("v_completions").select(
        "completion_id", A.normalize_answer(A.extract_final_answer(F.col("text"))).alias("normalized"))


@register("t7_normalize_plain", f"SELECT doc_id, {S.normalize_plain('text')} AS normalized FROM documents")
def t7(c: Ctx) -> DataFrame:
    return c.t.documents.select("doc_id", A.normalize_answer_plain(F.col("text")).alias("normalized"))


@register("t8_extract_final_answer", f"SELECT completion_id, {S.extract_final_answer('text')} AS final_answer FROM v_completions")
def t8(c: Ctx) -> DataFrame:
    return c.v("v_completions").select("completion_id", A.extract_final_answer(F.col("text")).alias("final_answer"))


@register("t9_extract_answer_uncertain", f"SELECT completion_id, {S.extract_answer_uncertain('text')} AS answer FROM v_completions")
def t9(c: Ctx) -> DataFrame:
    return c.v("v_completions").select("completion_id", A.extract_answer_uncertain(F.col("text")).alias("answer"))


_NUM = S.numeric_answer("text")


@register("t10_extract_numeric_answer", f"SELECT completion_id, {_NUM[0]} AS answer, {_NUM[1]} AS confidence FROM v_completions")
def t10(c: Ctx) -> DataFrame:
    x = A.extract_numeric_answer(F.col("text"))
    return c.v("v_completions").select("completion_id", x["answer"].alias("answer"), x["confidence"].alias("confidence"))


@register("t11_extract_aime", f"SELECT completion_id, {S.extract_aime('text')} AS aime_answer FROM v_completions")
def t11(c: Ctx) -> DataFrame:
    return c.v("v_completions").select("completion_id", A.extract_aime(F.col("text")).alias("aime_answer"))


@register("t16_last_sentence", f"SELECT doc_id, {S.last_sentence('text')} AS last_sentence FROM documents")
def t16(c: Ctx) -> DataFrame:
    return c.t.documents.select("doc_id", A.last_sentence(F.col("text")).alias("last_sentence"))


@register("t17_code_blocks", f"""
    SELECT completion_id, unnest({S.python_blocks('text')}) AS code FROM v_completions""")
def t17(c: Ctx) -> DataFrame:
    return c.v("v_completions").select("completion_id", F.explode(A.python_blocks(F.col("text"))).alias("code"))


@register("t17_code_extraction_rate", f"""
    SELECT question_id, count(*) AS n_responses,
           CAST(sum(CASE WHEN ({S.first_code_block('text')}) IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_with_code,
           round(sum(CASE WHEN ({S.first_code_block('text')}) IS NOT NULL THEN 1 ELSE 0 END) / count(*), 6) AS extraction_rate
    FROM v_completions GROUP BY question_id""")
def t17_rate(c: Ctx) -> DataFrame:
    comp = c.v("v_completions")
    has = F.when(A.first_code_block(F.col("text")).isNotNull(), 1).otherwise(0)
    return comp.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_responses"), F.sum(has).cast("bigint").alias("n_with_code"),
        F.round(F.sum(has) / F.count(F.lit(1)), 6).alias("extraction_rate"))


_GL = S.grade_lines("text")
_GC = S.grade_ci("text")


@register("t19_grade_decision_lines", f"SELECT completion_id, {_GL[0]} AS decision, {_GL[1]} AS explanation FROM v_completions")
def t19a(c: Ctx) -> DataFrame:
    g = A.grade_decision_lines(F.col("text"))
    return c.v("v_completions").select("completion_id", g["decision"].alias("decision"), g["explanation"].alias("explanation"))


# The case-insensitive variant also sees lower-cased and blank responses.
_CI_TEXT = "CASE WHEN completion_id % 9 = 0 THEN '' WHEN completion_id % 4 = 1 THEN lower(text) ELSE text END"


@register("t19_grade_decision_ci", f"""
    WITH g AS (SELECT completion_id, {_CI_TEXT} AS text FROM v_completions)
    SELECT completion_id, {_GC[0]} AS decision, {_GC[1]} AS explanation FROM g""")
def t19b(c: Ctx) -> DataFrame:
    comp = c.v("v_completions")
    text = F.when(F.col("completion_id") % 9 == 0, F.lit("")).when(F.col("completion_id") % 4 == 1, F.lower("text")) \
        .otherwise(F.col("text"))
    g = A.grade_decision_ci(text)
    return comp.select("completion_id", g["decision"].alias("decision"), g["explanation"].alias("explanation"))


@register("t19_grade_yes", """
    SELECT completion_id, CASE WHEN contains(text, 'Yes') THEN 'TRUE' ELSE 'FALSE' END AS decision
    FROM (SELECT completion_id, CASE WHEN completion_id % 3 = 0 THEN 'Yes, it matches. ' || text ELSE text END AS text FROM v_completions)""")
def t19c(c: Ctx) -> DataFrame:
    comp = c.v("v_completions")
    text = F.when(F.col("completion_id") % 3 == 0, F.concat(F.lit("Yes, it matches. "), F.col("text"))).otherwise(F.col("text"))
    return comp.select("completion_id", A.grade_yes(text)["decision"].alias("decision"))


def _json_grade_text(n, event_type):
    return F.when(n % 7 == 0, F.concat(F.lit("{decision: "), event_type)).otherwise(F.concat(
        F.lit('```json\n{"decision": "'), F.when(n % 3 == 0, "true").otherwise("false"),
        F.lit('", "explanation": "about '), event_type, F.lit('"}\n```')))


@register("t19_grade_json", """
    WITH g AS (SELECT completion_id, CASE WHEN completion_id % 7 = 0 THEN 'ERROR' ELSE CASE WHEN completion_id % 3 = 0 THEN 'TRUE' ELSE 'FALSE' END END AS decision,
                      CASE WHEN completion_id % 7 = 0 THEN '' ELSE 'about ' || regexp_extract(text, 'Final answer: ([a-z]+)', 1) END AS explanation
               FROM v_completions)
    SELECT * FROM g""")
def t19d(c: Ctx) -> DataFrame:
    e = c.t.events.select(F.col("event_id").alias("completion_id"), "event_type")
    g = A.grade_json(_json_grade_text(F.col("completion_id"), F.col("event_type")))
    return e.select("completion_id", g["decision"].alias("decision"), g["explanation"].alias("explanation"))


_BARE = "CASE WHEN completion_id % 5 = 0 THEN 'n/a' ELSE ' ' || (completion_id % 13) || '.25 ' END"


@register("t20_ratings", f"""
    WITH r AS (SELECT completion_id, text, {_BARE} AS bare FROM v_completions)
    SELECT completion_id, {S.rating_absolute('text')} AS rating, {S.rating_score('text')} AS score,
           {S.rating_bare('bare')} AS bare_rating, {S.rating_unit('bare')} AS unit_rating,
           {S.better_response('text')} AS better_response,
           {S.selected_candidate("('BEST CANDIDATE: ' || (completion_id % 6))", '4')} AS selected_index
    FROM r""")
def t20(c: Ctx) -> DataFrame:
    comp = c.v("v_completions")
    n = F.col("completion_id")
    bare = F.when(n % 5 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), (n % 13).cast("string"), F.lit(".25 ")))
    sel_text = F.concat(F.lit("BEST CANDIDATE: "), (n % 6).cast("string"))
    t = F.col("text")
    return comp.select("completion_id", A.rating_absolute(t).alias("rating"), A.rating_score(t).alias("score"),
                       A.rating_bare(bare).alias("bare_rating"), A.rating_unit(bare).alias("unit_rating"),
                       A.better_response(t).alias("better_response"),
                       A.selected_candidate(sel_text, F.lit(4)).alias("selected_index"))


def _verification_text(c: Ctx) -> DataFrame:
    v = c.v("v_verifications")
    text = F.concat(
        F.lit("The solution is "), F.lower("assessment"), F.lit(".\n"),
        F.lit("Confidence: "), (F.col("attempt") % 10).cast("string"), F.lit(" out of 10\n"),
        F.when(F.col("attempt") % 3 == 0, F.lit("  There is an error in step 2  \n")).otherwise(F.lit("")),
        F.when(F.col("attempt") % 4 == 0, F.lit("I suggest checking the algebra.\n")).otherwise(F.lit("")),
        F.lit("Done."))
    return v.select("solution_id", "attempt", text.alias("text"))


_VER_TEXT_SQL = """
    vt AS (SELECT solution_id, attempt,
                  'The solution is ' || lower(assessment) || '.' || chr(10) || 'Confidence: ' || (attempt % 10) || ' out of 10' || chr(10) ||
                  CASE WHEN attempt % 3 = 0 THEN '  There is an error in step 2  ' || chr(10) ELSE '' END ||
                  CASE WHEN attempt % 4 = 0 THEN 'I suggest checking the algebra.' || chr(10) ELSE '' END || 'Done.' AS text
           FROM v_verifications)"""
_PV = S.parse_verification("text")


@register("t21_parse_verification", f"""
    WITH {_VER_TEXT_SQL}
    SELECT solution_id, attempt, {_PV['assessment']} AS assessment, {_PV['confidence']} AS confidence,
           {_PV['issues']} AS issues, {_PV['suggestions']} AS suggestions
    FROM vt""")
def t21(c: Ctx) -> DataFrame:
    vt = _verification_text(c)
    p = A.parse_verification(F.col("text"))
    return vt.select("solution_id", "attempt", p["assessment"].alias("assessment"), p["confidence"].alias("confidence"),
                     p["issues"].alias("issues"), p["suggestions"].alias("suggestions"))
