"""Catalog entries for heuristics and report hygiene (SURVEY 2.E T24-T26,
T31-T33, T41)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import heuristics as HX
from . import sqlx as S
from .catalog import Ctx, register


def _count_sql(t: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower({t}), {S.q(w)}) THEN 1 ELSE 0 END" for w in HX.COMPLEXITY_INDICATORS) + ")"


def _score_sql(t: str) -> str:
    return f"(least(CAST(length({t}) AS DOUBLE) / 100, 2.0) * least(CAST({_count_sql(t)} AS DOUBLE) / 3, 1.5))"


@register("t24_complexity", f"""
    SELECT doc_id, CASE WHEN {_score_sql('text')} > 1.0 THEN 'HIGH' ELSE 'LOW' END AS label,
           round({_score_sql('text')}, 9) AS score, {_count_sql('text')} AS n_indicators FROM documents""")
def t24(c: Ctx) -> DataFrame:
    x = HX.complexity(F.col("text"))
    return c.t.documents.select("doc_id", x["label"].alias("label"), F.round(x["score"], 9).alias("score"),
                                x["n_indicators"].alias("n_indicators"))


@register("t24_complexity_report", f"""
    SELECT CASE WHEN {_score_sql('text')} > 1.0 THEN 'HIGH' ELSE 'LOW' END AS label, count(*) AS n FROM documents GROUP BY 1""")
def t24_report(c: Ctx) -> DataFrame:
    x = HX.complexity(F.col("text"))
    return c.t.documents.groupBy(x["label"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _conf_sql(t: str) -> str:
    low = f"lower({t})"
    words = f"len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: length(w) > 0))"
    return (f"greatest(0.1, least(1.0, 0.5 + CASE WHEN contains({t}, '\\boxed{{') THEN 0.2 ELSE 0.0 END"
            f" + CASE WHEN contains({low}, 'therefore') OR contains({low}, 'thus') THEN 0.1 ELSE 0.0 END"
            f" + CASE WHEN contains({low}, 'proof') THEN 0.1 ELSE 0.0 END"
            f" + CASE WHEN {words} > 200 THEN 0.1 ELSE 0.0 END"
            f" + CASE WHEN contains({low}, 'let') AND contains({low}, 'assume') THEN 0.1 ELSE 0.0 END"
            f" - CASE WHEN contains({low}, 'might') OR contains({low}, 'possibly') THEN 0.1 ELSE 0.0 END"
            f" - CASE WHEN contains({low}, 'unsure') OR contains({low}, 'not sure') THEN 0.2 ELSE 0.0 END))")


@register("t25_solution_confidence", f"SELECT doc_id, round(CAST({_conf_sql('text')} AS DOUBLE), 9) AS confidence FROM documents")
def t25(c: Ctx) -> DataFrame:
    return c.t.documents.select("doc_id", F.round(HX.solution_confidence(F.col("text")), 9).alias("confidence"))


@register("t26_token_budgets", f"""
    SELECT doc_id, CAST(floor(4096 * 0.10) AS BIGINT) AS effort_min_tokens,
           CAST(floor(4096 * CASE doc_id % 3 WHEN 1 THEN 0.66 WHEN 2 THEN 0.90 ELSE 0.33 END) AS BIGINT) AS effort_max_tokens,
           CAST(CASE WHEN {_score_sql('text')} > 1.0 THEN 1024 ELSE 256 END AS BIGINT) AS complexity_min_tokens,
           CAST(CASE WHEN {_score_sql('text')} > 1.0 THEN 4096 ELSE 1024 END AS BIGINT) AS complexity_max_tokens
    FROM documents""")
def t26(c: Ctx) -> DataFrame:
    d = c.t.documents
    effort = F.when(F.col("doc_id") % 3 == 1, "medium").when(F.col("doc_id") % 3 == 2, "HIGH").otherwise("low")
    e = HX.effort_budget(effort, F.lit(4096))
    b = HX.complexity_budget(HX.complexity(F.col("text"))["label"])
    return d.select("doc_id", e["min_tokens"].alias("effort_min_tokens"), e["max_tokens"].alias("effort_max_tokens"),
                    b["min_tokens"].alias("complexity_min_tokens"), b["max_tokens"].alias("complexity_max_tokens"))


def _task_sql(t: str) -> str:
    arms = []
    for name, words in HX.TASK_KEYWORDS:
        cond = " OR ".join(f"contains(lower({t}), {S.q(w)})" for w in words)
        arms.append(f"CASE WHEN {cond} THEN {S.q(name)} END")
    return f"list_filter([{', '.join(arms)}], lambda x: x IS NOT NULL)"


@register("t41_task_types", f"SELECT doc_id, {_task_sql('text')} AS task_types, {_task_sql('text')}[1] AS primary_type FROM documents")
def t41(c: Ctx) -> DataFrame:
    tt = HX.task_types(F.col("text"))
    return c.t.documents.select("doc_id", tt.alias("task_types"), F.try_element_at(tt, F.lit(1)).alias("primary_type"))


@register("t41_task_type_report", f"""
    SELECT coalesce({_task_sql('text')}[1], 'general') AS primary_type, count(*) AS n FROM documents GROUP BY 1""")
def t41_report(c: Ctx) -> DataFrame:
    tt = HX.task_types(F.col("text"))
    return c.t.documents.groupBy(F.coalesce(F.try_element_at(tt, F.lit(1)), F.lit("general")).alias("primary_type")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _cleanup_sql(t: str) -> str:
    x = t
    for p in HX.PLACEHOLDER_PATTERNS:
        x = f"regexp_replace({x}, {S.q('(?i)' + p)}, '', 'g')"
    lines = (f"list_filter(string_split({x}, chr(10)), lambda ln: length({S.py_strip('ln')}) = 0 OR "
             f"NOT regexp_matches({S.py_strip('ln')}, '^[\\s\\-\\*\\.\\,\\;\\:]*\\z'))")
    y = f"regexp_replace(array_to_string({lines}, chr(10)), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g')"
    return S.py_strip(y)


@register("t31_placeholder_cleanup", f"SELECT report_id, {_cleanup_sql('text')} AS cleaned FROM v_reports")
def t31(c: Ctx) -> DataFrame:
    return c.v("v_reports").select("report_id", HX.cleanup_placeholders(F.col("text")).alias("cleaned"))


@register("t31_placeholder_counts", "SELECT report_id, [" + ", ".join(
    f"CAST(len(regexp_extract_all(text, {S.q('(?i)' + p)}, 0)) AS INTEGER)" for p in HX.PLACEHOLDER_PATTERNS) + "] AS counts FROM v_reports")
def t31_counts(c: Ctx) -> DataFrame:
    return c.v("v_reports").select("report_id", HX.placeholder_counts(F.col("text")).alias("counts"))


def _audit_sql(t: str) -> str:
    words = f"len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: length(w) > 0))"
    parts = f"string_split({t}, '##')"
    title = S.py_strip("regexp_extract(p, '(?s)^\\s+([^#\\n]+)\\n', 1)")
    secs = (f"list_transform(list_filter(list_slice({parts}, 2, len({parts})), "
            f"lambda p: regexp_matches(p, '(?s)^\\s+[^#\\n]+\\n')), lambda p: {{'title': {title}, "
            f"'body': regexp_extract(p, '(?s)^\\s+[^#\\n]+\\n(.*)\\z', 1)}})")
    cits = []
    for p in HX.PLACEHOLDER_CITATION_PATTERNS:
        n = f"len(regexp_extract_all({t}, {S.q('(?i)' + p)}, 0))"
        cits.append(f"CASE WHEN {n} > 0 THEN 'Found ' || {n} || ' placeholder citations' END")
    asked = f"regexp_extract({t}, {S.q(HX.QUESTION_SECTION_RE)}, 0)"
    marks = (f"len(list_filter(list_transform(string_split({asked}, chr(10)), lambda ln: {S.py_strip('ln')}), "
             f"lambda ln: starts_with(ln, '*') OR starts_with(ln, '-')))")
    cits.append(f"CASE WHEN {marks} > 3 THEN {S.q(HX.ISSUE_QUESTIONS)} END")
    heavy = (f"list_transform(list_filter({secs}, lambda s: len(regexp_extract_all(s.body, {S.q(HX.SECTION_PLACEHOLDER)}, 0)) > "
             f"len(list_filter(string_split(s.body, chr(10)), lambda ln: length({S.py_strip('ln')}) > 0)) / 3.0), "
             f"lambda s: 'Section ''' || s.title || ''' is mostly placeholders')")
    opens = f"(length({t}) - length(replace({t}, '[', '')))"
    closes = f"(length({t}) - length(replace({t}, ']', '')))"
    tail = (f"list_filter([CASE WHEN {opens} <> {closes} THEN 'Unmatched brackets detected - possible incomplete citations' END, "
            f"CASE WHEN {words} < 500 THEN 'Report appears to be very short, possibly incomplete' END], lambda x: x IS NOT NULL)")
    issues = f"list_concat(list_filter([{', '.join(cits)}], lambda x: x IS NOT NULL), {heavy}, {tail})"
    return (f"{issues} AS issues, CAST({words} AS BIGINT) AS word_count, CAST(len({secs}) AS BIGINT) AS section_count, "
            f"len({issues}) = 0 AS is_complete")


@register("t32_report_audit", f"SELECT report_id, {_audit_sql('text')} FROM v_reports")
def t32(c: Ctx) -> DataFrame:
    a = HX.report_audit(F.col("text"))
    return c.v("v_reports").select("report_id", a["issues"].alias("issues"), a["word_count"].alias("word_count"),
                                   a["section_count"].alias("section_count"), a["is_complete"].alias("is_complete"))
