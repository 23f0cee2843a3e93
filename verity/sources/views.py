"""Test views over the provided tables (FIXTURES.md section 3).

Each view is built twice: as a Spark DataFrame (what the operators consume)
and as DuckDB SQL (what the oracle queries consume, spliced in as CTEs).
The two definitions must agree row for row.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Tables

# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

# Reasoning-type strings per document language (FIXTURES.md).
LANG_REASONING = {
    "en": "Multiple constraints",
    "fr": "Numerical reasoning | Tabular reasoning",
    "de": "Temporal reasoning | Post processing",
    "es": "numerical reasoning | Multiple constraints | Temporal reasoning | Other",
}


def _lang_types(col):
    expr = None
    for lang, types in LANG_REASONING.items():
        expr = (F.when(col == lang, F.lit(types)) if expr is None
                else expr.when(col == lang, F.lit(types)))
    return expr


#: Documents (pages) of one record: a record's size does not grow with the corpus.
RECORD_ROWS = 8


def _record(column: str):
    return F.expr(f"{column} div {RECORD_ROWS}")


def v_results(t: Tables) -> DataFrame:
    d = t.documents
    lab = t.labels
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("idx"),
        F.col("text").alias("prompt"),
        F.col("source").alias("answer"),
        F.col("text").alias("model_answer"),
        F.col("n_chars").alias("q_in_tokens"),
        F.floor(F.col("n_chars") / 4).cast("bigint").alias("q_out_tokens"),
        F.when(F.col("quality") == 1, "TRUE").when(F.col("quality") == 0, "FALSE")
         .otherwise("").alias("grader_decision"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("is_hallucination"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text")).alias("context"),
        _lang_types(F.col("lang")).alias("reasoning_types"),
    )


def v_questions(t: Tables) -> DataFrame:
    """One question per record, taken from ``benchmark`` in turn."""
    n = t.benchmark.agg(F.count(F.lit(1)).alias("n"))  # one row
    records = t.documents.select(_record("doc_id").alias("idx")).distinct().join(F.broadcast(n)) \
        .withColumn("item_id", F.col("idx") % F.col("n"))
    return records.join(t.benchmark, "item_id").select("idx", F.col("text").alias("prompt"))


def v_contexts(t: Tables, parts: int | None = None) -> DataFrame:
    d = t.documents.select("doc_id", "text").withColumn("idx", _record("doc_id"))
    d = d if parts is None else d.repartition(parts, "idx")
    w = Window.partitionBy("idx").orderBy("doc_id")
    return d.select(
        "idx",
        F.row_number().over(w).cast("bigint").alias("doc_index"),
        F.concat(F.lit("https://example.org/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring("text", 1, 30).alias("title"),
        F.col("text").alias("article"),
    )


def v_links(t: Tables) -> DataFrame:
    # Every tenth link is dead.
    url = F.when(F.col("page_id") % 10 == 9, F.concat("url", F.lit("/gone"))).otherwise(F.col("url"))
    p = t.pages.select("page_id", url.alias("url")).withColumn("idx", _record("page_id"))
    w = Window.partitionBy("idx").orderBy("page_id")
    p = p.withColumn("rn", F.row_number().over(w)).withColumn("next_url", F.lead("url").over(w))
    merged = (F.col("idx") % 7 == 0) & (F.col("rn") == 1) & F.col("next_url").isNotNull()
    p = p.where(~((F.col("idx") % 7 == 0) & (F.col("rn") == 2)))
    p = p.withColumn("elem", F.when(merged, F.concat_ws(", ", "url", "next_url")).otherwise(F.col("url")))
    agg = p.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("page_id", "elem"))).alias("e"))
    lit = F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: F.concat(F.lit("'"), x["elem"], F.lit("'"))), ", "), F.lit("]"))
    return agg.select("idx", lit.alias("wiki_links"))


def _event_pos(e: DataFrame, key: str = "user_id") -> DataFrame:
    """Position of each event inside its user's history (1-based), from time
    buckets, so a user with a third of all events is not numbered by one task."""
    from ..operators.ranking import rank_within

    return rank_within(e, key, ["ts", "event_id"], "rn")


def v_candidates(t: Tables) -> DataFrame:
    e = _event_pos(t.events.select("event_id", "ts", "user_id", "event_type", "value"))
    return e.select(
        F.col("user_id").alias("question_id"),
        F.col("event_id").alias("candidate_id"),
        F.col("rn").cast("bigint").alias("pos"),
        F.col("event_type").alias("answer"),
        (F.col("value") / 500).alias("confidence"),
        F.col("ts").cast("timestamp").alias("ts"),
        ((F.col("event_id") % 4) / 10).alias("temperature"),
    )


def completion_text(n, event_type):
    """Templated completion text (FIXTURES.md V_completions)."""
    ns = n.cast("string")
    return F.concat(
        F.lit("<think>step "), ns,
        F.when(n % 20 == 0, F.lit("")).otherwise(F.lit("</think>")), F.lit("\n"),
        F.lit("Final answer: "), event_type, F.lit(".\n"),
        F.lit("Score: "), (n % 11).cast("string"), F.lit("\n"),
        F.lit("Explanation: e"), ns, F.lit("\n"),
        F.lit("Decision: "), F.when(n % 3 == 0, F.lit("TRUE")).otherwise(F.lit("FALSE")), F.lit("\n"),
        F.lit("Rating: [["), (n % 2).cast("string"), F.lit("]]\n"),
        F.lit("\\boxed{"), (n % 1000).cast("string"), F.lit("}\n"),
        F.lit("Answer: ("), F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), 1), F.lit(")"),
        F.when(n % 10 == 0, F.concat(F.lit("\n```python\nprint("), ns, F.lit(")\n```"))).otherwise(F.lit("")),
    )


def v_completions(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type")
    return e.select(
        F.col("event_id").alias("completion_id"),
        F.col("user_id").alias("question_id"),
        completion_text(F.col("event_id"), F.col("event_type")).alias("text"),
    )


def v_verifications(t: Tables) -> DataFrame:
    e = _event_pos(t.events.select("event_id", "ts", "user_id", "event_type", "value"))
    return e.select(
        F.col("user_id").alias("solution_id"),
        F.col("rn").cast("bigint").alias("attempt"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "INCORRECT")
         .when(F.col("event_type") == "signup", "INCOMPLETE").otherwise("CORRECT").alias("assessment"),
        (F.col("value") / 500).alias("confidence"),
    )


def v_trace_tokens(t: Tables) -> DataFrame:
    e = _event_pos(t.events.select("event_id", "ts", "user_id", "value"))
    return e.select(
        F.col("user_id").alias("trace_id"),
        (F.col("rn") - 1).cast("bigint").alias("pos"),
        F.col("value").alias("token_confidence"),
    )


def v_attempts(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("user_id").alias("strategy_id"),
        F.concat(F.lit("type_"), (F.col("user_id") % 5).cast("string")).alias("problem_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id"),
        F.col("event_type").isin("purchase", "click").alias("success"),
        (F.col("value") / 500).alias("confidence"),
    )


def v_strategies(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("strategy_id"), F.col("source").alias("problem_type"),
                    F.col("text").alias("strategy_text"))


def v_requests(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "event_type")
    kind = (F.when(F.col("event_type") == "signup", "start")
             .when(F.col("event_type").isin("click", "view"), "provider_call")
             .when(F.col("event_type") == "purchase", "final")
             .otherwise("error"))
    return e.select(
        F.col("user_id").alias("request_id"),
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"),
        F.concat(F.lit("model_"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.concat(F.lit("approach_"), (F.col("user_id") % 4).cast("string")).alias("approach"),
    )


def report_text(doc_id, text):
    """Templated research report (FIXTURES.md V_reports)."""
    ids = doc_id.cast("string")
    return F.concat(
        F.lit("# Report "), ids, F.lit("\n\n## Summary\n"), text,
        F.when(doc_id % 3 == 0, F.concat(F.lit("\n[NEEDS RESEARCH topic "), ids, F.lit("]"))).otherwise(F.lit("")),
        F.lit("\n\n## Findings\n"),
        F.when(doc_id % 4 == 0, F.concat(F.lit("Claim [1] [Placeholder for source "), ids, F.lit("]\n"))).otherwise(F.lit("")),
        F.when(doc_id % 5 == 0, F.lit("[Citation needed]\n...\n")).otherwise(F.lit("")),
        F.when(doc_id % 6 == 0, F.lit("\n## Research Questions for Investigation\n* a?\n * b?\n- c?\n* d?\n\n## Next\n")).otherwise(F.lit("")),
        F.lit("See [2] for details.\n\n## References\n[1] Source one\n"),
    )


def v_reports(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text")
    return d.select(F.col("doc_id").alias("report_id"), report_text(F.col("doc_id"), F.col("text")).alias("text"))


SPARK_VIEWS = {
    "v_results": v_results,
    "v_questions": v_questions,
    "v_contexts": v_contexts,
    "v_links": v_links,
    "v_candidates": v_candidates,
    "v_completions": v_completions,
    "v_verifications": v_verifications,
    "v_trace_tokens": v_trace_tokens,
    "v_attempts": v_attempts,
    "v_strategies": v_strategies,
    "v_requests": v_requests,
    "v_reports": v_reports,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return SPARK_VIEWS[name](Tables(spark, sf_dir))


# ---------------------------------------------------------------------------
# DuckDB side (oracle). Each entry is the body of a CTE.
# ---------------------------------------------------------------------------

_LANG_CASE = "CASE lang " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in LANG_REASONING.items()) + " END"

_COMPLETION_SQL = (
    "'<think>step ' || event_id || CASE WHEN event_id % 20 = 0 THEN '' ELSE '</think>' END || chr(10) || "
    "'Final answer: ' || event_type || '.' || chr(10) || "
    "'Score: ' || (event_id % 11) || chr(10) || "
    "'Explanation: e' || event_id || chr(10) || "
    "'Decision: ' || CASE WHEN event_id % 3 = 0 THEN 'TRUE' ELSE 'FALSE' END || chr(10) || "
    "'Rating: [[' || (event_id % 2) || ']]' || chr(10) || "
    "'\\boxed{' || (event_id % 1000) || '}' || chr(10) || "
    "'Answer: (' || substr('ABCD', CAST(event_id % 4 + 1 AS INTEGER), 1) || ')' || "
    "CASE WHEN event_id % 10 = 0 THEN chr(10) || '```python' || chr(10) || 'print(' || event_id || ')' || chr(10) || '```' ELSE '' END"
)

_REPORT_SQL = (
    "'# Report ' || doc_id || chr(10) || chr(10) || '## Summary' || chr(10) || text || "
    "CASE WHEN doc_id % 3 = 0 THEN chr(10) || '[NEEDS RESEARCH topic ' || doc_id || ']' ELSE '' END || "
    "chr(10) || chr(10) || '## Findings' || chr(10) || "
    "CASE WHEN doc_id % 4 = 0 THEN 'Claim [1] [Placeholder for source ' || doc_id || ']' || chr(10) ELSE '' END || "
    "CASE WHEN doc_id % 5 = 0 THEN '[Citation needed]' || chr(10) || '...' || chr(10) ELSE '' END || "
    "CASE WHEN doc_id % 6 = 0 THEN chr(10) || '## Research Questions for Investigation' || chr(10) || '* a?' || chr(10) || ' * b?' || chr(10) || '- c?' || chr(10) || '* d?' || chr(10) || chr(10) || '## Next' || chr(10) ELSE '' END || "
    "'See [2] for details.' || chr(10) || chr(10) || '## References' || chr(10) || '[1] Source one' || chr(10)"
)

VIEW_SQL = {
    "v_results": f"""
        SELECT d.doc_id AS idx, d.text AS prompt, d.source AS answer, d.text AS model_answer,
               d.n_chars AS q_in_tokens, CAST(floor(d.n_chars / 4) AS BIGINT) AS q_out_tokens,
               CASE WHEN l.quality = 1 THEN 'TRUE' WHEN l.quality = 0 THEN 'FALSE' ELSE '' END AS grader_decision,
               coalesce(l.toxic, 0) = 1 AS is_hallucination,
               CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE d.text END AS context,
               {_LANG_CASE} AS reasoning_types
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_questions": f"""
        SELECT r.idx, b.text AS prompt
        FROM (SELECT DISTINCT doc_id // {RECORD_ROWS} AS idx FROM documents) r
        JOIN benchmark b ON b.item_id = r.idx % (SELECT count(*) FROM benchmark)""",
    "v_contexts": f"""
        SELECT doc_id // {RECORD_ROWS} AS idx,
               CAST(row_number() OVER (PARTITION BY doc_id // {RECORD_ROWS} ORDER BY doc_id) AS BIGINT) AS doc_index,
               'https://example.org/doc/' || doc_id AS url, substr(text, 1, 30) AS title, text AS article
        FROM documents""",
    "v_links": f"""
        SELECT idx, '[' || string_agg('''' || elem || '''', ', ' ORDER BY page_id) || ']' AS wiki_links
        FROM (
          SELECT idx, page_id, rn,
                 CASE WHEN idx % 7 = 0 AND rn = 1 AND next_url IS NOT NULL THEN url || ', ' || next_url ELSE url END AS elem
          FROM (SELECT page_id // {RECORD_ROWS} AS idx, page_id, CASE WHEN page_id % 10 = 9 THEN url || '/gone' ELSE url END AS url,
                       row_number() OVER (PARTITION BY page_id // {RECORD_ROWS} ORDER BY page_id) AS rn,
                       lead(CASE WHEN page_id % 10 = 9 THEN url || '/gone' ELSE url END) OVER (PARTITION BY page_id // {RECORD_ROWS} ORDER BY page_id) AS next_url
                FROM pages) p0
          WHERE NOT (idx % 7 = 0 AND rn = 2)) p1
        GROUP BY idx""",
    "v_candidates": """
        SELECT user_id AS question_id, event_id AS candidate_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos,
               event_type AS answer, value / 500 AS confidence, CAST(ts AS TIMESTAMP) AS ts,
               (event_id % 4) / 10 AS temperature
        FROM events""",
    "v_completions": f"SELECT event_id AS completion_id, user_id AS question_id, {_COMPLETION_SQL} AS text FROM events",
    "v_verifications": """
        SELECT user_id AS solution_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS attempt,
               CAST(ts AS TIMESTAMP) AS ts,
               CASE WHEN event_type = 'error' THEN 'INCORRECT' WHEN event_type = 'signup' THEN 'INCOMPLETE' ELSE 'CORRECT' END AS assessment,
               value / 500 AS confidence
        FROM events""",
    "v_trace_tokens": """
        SELECT user_id AS trace_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
               value AS token_confidence
        FROM events""",
    "v_attempts": """
        SELECT user_id AS strategy_id, 'type_' || (user_id % 5) AS problem_type, CAST(ts AS TIMESTAMP) AS ts,
               event_id, event_type IN ('purchase', 'click') AS success, value / 500 AS confidence
        FROM events""",
    "v_strategies": "SELECT doc_id AS strategy_id, source AS problem_type, text AS strategy_text FROM documents",
    "v_requests": """
        SELECT user_id AS request_id, event_id, CAST(ts AS TIMESTAMP) AS ts,
               CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type IN ('click', 'view') THEN 'provider_call'
                    WHEN event_type = 'purchase' THEN 'final' ELSE 'error' END AS kind,
               'model_' || (user_id % 3) AS model, 'approach_' || (user_id % 4) AS approach
        FROM events""",
    "v_reports": f"SELECT doc_id AS report_id, {_REPORT_SQL} AS text FROM documents",
}

_VIEW_RE = re.compile(r"\bv_[a-z_]+\b")


@lru_cache(maxsize=None)
def with_views(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every fixture view it names."""
    names = [n for n in dict.fromkeys(_VIEW_RE.findall(sql)) if n in VIEW_SQL]
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
