"""Catalog entries for chunking, retrieval and context reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context as CX
from ..operators import retrieval as RT
from ..session import parts_for
from ..sources.views import v_contexts
from . import sqlx as S
from .catalog import Ctx, register

# ---- DuckDB twins ------------------------------------------------------------


def sentences_sql(t: str) -> str:
    marked = f"regexp_replace(coalesce({t}, ''), '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {S.py_strip('s')}), lambda s: length(s) > 0)"


def split_sentence_sql(s: str, size: int) -> str:
    words = f"list_filter(regexp_split_to_array({s}, '\\s+'), lambda w: length(w) > 0)"
    ws = "strlen(w)"
    sep = "(CASE WHEN acc.n > 0 THEN 1 ELSE 0 END)"
    over = f"(acc.n > 0 AND acc.sz + {ws} + {sep} > {size})"
    p1 = f"(CASE WHEN {over} THEN list_append(acc.p, {S.py_strip('acc.cur')}) ELSE acc.p END)"
    cur1 = f"(CASE WHEN {over} OR acc.n = 0 THEN w ELSE acc.cur || ' ' || w END)"
    n1 = f"(CASE WHEN {over} THEN 1 ELSE acc.n + 1 END)"
    s1 = f"(CASE WHEN {over} THEN {ws} ELSE acc.sz + {sep} + {ws} END)"
    big = f"({ws} > {size})"
    step = (f"{{'p': CASE WHEN {big} THEN list_append({p1}, w) ELSE {p1} END, 'cur': CASE WHEN {big} THEN '' ELSE {cur1} END, "
            f"'n': CASE WHEN {big} THEN 0 ELSE {n1} END, 'sz': CASE WHEN {big} THEN 0 ELSE {s1} END}}")
    fold = f"list_reduce({words}, lambda acc, w: {step}, {{'p': []::VARCHAR[], 'cur': '', 'n': 0, 'sz': 0}})"
    fin = f"list_filter(CASE WHEN ({fold}).n > 0 THEN list_append(({fold}).p, {S.py_strip(f'({fold}).cur')}) ELSE ({fold}).p END, lambda z: length(z) > 0)"
    return f"(CASE WHEN strlen({s}) <= {size} THEN [{s}] WHEN len({words}) = 0 THEN [{s}] ELSE {fin} END)"


def chunk_sql(text: str, chunk_bytes: int) -> str:
    size = max(512, chunk_bytes)
    t = S.py_strip(f"coalesce({text}, '')")
    sents = sentences_sql(t)
    pieces = f"flatten(list_transform({sents}, lambda s: {split_sentence_sql('s', size)}))"
    ps = "strlen(x)"
    flush = f"(acc.has AND acc.sz + {ps} > {size})"
    done = S.py_strip("acc.cur")
    c1 = f"(CASE WHEN {flush} AND length({done}) > 0 THEN list_append(acc.c, {done}) ELSE acc.c END)"
    cur1 = f"(CASE WHEN {flush} OR NOT acc.has THEN x ELSE acc.cur || ' ' || x END)"
    s1 = f"(CASE WHEN {flush} THEN {ps} ELSE acc.sz + {ps} END)"
    full = f"({s1} >= {size * 1.5})"
    done1 = S.py_strip(cur1)
    step = (f"{{'c': CASE WHEN {full} AND length({done1}) > 0 THEN list_append({c1}, {done1}) ELSE {c1} END, "
            f"'cur': CASE WHEN {full} THEN '' ELSE {cur1} END, 'has': NOT {full}, 'sz': CASE WHEN {full} THEN 0 ELSE {s1} END}}")
    fold = f"list_reduce({pieces}, lambda acc, x: {step}, {{'c': []::VARCHAR[], 'cur': '', 'has': false, 'sz': 0}})"
    last = S.py_strip(f"({fold}).cur")
    fin = f"CASE WHEN ({fold}).has AND length({last}) > 0 THEN list_append(({fold}).c, {last}) ELSE ({fold}).c END"
    return f"(CASE WHEN length({t}) = 0 THEN []::VARCHAR[] WHEN len({sents}) = 0 THEN [{t}] ELSE {fin} END)"


def truncate_bytes_sql(t: str, limit: str) -> str:
    hx = f"left(hex(encode({t})), 2 * ({limit}))"
    hx = f"regexp_replace({hx}, '(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){{0,2}})\\z', '')"
    return f"(CASE WHEN strlen({t}) <= {limit} THEN {t} ELSE regexp_replace(decode(unhex({hx})), '\\s+\\z', '') END)"


def tfidf_ctes(docs: str) -> str:
    """CTEs over ``docs(idx, seg, t)`` (seg 0 = question) ending in ``scores``."""
    return f"""
    toks AS (SELECT idx, seg, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+', 0)) AS term FROM {docs}),
    tf AS (SELECT idx, seg, term, count(*) AS c FROM toks GROUP BY ALL),
    lens AS (SELECT idx, seg, sum(c) AS len FROM tf GROUP BY ALL),
    nd AS (SELECT idx, count(*) AS n FROM {docs} GROUP BY idx),
    dfq AS (SELECT idx, term, count(*) AS df FROM tf GROUP BY ALL),
    w AS (SELECT tf.idx, tf.seg, tf.term, tf.c / lens.len * (ln((1 + nd.n) / (1 + dfq.df)) + 1) AS w
          FROM tf JOIN lens USING (idx, seg) JOIN dfq USING (idx, term) JOIN nd USING (idx)),
    norms AS (SELECT idx, seg, sqrt(sum(w * w)) AS nn FROM w GROUP BY ALL),
    dots AS (SELECT s.idx, s.seg, sum(s.w * q.w) AS dot FROM w s JOIN w q ON s.idx = q.idx AND s.term = q.term AND q.seg = 0
             WHERE s.seg > 0 GROUP BY ALL),
    scores AS (SELECT d.idx, d.seg, coalesce(dots.dot, 0.0) /
                      ((CASE WHEN coalesce(qn.nn, 0) = 0 THEN 1.0 ELSE qn.nn END) * (CASE WHEN coalesce(sn.nn, 0) = 0 THEN 1.0 ELSE sn.nn END)) AS score
               FROM (SELECT idx, seg FROM {docs} WHERE seg > 0) d
               LEFT JOIN norms sn ON sn.idx = d.idx AND sn.seg = d.seg
               LEFT JOIN norms qn ON qn.idx = d.idx AND qn.seg = 0
               LEFT JOIN dots ON dots.idx = d.idx AND dots.seg = d.seg)"""


def select_ctes(scored: str, limit: int) -> str:
    """CTEs over ``scored(idx, o, score, t)`` ending in ``selected(idx, n_selected, context)``."""
    fold = (f"list_reduce(l, lambda acc, x: {{'keep': CASE WHEN acc.total + x.b <= {limit} THEN list_append(acc.keep, x.o) ELSE acc.keep END, "
            f"'total': CASE WHEN acc.total + x.b <= {limit} THEN acc.total + x.b ELSE acc.total END}}, "
            f"{{'keep': []::BIGINT[], 'total': 0::BIGINT}}).keep")
    joined = (f"array_to_string(list_filter(list_transform(list_sort(list_transform(list_filter(l, lambda x: list_contains(k, x.o)), "
              f"lambda x: {{'o': x.o, 't': x.t}})), lambda x: {S.py_strip('x.t')}), lambda s: length(s) > 0), chr(10) || chr(10))")
    return f"""
    sl AS (SELECT idx, list_sort(list({{'ns': -round(score, 12), 'o': CAST(o AS BIGINT), 'b': CAST(strlen(t) AS BIGINT), 't': t}})) AS l FROM {scored} GROUP BY idx),
    sk AS (SELECT idx, l, {fold} AS k FROM sl),
    sj AS (SELECT idx, l, k, {joined} AS j FROM sk),
    selected AS (SELECT idx, len(k) AS n_selected,
                        CASE WHEN len(k) = 0 THEN {truncate_bytes_sql('l[1].t', str(limit))}
                             WHEN strlen(j) > {limit} THEN {truncate_bytes_sql('j', str(limit))} ELSE j END AS context FROM sj)"""


# ---- queries -----------------------------------------------------------------

@register("d1_sentences", f"""
    SELECT doc_id, generate_subscripts(s, 1) - 1 AS sentence_no, unnest(s) AS sentence
    FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)""")
def d1(c: Ctx) -> DataFrame:
    return c.t.documents.select("doc_id", F.posexplode(CX.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def _chunks_query(chunk_bytes: int):
    sql = f"""
    SELECT doc_id, generate_subscripts(ch, 1) - 1 AS chunk_no, unnest(ch) AS chunk
    FROM (SELECT doc_id, {chunk_sql('text', chunk_bytes)} AS ch FROM documents)"""

    def build(c: Ctx) -> DataFrame:
        return c.t.documents.select("doc_id", F.posexplode(CX.chunk_text(F.col("text"), chunk_bytes)).alias("chunk_no", "chunk"))

    return sql, build


_D2_SQL, _d2 = _chunks_query(2048)
register("d2_chunk_reducer", _D2_SQL)(_d2)
_D2S_SQL, _d2s = _chunks_query(512)
register("d2_chunk_reducer_512", _D2S_SQL)(_d2s)


@register("d5_chunk_fixed", """
    SELECT doc_id, generate_subscripts(ch, 1) - 1 AS chunk_no, unnest(ch) AS chunk
    FROM (SELECT doc_id, list_transform(range(0, length(text), 1000), lambda s: substring(text, s + 1, 1000)) AS ch FROM documents)""")
def d5(c: Ctx) -> DataFrame:
    return c.t.documents.select("doc_id", F.posexplode(CX.chunk_fixed(F.col("text"), 1000)).alias("chunk_no", "chunk"))


@register("d6_chunk_overlap", """
    SELECT doc_id, generate_subscripts(ch, 1) - 1 AS chunk_no, unnest(ch) AS chunk
    FROM (SELECT doc_id, list_transform(range(0, length(text), 800), lambda s: substring(text, s + 1, 1000)) AS ch FROM documents)""")
def d6(c: Ctx) -> DataFrame:
    return c.t.documents.select("doc_id", F.posexplode(CX.chunk_overlap(F.col("text"), 1000, 200)).alias("chunk_no", "chunk"))


_D9_DOCS = """
    docs AS (SELECT idx, 0 AS seg, prompt AS t FROM v_questions UNION ALL SELECT idx, doc_index AS seg, article AS t FROM v_contexts)"""


@register("d9_tfidf_scores", f"""
    WITH {_D9_DOCS}, {tfidf_ctes('docs')}
    SELECT idx, seg AS doc_index, round(score, 9) AS score FROM scores""")
def d9(c: Ctx) -> DataFrame:
    sc = CX.tfidf_scores(c.v("v_questions"), c.v("v_contexts").select("idx", (F.col("doc_index") - 1).alias("seg"), "article"),
                         "idx", "seg", "prompt", "article")
    return sc.select("idx", (F.col("seg") + 1).alias("doc_index"), F.round("score", 9).alias("score"))


def _scored_articles(c: Ctx) -> DataFrame:
    ctx = c.v("v_contexts")
    sc = CX.tfidf_scores(c.v("v_questions"), ctx.select("idx", "doc_index", "article"), "idx", "doc_index", "prompt", "article")
    return sc.join(ctx.select("idx", "doc_index", "article"), ["idx", "doc_index"])


@register("d10_d11_select_segments", f"""
    WITH {_D9_DOCS}, {tfidf_ctes('docs')},
    sc AS (SELECT s.idx, s.seg AS o, s.score, v.article AS t FROM scores s JOIN v_contexts v ON v.idx = s.idx AND v.doc_index = s.seg),
    {select_ctes('sc', 8000)}
    SELECT * FROM selected""")
def d10(c: Ctx) -> DataFrame:
    return CX.select_segments(_scored_articles(c), "idx", "doc_index", "article", 8000)


@register("d12_truncate_bytes", f"SELECT doc_id, {truncate_bytes_sql('text', '1001')} AS text FROM documents")
def d12(c: Ctx) -> DataFrame:
    return c.t.documents.select("doc_id", CX.truncate_bytes(F.col("text"), 1001).alias("text"))


_D13_LIMIT = 4096
_D13_SQL = f"""
    base AS (SELECT idx, prompt, model_answer AS ctx FROM v_results),
    big AS (SELECT * FROM base WHERE strlen(ctx) > {_D13_LIMIT}),
    segs AS (SELECT idx, generate_subscripts(ch, 1) AS seg, unnest(ch) AS t FROM (SELECT idx, {chunk_sql('ctx', 2048)} AS ch FROM big)),
    docs AS (SELECT idx, 0 AS seg, prompt AS t FROM big WHERE idx IN (SELECT idx FROM segs) UNION ALL SELECT idx, seg, t FROM segs),
    {tfidf_ctes('docs')},
    sc AS (SELECT s.idx, s.seg AS o, s.score, g.t FROM scores s JOIN segs g ON g.idx = s.idx AND g.seg = s.seg),
    {select_ctes('sc', _D13_LIMIT)},
    reduced AS (SELECT idx, ctx AS context FROM base WHERE strlen(ctx) <= {_D13_LIMIT}
                UNION ALL SELECT idx, context FROM selected
                UNION ALL SELECT idx, {truncate_bytes_sql('ctx', str(_D13_LIMIT))} FROM big WHERE idx NOT IN (SELECT idx FROM segs))"""


def _reduced(c: Ctx) -> DataFrame:
    r = c.v("v_results").select("idx", "prompt", F.col("model_answer").alias("ctx"))
    return reduce_context(r, "idx", "prompt", "ctx", _D13_LIMIT)


def reduce_context(df: DataFrame, key: str, question: str, context: str, limit: int | str,
                   chunk_bytes: int = 2048) -> DataFrame:
    """Pass-through when the context fits; else chunk, score against the
    question, select within the byte budget and reassemble. ``limit`` is a
    number of bytes or the name of a per-row limit column."""
    lim = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    fits = df.where(F.octet_length(context) <= lim).select(key, F.col(context).alias("context"))
    big = df.where(F.octet_length(context) > lim)
    segs = big.select(key, F.posexplode(CX.chunk_text(F.col(context), chunk_bytes)).alias("seg", "t"))
    parts = parts_for(df, question, context)
    qs = big.select(key, question).repartition(parts, key).join(segs.select(key).distinct(), key, "left_semi")
    sc = CX.tfidf_scores(qs, segs, key, "seg", question, "t", parts).repartition(parts, key, "seg").join(segs.repartition(parts, key, "seg"), [key, "seg"])
    if isinstance(limit, str):
        sc = sc.join(big.select(key, limit), key)
    sel = CX.select_segments(sc, key, "seg", "t", limit, parts).select(key, "context")
    empty = big.repartition(parts, key).join(segs.select(key).distinct(), key, "left_anti").select(key, CX.truncate_bytes(F.col(context), lim).alias("context"))
    return fits.unionByName(sel).unionByName(empty)


TRIM_KB = 8


def trim_budgets(c: Ctx, limit_kb: int = TRIM_KB) -> DataFrame:
    """D14 budgets: record budget int(kb * 1024 * 0.75 * 2.5) bytes shared by
    its articles in proportion to their sizes."""
    from pyspark.sql import Window
    budget = int(limit_kb * 1024 * 0.75 * 2.5)
    a = v_contexts(c.t, parts_for(c.t.documents, "text")).select("idx", "doc_index", "article").withColumn("original_bytes", F.octet_length("article"))
    a = a.withColumn("_total", F.sum("original_bytes").over(Window.partitionBy("idx")))
    return a.withColumn("article_limit", F.floor(F.col("original_bytes") / F.col("_total") * budget).cast("bigint")).drop("_total")


@register("d14_trim_budgets", f"""
    SELECT idx, doc_index, CAST(strlen(article) AS BIGINT) AS original_bytes,
           CAST(floor(strlen(article) / sum(strlen(article)) OVER (PARTITION BY idx) * {int(TRIM_KB * 1024 * 0.75 * 2.5)}) AS BIGINT) AS article_limit
    FROM v_contexts""")
def d14_budgets(c: Ctx) -> DataFrame:
    return trim_budgets(c).select("idx", "doc_index", "original_bytes", "article_limit")


@register("d14_trim_records")
def d14(c: Ctx) -> DataFrame:
    """Every article reduced (D13) to its share of the record budget."""
    b = trim_budgets(c).join(c.v("v_questions"), "idx") \
        .withColumn("_k", F.concat_ws(":", F.col("idx").cast("string"), F.col("doc_index").cast("string")))
    red = reduce_context(b.select("_k", "prompt", "article", "article_limit"), "_k", "prompt", "article", "article_limit")
    red = red.repartition(parts_for(c.t.documents, "text"), "_k")
    out = b.select("_k", "idx", "doc_index", "original_bytes", "article_limit").join(red, "_k").drop("_k")
    return out.withColumn("reduced_bytes", F.octet_length("context").cast("bigint"))


@register("d15_trim_record_statistics")
def d15_records(c: Ctx) -> DataFrame:
    r = d14(c)
    return r.agg(F.count_distinct("idx").alias("records"),
                 F.sum(F.when(F.col("reduced_bytes") < F.col("original_bytes"), 1).otherwise(0)).cast("bigint").alias("trimmed_items"),
                 F.sum("original_bytes").cast("bigint").alias("original_bytes"),
                 F.sum("reduced_bytes").cast("bigint").alias("reduced_bytes"),
                 F.sum(F.when(F.col("reduced_bytes") > F.col("article_limit"), 1).otherwise(0)).cast("bigint").alias("over_limit"))


@register("d13_reduce_context", f"WITH {_D13_SQL} SELECT idx, context, CAST(strlen(context) AS BIGINT) AS n_bytes FROM reduced")
def d13(c: Ctx) -> DataFrame:
    return _reduced(c).select("idx", "context", F.octet_length("context").cast("bigint").alias("n_bytes"))


@register("d15_trim_statistics", f"""
    WITH {_D13_SQL}
    SELECT count(*) AS records, CAST(sum(CASE WHEN strlen(r.context) < strlen(b.ctx) THEN 1 ELSE 0 END) AS BIGINT) AS trimmed_records,
           CAST(sum(strlen(b.ctx)) AS BIGINT) AS original_bytes, CAST(sum(strlen(r.context)) AS BIGINT) AS reduced_bytes
    FROM reduced r JOIN base b USING (idx)""")
def d15(c: Ctx) -> DataFrame:
    # Lengths are joined, not texts.
    r = _reduced(c).select("idx", F.octet_length("context").alias("_reduced")) \
        .join(c.v("v_results").select("idx", F.octet_length("model_answer").alias("_original")), "idx")
    return r.agg(F.count(F.lit(1)).alias("records"),
                 F.sum(F.when(F.col("_reduced") < F.col("_original"), 1).otherwise(0)).cast("bigint").alias("trimmed_records"),
                 F.sum("_original").cast("bigint").alias("original_bytes"),
                 F.sum("_reduced").cast("bigint").alias("reduced_bytes"))


_D17_SQL = """
    items AS (SELECT source AS mem, doc_id AS i, text FROM documents),
    queries AS (SELECT 'src' || (item_id % (SELECT count(DISTINCT source) FROM documents)) AS mem, item_id AS q, text FROM benchmark),
    it AS (SELECT mem, i, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}', 0)) AS term FROM items),
    tf AS (SELECT mem, i, term, count(*) AS c FROM it GROUP BY ALL),
    ni AS (SELECT mem, count(*) AS n FROM items GROUP BY mem),
    dfi AS (SELECT mem, term, count(*) AS df FROM tf GROUP BY ALL),
    idf AS (SELECT dfi.mem, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfi JOIN ni USING (mem)),
    iw0 AS (SELECT tf.mem, i, term, c * idf AS w FROM tf JOIN idf USING (mem, term)),
    inrm AS (SELECT mem, i, sqrt(sum(w * w)) AS nn FROM iw0 GROUP BY ALL),
    iw AS (SELECT iw0.mem, iw0.i, term, w / nn AS w FROM iw0 JOIN inrm USING (mem, i)),
    qt AS (SELECT mem, q, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}', 0)) AS term FROM queries),
    qtf AS (SELECT mem, q, term, count(*) AS c FROM qt GROUP BY ALL),
    qw0 AS (SELECT qtf.mem, q, term, c * idf AS w FROM qtf JOIN idf USING (mem, term)),
    qnrm AS (SELECT mem, q, sqrt(sum(w * w)) AS nn FROM qw0 GROUP BY ALL),
    qw AS (SELECT qw0.mem, qw0.q, term, w / nn AS w FROM qw0 JOIN qnrm USING (mem, q)),
    dots AS (SELECT qw.mem, q, i, sum(qw.w * iw.w) AS score FROM qw JOIN iw USING (mem, term) GROUP BY ALL),
    cand AS (SELECT queries.q, items.i, coalesce(dots.score, 0.0) AS score
             FROM queries JOIN items USING (mem) LEFT JOIN dots ON dots.mem = queries.mem AND dots.q = queries.q AND dots.i = items.i)"""


def _memory(c: Ctx, size: int) -> DataFrame:
    d = c.t.documents.select(F.col("source").alias("mem"), "doc_id", "text")
    return RT.bounded_memory(d, "mem", "doc_id", size)


@register("d17_retrieve_top_n", f"""
    WITH {_D17_SQL}
    SELECT q AS item_id, rank, i AS doc_id, round(score, 9) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, i DESC) AS rank FROM cand) WHERE rank <= 10""")
def d17(c: Ctx) -> DataFrame:
    n_src = c.t.documents.agg(F.count_distinct("source").alias("n"))  # one row
    q = c.t.benchmark.join(F.broadcast(n_src)) \
        .select(F.concat(F.lit("src"), (F.col("item_id") % F.col("n")).cast("string")).alias("mem"), "item_id", "text")
    items = c.t.documents.select(F.col("source").alias("mem"), "doc_id", "text")
    return RT.retrieve(items, q, "mem", "doc_id", "text", "item_id", "text", 10)


@register("d18_bounded_memory", """
    SELECT source AS mem, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 20""")
def d18(c: Ctx) -> DataFrame:
    return _memory(c, 20).select("mem", "doc_id")


_D19_TEXT = "CASE WHEN doc_id % 3 = 0 THEN text || ' Query: what about ' || source WHEN doc_id % 3 = 1 THEN text ELSE source END"


def _d19_sql() -> str:
    t = "t"
    after = f"regexp_extract({t}, '(?s)^.*Query:(.*)$', 1)"
    before = f"left({t}, length({t}) - length({after}) - 6)"
    s = f"string_split(regexp_replace({S.py_strip(t)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return (f"CASE WHEN strpos({t}, 'Query:') > 0 THEN {S.py_strip(after)} WHEN len({s}) > 1 THEN {s}[-1] "
            f"ELSE '{RT.QUERY_DEFAULT}' END AS query, "
            f"CASE WHEN strpos({t}, 'Query:') > 0 THEN {S.py_strip(before)} WHEN len({s}) > 1 THEN array_to_string(list_slice({s}, 1, len({s}) - 1), ' ') "
            f"ELSE {t} END AS context")


@register("d19_split_query", f"SELECT doc_id, {_d19_sql()} FROM (SELECT doc_id, {_D19_TEXT} AS t FROM documents)")
def d19(c: Ctx) -> DataFrame:
    d = c.t.documents
    t = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(" Query: what about "), F.col("source")))
          .when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise(F.col("source")))
    s = RT.split_query(t)
    return d.select("doc_id", s["query"].alias("query"), s["context"].alias("context"))


_D20_TEXT = ("CASE WHEN idx % 2 = 0 THEN '===Input Data===' || chr(10) || '- Question: ' || prompt || chr(10) || '- Predicted Answer: x' "
             "ELSE 'System: grade' || chr(10) || 'User: ' || prompt || chr(10) || chr(10) || 'more' END")


@register("d20_question_from_grader_prompt", f"""
    SELECT idx, CASE WHEN regexp_matches(t, '(?s)-\\s*Question:\\s*(.*?)\\n\\s*-\\s*Predicted Answer:')
                     THEN {S.py_strip("regexp_extract(t, '(?s)-\\s*Question:\\s*(.*?)\\n\\s*-\\s*Predicted Answer:', 1)")}
                     WHEN regexp_matches(t, '(?s)User:\\s*(.*?)\\n\\n') THEN {S.py_strip("regexp_extract(t, '(?s)User:\\s*(.*?)\\n\\n', 1)")}
                     ELSE '' END AS question
    FROM (SELECT idx, {_D20_TEXT} AS t FROM v_questions)""")
def d20(c: Ctx) -> DataFrame:
    q = c.v("v_questions")
    t = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("===Input Data===\n- Question: "), F.col("prompt"), F.lit("\n- Predicted Answer: x"))) \
        .otherwise(F.concat(F.lit("System: grade\nUser: "), F.col("prompt"), F.lit("\n\nmore")))
    return q.select("idx", RT.question_from_grader_prompt(t).alias("question"))


_D21_NOTE = "CASE completion_id % 3 WHEN 0 THEN 'YES#' || text WHEN 1 THEN 'NO#skip' ELSE 'N/A' END"


@register("d21_margin_notes", f"""
    SELECT question_id, count(*) AS n_notes, string_agg(substring(n, strpos(n, '#') + 1), chr(10) ORDER BY completion_id) AS combined_notes
    FROM (SELECT completion_id // 16 AS question_id, completion_id, {_D21_NOTE} AS n FROM v_completions) WHERE starts_with(n, 'YES#') GROUP BY 1""")
def d21(c: Ctx) -> DataFrame:
    comp = c.v("v_completions")
    n = F.col("completion_id") % 3
    note = F.when(n == 0, F.concat(F.lit("YES#"), F.col("text"))).when(n == 1, F.lit("NO#skip")).otherwise(F.lit("N/A"))
    return RT.margin_notes(comp.select(F.expr("completion_id div 16").alias("question_id"), "completion_id", note.alias("note")), "question_id", "completion_id", "note")


_IRRELEVANT = ["license", "password"]


@register("d22_drop_irrelevant_chunks", """
    SELECT doc_id, chunk_no FROM (
      SELECT doc_id, generate_subscripts(ch, 1) - 1 AS chunk_no, unnest(ch) AS chunk
      FROM (SELECT doc_id, list_transform(range(0, length(text), 1000), lambda s: substring(text, s + 1, 1000)) AS ch FROM documents))
    WHERE NOT (contains(upper(chunk), 'LICENSE') OR contains(upper(chunk), 'PASSWORD'))""")
def d22(c: Ctx) -> DataFrame:
    ch = c.t.documents.select("doc_id", F.posexplode(CX.chunk_fixed(F.col("text"), 1000)).alias("chunk_no", "chunk"))
    return RT.drop_irrelevant(ch, "chunk", _IRRELEVANT).select("doc_id", "chunk_no")


@register("d23_neighbour_summaries", """
    WITH ch AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS chunk_no, unnest(c) AS chunk
                FROM (SELECT doc_id, list_transform(range(0, length(text), 1000), lambda s: substring(text, s + 1, 1000)) AS c FROM documents)),
    n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ch)
    SELECT doc_id, chunk_no,
           coalesce(array_to_string(list(CASE WHEN chunk_no < n - 1 THEN chunk END) OVER (PARTITION BY doc_id ORDER BY chunk_no
                                         ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), chr(10) || chr(10)), '') AS neighbours
    FROM n""")
def d23(c: Ctx) -> DataFrame:
    ch = c.t.documents.select("doc_id", F.posexplode(CX.chunk_fixed(F.col("text"), 1000)).alias("chunk_no", "chunk"))
    return RT.neighbour_summaries(ch, "doc_id", "chunk_no", "chunk", 5)


_D26_TEXT = ("'Plan:' || chr(10) || '<SUB-QUESTIONS>' || chr(10) || '1. ' || prompt || chr(10) || chr(10) || "
             "'2.What of ' || prompt || chr(10) || 'Why ' || idx || '?' || chr(10) || '</SUB-QUESTIONS>'")


@register("d26_sub_questions", f"""
    SELECT idx, generate_subscripts(qs, 1) - 1 AS q_pos, unnest(qs) AS question FROM (
      SELECT idx, list_transform(list_filter(string_split({S.py_strip("regexp_extract(t, '(?s)<SUB-QUESTIONS>\\s*(.*?)\\s*</SUB-QUESTIONS>', 1)")}, chr(10)),
                                             lambda s: length(s) > 0), lambda s: regexp_replace(s, '^\\d+\\.', '')) AS qs
      FROM (SELECT idx, {_D26_TEXT} AS t FROM v_questions))""")
def d26(c: Ctx) -> DataFrame:
    q = c.v("v_questions")
    t = F.concat(F.lit("Plan:\n<SUB-QUESTIONS>\n1. "), F.col("prompt"), F.lit("\n\n2.What of "), F.col("prompt"),
                 F.lit("\nWhy "), F.col("idx").cast("string"), F.lit("?\n</SUB-QUESTIONS>"))
    return q.select("idx", F.posexplode(RT.sub_questions(t)).alias("q_pos", "question"))


_D26_NUMBERED = "'Queries:' || chr(10) || '1. [' || prompt || ']' || chr(10) || ' 2.  why ' || idx || chr(10) || 'x. no' || chr(10) || '3.' || chr(10) || '4. d' || chr(10) || '5. e' || chr(10) || '6. f' || chr(10) || '7. g'"


@register("d26_numbered_queries", f"""
    SELECT idx, generate_subscripts(qs, 1) - 1 AS q_pos, unnest(qs) AS question FROM (
      SELECT idx, list_slice(list_filter(list_transform(list_filter(list_transform(string_split({_D26_NUMBERED}, chr(10)), lambda s: {S.py_strip('s')}),
               lambda s: regexp_matches(s, '^[0-9]+\\.')), lambda s: {S.py_strip("regexp_replace(s, '^[0-9]+\\.\\s*\\[?(.*?)\\]?$', '\\1')")}),
               lambda q: length(q) > 0), 1, 5) AS qs FROM v_questions)""")
def d26_numbered(c: Ctx) -> DataFrame:
    t = F.concat(F.lit("Queries:\n1. ["), F.col("prompt"), F.lit("]\n 2.  why "), F.col("idx").cast("string"), F.lit("\nx. no\n3.\n4. d\n5. e\n6. f\n7. g"))
    return c.v("v_questions").select("idx", F.posexplode(RT.numbered_queries(t)).alias("q_pos", "question"))


@register("d26_focused_queries", """
    SELECT idx, generate_subscripts(qs, 1) - 1 AS q_pos, unnest(qs) AS question FROM (
      SELECT idx, list_transform(list_slice(string_split(prompt, ' '), 1, 3), lambda a: 'about ' || idx || ' ' || a) AS qs FROM v_questions)""")
def d26_focused(c: Ctx) -> DataFrame:
    q = F.concat(F.lit("about "), F.col("idx").cast("string"))
    return c.v("v_questions").select("idx", F.posexplode(RT.focused_queries(F.split("prompt", " "), q)).alias("q_pos", "question"))


_TAGS = ["Final answer:", "Answer:"]


@register("d27_answer_tag_split", f"""
    SELECT completion_id, CASE WHEN contains(text, 'Final answer:') THEN {S.py_strip("regexp_extract(text, '(?s)^.*Final answer:(.*)$', 1)")}
                               WHEN contains(text, 'Answer:') THEN {S.py_strip("regexp_extract(text, '(?s)^.*Answer:(.*)$', 1)")}
                               ELSE text END AS answer
    FROM v_completions""")
def d27(c: Ctx) -> DataFrame:
    return c.v("v_completions").select("completion_id", RT.after_answer_tag(F.col("text"), _TAGS).alias("answer"))


_BLOCK_SQL_D4 = ("'<<<BEGIN DOC [' || doc_index || ']>>>' || chr(10) || 'Source: Wikipedia | URL: ' || url || chr(10) || "
                 "'Title: ' || title || chr(10) || article || chr(10) || '<<<END DOC [' || doc_index || ']>>>' || chr(10)")
_D4_SQL = f"""
    ctx AS (SELECT idx, string_agg({_BLOCK_SQL_D4}, chr(10) ORDER BY doc_index) AS context FROM v_contexts GROUP BY idx),
    lk AS (SELECT v.idx, v.url AS link, instr(c.context, v.url) AS p FROM v_contexts v JOIN ctx c USING (idx) WHERE instr(c.context, v.url) > 0),
    g AS (SELECT idx, list_sort(list({{'p': p, 'l': link}})) AS L FROM lk GROUP BY idx),
    r AS (SELECT ctx.idx, ctx.context, coalesce(g.L, []) AS L FROM ctx LEFT JOIN g USING (idx)),
    parts AS (SELECT idx, CASE WHEN len(L) = 0 THEN [{{'t': context, 'link': NULL::VARCHAR}}]
                  ELSE list_concat(
                    CASE WHEN L[1].p > 1 AND length({S.py_strip('substring(context, 1, L[1].p - 1)')}) > 0
                         THEN [{{'t': {S.py_strip('substring(context, 1, L[1].p - 1)')}, 'link': NULL::VARCHAR}}] ELSE [] END,
                    list_transform(range(1, len(L) + 1),
                                   lambda i: {{'t': substring(context, L[i].p, coalesce(L[i + 1].p, length(context) + 1) - L[i].p), 'link': L[i].l}}))
                  END AS parts FROM r),
    segs AS (SELECT idx, generate_subscripts(parts, 1) AS o, unnest(parts) AS s FROM parts),
    chunks AS (SELECT idx, o, s.link AS link, {chunk_sql('s.t', 2048)} AS ch FROM segs),
    flat AS (SELECT idx, o, link, generate_subscripts(ch, 1) AS j, unnest(ch) AS text FROM chunks)"""


@register("d4_link_segments", f"""
    WITH {_D4_SQL}
    SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY o, j) - 1 AS seg_order, link, text FROM flat""")
def d4(c: Ctx) -> DataFrame:
    from ..operators import joins as J
    ctx = J.build_context(c.v("v_contexts"), "idx")
    links = c.v("v_contexts").select("idx", F.col("url").alias("link"))
    return CX.link_segments(ctx, links, "idx", "context", "link", 2048)


def _granular_sql(budget: int) -> str:
    most = 4 * budget
    tok = lambda x: f"CAST(ceil(({x}) / 4) AS BIGINT)"
    slices = f"list_transform(range(0, length(w), {most}), lambda i: least({most}, length(w) - i))"
    words = f"flatten(list_transform(regexp_extract_all(s, {S.q(CX.WORD_RE)}, 0), lambda w: {slices}))"
    atoms = (f"flatten(list_transform(regexp_extract_all(t, {S.q(CX.SENTENCE_RE)}, 0), "
             f"lambda s: CASE WHEN length(s) <= {most} THEN [length(s)] ELSE {words} END))")
    over = f"(a.chars > 0 AND {tok('a.chars')} + {tok('n')} > {budget})"
    step = (f"{{'starts': CASE WHEN {over} THEN list_append(a.starts, a.at) ELSE a.starts END, 'at': a.at + n, "
            f"'chars': CASE WHEN {over} THEN n ELSE a.chars + n END, 'before': CASE WHEN {over} THEN a.inside ELSE a.before END, "
            f"'inside': CASE WHEN {over} THEN [a.at] ELSE list_append(a.inside, a.at) END}}")
    init = "{'starts': [0::BIGINT], 'at': 0::BIGINT, 'chars': 0::BIGINT, 'before': []::BIGINT[], 'inside': []::BIGINT[]}"
    return f"""
    WITH d AS (SELECT doc_id, {S.py_strip("coalesce(text, '')")} AS t FROM documents),
    p AS (SELECT doc_id, t, list_reduce({atoms}, lambda a, n: {step}, {init}) AS f FROM d WHERE length(t) > 0),
    q AS (SELECT doc_id, t, f.starts AS st, f.at AS fin, list_concat(f.before, f.inside) AS bounds FROM p),
    r AS (SELECT doc_id, t, fin, CASE WHEN len(st) > 1 AND {tok('fin - st[-1]')} < {budget // 2}
            THEN list_append(list_slice(st, 1, len(st) - 1), list_min(list_transform(
              list_filter(bounds, lambda b: b > st[-2] AND {tok('b - st[-2]')} <= {budget} AND {tok('fin - b')} <= {budget}),
              lambda b: {{'d': abs(2 * b - st[-2] - fin), 'b': b}})).b)
            ELSE st END AS s FROM q),
    x AS (SELECT doc_id, t, fin, s, generate_subscripts(s, 1) AS i FROM r)
    SELECT doc_id, i - 1 AS chunk_no, substring(t, s[i] + 1, coalesce(s[i + 1], fin) - s[i]) AS chunk FROM x"""


@register("d8_chunk_granular", _granular_sql(200))
def d8(c: Ctx) -> DataFrame:
    return CX.chunk_granular(c.t.documents, "doc_id", "text", 200)


# ---- D16: single-context trim with link-anchored segments -----------------------

def reduce_context_links(ctx: DataFrame, links: DataFrame, questions: DataFrame, key: str, limit: int) -> DataFrame:
    """Like D13, but segments come from link-anchored segmentation."""
    fits = ctx.where(F.octet_length("context") <= limit).select(key, "context")
    big = ctx.where(F.octet_length("context") > limit)
    segs = CX.link_segments(big, links, key, "context", "link").select(key, F.col("seg_order").alias("seg"), F.col("text").alias("t"))
    qs = questions.join(segs.select(key).distinct(), key, "left_semi")
    sc = CX.tfidf_scores(qs, segs, key, "seg", "prompt", "t").join(segs, [key, "seg"])
    sel = CX.select_segments(sc, key, "seg", "t", limit).select(key, "context")
    empty = big.join(segs.select(key).distinct(), key, "left_anti").select(key, CX.truncate_bytes(F.col("context"), limit).alias("context"))
    return fits.unionByName(sel).unionByName(empty)


def _d16_sql(limit: int) -> str:
    return f"""
    WITH {_D4_SQL},
    lsegs AS (SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY o, j) AS seg, text AS t FROM flat
             WHERE idx IN (SELECT idx FROM ctx WHERE strlen(context) > {limit})),
    docs AS (SELECT q.idx, 0 AS seg, q.prompt AS t FROM v_questions q WHERE q.idx IN (SELECT idx FROM lsegs)
             UNION ALL SELECT idx, seg, t FROM lsegs),
    {tfidf_ctes('docs')},
    sc AS (SELECT s.idx, s.seg AS o, s.score, g.t FROM scores s JOIN lsegs g ON g.idx = s.idx AND g.seg = s.seg),
    {select_ctes('sc', limit)},
    reduced AS (SELECT idx, context FROM ctx WHERE strlen(context) <= {limit}
                UNION ALL SELECT idx, context FROM selected
                UNION ALL SELECT idx, {truncate_bytes_sql('context', str(limit))} FROM ctx
                          WHERE strlen(context) > {limit} AND idx NOT IN (SELECT idx FROM lsegs))
    SELECT idx, context, CAST(strlen(context) AS BIGINT) AS n_bytes FROM reduced"""


def _d16(c: Ctx, limit: int) -> DataFrame:
    from ..operators import joins as J
    ctx = J.build_context(c.v("v_contexts"), "idx")
    links = c.v("v_contexts").select("idx", F.col("url").alias("link"))
    r = reduce_context_links(ctx, links, c.v("v_questions"), "idx", limit)
    return r.select("idx", "context", F.octet_length("context").cast("bigint").alias("n_bytes"))


@register("d16_trim_context_links_96k", _d16_sql(96 * 1024))
def d16(c: Ctx) -> DataFrame:
    return _d16(c, 96 * 1024)


@register("d16_trim_context_links_16k", _d16_sql(16 * 1024))
def d16_small(c: Ctx) -> DataFrame:
    return _d16(c, 16 * 1024)


# ---- D24/D25: map / collapse / reduce tables -----------------------------------
# Map completions are outside the engine; each chunk stands in for its map result.

MAP_TEMPLATE = "Question: {question}\nContext:\n{context}\nAnswer briefly."
REDUCE_TEMPLATE = "Question: {question}\nNotes:\n{context}\nGive the final answer."
WINDOW_TOKENS, OUTPUT_TOKENS = 2000, 256
COLLAPSE_BUDGET = WINDOW_TOKENS - len(REDUCE_TEMPLATE) // 4 - OUTPUT_TOKENS

_MR_SQL = """
    ch AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS chunk_no, unnest(c) AS chunk
           FROM (SELECT doc_id, list_transform(range(0, length(text), 1000), lambda s: substring(text, s + 1, 1000)) AS c FROM documents)),
    res AS (SELECT doc_id, chunk_no, chunk AS t FROM ch
            WHERE NOT (contains(upper(chunk), 'LICENSE') OR contains(upper(chunk), 'PASSWORD'))),
    red AS (SELECT doc_id, count(*) AS n_chunks,
                   string_agg('Information of Chunk ' || (rn - 1) || ':' || chr(10) || t || chr(10), '' ORDER BY chunk_no) AS context
            FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) AS rn FROM res) GROUP BY doc_id)"""


def _map_chunks(c: Ctx) -> DataFrame:
    return c.t.documents.select("doc_id", F.posexplode(CX.chunk_fixed(F.col("text"), 1000)).alias("chunk_no", "chunk"))


def _map_results(c: Ctx) -> DataFrame:
    ch = RT.drop_irrelevant(_map_chunks(c), "chunk", _IRRELEVANT)
    return ch.select("doc_id", "chunk_no", F.col("chunk").alias("t"))


@register("d24_map_prompts", f"""
    WITH {_MR_SQL}
    SELECT doc_id, chunk_no, 'Question: What does document ' || doc_id || ' say?' || chr(10) || 'Context:' || chr(10) || chunk
                              || chr(10) || 'Answer briefly.' AS prompt FROM ch""")
def d24_map(c: Ctx) -> DataFrame:
    q = F.concat(F.lit("What does document "), F.col("doc_id").cast("string"), F.lit(" say?"))
    return RT.map_prompts(_map_chunks(c), "doc_id", "chunk_no", "chunk", q, MAP_TEMPLATE)


@register("d24_reduce_input", f"WITH {_MR_SQL} SELECT * FROM red")
def d24_reduce(c: Ctx) -> DataFrame:
    return RT.reduce_input(_map_results(c), "doc_id", "chunk_no", "t")


@register("d25_collapse_plan", f"""
    WITH {_MR_SQL}
    SELECT doc_id, n_chunks, CAST(floor(length(context) / 4) AS BIGINT) AS num_tokens, CAST({COLLAPSE_BUDGET} AS BIGINT) AS token_budget,
           floor(length(context) / 4) > {COLLAPSE_BUDGET} AND n_chunks > 1 AS needs_collapse FROM red""")
def d25_plan(c: Ctx) -> DataFrame:
    return RT.collapse_plan(RT.reduce_input(_map_results(c), "doc_id", "chunk_no", "t"), "doc_id", COLLAPSE_BUDGET)


@register("d25_collapse_round", f"""
    WITH {_MR_SQL},
    r AS (SELECT res.*, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS p FROM res
          WHERE doc_id IN (SELECT doc_id FROM red WHERE n_chunks > 1)),
    g AS (SELECT doc_id, CASE WHEN p <= 0 THEN p WHEN p = 1 THEN 0 ELSE p - 1 END AS new_pos, p, t FROM r)
    SELECT doc_id, new_pos, string_agg(t, chr(10) || chr(10) ORDER BY p) AS t FROM g GROUP BY doc_id, new_pos""")
def d25_round(c: Ctx) -> DataFrame:
    from pyspark.sql import Window
    res = _map_results(c)
    multi = res.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("doc_id")
    r = res.join(multi, "doc_id", "left_semi") \
        .withColumn("p", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no")) - 1)
    return RT.collapse_round(r, "doc_id", "p", "t", F.lit(0))


_D25_SIZE = "list_sum(list_transform(%s, lambda n, i: n + 24 + length((i - 1)::VARCHAR)))"


def _d25_sql(budget: int) -> str:
    tok = lambda x: f"CAST(floor({_D25_SIZE % x} / 4) AS BIGINT)"
    more = f"(len(a.c) > 1 AND {tok('a.c')} > {budget})"
    merged = ("list_concat(list_slice(a.c, 1, a.at_), list_concat([a.c[a.at_ + 1] + a.c[a.at_ + 2] + 2], list_slice(a.c, a.at_ + 3, len(a.c))))")
    fold = (f"list_reduce(l, lambda a, x: {{'c': CASE WHEN {more} THEN {merged} ELSE a.c END, "
            f"'at_': CASE WHEN {more} THEN (a.at_ + 1) % greatest(len(a.c) - 2, 1) ELSE a.at_ END, "
            f"'steps': CASE WHEN {more} THEN a.steps + 1 ELSE a.steps END}}, {{'c': l, 'at_': 0::BIGINT, 'steps': 0::BIGINT}})")
    return f"""
    WITH {_MR_SQL},
    g AS (SELECT doc_id, list(length(t) ORDER BY chunk_no) AS l FROM res GROUP BY 1),
    f AS (SELECT doc_id, {fold} AS f FROM g)
    SELECT doc_id, f.steps AS n_steps, len(f.c) AS n_chunks, {tok('f.c')} AS num_tokens FROM f"""


@register("d25_collapse_all", _d25_sql(COLLAPSE_BUDGET))
def d25_all(c: Ctx) -> DataFrame:
    return RT.collapse_all(_map_results(c), "doc_id", "chunk_no", "t", COLLAPSE_BUDGET)
