"""Catalog entries for URL, link and HTML jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import web as W
from . import sqlx as S
from .catalog import Ctx, register

BIG = 2147483647


# ---- DuckDB twins ------------------------------------------------------------

def n_url(x: str) -> str:
    u = S.py_strip(x)
    u = f"replace({u}, '%2527', '%27')"
    u = f"(CASE WHEN contains({u}, ' ') THEN split_part({u}, ' ', 1) ELSE {u} END)"
    return (f"(CASE WHEN length({u}) = 0 THEN {u} WHEN starts_with({u}, 'https://') THEN {u} "
            f"WHEN starts_with({u}, 'http://') THEN 'https://' || substring({u}, 8) ELSE 'https://' || {u} END)")


def strip_comment(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, ' \\([^)]*\\) $') THEN split_part({x}, ' ', 1) ELSE {x} END)"


def decode(x: str) -> str:
    for k, v in W.HTML_ENTITIES:
        x = f"replace({x}, {S.q(k)}, {S.q(v)})"
    return x


def strip_tags(x: str) -> str:
    return decode(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


def clean_text(x: str) -> str:
    y = S.py_strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")
    return f"regexp_replace({y}, '\\[.*?\\]+', '', 'g')"


def drop_code(x: str) -> str:
    h = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    return f"regexp_replace({h}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"


def main_block(h: str) -> str:
    pats = [r"(?is)<article[^>]*>(.*?)</article>", r"(?is)<main[^>]*>(.*?)</main>",
            r'(?is)<div[^>]*role="main"[^>]*>(.*?)</div>',
            r'(?is)<[a-z0-9]+[^>]*class="[^"]*main-content[^"]*"[^>]*>(.*?)</[a-z0-9]+>']
    parts = [f"CASE WHEN regexp_matches({h}, {S.q(p)}) THEN regexp_extract({h}, {S.q(p)}, 1) END" for p in pats]
    return f"coalesce({', '.join(parts)}, {h})"


def element_texts(h: str, tags: str) -> str:
    m = f"regexp_replace({h}, '(?i)<(?:{tags})(?:\\s[^>]*)?>', chr(1), 'g')"
    m = f"regexp_replace({m}, '(?i)</(?:{tags})\\s*>', chr(2), 'g')"
    return f"list_transform(list_slice(string_split({m}, chr(1)), 2, {BIG}), lambda p: {strip_tags('split_part(p, chr(2), 1)')})"


def page_title(html: str, url: str) -> str:
    t = S.py_strip(decode(f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)"))
    return f"coalesce(CASE WHEN length({t}) > 0 THEN {t} END, {url})"


def article(html: str) -> str:
    h = drop_code(html)
    parts = element_texts(main_block(h), "h[1-6]|p")
    return clean_text(f"CASE WHEN len({parts}) > 0 THEN array_to_string({parts}, ' ') ELSE {strip_tags(h)} END")


_LINKS_ARR = "from_json(replace(wiki_links, '''', '\"'), '[\"VARCHAR\"]')"

_EXPLODE_SQL = f"""
    l0 AS (SELECT idx, {_LINKS_ARR} AS arr FROM v_links),
    l1 AS (SELECT idx, generate_subscripts(arr, 1) AS pos, unnest(arr) AS raw FROM l0),
    l2 AS (SELECT idx, pos, {strip_comment('raw')} AS raw FROM l1 WHERE raw IS NOT NULL),
    l3 AS (SELECT idx, pos, CASE WHEN contains(raw, ', ') THEN list_filter(list_transform(string_split(raw, ', '), lambda p: {S.py_strip('p')}), lambda p: length(p) > 0)
                                 ELSE [raw] END AS parts FROM l2),
    l4 AS (SELECT idx, pos, generate_subscripts(parts, 1) - 1 AS sub, unnest(parts) AS part FROM l3),
    l5 AS (SELECT idx, pos, sub, CASE WHEN sub > 0 THEN 1 ELSE 0 END AS is_tail,
                  {n_url("CASE WHEN sub > 0 THEN " + strip_comment('part') + " ELSE part END")} AS url FROM l4),
    links AS (SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY is_tail, pos, sub) AS doc_index, url FROM l5 WHERE length(url) > 0)"""

_PAGES_SQL = f"pg AS (SELECT {n_url('url')} AS url, html FROM pages)"


# ---- Spark queries -----------------------------------------------------------

@register("b1_parse_link_lists", f"""
    SELECT idx, CAST(coalesce(len({_LINKS_ARR}), 0) AS BIGINT) AS n_links, {_LINKS_ARR} IS NOT NULL AS parsed FROM v_links""")
def b1(c: Ctx) -> DataFrame:
    arr = tx.parse_link_list(F.col("wiki_links"))
    return c.v("v_links").select("idx", F.coalesce(F.size(arr), F.lit(0)).cast("bigint").alias("n_links"),
                                 arr.isNotNull().alias("parsed"))


@register("b2_explode_links", f"WITH {_EXPLODE_SQL} SELECT * FROM links")
def b2(c: Ctx) -> DataFrame:
    return W.explode_links(c.v("v_links"))


_URL_VARIANT_SQL = ("CASE page_id % 4 WHEN 1 THEN '  ' || replace(url, 'http://', '') || ' (mirror) ' "
                    "WHEN 2 THEN replace(url, '?', '%2527?') ELSE url END")


@register("b3_normalize_url", f"SELECT page_id, {n_url(_URL_VARIANT_SQL)} AS url FROM pages")
def b3(c: Ctx) -> DataFrame:
    p = c.t.pages
    v = (F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("  "), F.replace(F.col("url"), F.lit("http://"), F.lit("")),
                                                     F.lit(" (mirror) ")))
          .when(F.col("page_id") % 4 == 2, F.replace(F.col("url"), F.lit("?"), F.lit("%2527?"))).otherwise(F.col("url")))
    return p.select("page_id", W.normalize_url(v).alias("url"))


_URL_TEXT_SQL = "'Visit ' || url || '), or see \"' || url || '\" and ' || url || ',' || chr(10) || 'done'"


@register("b4_extract_urls", f"""
    SELECT page_id, unnest(list_transform(regexp_extract_all({_URL_TEXT_SQL}, 'https?://[^\\s''"]+', 0),
                                          lambda u: regexp_replace(u, '[,''")\\]]+\\z', '', 'g'))) AS url FROM pages""")
def b4(c: Ctx) -> DataFrame:
    p = c.t.pages
    text = F.concat(F.lit("Visit "), F.col("url"), F.lit('), or see "'), F.col("url"), F.lit('" and '), F.col("url"),
                    F.lit(",\ndone"))
    return p.select("page_id", F.explode(W.extract_urls(text)).alias("url"))


@register("b7_domain_counts", """
    SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS domain, count(*) AS n_pages FROM pages GROUP BY 1""")
def b7(c: Ctx) -> DataFrame:
    return c.t.pages.groupBy(W.url_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n_pages"))


@register("b7_inline_content", f"""
    SELECT page_id, replace('Read ' || url || ' now', url,
                            url || ' [Content from ' || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) || ': '
                            || {page_title('html', 'url')} || ']') AS text
    FROM pages""")
def b7_inline(c: Ctx) -> DataFrame:
    p = c.t.pages
    rep = F.concat(F.col("url"), F.lit(" [Content from "), W.url_domain(F.col("url")), F.lit(": "),
                   W.page_title(F.col("html"), F.col("url")), F.lit("]"))
    return p.select("page_id", F.replace(F.concat(F.lit("Read "), F.col("url"), F.lit(" now")), F.col("url"), rep).alias("text"))


@register("b9_extract_articles", f"""
    SELECT page_id, {page_title('html', 'url')} AS title, {article('html')} AS article FROM pages""")
def b9(c: Ctx) -> DataFrame:
    p = c.t.pages
    return p.select("page_id", W.page_title(F.col("html"), F.col("url")).alias("title"),
                    W.extract_article(F.col("html")).alias("article"))


@register("b11_paragraphs", f"""
    SELECT page_id, {clean_text("array_to_string(" + element_texts(
        "CASE WHEN regexp_matches(" + drop_code('html') + ", '(?is)<div[^>]*id=\"bodyContent\"[^>]*>(.*)</div>') THEN regexp_extract("
        + drop_code('html') + ", '(?is)<div[^>]*id=\"bodyContent\"[^>]*>(.*)</div>', 1) ELSE " + drop_code('html') + " END", 'p') + ", ' ')")} AS text
    FROM pages""")
def b11(c: Ctx) -> DataFrame:
    return c.t.pages.select("page_id", W.extract_paragraphs(F.col("html")).alias("text"))


def _body_sql(x: str) -> str:
    h = drop_code(x)
    for t in ("nav", "header", "footer", "aside"):
        h = f"regexp_replace({h}, '(?is)<{t}[^>]*>.*?</{t}>', ' ', 'g')"
    spaced = f"regexp_replace({h}, '<[^>]*>', ' ', 'g')"
    text = S.py_strip(f"regexp_replace({strip_tags(spaced)}, '\\s+', ' ', 'g')")
    return f"regexp_replace({text}, '\\[(?:\\d+|edit)\\]', '', 'g')"


@register("b12_body_text", f"SELECT page_id, {_body_sql('html')} AS text FROM pages")
def b12(c: Ctx) -> DataFrame:
    return c.t.pages.select("page_id", W.extract_body_text(F.col("html")).alias("text"))


@register("b13_page_title", f"SELECT page_id, {page_title('html', 'url')} AS title FROM pages")
def b13(c: Ctx) -> DataFrame:
    return c.t.pages.select("page_id", W.page_title(F.col("html"), F.col("url")).alias("title"))


_NOTES_SQL = "text || ' [' || (doc_id % 7) || '] tail [edit]]'"


@register("b14_clean_text", f"SELECT doc_id, {clean_text(_NOTES_SQL)} AS text FROM documents")
def b14(c: Ctx) -> DataFrame:
    d = c.t.documents
    t = F.concat(F.col("text"), F.lit(" ["), (F.col("doc_id") % 7).cast("string"), F.lit("] tail [edit]]"))
    return d.select("doc_id", W.clean_text(t).alias("text"))


@register("b15_truncate_chars", """
    SELECT doc_id, CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || '...' ELSE text END AS text FROM documents""")
def b15(c: Ctx) -> DataFrame:
    return c.t.documents.select("doc_id", W.truncate_chars(F.col("text"), 2000).alias("text"))


@register("b15_truncation_report", """
    SELECT count(*) AS n_records, CAST(sum(CASE WHEN length(text) > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS n_truncated FROM documents""")
def b15_report(c: Ctx) -> DataFrame:
    d = c.t.documents
    return d.agg(F.count(F.lit(1)).alias("n_records"),
                 F.sum(F.when(F.length("text") > 2000, 1).otherwise(0)).cast("bigint").alias("n_truncated"))


_FOUND_SQL = f"""
    {_EXPLODE_SQL}, {_PAGES_SQL},
    found AS (SELECT links.idx, links.doc_index, links.url, {page_title('pg.html', 'links.url')} AS title, {article('pg.html')} AS article
              FROM links JOIN pg ON links.url = pg.url)"""


def _found(c: Ctx) -> DataFrame:
    found, _ = W.fetch_lookup(W.explode_links(c.v("v_links")), c.t.pages)
    return found


@register("a20_fetch_lookup", f"WITH {_FOUND_SQL} SELECT * FROM found")
def a20(c: Ctx) -> DataFrame:
    return _found(c)


@register("a20_fetch_misses", f"""
    WITH {_EXPLODE_SQL}, {_PAGES_SQL}
    SELECT links.idx, links.doc_index, links.url FROM links WHERE url NOT IN (SELECT url FROM pg)""")
def a20_misses(c: Ctx) -> DataFrame:
    _, misses = W.fetch_lookup(W.explode_links(c.v("v_links")), c.t.pages)
    return misses.select("idx", "doc_index", "url")


@register("b16_context_docs", f"WITH {_FOUND_SQL} SELECT idx, doc_index, url, title FROM found")
def b16(c: Ctx) -> DataFrame:
    return _found(c).select("idx", "doc_index", "url", "title")


@register("b16_wiki_content", f"""
    WITH {_FOUND_SQL}
    SELECT idx, to_json(list({{'doc_index': doc_index, 'url': url, 'title': title, 'article': article}} ORDER BY doc_index))::VARCHAR AS wiki_content
    FROM found WHERE (idx + doc_index) % 5 <> 0 GROUP BY idx""")
def b16_nested(c: Ctx) -> DataFrame:
    """Every fifth fetch fails; the others keep their numbers."""
    found = _found(c).where((F.col("idx") + F.col("doc_index")) % 5 != 0)
    return W.wiki_content(found, "idx").select("idx", F.to_json("wiki_content").alias("wiki_content"))


@register("b17_generated_context", f"""
    WITH {_FOUND_SQL}
    SELECT idx, string_agg('--- Content from ' || url || ' ---' || chr(10) || article || chr(10), chr(10) ORDER BY doc_index) AS generated_context
    FROM found GROUP BY idx""")
def b17(c: Ctx) -> DataFrame:
    return W.generated_context(_found(c), "idx", "doc_index", "url", "article")


@register("b18_unique_results", """
    WITH r AS (SELECT page_id % 10 AS query_id, page_id AS rank,
                      'https://' || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS url FROM pages)
    SELECT query_id, url, min(rank) AS rank FROM r WHERE NOT contains(url, 'google.com') GROUP BY 1, 2""")
def b18(c: Ctx) -> DataFrame:
    p = c.t.pages
    r = p.select((F.col("page_id") % 10).alias("query_id"), F.col("page_id").alias("rank"),
                 F.concat(F.lit("https://"), W.url_domain(F.col("url"))).alias("url"))
    return W.unique_results(r, "query_id", "rank", "url").select("query_id", "url", "rank")


@register("b19_parse_result_blocks", f"""
    WITH g AS (SELECT page_id // 20 AS grp,
                      string_agg((page_id % 20 + 1) || '. **' || {page_title('html', 'url')} || '**' || chr(10) || '   URL: ' || url || chr(10), ''
                                 ORDER BY page_id) AS text FROM pages GROUP BY 1),
    m AS (SELECT grp, regexp_extract_all(text, '(?m)(\\d+)\\.\\s*\\*\\*(.+?)\\*\\*\\s*\\n\\s*URL:\\s*(.+?)\\n', 1) AS nums,
                 regexp_extract_all(text, '(?m)(\\d+)\\.\\s*\\*\\*(.+?)\\*\\*\\s*\\n\\s*URL:\\s*(.+?)\\n', 2) AS titles,
                 regexp_extract_all(text, '(?m)(\\d+)\\.\\s*\\*\\*(.+?)\\*\\*\\s*\\n\\s*URL:\\s*(.+?)\\n', 3) AS urls FROM g)
    SELECT grp, unnest(nums) AS number, {S.py_strip('unnest(titles)')} AS title, {S.py_strip('unnest(urls)')} AS url FROM m""")
def b19(c: Ctx) -> DataFrame:
    p = c.t.pages
    line = F.concat((F.col("page_id") % 20 + 1).cast("string"), F.lit(". **"),
                    W.page_title(F.col("html"), F.col("url")), F.lit("**\n   URL: "), F.col("url"), F.lit("\n"))
    g = p.groupBy(F.expr("page_id div 20").alias("grp")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", line.alias("l")))), lambda x: x["l"]), "")
         .alias("text"))
    parsed = g.select("grp", F.explode(W.parse_result_blocks(F.col("text"))).alias("r"))
    return parsed.select("grp", F.col("r.number").alias("number"), F.col("r.title").alias("title"), F.col("r.url").alias("url"))


@register("f15_page_token_rollup", f"""
    WITH {_FOUND_SQL}
    SELECT idx, url, CAST(sum(floor(length(article) / 4)) AS BIGINT) AS tokens, count(*) AS n_pages
    FROM found GROUP BY ROLLUP (idx, url)""")
def f15(c: Ctx) -> DataFrame:
    f = _found(c).withColumn("_t", tx.chars_div4(F.col("article")))
    return f.rollup("idx", "url").agg(F.sum("_t").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("n_pages"))


_SQ_TEXT = ("CASE turn % 4 WHEN 0 THEN 'User: search for: ' || text || chr(10) || 'thanks' "
            "WHEN 1 THEN 'look up \"' || text || '\"?' WHEN 2 THEN 'research ?' ELSE text END")


def _strip_quotes_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[''\"]+|[''\"]+\\z', '', 'g')"


def _search_sql() -> str:
    t = "t"
    found = "list_concat(" + ", ".join(f"regexp_extract_all({t}, {S.q('(?i)' + p)}, 1)" for p in W.SEARCH_PATTERNS) + ")"
    found = f"list_filter(list_transform({found}, lambda m: {_strip_quotes_sql(S.py_strip('m'))}), lambda m: length(m) > 0)"
    low = S.py_strip(f"lower({t})")
    empty = " OR ".join(
        f"(starts_with({low}, {S.q(sp)}) AND length({_strip_quotes_sql(S.py_strip(f'replace({low}, {S.q(sp)}, {S.EMPTY})'))}) < 2)"
        for sp in W.SEARCH_PREFIXES)
    plain = _strip_quotes_sql(S.py_strip(f"replace({t}, '?', '')"))
    n_words = f"len(list_filter(regexp_split_to_array({plain}, '\\s+'), lambda w: length(w) > 0))"
    cleaned = _strip_quotes_sql(S.py_strip(f"regexp_replace(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s.]', ' ', 'g'), '\\s+', ' ', 'g')"))
    cut = f"CASE WHEN length({cleaned}) > 100 THEN regexp_replace(substring({cleaned}, 1, 100), ' [^ ]*\\z', '') ELSE {cleaned} END"
    return (f"CASE WHEN len({found}) > 0 THEN {found} WHEN {empty} THEN [] "
            f"WHEN length({plain}) > 0 AND {n_words} > 2 THEN [{plain}] WHEN length({cut}) > 2 THEN [{cut}] ELSE [] END")


@register("b20_search_queries", f"""
    WITH c AS (SELECT conv_id, turn, {S.py_strip("regexp_replace(" + _SQ_TEXT + ", " + S.q(W.prefix_pattern()) + ", '')")} AS t
               FROM conversations WHERE role = 'user'),
    q AS (SELECT conv_id, turn, {_search_sql()} AS queries FROM c)
    SELECT conv_id, turn, generate_subscripts(queries, 1) - 1 AS query_pos, unnest(queries) AS query FROM q""")
def b20(c: Ctx) -> DataFrame:
    conv = c.t.conversations.where(F.col("role") == "user")
    n = F.col("turn") % 4
    text = (F.when(n == 0, F.concat(F.lit("User: search for: "), F.col("text"), F.lit("\nthanks")))
             .when(n == 1, F.concat(F.lit('look up "'), F.col("text"), F.lit('"?')))
             .when(n == 2, F.lit("research ?")).otherwise(F.col("text")))
    q = conv.select("conv_id", "turn", W.search_queries(text).alias("queries"))
    return q.select("conv_id", "turn", F.posexplode("queries").alias("query_pos", "query"))


def _decoded_sql(x: str) -> str:
    return f"url_decode({x})"


def _encoded_sql(x: str, safe: str) -> str:
    out = f"url_encode({x})"
    for ch in safe:
        out = f"replace({out}, '%{ord(ch):02X}', '{ch}')"
    return out


def _variants_sql(u: str) -> str:
    part = lambda i: f"regexp_extract({u}, {S.q(W.URL_PARTS_RE)}, {i})"
    path = _encoded_sql(_decoded_sql(part(3)), W.PATH_SAFE)
    query = _encoded_sql(_decoded_sql(f"substring({part(4)}, 2)"), W.QUERY_SAFE)
    anew = (f"{part(1)} || {part(2)} || {path} || CASE WHEN length({part(4)}) > 1 THEN '?' || {query} ELSE '' END "
            f"|| CASE WHEN length({part(5)}) > 1 THEN {part(5)} ELSE '' END")
    return f"[{u}, {_decoded_sql(u)}, {_decoded_sql(_decoded_sql(u))}, {anew}]"


@register("b6_url_variants_first_hit", f"""
    WITH l AS (SELECT page_id AS link_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '?', '%253F') ELSE url END AS url FROM pages),
    v AS (SELECT link_id, url, {_variants_sql('url')} AS vs FROM l),
    e AS (SELECT link_id, unnest(vs) AS variant, generate_subscripts(vs, 1) AS i FROM v),
    g AS (SELECT link_id, variant, row_number() OVER (PARTITION BY link_id ORDER BY min(i)) - 1 AS variant_no FROM e GROUP BY 1, 2),
    h AS (SELECT link_id, variant_no, variant, page_id FROM g JOIN pages ON pages.url = g.variant
          QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY variant_no, variant, page_id) = 1)
    SELECT link_id, l.url, CAST(variant_no AS INTEGER) AS variant_no, variant AS matched_url, page_id FROM l LEFT JOIN h USING (link_id)""")
def b6(c: Ctx) -> DataFrame:
    # Links arrive percent-encoded twice ('?' -> '%253F') for every third page.
    p = c.t.pages
    links = p.select("page_id", F.when(F.col("page_id") % 3 == 0, F.replace(F.col("url"), F.lit("?"), F.lit("%253F")))
                     .otherwise(F.col("url")).alias("url")).withColumnRenamed("page_id", "link_id")
    return W.first_variant_hit(links, p, ["link_id"])


# Pages mark their main block in four ways, and every third has a table.
_TABLE = "<table><tr><th>Key</th><th>Value</th></tr><tr><td>url</td><td> %s </td></tr></table>"
_MAIN_TAGS = {1: ('<main class="x">', "</main>"), 2: ('<div role="main">', "</div>"), 3: ('<section class="wide main-content">', "</section>")}


def _b8_html_sql() -> str:
    h = "CASE WHEN page_id % 3 = 0 THEN replace(html, '</article>', '" + _TABLE.replace("%s", "' || url || '") + "</article>') ELSE html END"
    for k, (a, b) in _MAIN_TAGS.items():
        h = f"CASE WHEN page_id % 4 = {k} THEN replace(replace({h}, '<article>', {S.q(a)}), '</article>', {S.q(b)}) ELSE {h} END"
    return h


def _b8_html() -> Column:
    pre, post = _TABLE.split("%s")
    h = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("</article>"), F.concat(F.lit(pre), F.col("url"), F.lit(post + "</article>")))) \
        .otherwise(F.col("html"))
    for k, (a, b) in _MAIN_TAGS.items():
        h = F.when(F.col("page_id") % 4 == k, F.replace(F.replace(h, F.lit("<article>"), F.lit(a)), F.lit("</article>"), F.lit(b))).otherwise(h)
    return h


_CELL_END = r"split_part(regexp_replace(c, '(?i)</t[dhr]\s*>', chr(6), 'g'), chr(6), 1)"


def _table_sql(x: str) -> str:
    cells = lambda y, tag: (f"list_transform(list_slice(string_split(regexp_replace({y}, '(?i)<{tag}(?:\\s[^>]*)?>', chr(5), 'g'), chr(5)), 2, {BIG}), "  # noqa: E731
                            f"lambda c: {S.py_strip(strip_tags(_CELL_END))})")
    rows = f"list_slice(string_split(regexp_replace({x}, '(?i)<tr(?:\\s[^>]*)?>', chr(4), 'g'), chr(4)), 2, {BIG})"
    lines = f"list_concat([array_to_string({cells(x, 'th')}, ' | ')], list_transform({rows}, lambda r: array_to_string({cells('r', 't[dh]')}, ' | ')))"
    return f"array_to_string(list_filter({lines}, lambda z: length(z) > 0), ' ')"


def _block_texts_sql(h: str) -> str:
    m = f"regexp_replace({h}, '(?i)<table(?:\\s[^>]*)?>', chr(1) || chr(3), 'g')"
    m = f"regexp_replace({m}, '(?i)<(?:h[1-6]|p)(?:\\s[^>]*)?>', chr(1), 'g')"
    m = f"regexp_replace({m}, '(?i)</(?:h[1-6]|p|table)\\s*>', chr(2), 'g')"
    pieces = f"list_transform(list_slice(string_split({m}, chr(1)), 2, {BIG}), lambda p: split_part(p, chr(2), 1))"
    return f"list_transform({pieces}, lambda p: CASE WHEN left(p, 1) = chr(3) THEN {_table_sql('p')} ELSE {strip_tags('p')} END)"


@register("b8_extract_articles_dom", f"""
    WITH s AS (SELECT page_id, url, {_b8_html_sql()} AS html FROM pages),
    d AS (SELECT page_id, url, html, {drop_code('html')} AS h FROM s),
    b AS (SELECT page_id, url, html, {_block_texts_sql(main_block('h'))} AS own, {_block_texts_sql('h')} AS whole FROM d)
    SELECT page_id, {page_title('html', 'url')} AS title,
           {clean_text("array_to_string(CASE WHEN len(own) > 0 THEN own ELSE whole END, ' ')")} AS article FROM b""")
def b8(c: Ctx) -> DataFrame:
    p = c.t.pages.select("page_id", "url", _b8_html().alias("html"))
    return p.select("page_id", W.page_title(F.col("html"), F.col("url")).alias("title"), W.extract_article_blocks(F.col("html")).alias("article"))


_LENIENT_TEXT = ("'See ' || replace(url, 'http://', '') || '). Also (www.' || regexp_extract(url, '://([^/?#]*)', 1) "
                 "|| '/Page_(' || page_id || ')). Ref [' || url || ']]. End'")


def _unbalanced_sql(u: str, o: str, cl: str) -> str:
    opens = f"(length({u}) - length(replace({u}, '{o}', '')))"
    closes = f"(length({u}) - length(replace({u}, '{cl}', '')))"
    run = f"(length({u}) - length(regexp_replace({u}, '\\{cl}+\\z', '')))"
    return f"substring({u}, 1, length({u}) - greatest(0, least({run}, {closes} - {opens})))"


@register("b5_extract_urls_lenient", f"""
    WITH m AS (SELECT page_id, unnest(regexp_extract_all(t, {S.q(W.LENIENT_URL_RE)}, 0)) AS orig
               FROM (SELECT page_id, {_LENIENT_TEXT} AS t FROM pages)),
    s1 AS (SELECT page_id, orig, regexp_replace(orig, '[.,;:!?"]+\\z', '') AS u FROM m),
    s2 AS (SELECT page_id, orig, {_unbalanced_sql('u', '(', ')')} AS u FROM s1),
    s3 AS (SELECT page_id, orig, {_unbalanced_sql('u', '[', ']')} AS u FROM s2),
    s4 AS (SELECT page_id, orig, ends_with(u, '.') AS dot, CASE WHEN ends_with(u, '.') THEN regexp_replace(u, '\\.+\\z', '') ELSE u END AS u FROM s3)
    SELECT page_id, orig AS original,
           CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u ELSE 'https://' || u END || CASE WHEN dot THEN '.' ELSE '' END AS url
    FROM s4 WHERE length(u) > 0""")
def b5(c: Ctx) -> DataFrame:
    p = c.t.pages
    t = F.concat(F.lit("See "), F.replace(F.col("url"), F.lit("http://"), F.lit("")), F.lit("). Also (www."),
                 F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit("/Page_("), F.col("page_id").cast("string"),
                 F.lit(")). Ref ["), F.col("url"), F.lit("]]. End"))
    e = p.select("page_id", F.explode(W.extract_urls_lenient(t)).alias("u"))
    return e.select("page_id", F.col("u.original").alias("original"), F.col("u.url").alias("url"))
