"""Line dedup by site-relative frequency.

Lines are compared without surrounding white space; blank lines are never
dropped. Per host, a line's frequency is the pages that contain it divided by
the host's pages; lines above ``RATIO`` (and on at least ``MIN_PAGES`` pages)
are boilerplate and leave every page of the host. Pages with the same text
count once, above and below the line, so that a text copied many times is not
taken for boilerplate of its host: copies are near-dedup's to remove.

At most (mean lines a page) / RATIO lines of a host can exceed the ratio, which
bounds a host's drop list whatever the host's size. All counts are partial
aggregates; texts are not shuffled when the drop lists are small enough for
Spark's own broadcast threshold, and AQE splits a hot host otherwise.

Edge cases: a null text stays null with no lines; a null host is the empty
host; a page whose lines all go keeps the empty text; repeated rows count once
and are all cleaned; an empty table gives an empty result; input columns named
like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Share of a host's pages above which a line is boilerplate, and the fewest pages for it.
RATIO, MIN_PAGES = 0.1, 4

#: Characters trimmed from a line's ends before comparing.
BLANKS = " \t\n\x0b\x0c\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(df: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, drop): hashes of the lines that exceed the ratio on each host that has any."""
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split(F.col(text), "\n", -1), _bare), lambda x: x != ""),
                                         lambda x: F.xxhash64(x)))
    pages = df.where(F.col(text).isNotNull()) \
        .select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.md5(F.col(text).cast("binary")).alias("_page"),
                lines.alias("_lines")) \
        .groupBy("_host", "_page").agg(F.first("_lines").alias("_lines"))
    pages = common.written(pages, "pages")
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    counts = pages.select("_host", F.explode("_lines").alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    often = counts.where(F.col("_n") >= min_pages).join(totals, "_host").where(F.col("_n") > F.lit(ratio) * F.col("_pages"))
    return often.groupBy("_host").agg(F.sort_array(F.collect_list("_line")).alias("_drop"))


def drop_lines(df: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``df`` with ``text`` cleaned, n_lines (before) and n_dropped."""
    # Written, so that Spark knows its size and broadcasts it only if it is small.
    drops = common.written(boilerplate(df, host, text, ratio, min_pages), "boilerplate")
    rows = common.without(df, "n_lines", "n_dropped", "_host", "_drop") \
        .withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit(""))).join(drops, "_host", "left")
    rows = rows.withColumn("_lines", F.split(F.col(text), "\n", -1))
    rows = rows.withColumn("_left", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: (_bare(x) == "") | ~F.array_contains(F.col("_drop"), F.xxhash64(_bare(x))))))
    rows = rows.withColumn("n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long")) \
        .withColumn("n_dropped", F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0)).cast("long")) \
        .withColumn(text, F.when(F.size("_lines") == F.size("_left"), F.col(text)).otherwise(F.array_join("_left", "\n")))
    return rows.drop("_host", "_drop", "_lines", "_left")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the boilerplate lines of their source."""
    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    return drop_lines(docs, "source", "text").select("doc_id", "source", "n_lines", "n_dropped", "text")


ORACLE = f"""
WITH p AS (SELECT DISTINCT coalesce(source, '') AS host, text FROM documents WHERE text IS NOT NULL),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
l AS (SELECT host, unnest(list_distinct(list_transform(string_split(text, chr(10)),
      lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))) AS line FROM p),
b AS (SELECT host, line FROM l JOIN t USING (host) WHERE line <> '' GROUP BY host, line, pages
      HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * pages),
d AS (SELECT host, list(line) AS gone FROM b GROUP BY 1),
x AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines, coalesce(gone, []) AS gone
      FROM documents LEFT JOIN d ON coalesce(source, '') = host),
y AS (SELECT *, list_filter(lines, lambda x: NOT list_contains(gone,
      trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS rest FROM x)
SELECT doc_id, source, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(rest), 0) AS n_dropped,
       array_to_string(rest, chr(10)) AS text FROM y"""
