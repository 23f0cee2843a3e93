"""Catalog entries for privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import privacy as PV
from . import sqlx as S
from .catalog import Ctx, register

_RULES_SQL = "list_concat(" + ", ".join(
    f"list_transform(regexp_extract_all(text, {S.q(p)}, 0), lambda s: {{'entity_type': {S.q(t)}, 'surface': s}})"
    for t, p in PV.ENTITY_RULES) + ")"

_ENT_SQL = f"""
    e0 AS (SELECT doc_id, text, unnest(list_distinct({_RULES_SQL})) AS e FROM documents),
    ents AS (SELECT doc_id, e.entity_type AS entity_type, e.surface AS surface, CAST(instr(text, e.surface) AS INTEGER) AS start FROM e0),
    emap AS (SELECT *, '<' || entity_type || '_' || (row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start, surface) - 1) || '>' AS placeholder
             FROM ents),
    pairs AS (SELECT doc_id, list_sort(list({{'nl': -length(surface), 's': surface, 'p': placeholder}})) AS m FROM emap GROUP BY doc_id),
    anon AS (SELECT d.doc_id, d.text, CASE WHEN pairs.m IS NULL THEN d.text
                                          ELSE list_reduce(pairs.m, lambda acc, x: replace(acc, x.s, x.p), d.text) END AS anonymized
             FROM documents d LEFT JOIN pairs USING (doc_id))"""


def _docs(c: Ctx) -> DataFrame:
    return c.t.documents.select("doc_id", "text")


@register("k1_detect_entities", f"WITH {_ENT_SQL} SELECT * FROM ents")
def k1(c: Ctx) -> DataFrame:
    return PV.detect_entities(_docs(c), "doc_id", "text")


@register("k2_entity_map", f"WITH {_ENT_SQL} SELECT doc_id, entity_type, surface, start, placeholder FROM emap")
def k2_map(c: Ctx) -> DataFrame:
    return PV.entity_map(PV.detect_entities(_docs(c), "doc_id", "text"), "doc_id")


@register("k2_anonymize", f"WITH {_ENT_SQL} SELECT doc_id, anonymized FROM anon")
def k2(c: Ctx) -> DataFrame:
    return PV.anonymize(_docs(c), "doc_id", "text")


@register("k3_restore_round_trip", f"""
    WITH {_ENT_SQL},
    rp AS (SELECT doc_id, list({{'p': placeholder, 's': surface}}) AS m FROM emap GROUP BY doc_id),
    rs AS (SELECT a.doc_id, a.text, CASE WHEN rp.m IS NULL THEN a.anonymized
                                         ELSE list_reduce(list_sort(rp.m), lambda acc, x: replace(acc, x.p, x.s), a.anonymized) END AS restored
           FROM anon a LEFT JOIN rp USING (doc_id))
    SELECT count(*) AS n_documents, CAST(sum(CASE WHEN restored = text THEN 1 ELSE 0 END) AS BIGINT) AS n_restored_equal,
           CAST(sum(CASE WHEN anonymized <> text THEN 1 ELSE 0 END) AS BIGINT) AS n_changed
    FROM (SELECT rs.*, anon.anonymized FROM rs JOIN anon USING (doc_id))""")
def k3(c: Ctx) -> DataFrame:
    docs = _docs(c)
    m = PV.entity_map(PV.detect_entities(docs, "doc_id", "text"), "doc_id")
    anon = PV.anonymize(docs, "doc_id", "text")
    back = PV.restore(anon, m, "doc_id")
    j = docs.join(anon, "doc_id").join(back, "doc_id")
    return j.agg(F.count(F.lit(1)).alias("n_documents"),
                 F.sum(F.when(F.col("restored") == F.col("text"), 1).otherwise(0)).cast("bigint").alias("n_restored_equal"),
                 F.sum(F.when(F.col("anonymized") != F.col("text"), 1).otherwise(0)).cast("bigint").alias("n_changed"))


@register("c13_deanonymize", f"""
    WITH {_ENT_SQL},
    rp AS (SELECT doc_id, list({{'p': placeholder, 's': surface}}) AS m FROM emap GROUP BY doc_id)
    SELECT a.doc_id, CASE WHEN rp.m IS NULL THEN a.anonymized
                          ELSE list_reduce(list_sort(rp.m), lambda acc, x: replace(acc, x.p, x.s), a.anonymized) END AS restored
    FROM anon a LEFT JOIN rp USING (doc_id)""")
def c13(c: Ctx) -> DataFrame:
    docs = _docs(c)
    m = PV.entity_map(PV.detect_entities(docs, "doc_id", "text"), "doc_id")
    return PV.restore(PV.anonymize(docs, "doc_id", "text"), m, "doc_id")


@register("k4_entity_report", f"""
    WITH {_ENT_SQL}
    SELECT entity_type, count(*) AS n_entities, count(DISTINCT doc_id) AS n_documents,
           round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 9) AS document_share
    FROM ents GROUP BY 1""")
def k4(c: Ctx) -> DataFrame:
    docs = _docs(c)
    return PV.entity_report(PV.detect_entities(docs, "doc_id", "text"), docs, "doc_id")
