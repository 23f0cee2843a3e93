"""Entity detection, anonymisation and restoration.

The reference calls an NER engine; here detection is a rule set of regular
expressions (one ``regexp_extract_all`` per rule). Placeholders follow the
reference's ``<TYPE_i>`` format: the same surface always maps to the same
placeholder, and ``i`` counts from 0 per type per document in order of first
appearance. A document's entity map is bounded by the document itself, so
it is gathered per document and applied with an ``aggregate`` fold of
``replace`` (longest surface first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Detection rules (type, pattern), kept RE2-compatible.
ENTITY_RULES = [
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("PHONE_NUMBER", r"(?:\+\d{1,3} )?\(\d{3}\) \d{3}-\d{4}"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[ -]?){3}\d{4}\b"),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    ("SECRET_TOKEN", r"\b[0-9a-f]{24,}\b"),
    ("URL", r"https?://[^\s'\"<>]+"),
]

PLACEHOLDER_RE = r"<[A-Z_]+_\d+>"

# A literal every match of a rule must contain: texts without it skip the
# (backtracking-heavy) pattern scan; results are unchanged.
RULE_GUARDS = {"EMAIL_ADDRESS": "@", "PHONE_NUMBER": "(", "URL": "http"}


def _extract(text: Column, etype: str, pat: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pat), 0)
    guard = RULE_GUARDS.get(etype)
    return F.when(text.contains(guard), found).otherwise(F.array().cast("array<string>")) if guard else found


def detect_entities(docs: DataFrame, key: str, text: str) -> DataFrame:
    """K1: one row per (document, type, distinct surface) with the 1-based
    position of the surface's first occurrence."""
    def tag(etype):
        return lambda s: F.struct(F.lit(etype).alias("entity_type"), s.alias("surface"))

    parts = [F.transform(_extract(F.col(text), etype, pat), tag(etype)) for etype, pat in ENTITY_RULES]
    e = docs.select(key, F.col(text).alias("_t"), F.explode(F.array_distinct(F.concat(*parts))).alias("_e"))
    return e.select(key, F.col("_e.entity_type").alias("entity_type"), F.col("_e.surface").alias("surface"),
                    F.instr(F.col("_t"), F.col("_e.surface")).alias("start"))


def entity_map(entities: DataFrame, key: str) -> DataFrame:
    """K2 map: placeholder per (document, type, surface); index from 0 per
    type per document by first appearance (ties: surface order)."""
    w = Window.partitionBy(key, "entity_type").orderBy("start", "surface")
    return entities.withColumn(
        "placeholder", F.format_string("<%s_%d>", F.col("entity_type"), F.row_number().over(w) - 1))


def _row_entities(text):
    def tag(etype):
        return lambda s: F.struct(F.lit(etype).alias("entity_type"), s.alias("surface"))

    parts = [F.transform(_extract(text, etype, pat), tag(etype)) for etype, pat in ENTITY_RULES]
    return F.array_distinct(F.concat(*parts))


def anonymize(docs: DataFrame, key: str, text: str) -> DataFrame:
    """K2: replace every detected surface by its placeholder.

    The entity map of a document is built inside its row (entities sorted
    by type, first position, surface; the index is the position inside its
    type's run), then applied longest surface first: a single projection,
    no shuffle and no join back to the documents."""
    t = F.col(text)
    ents = F.transform(_row_entities(t), lambda e: F.struct(
        e["entity_type"].alias("ty"), F.instr(t, e["surface"]).alias("st"), e["surface"].alias("s")))
    d = docs.select(key, text).withColumn("_e", F.array_sort(ents))
    types = F.transform("_e", lambda e: e["ty"])
    indexed = F.transform("_e", lambda e, i: F.struct(
        (-F.length(e["s"])).alias("nl"), e["s"].alias("s"),
        F.format_string("<%s_%d>", e["ty"], i + 1 - F.array_position(types, e["ty"])).alias("p")))
    out = F.aggregate(F.array_sort(indexed), t, lambda acc, x: F.replace(acc, x["s"], x["p"]))
    return d.select(key, out.alias("anonymized"))


def restore(anon: DataFrame, mapping: DataFrame, key: str, text: str = "anonymized") -> DataFrame:
    """Put surfaces back in place of placeholders (placeholders are
    unique tokens, so replacement order does not matter)."""
    pairs = mapping.groupBy(key).agg(F.collect_list(F.struct(F.col("placeholder").alias("p"),
                                                             F.col("surface").alias("s"))).alias("_m"))
    j = anon.join(pairs, key, "left")
    lst = F.array_sort(F.coalesce(F.col("_m"), F.array().cast(pairs.schema["_m"].dataType)))
    out = F.aggregate(lst, F.col(text), lambda acc, x: F.replace(acc, x["p"], x["s"]))
    return j.select(key, out.alias("restored"))


def entity_report(entities: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """K4: per type, distinct entities, documents containing one, and the
    share of all documents."""
    n = docs.agg(F.count_distinct(key).alias("_docs"))  # one row
    g = entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_entities"),
                                            F.count_distinct(key).alias("n_documents"))
    return g.join(F.broadcast(n)).withColumn("document_share", F.round(F.col("n_documents") / F.col("_docs"), 9)).drop("_docs")
