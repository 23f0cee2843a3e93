"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At every level each child of the chosen
node draws ``-ln(u) / weight`` with ``u`` hashed from (key, child's name), and
the smallest draw wins. A child's draw depends only on its own name and
weight, so a changed weight moves keys only between that child and its
siblings, one subtree at a time. A node's weight is the sum of its shards'.

Edge cases: a null key is the empty key, so all null keys share one shard;
repeated keys share a shard and get distinct slots; an empty table gives an
empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: {region: {rack: {shard: weight}}}
Topology = dict[str, dict[str, dict[int, float]]]

RACKS_A_REGION, SHARDS_A_RACK = 2, 2


def topology(n_shards: int, grown: int = 0) -> Topology:
    """``n_shards`` equal shards, two to a rack and four to a region; ``grown``
    further shards are each a region of their own, so that each takes keys
    from others and moves none between them."""
    tree: Topology = {}
    for s in range(n_shards):
        region = f"region{s // (RACKS_A_REGION * SHARDS_A_RACK)}"
        rack = f"rack{s // SHARDS_A_RACK}"
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    for s in range(n_shards, n_shards + grown):
        tree[f"region+{s}"] = {f"rack+{s}": {s: 1.0}}
    return tree


def _draw(key: Column, name: str, weight: float) -> Column:
    """Exponential draw of rate ``weight``: 52 hashed bits as u in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}")).cast("binary")), 1, 13), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def _pick(key: Column, weights: dict[str, float]) -> Column:
    """Name of the child with the smallest draw; names break ties."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.array_min(F.array(*[F.struct(_draw(key, n, w).alias("d"), F.lit(n).alias("n"))
                                 for n, w in weights.items()]))["n"]


def _case(on: Column, cases: dict[str, Column]) -> Column:
    out = None
    for value, then in cases.items():
        out = F.when(on == value, then) if out is None else out.when(on == value, then)
    return out


def place(df: DataFrame, key: str, tree: Topology, out: str = "shard") -> DataFrame:
    """Add the int column ``out``: the shard that ``key`` descends to."""
    total = {r: {k: sum(shards.values()) for k, shards in racks.items()} for r, racks in tree.items()}
    racks = {k: shards for r in tree.values() for k, shards in r.items()}
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    leaf = {k: _pick(text, {str(s): w for s, w in shards.items()}).cast("int") for k, shards in racks.items()}
    return common.without(df, out, "_region", "_rack") \
        .withColumn("_region", _pick(text, {r: sum(ks.values()) for r, ks in total.items()})) \
        .withColumn("_rack", _case(F.col("_region"), {r: _pick(text, ks) for r, ks in total.items()})) \
        .withColumn(out, _case(F.col("_rack"), leaf)).drop("_region", "_rack")


#: Buckets of a shard within which slots are numbered.
SLOT_BUCKETS = 4096


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 16) -> DataFrame:
    """Every document's shard, slot, and shard after one more is added. Law
    ``key``: the text plays no part, so equal texts need not meet. A null text
    has size 1 and the CRC of no bytes."""
    docs = common.documents(spark, sf_dir).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = place(docs, "doc_id", topology(n_shards))
    placed = place(placed, "doc_id", topology(n_shards, 1), "grown_shard")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|slot|"),
                            F.col("text_crc32").cast("string")).cast("binary"))
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % SLOT_BUCKETS).cast("int")
    out = common.gapless_slots(placed, ["shard"], bucket, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql_draw(name: str, weight: float) -> str:
    return (f"-ln((('0x' || substr(md5(k || '|{name}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(2**52)!r}::DOUBLE)"
            f" / {float(weight)!r}::DOUBLE")


def _sql_pick(weights: dict[str, float]) -> str:
    if len(weights) == 1:
        return f"'{next(iter(weights))}'"
    return "list_min([" + ", ".join(f"{{'d': {_sql_draw(n, w)}, 'n': '{n}'}}" for n, w in weights.items()) + "]).n"


def _sql_place(tree: Topology) -> tuple[str, str, str]:
    case = lambda on, cases: f"CASE {on} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + " END"
    region = _sql_pick({r: sum(w for s in ks.values() for w in s.values()) for r, ks in tree.items()})
    rack = case("region", {r: _sql_pick({k: sum(s.values()) for k, s in ks.items()}) for r, ks in tree.items()})
    shard = case("rack", {k: _sql_pick({str(s): w for s, w in shards.items()}) + "::INT"
                          for ks in tree.values() for k, shards in ks.items()})
    return region, rack, shard


def oracle(n_shards: int = 16) -> str:
    """DuckDB twin of the query; CRC-32 is folded over the UTF-8 bytes with a table made in SQL."""
    (r0, k0, s0), (r1, k1, s1) = _sql_place(topology(n_shards)), _sql_place(topology(n_shards, 1))
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "i"
    for _ in range(8):
        table = f"list_transform([{table}], lambda c: {step})[1]"
    return f"""
WITH crc AS (SELECT list({table} ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(strlen(text), 0) + 1 AS size,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
      FROM documents, crc),
a AS (SELECT *, {r0} AS region FROM d), b AS (SELECT *, {k0} AS rack FROM a),
c AS (SELECT * EXCLUDE (region, rack), {s0} AS shard FROM b),
e AS (SELECT *, {r1} AS region FROM c), f AS (SELECT *, {k1} AS rack FROM e),
g AS (SELECT *, {s1} AS grown_shard, ('0x' || substr(md5(k || '|slot|' || text_crc32::VARCHAR), 1, 8))::BIGINT % {SLOT_BUCKETS} AS bucket FROM f)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM g"""
