"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. Each text becomes the set of its word shingles (64-bit hashes). A
   SuperMinHash signature ranks every element by a permutation of the slots of
   its own: at level ``j`` an element offers ``j + r`` to one slot that it has
   not offered to before, and levels end as soon as no later one can lower a
   slot. Equal sets form one class at once, so copies meet only in an
   aggregate and never in pairs.
2. Signatures are cut into bands; classes that share a band value share a
   bucket. With 32 bands of 4 a pair at similarity 0.85 misses every bucket
   with probability 5e-11 (at 0.8: 5e-8).
3. Links are confirmed on the full sets. An intersection cannot hold shingles
   that nobody else has: classes with too many of their own leave first. A few
   rounds compare each class with one hub of its buckets (linear in the
   members) and merge what links; then every pair of a bucket is compared whose
   members are still in different components, share enough with other components
   and do not differ too much by a parity of their sets (all exact bounds). Pairs inside a component need no look, so a large group
   of near copies costs its members, not its pairs, and no link between
   different components is lost.
4. Components come from hooking to the smallest neighbour and shortcutting
   (union-find in rounds), written to the shared folder between rounds.

Edge cases: a text without words is linked with nothing; with fewer words than
a shingle, the whole sequence is one shingle; a null key ranks after every
other and is linked through equal sets only; repeated rows are one document;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bands and signature slots a band.
BANDS, ROWS = 32, 4
#: Rounds in which a class is compared with one hub.
HUB_ROUNDS = 3
#: Bits of the parity by which pairs are ruled out before their sets are read.
PARITY_BITS = 512

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``k``-word shingles; A-Z are lower-cased."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    acc = h[:n]
    for i in range(1, k):
        acc = _mix(acc + _GOLD) ^ h[i:i + n]
        acc = acc * _M2
    return np.unique(_mix(acc))


def signature(elements: np.ndarray, slots: int, block: int = 8192) -> np.ndarray:
    """SuperMinHash of a set: per slot the least ``level * 2**40 + rank``.

    Elements are taken in blocks, level by level; level ``j`` can only offer
    values from ``j`` up, so a block ends once every slot is below the next
    level. Expected work is about two levels for sets larger than ``slots``.
    """
    h = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(elements), block):
        e = elements[lo:lo + block]
        perm = None
        rows = np.arange(len(e))
        for j in range(slots):
            if int(h.max()) >> 40 < j:
                break
            x = _mix(e + np.uint64(int(_GOLD) * (j + 1) % 2**64))
            k = (j + (x & np.uint64(0xFFFFFF)) % np.uint64(slots - j)).astype(np.int64)
            if perm is None:  # level 0: the permutation is still the identity
                slot, first = k, k
            else:
                slot = perm[rows, k].astype(np.int64)
                perm[rows, k] = perm[:, j]
                perm[:, j] = slot
            np.minimum.at(h, slot, (np.uint64(j) << np.uint64(40)) | (x >> np.uint64(24)))
            if perm is None and int(h.max()) >> 40 >= 1:
                perm = np.tile(np.arange(slots, dtype=np.int16), (len(e), 1))
                perm[rows, first] = 0
                perm[:, 0] = first
    return h


def band_values(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value per band."""
    acc = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)
    for column in sig.reshape(bands, rows).T:
        acc = _mix(acc + column)
    return acc.view(np.int64)


def signed(df: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, set_key, bands): set_key digests the set, null if it is empty."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sizes, keys, values = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, k)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                values.append(band_values(signature(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(values, pa.list_(pa.int64()))], names=schema.names)

    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)


def parity(elements: np.ndarray) -> np.ndarray:
    """Every element flips one of PARITY_BITS bits. Two sets differ in at least
    as many elements as their parities differ in bits."""
    odd = np.bincount((elements % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(df: DataFrame, text: str, k: int) -> DataFrame:
    """(set_key, shingles, parity) of every row."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("set_key", T.BinaryType()), T.StructField("shingles", longs), T.StructField("parity", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingles(t, k) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                 pa.array([parity(s) for s in sets], pa.list_(pa.int64()))], names=schema.names)

    return df.select(F.col(text).alias("_text")).mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node of the node's component.

    Every node hooks to its smallest neighbour, two shortcuts follow, and the
    edges are contracted to the labels until none is left.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    e = common.written(e, "edges")
    labels = common.written(e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                            .select("node", F.col("node").alias("label")), "labels")
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("u"), F.least("a", "p").alias("p"))
        up = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        p = common.written(p.join(up, "p").select("u", F.col("pp").alias("l")), "hooks")
        la, lb = p.select(F.col("u").alias("a"), F.col("l").alias("la")), p.select(F.col("u").alias("b"), F.col("l").alias("lb"))
        e = common.written(e.join(la, "a").join(lb, "b").where("la <> lb")
                           .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        labels = common.written(labels.join(p.withColumnRenamed("u", "label"), "label", "left")
                                .select("node", F.coalesce("l", "label").alias("label")), "labels")
    return labels


def near_duplicates(df: DataFrame, key: str, text: str, k: int = 5, num: int = 80, den: int = 100,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) for documents linked when
    ``den * intersection >= num * union`` on their ``k``-word shingle sets."""
    docs = common.written(signed(df, key, text, k, bands, rows), "signatures")
    classes = docs.where("set_key is not null and id is not null").groupBy("set_key").agg(
        F.min("id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = common.written(classes, "classes")
    labels = _link(df, key, text, classes, k, num, den)
    named = classes.select("set_key", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left") \
        .select("set_key", F.coalesce("label", "rep").alias("label"))
    out = docs.drop("bands").join(named, "set_key", "left") \
        .withColumn("component_id", F.coalesce("label", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _shared_buckets(rows: DataFrame, by: str) -> DataFrame:
    """The rows of the buckets that hold more than one value of ``by``."""
    mixed = rows.groupBy("bucket").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).where("lo <> hi").select("bucket")
    return rows.join(mixed, "bucket")


def _can_link(a: str, b: str, num: int, den: int):
    """Whether two rows can link by their sizes and shared counts: an intersection
    has at most as many shingles as either set shares with anybody."""
    return F.expr(f"{num + den} * least({a}.shared, {b}.shared) >= {num} * ({a}.size + {b}.size)")


def _shared_shingles(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(rep, shared): of each row's (rep, label) shingles, those that a row of another label has too."""
    each = rows.select("rep", "label").join(sets, "rep").select("rep", "label", F.explode("shingles").alias("x"))
    mixed = each.groupBy("x").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("x")
    return each.join(mixed, "x").groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(rep, own): the shingles that no other set has, from one aggregate."""
    each = sets.select("rep", F.explode("shingles").alias("x"))
    return each.groupBy("x").agg(F.min("rep").alias("rep"), F.max("rep").alias("hi")).where("rep = hi") \
        .groupBy("rep").agg(F.count(F.lit(1)).alias("own"))


def _link(df: DataFrame, key: str, text: str, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, label) over the classes that link with another."""
    buckets = classes.select("rep", "size", F.explode("bands").alias("bucket"))
    buckets = common.written(_shared_buckets(buckets, "rep"), "buckets")
    # The sets of those classes only, read anew from the text of one document each.
    wanted = classes.select("set_key", "rep").join(buckets.select("rep").distinct(), "rep", "left_semi")
    texts = df.select(F.col(key).alias("rep"), F.col(text).alias("_text")).join(wanted.select("rep"), "rep", "left_semi")
    sets = common.written(shingle_sets(texts, "_text", k).join(wanted, "set_key")
                          .groupBy("rep").agg(F.first("shingles").alias("shingles"), F.first("parity").alias("parity")), "sets")
    # A class too much of its own can link with nobody.
    shared = F.col("size") - F.coalesce("own", F.lit(0))
    buckets = common.written(_shared_buckets(buckets.join(_own_shingles(sets), "rep", "left").select("rep", "size", "bucket", shared.alias("shared"))
                                             .where(den * F.col("shared") >= num * F.col("size")), "rep"), "buckets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sa = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
        sb = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(sa, "a").join(sb, "b").select(
            "a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("i"))
        return both.where(F.expr(f"{den} * i >= {num} * (n - i)")).select("a", "b")

    links: DataFrame | None = None
    labels = df.sparkSession.createDataFrame([], T.StructType([T.StructField("node", wanted.schema["rep"].dataType),
                                                               T.StructField("label", wanted.schema["rep"].dataType)]))
    for turn in range(HUB_ROUNDS + 1):
        live = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left") \
            .withColumn("label", F.coalesce("label", "rep"))
        live = common.written(_shared_buckets(live, "label"), "live")
        if live.isEmpty():
            break
        if turn < HUB_ROUNDS:
            # Hubs are the members with the smallest share of their own shingles, which links reach best.
            rank = F.struct((1 - F.col("shared") / F.col("size")).alias("own"), F.xxhash64("rep", F.lit(turn)).alias("h"))
            if turn:
                rank = F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"))
            hubs = live.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "rep", "size", "shared", "label")).alias("h")) \
                .select("bucket", "h.*").alias("h")
            near = live.alias("m").join(hubs, "bucket").where(F.expr("m.label <> h.label") & _can_link("m", "h", num, den))
            pairs = near.groupBy("m.rep").agg(F.min(F.struct("h.rank", F.col("h.rep").alias("hub"))).alias("p")) \
                .select(F.least("rep", "p.hub").alias("a"), F.greatest("rep", "p.hub").alias("b")).distinct()
        else:
            pairs = _across(sets, live, num, den)
        found = common.written(confirmed(pairs), "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionAll(found)
        labels = components(links)
    return labels


def _across(sets: DataFrame, live: DataFrame, num: int, den: int) -> DataFrame:
    """Every pair (a, b) of a bucket whose members are in different components
    and can link by what they share with other components. The members outside
    a bucket's largest component are joined with the bucket, so a large
    component costs its members only. Pairs whose parities show that they differ
    in too many shingles never leave the join."""
    shared = _shared_shingles(sets, live.select("rep", "label").distinct())
    live = live.drop("shared").join(shared, "rep").where(den * F.col("shared") >= num * F.col("size")) \
        .join(sets.select("rep", "parity"), "rep")
    live = common.written(_shared_buckets(live, "label"), "across")
    largest = live.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("m")).select("bucket", F.col("m.label").alias("largest"))
    rows = live.join(largest, "bucket")
    apart = " + ".join(f"bit_count(m.parity[{i}] ^ f.parity[{i}])" for i in range(PARITY_BITS // 64))
    few = rows.where("label <> largest")
    near = rows.alias("m").join(few.alias("f"), "bucket").where(
        F.expr("(m.label = m.largest or m.label < f.label) and m.label <> f.label") & _can_link("m", "f", num, den)
        & F.expr(f"{num + den} * ({apart}) <= {den - num} * (m.size + f.size)"))
    return near.select(F.least("m.rep", "f.rep").alias("a"), F.greatest("m.rep", "f.rep").alias("b")).distinct()


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents``: three-word shingles, similarity 0.85."""
    return near_duplicates(common.documents(spark, sf_dir), "doc_id", "text", k=3, num=85, den=100)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
c AS (SELECT min(doc_id) AS rep, len(sh) AS n, sh FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
      FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS other FROM c UNION SELECT r.node, d.b FROM r JOIN d ON r.other = d.a),
k AS (SELECT node, min(other) AS comp FROM r GROUP BY 1)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(k.comp, s.doc_id) AS component_id, coalesce(k.comp, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN k ON k.node = c.rep"""
