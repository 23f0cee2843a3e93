"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

1. Every text becomes the set of its word n-grams (64-bit hashes); equal sets
   are one class.
2. First fragment of the hash range: its n-grams alone are shuffled, packed per
   task, to find those that only one class has. A class with more of its own
   than a partner may lack can link with nobody, and most unrelated texts leave
   here on a third of their n-grams. Only sets that stay are read in full, and
   the same bound is applied to them whole.
3. The global order puts rare n-grams first (number of classes in powers of two,
   then hash). It is cut into ``FRAGMENTS`` fragments of about equal numbers of
   occurrences, and each set into a segment per fragment.
4. A pair's overlap is counted segment by segment, each (pair, fragment) on its
   own, and summed per pair. Before that the shorter segment of each fragment,
   summed, bounds the overlap from above.
5. Candidates share an n-gram of their prefixes in the global order (linked sets
   always do). In ``HUB_ROUNDS`` rounds a class is compared with one hub of its
   n-grams only, and linked classes become one component; then all candidates
   that are still in different components are compared. So a large group of
   near copies costs its members, not its pairs, and every link between
   different components is found.

Links are exact up to collisions of 64-bit hashes. ``links`` returns the links
between class representatives that were counted; pairs inside a component that
nobody needs are not among them.

Edge cases: a text without words is linked with nothing; with fewer words than
an n-gram, the whole sequence is one n-gram; a row with a null key is linked as
any other, and names a component only where all keys are null; every row is a
document of its own, so repeated rows share a component, and rows with one key
and different texts need not; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .neardup import components, shingles

#: Share of the hash range whose n-grams are counted first.
FIRST_SHARE = 0.3
#: N-grams of the first fragment that a task packs at once, and that one group counts.
PACKED, GROUPED = 2_000_000, 250_000
#: Fragments of the global order, and rounds in which a class is compared with one hub.
FRAGMENTS, HUB_ROUNDS = 16, 3
#: Bits of an n-gram's place in the order that hold its hash; those above hold its frequency level.
HASH_BITS = 58


def needed(n: Column | str, num: int, den: int) -> Column:
    """Fewest n-grams that a partner shares with a set of ``n`` (intersection >= num/den of the larger set)."""
    n = F.col(n) if isinstance(n, str) else n
    return F.floor((n * num + (den - 1)) / den).cast("long")


def _first_end() -> np.uint64:
    return np.uint64(int(FIRST_SHARE * 2**64))


def sized(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, n, n_first, set_key) of every row: set size, how many lie in the
    first fragment, and a digest of the set (null if empty)."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("n", T.LongType()),
                           T.StructField("n_first", T.LongType()), T.StructField("set_key", T.BinaryType())])
    end = _first_end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            n, first, keys = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                first.append(int(np.searchsorted(s, end)))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()),
                                              pa.array(keys, pa.binary())], names=schema.names)

    return df.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def class_number(key: bytes) -> int:
    """64 bits of a set's digest."""
    return int.from_bytes(key[:8], "big", signed=True)


def _runs(xs: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]])) if len(xs) else np.zeros(0, np.int64)


def packed(df: DataFrame, text: str, k: int, buckets: int) -> DataFrame:
    """(bucket, known, grams, owners): n-grams of the first fragment with the
    numbers of the classes that have them, as bytes. An n-gram that two classes
    of a task's pack have is known to be shared: two of its owners go to its
    bucket as witnesses, the others are only counted (``known``, spread by class)."""
    end, limit = _first_end(), PACKED

    def flush(sets: list[np.ndarray], owners: list[int]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(sets)
        who = np.repeat(np.array(owners, np.int64), [len(s) for s in sets])
        order = np.argsort(x, kind="stable")
        x, who = x[order], who[order]
        place = np.arange(len(x)) - np.repeat(_runs(x), np.diff(np.append(_runs(x), len(x))))
        rest = who[place >= 2]
        x, who = x[place < 2], who[place < 2]
        # Buckets are even ranges of the fragment; x is sorted, so each is a slice.
        bucket = (x.astype(np.float64) / float(end) * buckets).astype(np.int64).clip(0, buckets - 1)
        rows = []
        starts = _runs(bucket)
        for lo, hi in zip(starts, np.append(starts[1:], len(bucket))):
            rows.append((int(bucket[lo]), False, x[lo:hi].tobytes(), who[lo:hi].tobytes()))
        rest.sort()
        spread = (rest.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(spread, kind="stable")
        rest, spread = rest[order], spread[order]
        starts = _runs(spread)
        for lo, hi in zip(starts, np.append(starts[1:], len(spread))):
            rows.append((int(spread[lo]), True, b"", rest[lo:hi].tobytes()))
        for lo in range(0, len(rows), 256):
            columns = list(zip(*rows[lo:lo + 256]))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()),
                                              pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
                                             names=["bucket", "known", "grams", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sets, owners, seen, held = [], [], set(), 0
        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), k)
                if not len(s):
                    continue
                owner = class_number(xxhash.xxh3_128_digest(s.tobytes()))
                if owner in seen:
                    continue
                seen.add(owner)
                s = s[:np.searchsorted(s, end)].copy()
                if len(s):
                    sets.append(s)
                    owners.append(owner)
                    held += len(s)
                if held >= limit:
                    yield from flush(sets, owners)
                    sets, owners, seen, held = [], [], set(), 0
        if held:
            yield from flush(sets, owners)

    return df.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "bucket long, known boolean, grams binary, owners binary")


def shared_first(packs: DataFrame) -> DataFrame:
    """(owner, shared): how many n-grams of the first fragment a class shares
    with another, at least (a class packed by several tasks may count more)."""
    def count(table: pa.Table) -> pa.Table:
        who, known = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        grams = [np.zeros(0, np.uint64)]
        for flag, g, o in zip(*(table.column(c).to_pylist() for c in ("known", "grams", "owners"))):
            if flag:
                known.append(np.frombuffer(o, np.int64))
            else:
                grams.append(np.frombuffer(g, np.uint64))
                who.append(np.frombuffer(o, np.int64))
        x, w = np.concatenate(grams), np.concatenate(who)
        order = np.lexsort((w, x))
        x, w = x[order], w[order]
        if len(x):  # equal (n-gram, class) rows of several packs are one
            once = np.concatenate([[True], (x[1:] != x[:-1]) | (w[1:] != w[:-1])])
            x, w = x[once], w[once]
        starts = _runs(x)
        many = np.repeat(np.diff(np.append(starts, len(x))) > 1, np.diff(np.append(starts, len(x)))) if len(x) else np.zeros(0, bool)
        owner, n = np.unique(np.concatenate([w[many], *known]), return_counts=True)
        return pa.table({"owner": pa.array(owner, pa.int64()), "shared": pa.array(n.astype(np.int64), pa.int64())})

    return packs.groupBy("bucket").applyInArrow(count, "owner long, shared long") \
        .groupBy("owner").agg(F.sum("shared").alias("shared"))


def full_sets(df: DataFrame, text: str, k: int) -> DataFrame:
    """(set_key, grams) of every row."""
    schema = T.StructType([T.StructField("set_key", T.BinaryType()), T.StructField("grams", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingles(t.as_py(), k) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=schema.names)

    return df.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def ordered_sets(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, n, m, places): each class's n-grams that another class has too, as
    places in the global order, ascending; classes with too many of their own
    are gone. A place is the frequency level above the hash's bits."""
    each = sets.select("rep", F.explode("grams").alias("x"))
    level = F.least(F.floor(F.log2("df")), F.lit(31)).cast("long")
    place = F.shiftleft(level, HASH_BITS).bitwiseOR(F.shiftrightunsigned(F.col("x"), 64 - HASH_BITS))
    counted = each.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("x", place.alias("place"))
    kept = each.join(counted, "x").groupBy("rep").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return kept.join(sets.select("rep", "n"), "rep").select("rep", "n", F.size("places").cast("long").alias("m"), "places") \
        .where(F.col("m") >= needed("n", num, den))


def cuts(sets: DataFrame, fragments: int) -> list[int]:
    """Inner bounds of fragments with about equal numbers of occurrences, from a
    histogram of at most 32 levels x 64 ranges of the hash."""
    shift = HASH_BITS - 6
    bars = sorted(map(tuple, sets.select(F.explode("places").alias("p")).groupBy(F.shiftright("p", shift).alias("cell"))
                      .agg(F.count(F.lit(1)).alias("n")).collect()))
    total, run, out = sum(n for _, n in bars), 0, []
    for cell, n in bars:
        if run * fragments >= total * (len(out) + 1):
            out.append(cell << shift)
        run += n
    return out


def segments(sets: DataFrame, bounds: list[int]) -> tuple[DataFrame, Column]:
    """(rep, fragment, segment) rows, and the column of a set's segment lengths."""
    def below(bound: int) -> Column:
        return F.size(F.filter("places", lambda x: x < F.lit(bound)))

    ends = F.array(F.lit(0), *map(below, bounds), F.size("places"))
    lengths = F.array(*[F.get(F.col("ends"), i + 1) - F.get(F.col("ends"), i) for i in range(len(bounds) + 1)])
    cut = sets.withColumn("ends", ends)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(len(bounds))),
                         lambda f: F.struct(f.alias("fragment"), F.slice("places", F.get(F.col("ends"), f) + 1,
                                                                           F.get(F.col("ends"), f + 1) - F.get(F.col("ends"), f)).alias("segment")))
    rows = cut.select("rep", F.inline(F.filter(pieces, lambda s: F.size(s["segment"]) > 0)))
    return rows, cut.select("rep", "n", "m", lengths.alias("lengths"), "places")


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, overlap): partial overlaps of equal fragments, counted one by one and summed per pair."""
    left = parts.select(F.col("rep").alias("a"), "fragment", F.col("segment").alias("sa"))
    right = parts.select(F.col("rep").alias("b"), "fragment", F.col("segment").alias("sb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("part"))
    return partial.groupBy("a", "b").agg(F.sum("part").alias("overlap"))


def _mixed(rows: DataFrame, by: str) -> DataFrame:
    """The rows of the n-grams that more than one value of ``by`` has."""
    mixed = rows.groupBy("place").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).where("lo <> hi").select("place")
    return rows.join(mixed, "place")


def links(df: DataFrame, key: str, text: str, classes: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame | None, DataFrame]:
    """((a, b) links counted between class representatives, (node, label) of the
    classes that link with another). Classes go by their numbers."""
    labels = df.sparkSession.createDataFrame([], "node long, label long")
    first = classes.agg(F.sum("n_first")).first()[0] or 0
    first_shared = shared_first(packed(df, text, k, max(1, -(-int(first) // GROUPED))))
    own = F.col("n_first") - F.coalesce("shared", F.lit(0))
    live = classes.join(first_shared.withColumnRenamed("owner", "rep"), "rep", "left") \
        .where(own <= F.col("n") - needed("n", num, den)).select("set_key", "rep", "n", "id")
    live = common.written(live, "live")
    texts = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    texts = texts.join(live.select("id"), F.col("_id").eqNullSafe(F.col("id")), "left_semi")
    sets = full_sets(texts, "_text", k).join(live, "set_key").groupBy("rep").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    sets = common.written(sets, "sets")
    sets = common.written(ordered_sets(sets, num, den), "ordered")
    bounds = cuts(sets, FRAGMENTS)
    parts, cut = segments(sets, bounds)
    parts = common.written(parts, "segments")
    # Own n-grams come first in the order, so the prefix's rest is the first m - needed + 1 shared ones.
    index = common.written(cut.select("rep", "n", "m", "lengths", F.explode(F.slice("places", 1, (F.col("m") - needed("n", num, den) + 1).cast("int"))).alias("place")), "index")
    index = common.written(_mixed(index, "rep"), "prefixes")

    def can_link(a: str, b: str) -> Column:
        both = " + ".join(f"least({a}.lengths[{i}], {b}.lengths[{i}])" for i in range(len(bounds) + 1))
        return F.expr(f"{num + den} * least({a}.m, {b}.m) >= {num} * ({a}.n + {b}.n)") & F.expr(f"{num + den} * ({both}) >= {num} * ({a}.n + {b}.n)")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sizes = sets.select("rep", "n")
        both = overlaps(pairs, parts).join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a") \
            .join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
        return both.where(F.expr(f"{num + den} * overlap >= {num} * (na + nb)")).select("a", "b")

    found_all: DataFrame | None = None
    for turn in range(HUB_ROUNDS + 1):
        rows = index.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        rows = common.written(_mixed(rows, "label"), "candidates")
        if rows.isEmpty():
            break
        if turn < HUB_ROUNDS:
            # First the members with the smallest share of own n-grams, which links reach best; then by chance.
            rank = F.struct(F.xxhash64("rep", F.lit(turn)).alias("h")) if turn else \
                F.struct((1 - F.col("m") / F.col("n")).alias("own"), F.xxhash64("rep", F.lit(turn)).alias("h"))
            hubs = rows.groupBy("place").agg(F.min(F.struct(rank.alias("rank"), "rep", "n", "m", "lengths", "label")).alias("h")) \
                .select("place", "h.*").alias("h")
            near = rows.alias("m").join(hubs, "place").where(F.expr("m.label <> h.label") & can_link("m", "h"))
            pairs = near.groupBy("m.rep").agg(F.min(F.struct("h.rank", F.col("h.rep").alias("hub"))).alias("p")) \
                .select(F.least("rep", "p.hub").alias("a"), F.greatest("rep", "p.hub").alias("b")).distinct()
        else:
            # The members outside an n-gram's largest component meet all that has it.
            largest = rows.groupBy("place", "label").agg(F.count(F.lit(1)).alias("c")) \
                .groupBy("place").agg(F.max(F.struct("c", "label")).alias("m")).select("place", F.col("m.label").alias("largest"))
            rows = rows.join(largest, "place")
            near = rows.alias("m").join(rows.where("label <> largest").alias("f"), "place").where(
                F.expr("(m.label = m.largest or m.label < f.label) and m.label <> f.label") & can_link("m", "f"))
            pairs = near.select(F.least("m.rep", "f.rep").alias("a"), F.greatest("m.rep", "f.rep").alias("b")).distinct()
        found = common.written(confirmed(pairs), "links")
        if found.isEmpty():
            continue
        found_all = found if found_all is None else found_all.unionAll(found)
        labels = components(found_all)
    return found_all, labels


def jaccard_join(df: DataFrame, key: str, text: str, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id) for documents linked when
    ``den * intersection >= num * union`` on their sets of ``k``-word n-grams."""
    docs = common.written(sized(df, key, text, k), "sizes")
    number = F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long")  # class_number()
    classes = docs.where("set_key is not null").groupBy("set_key").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("n_first").alias("n_first"))
    classes = common.written(classes.withColumn("rep", number), "classes")
    _, labels = links(df, key, text, classes, k, num, den)
    linked = labels.withColumnRenamed("node", "rep").join(classes.select("set_key", "rep", "id"), "rep")
    smallest = linked.groupBy("label").agg(F.min("id").alias("_smallest"))
    named = linked.join(smallest, "label").select("set_key", "_smallest")
    alone = classes.select("set_key", F.col("id").alias("_alone"))
    return docs.join(alone, "set_key", "left").join(named, "set_key", "left") \
        .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("_smallest", "_alone", "id").alias("component_id"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked groups of ``documents``: five-word n-grams, similarity 0.8."""
    return jaccard_join(common.documents(spark, sf_dir), "doc_id", "text")


def oracle(k: int = 5, num: int = 80, den: int = 100) -> str:
    """DuckDB twin of the query: overlaps counted from the pairs of classes that share an n-gram."""
    gram = " || ' ' || ".join(["ws[j]", *(f"ws[j + {d}]" for d in range(1, k))])
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
           ELSE list_distinct(list_transform(range(1, len(ws) - {k - 2}), lambda j: {gram})) END) AS grams FROM words),
classes AS (SELECT min(doc_id) AS rep, len(grams) AS n, grams FROM sets WHERE len(grams) > 0 GROUP BY grams),
postings AS (SELECT rep, n, unnest(grams) AS x FROM classes),
overlap AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM postings a JOIN postings b
            ON a.x = b.x AND a.rep < b.rep AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) GROUP BY 1, 2),
linked AS (SELECT a, b FROM overlap WHERE {den} * i >= {num} * (na + nb - i)),
edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reached AS (SELECT rep AS node, rep AS other FROM classes UNION SELECT reached.node, edges.b FROM reached JOIN edges ON reached.other = edges.a),
named AS (SELECT node, min(other) AS smallest FROM reached GROUP BY 1)
SELECT sets.doc_id, len(sets.grams) AS n_shingles, coalesce(smallest, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.grams = classes.grams LEFT JOIN named ON named.node = classes.rep"""
