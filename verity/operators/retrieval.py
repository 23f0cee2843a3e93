"""Retrieval over memories and prompt/answer text helpers
(SURVEY 2.D: D17-D27, H14).

``retrieve`` scores queries against the items of the memory they belong to
with tf-idf fitted on the items only (2+ character lower-case word runs,
smoothed idf, L2-normalised count vectors). A memory's items and queries meet in
blocks of packed vectors, and a block returns each query's best items: no pair is a row.
``candidates`` is the form over posting lists, which scores few items in full
but shuffles a partial sum a related pair. ``bounded_memory`` (D18) keeps
a memory's latest items where a caller wants that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.answers import py_strip
from ..session import bucketed, dealt, settings, spread, stored
from .context import SK_TERM_RE


def bounded_memory(items: DataFrame, key: str, order: str, max_size: int = 100) -> DataFrame:
    """Keep the last ``max_size`` items of each memory (FIFO)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_size).drop("_r")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mem, _id, ids) as one row per distinct id of a row, with how often it is there."""
    for b in batches:
        ids = b.column("ids")
        row = np.repeat(np.arange(len(b)), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        term = ids.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((term, row))
        row, term = row[order], term[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
        at = np.flatnonzero(new)
        of = pa.array(row[at])
        yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(term[at], pa.int64()),
                                          pa.array(np.diff(np.append(at, len(row))), pa.int64())], names=[*b.schema.names[:2], "term", "_c"])


def _term_counts(d: DataFrame, mem: str, key: str, text: str) -> DataFrame:
    """(mem, _id, term, _c): terms as 64-bit hashes, counted row by row (no
    shuffle). A key on several rows has its terms once a row; callers add them up."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(SK_TERM_RE), 0), lambda w: F.xxhash64(w))
    rows = spread(d.select(mem, key, text)).select(F.col(mem), F.col(key).alias("_id"), words.alias("ids"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_counted, f"`{mem}` {kind[mem]}, _id {kind['_id']}, term long, _c long")


def _added(counts: DataFrame, mem: str, key: str) -> DataFrame:
    return counts.groupBy(mem, key, "term").agg(F.sum("_c").alias("_c"))


def _index(items: DataFrame, mem: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """``index`` and the names of its catalog entries."""
    by = (mem, "term")
    # Dealt once, by term: adding up, the terms' frequencies and all joins on terms stay in their bucket.
    counts = dealt(_term_counts(items, mem, item_id, item_text).withColumnRenamed("_id", "_i"), *by)
    postings, first = bucketed(_added(counts, mem, "_i"), *by)
    n_items = stored(items.groupBy(mem).agg(F.count(F.lit(1)).alias("_n")))
    frequent = postings.groupBy(*by).agg(F.count(F.lit(1)).alias("_df")).join(n_items, mem) \
        .select(*by, "_df", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("_idf"))
    terms, second = bucketed(dealt(frequent, *by), *by)
    w = F.col("_c") * F.col("_idf")
    lengths = stored(postings.join(terms, [*by]).groupBy(mem, "_i").agg(F.sqrt(F.sum(w * w)).alias("_l")))
    return postings, terms, lengths, [first, second]


def index(items: DataFrame, mem: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (mem, term, _i, _c) and terms (mem, term, _df, _idf), both in buckets of
    (mem, term), and the lengths (mem, _i, _l) of the items' weighted vectors."""
    return _index(items, mem, item_id, item_text)[:3]


#: A query's head ends where the weights of the terms after it have a length
#: below this (first pass), or below this share of the score to beat (second).
FIRST_REST, REST_SHARE = 0.6, 0.5
#: Slack for sums of doubles taken in another order.
SLACK = 1e-9


def _query_vectors(queries: DataFrame, terms: DataFrame, mem: str, query_id: str, query_text: str) -> DataFrame:
    """(mem, _q, term, _idf, _qw, _q2): unit-length query vectors over the
    memory's terms; _q2 sums the squared weights from a term on to the commonest."""
    raw = _added(_term_counts(queries, mem, query_id, query_text), mem, "_id").join(terms, [mem, "term"]).withColumn("_x", F.col("_c") * F.col("_idf"))
    norm = raw.groupBy(mem, "_id").agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_l"))
    unit = raw.join(norm, [mem, "_id"]).select(mem, F.col("_id").alias("_q"), "term", "_idf", "_df", (F.col("_x") / F.col("_l")).alias("_qw"))
    on = Window.partitionBy(mem, "_q").orderBy("_df", "term").rowsBetween(0, Window.unboundedFollowing)  # one text's terms
    return stored(unit.withColumn("_q2", F.sum(F.col("_qw") * F.col("_qw")).over(on)).drop("_df"))


def _dots(met: DataFrame, lengths: DataFrame, mem: str) -> DataFrame:
    """(mem, _q, _i, _s, _i2): dot products over the terms met, and the squared item weights there."""
    w = F.col("_c") * F.col("_idf")
    return met.groupBy(mem, "_q", "_i").agg(F.sum(F.col("_qw") * w).alias("_s"), F.sum(w * w).alias("_i2")).join(lengths, [mem, "_i"]) \
        .select(mem, "_q", "_i", (F.col("_s") / F.col("_l")).alias("_s"), (F.col("_i2") / (F.col("_l") * F.col("_l"))).alias("_i2"))


def _scores(vectors: DataFrame, postings: DataFrame, lengths: DataFrame, mem: str, others: bool) -> DataFrame:
    """``_dots`` of all items in the posting lists of the terms given."""
    met = vectors.join(postings, [mem, "term"])
    return _dots(met.where("_q <> _i") if others else met, lengths, mem)


def _scores_of(pairs: DataFrame, vectors: DataFrame, postings: DataFrame, lengths: DataFrame, mem: str) -> DataFrame:
    """``_dots`` of given pairs, by the items' own weights: no posting list is
    joined whole. The wanted weights are stored first, so that Spark sees their
    size and shuffles the postings only if they are many."""
    wanted = stored(pairs.select(mem, "_q", "_i").join(vectors.select(mem, "_q", "term", "_idf", "_qw"), [mem, "_q"]))
    return _dots(wanted.join(postings, [mem, "term", "_i"]), lengths, mem)


def _top(rows: DataFrame, mem: str, score: str, n: int) -> DataFrame:
    w = Window.partitionBy(mem, "_q").orderBy(F.desc(score), F.desc("_i"))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)


def candidates(postings: DataFrame, lengths: DataFrame, vectors: DataFrame, mem: str, n: int, others: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items that can be among a query's ``n`` best, as (mem, _q, _i, _s, with
    _s the score over the query's head), and the queries' tails. Terms are taken
    from the rarest on. The exact scores of the ``2 n`` best by a first head give
    a score to beat; the second head goes on until its rest is under a share of
    that score, so an item outside every head list cannot reach it (by
    Cauchy-Schwarz, a rest adds at most the query's length there times the
    item's). Its own ``2 n`` best raise the score to beat, and items are kept
    whose head score and rest can reach that. A query without ``n`` such items
    has all of its terms in the head."""
    def beaten(partial: DataFrame) -> DataFrame:
        """(mem, _q, _beat): the n-th best exact score of the 2 n best by a partial one."""
        seeds = stored(_top(partial, mem, "_s", 2 * n).select(mem, "_q", "_i"))
        exact = _top(_scores_of(seeds, vectors, postings, lengths, mem), mem, "_s", n)
        return exact.where(F.col("_r") == n).select(mem, "_q", F.col("_s").alias("_beat"))

    rest = F.sqrt("_q2")
    first = beaten(_scores(vectors.where(rest >= FIRST_REST), postings, lengths, mem, others))
    split = stored(vectors.join(first, [mem, "_q"], "left").withColumn("_head", F.col("_beat").isNull() | (rest >= REST_SHARE * F.col("_beat"))))
    tails = split.where("not _head").drop("_beat")
    left = tails.groupBy(mem, "_q").agg(F.max("_q2").alias("_q2"))
    head = stored(_scores(split.where("_head"), postings, lengths, mem, others))
    beat = beaten(head).join(left, [mem, "_q"], "left")
    more = F.sqrt(F.col("_q2") * F.greatest(1 + F.lit(SLACK) - F.col("_i2"), F.lit(0.0)))
    kept = head.join(beat, [mem, "_q"], "left").where(F.col("_beat").isNull() | (F.col("_s") + F.coalesce(more, F.lit(0.0)) >= F.col("_beat") - SLACK))
    return stored(kept.select(mem, "_q", "_i", "_s")), tails


#: Items and queries of a block of ``retrieve``, and the commonest terms of a memory whose weights are a dense matrix.
ITEMS, QUERIES, HEAVY = 8192, 8192, 512
#: Bags of a packed row, and bags that share one copy of their memory's terms when they are packed.
CHUNK, GROUP = 2048, 1 << 16
#: Distinct terms a bag has on average in a full packed row (those of longer ones hold fewer), and bags that are taken at once.
LONG, STEP = 512, 256
#: Queries of one product, and cells of scores that one count of rarer terms fills.
TILE, CELLS = 256, 1 << 16
#: More than twice what a sum of ``HEAVY`` products of unit vectors' weights can lose in single precision.
NEAR = 2.5 * HEAVY * 2.0 ** -24
#: Bytes that one wave of blocks shuffles, if that is more than all vectors have.
WAVE = 2 << 30


def _stored(d: DataFrame) -> DataFrame:
    """``stored``, with few rows in a batch for Python: a row has all words of a text."""
    with settings(d.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="512"):
        return stored(d)


def _one_row(d: DataFrame, mem: str, key: str, text: str) -> DataFrame:
    """(mem, _k, _t): one row a key; a key on several rows has their texts in one."""
    d = d.where(F.col(mem).isNotNull()).select(mem, F.col(key).alias("_k"), F.col(text).alias("_t"))
    often = stored(d.groupBy(mem, F.col("_k").alias("_same")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").withColumnRenamed(mem, "_m"))
    if often.isEmpty():
        return d
    same = (F.col(mem) == F.col("_m")) & F.col("_k").eqNullSafe(F.col("_same"))
    joined = d.join(often, same, "left_semi").groupBy(mem, "_k").agg(F.array_join(F.collect_list("_t"), " ").alias("_t"))
    return d.join(often, same, "left_anti").unionAll(joined)


class Bags(NamedTuple):
    """Texts of memories: their rows (mem, _k), and one row (mem, _k, ids, c) a key
    with its distinct terms, as 64-bit hashes, and how often each is there."""

    rows: DataFrame
    terms: DataFrame


def bags(d: DataFrame, mem: str, key: str, text: str) -> Bags:
    """The bags of a table's texts, stored: each text is split into words once."""
    words = F.transform(F.regexp_extract_all(F.lower("_t"), F.lit(SK_TERM_RE), 0), lambda w: F.xxhash64(w))
    texts = spread(_one_row(d, mem, key, text)).select(mem, "_k", words.alias("ids")).where(F.size("ids") > 0)
    kind = {f.name: f.dataType.simpleString() for f in texts.schema}
    return Bags(d.select(mem, F.col(key).alias("_k")), _stored(texts.mapInArrow(_bags, f"`{mem}` {kind[mem]}, _k {kind['_k']}, ids array<bigint>, c array<int>")))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mem, _n, ids) as (mem, part, ids, c): in how many of some million words' rows
    a term is, in as many parts as the memory has blocks."""
    held: dict = {}
    n = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for m, (parts, each) in held.items():
            ids, c = np.unique(np.concatenate(each), return_counts=True)
            part = ids % parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order])) for x in (ids, c.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array([m] * parts, kind), pa.array(np.arange(parts)), *lists], names=names)

    for b in batches:
        kind, names = b.schema.field(0).type, [b.schema.names[0], "part", "ids", "c"]
        for m, parts, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            x = ids.values.to_numpy(zero_copy_only=False)
            held.setdefault(m, (parts, []))[1].append(x)
            n += len(x)
        if n > 2 << 20:
            yield from counted()
            held, n = {}, 0
    if held:
        yield from counted()


def _flat(c: pa.ChunkedArray) -> np.ndarray:
    return c.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _lengths(c: pa.ChunkedArray) -> np.ndarray:
    return c.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _summed(t: pa.Table) -> pa.Table:
    """Rows (mem, part, ids, c) of one part as one row."""
    ids, at = np.unique(_flat(t["ids"]), return_inverse=True)
    c = np.bincount(at, _flat(t["c"]), len(ids)).astype(np.int32)
    return pa.Table.from_arrays([t.column(0).slice(0, 1), t["part"].slice(0, 1), pa.array([ids], pa.list_(pa.int64())), pa.array([c], pa.list_(pa.int32()))],
                                names=t.schema.names)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mem, _k, ids) with their distinct ids and how often each is there."""
    for b in batches:
        each = [np.unique(x.values.to_numpy(zero_copy_only=False), return_counts=True) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([x for x, _ in each], pa.list_(pa.int64())),
                                          pa.array([c.astype(np.int32) for _, c in each], pa.list_(pa.int32()))], names=[*b.schema.names[:2], "ids", "c"])


def _planes(x: np.ndarray) -> bytes:
    """Integers with their highest bytes first, then the next ones: shuffles and files compress that well."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T[::-1].tobytes()


def _unplaned(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1)[::-1].T.copy().view("<i4").ravel()


class _Terms:
    """A memory's terms: their ranks in falling frequency, and the idf of each run of ranks."""

    def __init__(self, voc: pa.Table):
        ids, df = _flat(voc["ids"]), _flat(voc["c"])
        order = np.argsort(ids, kind="stable")
        self.ids, df = ids[order], -df[order]
        order = np.argsort(df, kind="stable")
        self.rank = np.empty(len(ids), np.int32)
        self.rank[order] = np.arange(len(ids), dtype=np.int32)
        often, first = np.unique(df[order], return_index=True)
        self.ends = np.append(first[1:], len(ids)).astype(np.int32)
        self.idfs = np.log((1 + voc["_rows"][0].as_py()) / (1.0 - often)) + 1

    def pack(self, docs: pa.Table) -> tuple | None:
        """Bags as their distinct unit vectors: keys (the latest first), numbers of
        terms, lengths, ranks and counts. Nothing if no bag has a known term."""
        docs = docs.sort_by([("_k", "descending")])
        ids, c = _flat(docs["ids"]), _flat(docs["c"])
        row = np.repeat(np.arange(len(docs), dtype=np.int32), _lengths(docs["ids"]))
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        known = self.ids[at] == ids
        row, r, c = row[known], self.rank[at[known]], c[known]
        order = np.argsort(row * np.int64(len(self.ids)) + r, kind="stable")
        row, r, c = row[order], r[order], c[order]
        x = c * self.idfs[np.searchsorted(self.ends, r, side="right")]
        length = np.sqrt(np.bincount(row, x * x, len(docs)))
        n = np.bincount(row, minlength=len(docs))
        start = np.concatenate([[0], np.cumsum(n)])
        same: dict[bytes, list[int]] = {}
        for d in np.flatnonzero(n).tolist():
            cut = slice(start[d], start[d + 1])
            same.setdefault(r[cut].tobytes() + c[cut].tobytes(), []).append(d)
        if not same:
            return None
        first = np.array([g[0] for g in same.values()])
        cells = _spans(start[first], n[first])
        keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(g) for g in same.values()])]), pa.int32()),
                                        docs["_k"].combine_chunks().take(pa.array([d for g in same.values() for d in g])))
        return keys, n[first].astype(np.int32), length[first], _planes(r[cells]), _planes(c[cells])


def _packer(mem: str, schema: pa.Schema, size: int):
    """A function of batches of rows in groups (mem, a), in each the memory's terms
    (with _rows) before bags: packed rows, up to ``CHUNK`` bags in one and up to
    ``size`` of a group in a block."""
    chunk = min(CHUNK, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, terms, voc, held, rows, cells, no = None, None, [], [], 0, 0, 0

        def packed() -> Iterator[pa.RecordBatch]:
            found = terms.pack(pa.Table.from_batches(held)) if held and terms else None
            if found:
                keys, lens, length, ranks, counts = found
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[0]], schema.field(0).type), pa.array([(group[1] << 32) + no // (size // chunk)]), one(keys), one(pa.array(lens)), one(pa.array(length)),
                     pa.array([ranks]), pa.array([counts]), one(pa.array(terms.ends)), one(pa.array(terms.idfs))], schema=schema)

        for b in batches:
            for key, at in groupby(range(len(b)), list(zip(b[mem].to_pylist(), b["a"].to_pylist())).__getitem__):
                at = list(at)
                part = b.slice(at[0], len(at))
                if key != group:
                    yield from packed()
                    group, terms, voc, held, rows, cells, no = key, None, [], [], 0, 0, 0
                n = len(part) - part["_rows"].null_count
                if n:
                    voc.append(part.slice(0, n))
                if n < len(part) and voc:
                    terms, voc = _Terms(pa.Table.from_batches(voc)), []
                for first in range(n, len(part), min(STEP, chunk)):
                    held.append(part.slice(first, min(STEP, chunk)))
                    rows, cells = rows + len(held[-1]), cells + len(held[-1]["ids"].flatten())
                    if rows >= chunk or cells >= chunk * LONG:
                        yield from packed()
                        held, rows, cells, no = [], 0, 0, no + 1
                        pa.default_memory_pool().release_unused()
        yield from packed()

    return run


def _vectors(d: DataFrame, vocabulary: DataFrame, sizes: DataFrame, mem: str, size: int) -> DataFrame:
    """The bags of memories as packed rows of unit vectors. A task takes the terms of a
    memory and then some of its bags, one packed row at a time."""
    groups = F.ceil(F.count(F.lit(1)) / GROUP)
    deals = stored(d.groupBy(mem).agg(groups.alias("_n")).join(sizes, mem))
    texts = d.join(deals, mem).select(mem, F.pmod(F.xxhash64("_k"), F.col("_n")).alias("a"), "_k", "ids", "c", F.lit(None).cast("long").alias("_rows"))
    key = texts.schema["_k"].dataType
    voc = vocabulary.join(deals, mem).select(mem, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("a"), F.lit(None).cast(key).alias("_k"), "ids", "c", "_rows")
    out = T.StructType([texts.schema[mem], T.StructField("a", T.LongType()), T.StructField("keys", T.ArrayType(T.ArrayType(key))),
                        T.StructField("lens", T.ArrayType(T.IntegerType())), T.StructField("l", T.ArrayType(T.DoubleType())),
                        T.StructField("ranks", T.BinaryType()), T.StructField("counts", T.BinaryType()),
                        T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("idfs", T.ArrayType(T.DoubleType()))])
    dealt = texts.unionByName(voc).repartition(mem, "a").sortWithinPartitions(mem, "a", F.col("_rows").isNull())
    return _stored(dealt.mapInArrow(_packer(mem, to_arrow_schema(out), size), out))


class _Block:
    """A block's vectors: cells by vector and rank, unit weights, and the vectors' keys (``most`` of each, if given)."""

    def __init__(self, t: pa.Table, most: int | None = None):
        ends, idfs = (t[c][0].values.to_numpy(zero_copy_only=False) for c in ("ends", "idfs"))
        self.terms = int(ends[-1])
        n = _flat(t["lens"]).astype(np.int64)
        self.size, self.start = len(n), np.concatenate([[0], np.cumsum(n)])
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.rank = np.concatenate([_unplaned(b.as_py()) for b in t["ranks"]])
        count = np.concatenate([_unplaned(b.as_py()) for b in t["counts"]])
        self.w = count * np.repeat(idfs, np.diff(ends, prepend=0))[self.rank] / _flat(t["l"])[self.row]
        lists = t["keys"].combine_chunks().flatten()
        self.n_keys = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first, self.keys = np.cumsum(self.n_keys) - self.n_keys, lists.flatten()
        if most:
            self.n_keys = np.minimum(self.n_keys, most)
            self.keys = self.keys.take(pa.array(_spans(first, self.n_keys)))
        self.first_key = np.cumsum(self.n_keys) - self.n_keys

    def part(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.row[cells], self.rank[cells], self.w[cells]


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 ... (n[0] of them), first[1] ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _leading(of: np.ndarray, score: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    """Where the ``n`` best of each ``of`` are, by score and then position."""
    order = np.lexsort((-pos, -score, of))
    o = of[order]
    new = np.ones(len(o), bool)
    new[1:] = o[1:] != o[:-1]
    at = np.flatnonzero(new)
    return order[np.arange(len(o)) - np.repeat(at, np.diff(np.append(at, len(o)))) < n]


def _best_of_block(n: int, others: bool, mem: str, schema: pa.Schema):
    """A function of one block's packed rows of items (side 0) and queries (side 1):
    each query's ``n`` best items. A product over the commonest terms and a count
    over the postings of the others bring every pair's score in single precision;
    those near the best are summed in full."""
    m = n + others  # one of a query's best can be itself

    def run(t: pa.Table) -> pa.Table:
        side = t["side"]
        items, asked = t.filter(pc.equal(side, 0)), t.filter(pc.equal(side, 1))
        if not len(items) or not len(asked):
            return schema.empty_table()
        name = t[mem].slice(0, 1)
        it, qs = _Block(items, m), _Block(asked)
        del t, items, asked
        heavy, size, width = min(HEAVY, it.terms), it.size, it.terms + 1
        dense = np.zeros((heavy, size), np.float32)
        row, rank, w = it.part(it.rank < heavy)
        dense[rank, row] = w
        row, rank, w = it.part(it.rank >= heavy)
        order = np.argsort(rank, kind="stable")
        post_row, post_w = row[order], w[order].astype(np.float32)
        post = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=width))])
        rare = np.flatnonzero((qs.rank >= heavy) & (post[qs.rank + 1] > post[qs.rank]))
        rare_row, rare_rank, rare_w = qs.part(rare)
        rare_start = np.searchsorted(rare_row, np.arange(qs.size + 1))
        rare_first, rare_n = post[rare_rank], post[rare_rank + 1] - post[rare_rank]
        del row, rank, w, order
        key_pos = np.empty(len(it.keys), np.int64)
        key_pos[pc.array_sort_indices(it.keys, null_placement="at_start").to_numpy()] = np.arange(len(it.keys))
        own = pc.fill_null(pc.index_in(qs.keys.cast(it.keys.type), value_set=it.keys), -1).to_numpy(zero_copy_only=False)
        full = np.zeros(width)
        classes = min(64, size)
        at_once = max(1, CELLS // size)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, qs.size, TILE):
            b = min(a + TILE, qs.size)
            row, rank, w = qs.part(slice(qs.start[a], qs.start[b]))
            common = rank < heavy
            q = np.zeros((b - a, heavy), np.float32)
            q[row[common] - a, rank[common]] = w[common]
            scores = q @ dense
            for c in range(a, b, at_once):
                e = min(c + at_once, b)
                cut = slice(rare_start[c], rare_start[e])
                count = rare_n[cut]
                cells = _spans(rare_first[cut], count)
                if len(cells):
                    to = np.repeat((rare_row[cut] - c) * size, count) + post_row[cells]
                    scores[c - a:e - a] += np.bincount(to, np.repeat(rare_w[cut], count) * post_w[cells], (e - c) * size).reshape(e - c, size)
            if m <= classes:
                high = scores[:, :size // classes * classes].reshape(b - a, -1, classes).max(axis=1)
                least = np.partition(high, classes - m, axis=1)[:, classes - m] - NEAR
            else:
                least = np.zeros(b - a, np.float32)
            of, near = np.nonzero((scores >= least[:, None]) & (scores > 0))
            cuts = np.searchsorted(of, np.arange(b - a + 1))
            exact = np.empty(len(of))
            for k in range(b - a):
                js = near[cuts[k]:cuts[k + 1]]
                if not len(js):
                    continue
                mine = slice(qs.start[a + k], qs.start[a + k + 1])
                full[qs.rank[mine]] = qs.w[mine]
                count = it.start[js + 1] - it.start[js]
                cells = _spans(it.start[js], count)
                exact[cuts[k]:cuts[k + 1]] = np.bincount(np.repeat(np.arange(len(js)), count), full[it.rank[cells]] * it.w[cells], len(js))
                full[qs.rank[mine]] = 0
            # The n latest keys of the m best vectors hold the n best items.
            best = _leading(of, np.round(exact, 12), key_pos[it.first_key[near]], m)
            of, near, exact = of[best] + a, near[best], exact[best]
            count = it.n_keys[near] * qs.n_keys[of]
            each = np.repeat(np.arange(len(of)), count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, q_key = it.first_key[near[each]] + step % it.n_keys[near[each]], qs.first_key[of[each]] + step // it.n_keys[near[each]]
            if others:
                other = own[q_key] != i
                each, i, q_key = each[other], i[other], q_key[other]
            best = _leading(q_key, np.round(exact[each], 12), key_pos[i], n)
            found.append((q_key[best], i[best], exact[each[best]]))
        pa.default_memory_pool().release_unused()
        q, i, s = (np.concatenate(x) for x in zip(*found))
        return pa.table([name.combine_chunks().take(pa.array(np.zeros(len(q), np.int64))), qs.keys.take(pa.array(q)), it.keys.take(pa.array(i)), pa.array(s)], schema=schema)

    return run


def _best_in_blocks(items: Bags, queries: Bags | None, mem: str, n: int, others: bool) -> list[DataFrame]:
    """Tables (mem, _q, _i, score) of some queries each: every query's ``n`` best items
    (without ``queries``, every item is one).
    Blocks meet in waves of bounded shuffles; a wave has all items and some blocks of queries."""
    spark = items.rows.sparkSession
    sizes = stored(items.rows.groupBy(mem).agg(F.count(F.lit(1)).alias("_rows"), F.least(F.ceil(F.count(F.lit(1)) / ITEMS), F.lit(64)).alias("_parts")))
    seen = items.terms.join(sizes, mem).select(mem, "_parts", "ids")
    counts = f"`{mem}` {seen.schema[mem].dataType.simpleString()}, part long, ids array<bigint>, c array<int>"
    vocabulary = _stored(seen.mapInArrow(_seen, counts).groupBy(mem, "part").applyInArrow(_summed, counts))
    sides = [_vectors(items.terms, vocabulary, sizes, mem, ITEMS)]
    sides.append(sides[0] if queries is None else _vectors(queries.terms, vocabulary, sizes, mem, QUERIES))
    packed = F.sum(F.octet_length("ranks") + F.octet_length("counts"))
    blocks = [stored(d.groupBy(mem, F.col("a").alias(name)).agg(packed.alias(f"_{name}"))) for d, name in zip(sides, "ab")]
    met = blocks[0].join(blocks[1], mem).agg(F.sum(F.col("_a") + F.col("_b")), F.count(F.lit(1))).first()
    whole = sum(d.agg(F.sum(f"_{name}")).first()[0] or 0 for d, name in zip(blocks, "ab"))
    # Half of the planes are mostly zeros.
    waves = max(1, -(-(met[0] or 0) // 2 // max(WAVE, whole // 2)))
    tasks = max(spark.sparkContext.defaultParallelism, min(4096, 2 * met[1] // waves))
    rows = sides[0].join(blocks[1].select(mem, "b"), mem).withColumn("side", F.lit(0)) \
        .unionByName(sides[1].withColumnRenamed("a", "b").join(blocks[0].select(mem, "a"), mem).withColumn("side", F.lit(1)))
    key = lambda d: d.schema["keys"].dataType.elementType.elementType
    out = T.StructType([sides[0].schema[mem], T.StructField("_q", key(sides[1])), T.StructField("_i", key(sides[0])), T.StructField("_s", T.DoubleType())])
    run = _best_of_block(n, others, mem, to_arrow_schema(out))
    # Rank on the score rounded to 12 digits: identical items (exact copies)
    # tie exactly, whatever order their float sums were added in.
    return [stored(_top(rows.where(F.pmod(F.xxhash64(mem, "b"), F.lit(waves)) == wave).repartition(tasks, mem, "a", "b").groupBy(mem, "a", "b").applyInArrow(run, out)
                        .withColumn("_round", F.round("_s", 12)), mem, "_round", n).select(mem, "_q", "_i", F.col("_s").alias("score")))
            for wave in range(waves)]


def retrieve(items: DataFrame | Bags, queries: DataFrame | Bags | None, mem: str, item_id: str, item_text: str,
             query_id: str, query_text: str, n: int = 10, others: bool = False) -> DataFrame:
    """Top ``n`` items per query by cosine similarity (ties: later item
    first). Query terms unknown to the memory are ignored. Items that share no
    term score 0 and can fill a list only from the memory's ``n`` latest. With
    ``others`` an item whose id is the query's own is not found. Without
    ``queries`` every item is one. Exact: every item of the memory is scored,
    block by block, and those near the best in full."""
    items = items if isinstance(items, Bags) else bags(items, mem, item_id, item_text)
    queries = queries if queries is None or isinstance(queries, Bags) else bags(queries, mem, query_id, query_text)
    best = reduce(DataFrame.unionAll, _best_in_blocks(items, queries, mem, n, others))
    asked = items if queries is None else queries
    short = asked.rows.withColumnRenamed("_k", "_q").join(
        best.groupBy(mem, "_q").agg(F.count(F.lit(1)).alias("_found")), [mem, "_q"], "left").where(F.coalesce("_found", F.lit(0)) < n)
    latest = items.rows.withColumnRenamed("_k", "_i") \
        .withColumn("_r", F.row_number().over(Window.partitionBy(mem).orderBy(F.col("_i").desc()))).where(F.col("_r") <= 2 * n + 1).drop("_r")
    unrelated = short.select(mem, "_q").join(latest, mem).join(best, [mem, "_q", "_i"], "left_anti").withColumn("score", F.lit(0.0))
    if others:
        unrelated = unrelated.where("_q <> _i")
    w = Window.partitionBy(mem, "_q").orderBy(F.round("score", 12).desc(), F.col("_i").desc())
    top = best.unionByName(unrelated).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.select(F.col("_q").alias(query_id), "rank", F.col("_i").alias(item_id), F.round("score", 9).alias("score"))


QUERY_DEFAULT = "What is the main point of this text?"


def split_query(text: Column) -> Column:
    """struct(query, context): text after the last 'Query:' (context =
    text before it); else the last sentence (context = the others joined by
    spaces); a single sentence keeps the text as context with a default
    question."""
    has_q = F.locate("Query:", text) > 0
    after = F.substring_index(text, "Query:", -1)
    before = F.substring(text, F.lit(1), F.length(text) - F.length(after) - 6)
    s = F.split(F.regexp_replace(py_strip(text), r"([.!?])\s+", "$1\u0001"), "\u0001")
    many = F.size(s) > 1
    q = F.when(has_q, py_strip(after)).when(many, F.try_element_at(s, F.lit(-1))).otherwise(F.lit(QUERY_DEFAULT))
    ctx = F.when(has_q, py_strip(before)).when(many, F.array_join(F.slice(s, F.lit(1), F.size(s) - 1), " ")).otherwise(text)
    return F.struct(q.alias("query"), ctx.alias("context"))


def question_from_grader_prompt(text: Column) -> Column:
    """The '- Question:' field of an evaluation prompt, else the text
    after 'User:' up to a blank line, else ''."""
    a = F.regexp_extract(text, r"(?s)-\s*Question:\s*(.*?)\n\s*-\s*Predicted Answer:", 1)
    has_a = text.rlike(r"(?s)-\s*Question:\s*(.*?)\n\s*-\s*Predicted Answer:")
    b = F.regexp_extract(text, r"(?s)User:\s*(.*?)\n\n", 1)
    has_b = text.rlike(r"(?s)User:\s*(.*?)\n\n")
    return F.when(has_a, py_strip(a)).when(has_b, py_strip(b)).otherwise(F.lit(""))


def margin_notes(notes: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Keep 'YES#...' notes (text after the first '#'), drop the rest,
    and join the kept ones per question in order, newline-separated."""
    kept = notes.where(F.col(text).startswith("YES#")).select(
        key, order, F.col(text).substr(F.locate("#", F.col(text)) + 1, F.lit(2147483647)).alias("margin"))
    g = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "margin"))).alias("_l"))
    return g.select(key, F.size("_l").alias("n_notes"), F.array_join(F.transform("_l", lambda x: x["margin"]), "\n")
                    .alias("combined_notes"))


def drop_irrelevant(df: DataFrame, text: str, tags: list[str]) -> DataFrame:
    """Remove chunks containing any tag (case-insensitive)."""
    cond = None
    for t in tags:
        c = F.upper(F.col(text)).contains(t.upper())
        cond = c if cond is None else (cond | c)
    return df.where(~cond)


def neighbour_summaries(df: DataFrame, key: str, pos: str, text: str, k: int = 5) -> DataFrame:
    """For summary i of n, the summaries i-k .. i+k-1 that are not the
    last one, joined by a blank line (the reference's slice end excludes
    the final summary)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    d = df.withColumn("_n", n).withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1)
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(-k, k - 1)
    vals = F.collect_list(F.when(F.col("_rn") < F.col("_n") - 1, F.col(text))).over(w)
    return d.select(key, pos, F.array_join(vals, "\n\n").alias("neighbours"))


def sub_questions(text: Column) -> Column:
    """Lines inside the first <SUB-QUESTIONS> block, non-empty, with a
    leading 'n.' removed."""
    block = py_strip(F.regexp_extract(text, r"(?s)<SUB-QUESTIONS>\s*(.*?)\s*</SUB-QUESTIONS>", 1))
    lines = F.filter(F.split(block, r"\r\n|\r|\n"), lambda s: F.length(s) > 0)
    return F.transform(lines, lambda s: F.regexp_replace(s, r"^\d+\.", ""))


def numbered_queries(text: Column, most: int = 5) -> Column:
    """The first ``most`` lines 'n. query' or 'n. [query]', without number and brackets."""
    lines = F.filter(F.transform(F.split(text, "\n"), py_strip), lambda s: s.rlike(r"^[0-9]+\."))
    queries = F.transform(lines, lambda s: py_strip(F.regexp_replace(s, r"^[0-9]+\.\s*\[?(.*?)\]?$", "$1")))
    return F.slice(F.filter(queries, lambda q: F.length(q) > 0), 1, most)


def focused_queries(aspects: Column, query: Column, most: int = 3) -> Column:
    """The query with each of the first ``most`` missing aspects."""
    return F.transform(F.slice(aspects, 1, most), lambda a: F.concat(query, F.lit(" "), a))


def collapse_all(results: DataFrame, key: str, pos: str, text: str, budget: int) -> DataFrame:
    """While the formatted chunks of a question are above the budget and
    more than one, the pair at a rotating index is merged (joined by a blank
    line). A question's chunks are those of one document, so its rounds run as
    a fold inside its row: (key, n_steps, n_chunks, num_tokens)."""
    g = results.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, F.length(text).alias("n")))).alias("_l"))
    # Only lengths matter: a header is 23 characters and the digits of the chunk's number.
    header = lambda i: 23 + F.length(i.cast("string"))
    size = lambda c: F.aggregate(F.transform(c, lambda n, i: n + header(i) + 1), F.lit(0), lambda s, x: s + x)
    tokens = lambda c: F.floor(size(c) / 4)
    start = F.struct(F.transform("_l", lambda x: x["n"]).alias("c"), F.lit(0).alias("at"), F.lit(0).alias("steps"))

    def step(acc, _):
        n, at = F.size(acc["c"]), acc["at"]
        merged = F.concat(F.slice(acc["c"], F.lit(1), at), F.array(acc["c"][at] + acc["c"][at + 1] + 2),
                          F.slice(acc["c"], at + 3, F.greatest(n - at - 2, F.lit(0))))
        more = (n > 1) & (tokens(acc["c"]) > budget)
        return F.struct(F.when(more, merged).otherwise(acc["c"]).alias("c"),
                        F.when(more, (at + 1) % F.greatest(n - 2, F.lit(1))).otherwise(at).alias("at"),
                        F.when(more, acc["steps"] + 1).otherwise(acc["steps"]).alias("steps"))

    done = g.select(key, F.aggregate("_l", start, lambda a, x: step(a, x)).alias("_r"))
    return done.select(key, F.col("_r.steps").alias("n_steps"), F.size("_r.c").alias("n_chunks"), tokens(F.col("_r.c")).alias("num_tokens"))


def chunk_info_block(i: Column, text: Column) -> Column:
    """'Information of Chunk i:\\n<text>\\n' (0-based i)."""
    return F.concat(F.lit("Information of Chunk "), i.cast("string"), F.lit(":\n"), text, F.lit("\n"))


def map_prompts(chunks: DataFrame, key: str, pos: str, chunk: str, question: Column, template: str) -> DataFrame:
    """D24 map stage: one prompt row per chunk (``template`` with
    {question} and {context}); completions come back keyed by (key, pos)."""
    parts = template.split("{context}")
    q_parts = [p.split("{question}") for p in parts]

    def render(frag_list):
        out = []
        for j, f in enumerate(frag_list):
            if j:
                out.append(question)
            out.append(F.lit(f))
        return out

    pieces = render(q_parts[0]) + [F.col(chunk)] + (render(q_parts[1]) if len(q_parts) > 1 else [])
    return chunks.select(key, pos, F.concat(*pieces).alias("prompt"))


def reduce_input(results: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """D24 reduce stage input: the kept map results of a question, renumbered
    0.. in order, as 'Information of Chunk i' blocks."""
    g = results.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, text))).alias("_l"))
    blocks = F.transform("_l", lambda x, i: chunk_info_block(i, x[text]))
    return g.select(key, F.size("_l").alias("n_chunks"), F.array_join(blocks, "").alias("context"))


def collapse_plan(reduce_in: DataFrame, key: str, budget: int) -> DataFrame:
    """Tokens of the formatted chunk list (characters // 4) against the
    budget (window - reduce prompt - output); collapse is needed above it."""
    tok = F.floor(F.length("context") / 4).cast("bigint")
    return reduce_in.select(key, "n_chunks", tok.alias("num_tokens"), F.lit(budget).cast("bigint").alias("token_budget"),
                            ((tok > budget) & (F.col("n_chunks") > 1)).alias("needs_collapse"))


def collapse_round(results: DataFrame, key: str, pos: str, text: str, merge_idx: Column) -> DataFrame:
    """One collapse pass: chunks ``merge_idx`` and ``merge_idx + 1`` are
    merged (joined by a blank line), all others pass through; positions
    are renumbered. Grouping key = position with the pair folded together."""
    r = results.withColumn("_m", merge_idx)
    grp = F.when(F.col(pos) <= F.col("_m"), F.col(pos)).when(F.col(pos) == F.col("_m") + 1, F.col("_m")) \
        .otherwise(F.col(pos) - 1)
    g = r.groupBy(key, grp.alias("new_pos")).agg(F.sort_array(F.collect_list(F.struct(pos, text))).alias("_l"))
    return g.select(key, "new_pos", F.array_join(F.transform("_l", lambda x: x[text]), "\n\n").alias(text))


def after_answer_tag(text: Column, tags: list[str]) -> Column:
    """Text after the last occurrence of the first tag present."""
    out = text
    for t in reversed(tags):
        out = F.when(text.contains(t), py_strip(F.substring_index(text, t, -1))).otherwise(out)
    return out
