"""SimHash fingerprints and the search for all within a Hamming radius.

A text's terms are its pairs of neighbouring words, each weighted by how often
it occurs; every bit of a term's 128-bit hash votes for or against that bit of
the fingerprint. Votes are summed by Spark in packed lanes: a long holds four
16-bit counters, and a group holds at most ``CHUNK`` terms, so no lane overflows
however long the text is; the lanes are then unpacked and added.

The search keeps one row per distinct fingerprint. Fingerprints within
``RADIUS`` bits agree on at least ``BLOCKS - RADIUS`` of the ``BLOCKS`` blocks,
so each goes into one permuted table per choice of that many blocks, keyed by
them, and whatever lies within the radius of a query meets it in some table. A
find counts in the first table shared only; candidates that are too far apart
fail in the join, and finds are counted there, not written.

Only DataFrame functions. Edge cases: a null text is the empty text; a text
without words has the fingerprint 0; one word is a term of its own; repeated
rows follow one another; null ids come after all others, in an order of their
text's hash; the row after the last is the first (a single row follows itself);
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS, RADIUS, BLOCKS = 128, 6, 8
#: Terms whose votes share a group of lanes, and the lanes' mask.
CHUNK, LANES = 4096, 0x0001000100010001
#: Most rows of a bucket of neighbouring ids, unless a shift would have more than MAX_BUCKETS; buckets of rows without id.
BUCKET_ROWS, MAX_BUCKETS, NULL_BUCKETS = 4096, 1 << 18, 1024
#: A range of ids that has too many rows is cut into STEP.
FANOUT_BITS = 4
STEP = 1 << FANOUT_BITS
#: The search asks for the rows whose id is divisible by this.
ASKED = 20


def _terms(df: DataFrame, text: str, out: str) -> DataFrame:
    bare = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    df = df.withColumn("_h", F.transform(F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, common.SPACE, -1)),
                                         lambda w: F.xxhash64(w)))
    n = F.size("_h") - 1
    return df.withColumn(out, F.when(n < 1, F.col("_h")).otherwise(
        F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(2), n), lambda a, b: F.xxhash64(a, b)))).drop("_h")


def fingerprints(df: DataFrame, keys: list[str], text: str, carry: list[str]) -> DataFrame:
    """(keys, carry, lo, hi): the two halves of each text's fingerprint. ``keys``
    and ``carry`` are longs; the keys name a row, the others ride along."""
    terms = _terms(df.select(*keys, *carry, F.col(text).alias("_text")), "_text", "_terms")
    votes = terms.select(*keys, *carry, F.posexplode_outer("_terms").alias("_pos", "_lo")) \
        .withColumn("_hi", F.when(F.col("_lo").isNotNull(), F.xxhash64("_lo", F.lit(1))))
    ride = [F.max(c).alias(c) for c in carry]
    lanes = [(half, k) for half in ("_lo", "_hi") for k in range(16)]
    packed = votes.groupBy(*keys, F.floor(F.col("_pos") / CHUNK).alias("_chunk")).agg(
        F.count("_lo").alias("_n"),
        *[F.sum(F.shiftright(F.col(half), k).bitwiseAND(F.lit(LANES))).alias(f"{half}{k}") for half, k in lanes], *ride)
    ones = packed.groupBy(*keys).agg(
        F.sum("_n").alias("_n"),
        *[F.sum(F.shiftright(F.col(f"{half}{k}"), 16 * lane).bitwiseAND(F.lit(0xFFFF))).alias(f"{half}_{16 * lane + k}")
          for half, k in lanes for lane in range(4)], *ride)

    def word(half: str) -> Column:
        out = F.lit(0).cast("long")
        for bit in range(64):
            out = out.bitwiseOR(F.when(2 * F.col(f"{half}_{bit}") > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), bit))
                                .otherwise(F.lit(0).cast("long")))
        return out

    return ones.select(*keys, *carry, word("_lo").alias("lo"), word("_hi").alias("hi"))


def differing_bits(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    return F.bit_count(lo.bitwiseXOR(other_lo)) + F.bit_count(hi.bitwiseXOR(other_hi))


def near_counts(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(lo, hi, n_near) of each of the ``queries``, distinct (lo, hi) among
    ``prints``: how many rows of ``prints``, distinct (lo, hi, _copies), lie within
    the radius, its own other copies among them. Pairs are counted where they
    meet: what is written is at most one partial count per query and task."""
    size = BITS // BLOCKS
    block = lambda b, lo="lo", hi="hi": F.shiftright(F.col(lo if b < BLOCKS // 2 else hi), size * (b % (BLOCKS // 2))).bitwiseAND(
        F.lit((1 << size) - 1))
    choices = list(combinations(range(BLOCKS), max(1, BLOCKS - radius)))
    keys = F.array(*[F.xxhash64(F.lit(i), *[block(b) for b in c]) for i, c in enumerate(choices)])
    other = prints.select(F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), "_copies", F.posexplode(keys).alias("_t", "_k"))
    asked = queries.select("lo", "hi", F.posexplode(keys).alias("_table", "_key"))
    near = (F.col("_key") == F.col("_k")) & (F.col("_table") == F.col("_t")) \
        & (differing_bits(F.col("lo"), F.col("hi"), F.col("other_lo"), F.col("other_hi")) <= radius)
    same = F.array(*[block(b) == block(b, "other_lo", "other_hi") for b in range(BLOCKS)])
    first = F.coalesce(*[F.when(_all(same, c), F.lit(i)) for i, c in enumerate(choices)])
    return asked.join(other, near).where(F.col("_table") == first) \
        .groupBy("lo", "hi").agg((F.sum("_copies") - 1).alias("n_near"))


def _all(flags: Column, places: tuple[int, ...]) -> Column:
    out = flags[places[0]]
    for p in places[1:]:
        out = out & flags[p]
    return out


def id_ranges(df: DataFrame, key: str) -> DataFrame:
    """(shift, prefix, parts, first): the ranges of ids that become buckets, a
    range being the ids whose value without its last ``shift`` bits is ``prefix``,
    and the number of its first bucket. They follow the counts: from the whole
    table down, a range of too many rows is cut into 16. An id that has too many
    rows itself has several ``parts``. At most 16 ranges come from a range that was
    cut, so one shift has at most ``MAX_BUCKETS`` of them."""
    ids = df.select(F.col(key).cast("long").alias("_id")).where("_id is not null").groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    stats = ids.agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.sum("n").alias("n")).first()
    rows = stats.n or 0
    most = max(BUCKET_ROWS, STEP * rows // MAX_BUCKETS)
    shifts = [s for s in range(0, 64, FANOUT_BITS) if s == 0 or (stats.lo or 0) >> s != (stats.hi or 0) >> s]
    level = F.explode(F.array(*[F.struct(F.lit(s).alias("shift"), F.shiftright("_id", s).alias("prefix")) for s in shifts]))
    nodes = ids.select("n", level.alias("_x")).groupBy("_x.shift", "_x.prefix").agg(F.sum("n").alias("n"))
    nodes = common.written(nodes, "ranges")
    above = nodes.select((F.col("shift") - FANOUT_BITS).alias("shift"), F.col("prefix").alias("_up"), F.col("n").alias("_above"))
    cut = nodes.withColumn("_up", F.shiftright("prefix", FANOUT_BITS)).join(above, ["shift", "_up"], "left")
    cut = cut.where((F.coalesce("_above", F.lit(rows)) > most) & ((F.col("n") <= most) | (F.col("shift") == 0)))
    if rows <= most:  # nothing to cut: the top ranges keep their rows
        cut = cut.unionAll(nodes.where(F.col("shift") == max(shifts)).withColumn("_up", F.lit(None).cast("long")).withColumn("_above", F.lit(None).cast("long"))
                           .select(*cut.columns))
    parts = F.greatest(F.ceil(F.col("n") / most), F.lit(1)).cast("long")
    before = Window.orderBy(F.expr("shiftleft(prefix, shift)")).rowsBetween(Window.unboundedPreceding, -1)
    return common.written(cut.select("shift", "prefix", parts.alias("parts"))
                          .withColumn("first", F.coalesce(F.sum("parts").over(before), F.lit(0))), "buckets")


def id_buckets(df: DataFrame, key: str, text: str) -> DataFrame:
    """Add ``_bucket``: ranges of ids (``id_ranges``), ascending; the rows of an id
    with several parts are dealt by their text's hash; negative without an id."""
    ranges = id_ranges(df, key)
    shifts = sorted(r.shift for r in ranges.select("shift").distinct().collect())  # at most 16
    out, found = df, []
    for s in shifts:
        own = ranges.where(F.col("shift") == s).select(F.col("prefix").alias(f"_p{s}"), F.col("parts").alias(f"_n{s}"), F.col("first").alias(f"_f{s}"))
        out = out.join(F.broadcast(own), F.shiftright(F.col(key).cast("long"), s) == F.col(f"_p{s}"), "left")
        found.append(F.col(f"_f{s}") + F.pmod(F.xxhash64(text), F.col(f"_n{s}")))
    no_id = F.lit(-1) - F.pmod(F.xxhash64(text), F.lit(NULL_BUCKETS))
    return out.select(*df.columns, F.coalesce(*found, no_id).cast("long").alias("_bucket"))


def _next_bucket(buckets: DataFrame) -> DataFrame:
    """(_bucket, _after): the bucket that follows, descending; the first after the last.
    One row per bucket: their number is bounded (``id_ranges``)."""
    w = Window.orderBy(F.desc("_bucket"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return buckets.select("_bucket", F.coalesce(F.lead("_bucket").over(w), F.first("_bucket").over(whole)).alias("_after"))


def edited(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row, _bucket, key, _text, _edited): each text, and the text whose last
    third is replaced by the beginning of the next row's, ids descending.
    ``row`` numbers a bucket's rows in that order."""
    docs = id_buckets(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), key, "_text")
    order = Window.partitionBy("_bucket").orderBy(F.col(key).desc_nulls_last(), F.desc("_text"))
    rows = docs.select("_bucket", key, "_text", F.row_number().over(order).cast("long").alias("row"),
                       F.lead("_text").over(order).alias("_next"))
    # The first text of every bucket, found by its id: one row a bucket.
    tops = docs.groupBy("_bucket").agg(F.max(key).alias("_top"))
    firsts = docs.join(F.broadcast(tops.select(F.col("_bucket").alias("_b"), "_top")),
                       (F.col("_bucket") == F.col("_b")) & F.col(key).eqNullSafe(F.col("_top"))) \
        .groupBy("_bucket").agg(F.max("_text").alias("_first"))
    joint = _next_bucket(tops.select("_bucket")).join(firsts.withColumnRenamed("_bucket", "_after"), "_after").select("_bucket", "_first")
    rows = rows.join(joint, "_bucket")
    n = F.char_length("_text")
    cut = F.floor(n / 3).cast("int")
    after = F.coalesce("_next", "_first")
    return rows.select("row", "_bucket", key, "_text", n.cast("long").alias("n_chars"),
                       F.concat(F.substring("_text", F.lit(1), n - cut), F.substring(after, F.lit(1), cut)).alias("_edited"))


def _hex(lo: str, hi: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness (the
    share of equal bits), that of the next document, and ``n_near``: the other
    documents whose fingerprints lie within the radius, searched among all of
    them for every document whose id is divisible by ASKED (else null)."""
    return compared(common.documents(spark, sf_dir), "doc_id", "text", ASKED)


def compared(df: DataFrame, key: str, text: str, asked: int = 1) -> DataFrame:
    """The columns of ``op2_simhash`` for any table; ``n_near`` for the rows
    whose id is divisible by ``asked``, and null without an id."""
    rows = edited(df, key, text)
    digest = F.sha2(F.col("_edited").cast("binary"), 256)
    sha = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias(f"_sha{i}") for i in range(4)]
    carry = [key, "n_chars", "_sha0", "_sha1", "_sha2", "_sha3"]
    both = rows.select("row", "_bucket", key, "n_chars", *sha, F.posexplode(F.array("_text", "_edited")).alias("_which", "_x")) \
        .withColumn("_which", F.col("_which").cast("long"))
    prints = fingerprints(both, ["_bucket", "row", "_which"], "_x", carry)
    half = lambda c, which: F.max(F.when(F.col("_which") == which, F.col(c)))
    light = common.written(prints.groupBy("_bucket", "row").agg(
        *[F.max(c).alias(c) for c in carry], half("lo", 0).alias("lo"), half("hi", 0).alias("hi"),
        half("lo", 1).alias("edited_lo"), half("hi", 1).alias("edited_hi")), "prints")
    firsts = light.where("row = 1").select(F.col("_bucket").alias("_after"), F.col("lo").alias("_flo"), F.col("hi").alias("_fhi"))
    joint = _next_bucket(light.where("row = 1").select("_bucket")).join(firsts, "_after").drop("_after")
    order = Window.partitionBy("_bucket").orderBy("row")
    out = light.withColumn("_nlo", F.lead("lo").over(order)).withColumn("_nhi", F.lead("hi").over(order)).join(joint, "_bucket") \
        .withColumn("_nhi", F.when(F.col("_nlo").isNull(), F.col("_fhi")).otherwise(F.col("_nhi"))) \
        .withColumn("_nlo", F.coalesce("_nlo", "_flo"))
    ask = F.pmod(F.col(key), F.lit(asked)) == 0
    distinct = common.written(light.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("_copies"), F.max(ask).alias("_ask")), "distinct")
    counts = near_counts(distinct.where("_ask"), distinct.drop("_ask"))
    out = out.join(counts, ["lo", "hi"], "left").withColumn("n_near", F.when(ask, F.col("n_near")))
    likeness = lambda lo, hi: 1 - differing_bits(F.col("lo"), F.col("hi"), F.col(lo), F.col(hi)) / F.lit(float(BITS))
    return out.select(
        key, "n_chars", F.lower(F.concat(*[F.lpad(F.hex(f"_sha{i}"), 16, "0") for i in range(4)])).alias("edited_sha256"),
        _hex("lo", "hi").alias("fingerprint"), _hex("edited_lo", "edited_hi").alias("edited_fingerprint"),
        likeness("edited_lo", "edited_hi").alias("near_edited"), likeness("_nlo", "_nhi").alias("near_next"), "n_near")
