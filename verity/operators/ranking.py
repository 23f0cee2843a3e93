"""Exact ranks without a window over all rows or over a hot group.

A row's bucket is computed from its own order column, so every plan, retry and
recomputation agrees on it: rows are counted per (group, bucket), a running sum
over that small table gives what lies before each bucket, and ``row_number``
numbers the rows inside one. A group with a third of all rows is spread over
its buckets. Partition ids and sampled range bounds play no part.

The bucket must rise with the first order column: by default the hour of a
timestamp, the day of a date, and ``BUCKET_WIDTH`` consecutive values of a
number; strings and others need a bucket of the caller's. Nulls come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Consecutive values of a whole-number order column that share a bucket.
BUCKET_WIDTH = 4096


def default_bucket(df: DataFrame, column: str) -> Column:
    """A coarse, rising function of an order column."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("hour", F.col(column))
    if isinstance(kind, T.DateType):
        return F.col(column)
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(column) / F.lit(BUCKET_WIDTH))
    raise TypeError(f"no default bucket for {column}: {kind.simpleString()}")


def _numbered(df: DataFrame, groups: list[str], order: list[str], bucket: Column, rank_col: str) -> DataFrame:
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_b"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    out = rows.withColumn("_in", F.row_number().over(inside)).join(offsets, on)
    return out.withColumn(rank_col, F.col("_off") + F.col("_in")) \
        .drop("_bucket", "_b", "_off", "_in", *[f"_g{i}" for i in range(len(groups))])


def global_rank(df: DataFrame, order: list[str], rank_col: str = "rank", bucket: Column | None = None) -> DataFrame:
    """Add a 1-based ``rank_col`` following ``order`` (a total order: a unique
    key last). The running sum has one row per bucket of the whole table."""
    return _numbered(df, [], order, default_bucket(df, order[0]) if bucket is None else bucket, rank_col)


def rank_within(df: DataFrame, key: str | list[str], order: list[str], rank_col: str = "rank", bucket: Column | None = None) -> DataFrame:
    """Add the 1-based position inside each ``key`` group (one column or
    several) following ``order`` (a total order)."""
    return _numbered(df, [key] if isinstance(key, str) else key, list(order), default_bucket(df, order[0]) if bucket is None else bucket, rank_col)


def running(df: DataFrame, groups: list[str], order: list[str], value: Column, how: str, bucket: Column, out: str,
            inclusive: bool = True) -> DataFrame:
    """Add ``out``: the running ``how`` ('sum', 'max') of ``value`` in each group
    following ``order``; without ``inclusive`` the row itself is left out.
    Inside a bucket a frame does it, before it the buckets' own totals."""
    agg = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = rows.groupBy(*groups, "_bucket").agg(agg("_value").alias("_total"))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_b"),
                            agg("_total").over(earlier).alias("_carried"))
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    both = rows.withColumn("_in", agg("_value").over(inside)).join(carried, on)
    if how == "sum":
        result = F.when(F.col("_in").isNotNull() | F.col("_carried").isNotNull(),
                        F.coalesce("_in", F.lit(0)) + F.coalesce("_carried", F.lit(0)))
    else:
        result = F.greatest("_in", "_carried")
    return both.withColumn(out, result).drop("_bucket", "_value", "_b", "_in", "_carried", *[f"_g{i}" for i in range(len(groups))])


def value_bucket(c: Column) -> Column:
    """A coarse rising function of a double: its magnitude in 64 steps a doubling, with its sign."""
    size = F.floor(F.log2(F.abs(c) + F.lit(1e-9)) * 64) + 4096
    return F.when(c < 0, -size).otherwise(size)
