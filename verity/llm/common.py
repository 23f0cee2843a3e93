"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ASCII white space that separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the
    lineage, survives lost executors, and pins values (partition ids, tie
    orders) that a recomputation could change."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the named columns, compared as Spark compares names.
    Operators replace input columns that clash with their outputs."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def gapless_slots(df: DataFrame, group: list[str], bucket: Column, order: list[str], slot: str = "slot") -> DataFrame:
    """0-based gapless position inside each ``group``, ordered by ``bucket``
    and then ``order``. ``bucket`` is computed from the row, so retries and
    re-plans agree: count per (group, bucket), a running sum over that small
    table, ``row_number`` inside a bucket. No task sees a whole group."""
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_bucket").alias("_b"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*group, "_bucket").orderBy(*order)
    on = rows["_bucket"].eqNullSafe(offsets["_b"])
    for i, c in enumerate(group):
        on = on & rows[c].eqNullSafe(offsets[f"_g{i}"])
    out = rows.withColumn("_local", F.row_number().over(local))
    joined = out.join(offsets, on)
    return joined.withColumn(slot, (F.col("_off") + F.col("_local") - 1).cast("long")) \
        .drop("_bucket", "_b", "_off", "_local", *[f"_g{i}" for i in range(len(group))])


def _field(name: str):
    return lambda pair: pair[name]


def running(df: DataFrame, group: str, block: str, order: list[str], outs: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """Add running values of each ``group`` following ``order``: name -> (how,
    value, whether the row itself counts), how one of ``sum``, ``xor`` and
    ``list`` (of the values that are not null). The column ``block`` rises with
    ``order``; neither it nor ``group`` is null. A frame does the inside of a
    block, the totals of the earlier blocks are carried in, and no task sees a
    whole group."""
    rows = df.withColumns({f"_v{i}": v for i, (_, v, _) in enumerate(outs.values())})
    totals, carried, result = [], [], {}
    earlier = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    for i, (name, (how, _, inclusive)) in enumerate(outs.items()):
        v, t, c = f"_v{i}", f"_t{i}", f"_c{i}"
        inside = Window.partitionBy(group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if how == "list":
            totals.append(F.transform(F.sort_array(F.collect_list(F.when(F.col(v).isNotNull(), F.struct(*order, v)))), _field(v)).alias(t))
            carried.append(F.flatten(F.collect_list(t).over(earlier)).alias(c))
            result[name] = F.concat(c, F.collect_list(v).over(inside))
        elif how == "xor":
            totals.append(F.bit_xor(v).alias(t))
            carried.append(F.bit_xor(t).over(earlier).alias(c))
            result[name] = F.coalesce(F.col(c), F.lit(0)).bitwiseXOR(F.coalesce(F.bit_xor(v).over(inside), F.lit(0)))
        else:
            totals.append(F.sum(v).alias(t))
            carried.append(F.sum(t).over(earlier).alias(c))
            result[name] = F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.sum(v).over(inside), F.lit(0))
    before = rows.groupBy(group, block).agg(*totals).select(group, block, *carried)
    return rows.join(before, [group, block]).withColumns(result).drop(*[f"_{k}{i}" for i in range(len(outs)) for k in "vc"])
