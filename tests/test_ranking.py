"""Ranks and running values on wide rows, a hot key and every way of planning them."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from verity.operators import ranking

PLANS = [{}, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}, {"spark.sql.adaptive.enabled": "false"}]


@pytest.fixture(params=range(len(PLANS)))
def planned(spark, request):
    for k, v in PLANS[request.param].items():
        spark.conf.set(k, v)
    yield spark
    for k in PLANS[request.param]:
        spark.conf.unset(k)


def rows(spark, n=100_000):
    """A third of the rows have key 0; several rows share a time."""
    i = F.col("id")
    return spark.range(n).repartition(7).select(
        F.when(i % 3 == 0, 0).otherwise(i % 97).alias("key"), i.alias("event_id"),
        F.timestamp_seconds(1_700_000_000 + F.pmod(i * 7919, F.lit(n)) * 20 / 3).alias("ts"),
        (F.pmod(i * 31, F.lit(1009)) - 500).cast("double").alias("value"), F.repeat(F.lit("x"), 40).alias("wide"))


def test_rank_within_and_global(planned):
    df = rows(planned)
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    got = ranking.rank_within(df, "key", ["ts", "event_id"], "r").withColumn("want", F.row_number().over(w))
    assert got.count() == 100_000 and got.where("r <> want").isEmpty()
    whole = ranking.global_rank(df.select("event_id", "wide", "value"), ["event_id"], "r")
    assert whole.count() == 100_000 and whole.where("r <> event_id + 1").isEmpty()
    by_value = ranking.rank_within(df, "key", ["value", "event_id"], "r", ranking.value_bucket(F.col("value"))) \
        .withColumn("want", F.row_number().over(Window.partitionBy("key").orderBy("value", "event_id")))
    assert by_value.where("r <> want").isEmpty()


def test_running_values(planned):
    df = rows(planned, 20_000)
    bucket = F.date_trunc("hour", "ts")
    w = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    top = ranking.running(df, ["key"], ["ts", "event_id"], F.col("value"), "max", bucket, "m").withColumn("want", F.max("value").over(w))
    assert top.count() == 20_000 and top.where("m <> want").isEmpty()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = ranking.running(df, ["key"], ["ts", "event_id"], F.col("value"), "sum", bucket, "s", inclusive=False) \
        .withColumn("want", F.sum("value").over(before))
    assert s.where("not (s <=> want)").isEmpty()


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", None), ("a", 5)], "key string, n long")
    got = sorted(map(repr, map(tuple, ranking.rank_within(df, "key", ["n"], "r").collect())))
    assert got == sorted(map(repr, [(None, 1, 1), (None, 2, 2), ("a", None, 1), ("a", 5, 2)]))
    assert ranking.rank_within(df.where("false"), "key", ["n"], "r").count() == 0
