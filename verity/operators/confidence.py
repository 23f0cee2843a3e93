"""Confidence over token traces and logits.

Traces: one row per (trace_id, pos, token_confidence). A trace is one
generation, bounded by the generator's token limit, so per-trace windows
are bounded. Logit vectors: ``array<float>`` per step; all vector maths are
higher-order functions (``aggregate``/``transform``) inside codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import BUCKET_WIDTH, rank_within, running, value_bucket

#: Positions of one key that a rolling mean's task sees together.
BLOCK = 4096

LN2 = math.log(2.0)


def _dbl(arr: Column) -> Column:
    return F.transform(arr, lambda x: x.cast("double"))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def _with_scalar(arr: Column, scalar: Column, fn) -> Column:
    """Apply ``fn(element, scalar)`` over ``arr`` with the per-row scalar
    passed in as a repeated array, so the scalar is evaluated once per row
    rather than once per element inside the lambda."""
    return F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), fn)


def log_softmax(logits: Column) -> Column:
    """Max-shifted log-softmax of an array of logits."""
    x = _dbl(logits)
    m = F.array_max(x)
    lz = F.log(_sum(_with_scalar(x, m, lambda v, s: F.exp(v - s))))
    return _with_scalar(x, m + lz, lambda v, s: v - s)


def entropy_nats(logits: Column) -> Column:
    """Softmax entropy H = -sum p ln p."""
    lp = log_softmax(logits)
    return -_sum(F.transform(lp, lambda v: F.exp(v) * v))


def topk_confidence(logits: Column, k: int = 5) -> Column:
    """-mean of the k largest log-probabilities."""
    top = F.slice(F.sort_array(log_softmax(logits), asc=False), 1, k)
    return -_sum(top) / F.size(top)


def with_entropy_varentropy(df: DataFrame, logits: str) -> DataFrame:
    """Entropy and varentropy (bits) as two staged projections."""
    d = df.withColumn("_lp", log_softmax(F.col(logits)))
    d = d.withColumn("entropy", -_sum(F.transform("_lp", lambda v: F.exp(v) * v)) / LN2)
    ve = _sum(_with_scalar(F.col("_lp"), F.col("entropy"), lambda v, h: F.exp(v) * F.pow(v / LN2 + h, 2)))
    return d.withColumn("varentropy", ve).drop("_lp")


def top2_margin(logits: Column) -> Column:
    """I4 per step: p1 - p2 of the softmax (1.0 for a single logit)."""
    top = F.slice(F.sort_array(log_softmax(logits), asc=False), 1, 2)
    return F.when(F.size(top) > 1, F.exp(top[0]) - F.exp(top[1])).otherwise(F.lit(1.0))


def group_confidence(tokens: DataFrame, window: int, key: str = "trace_id", pos: str = "pos",
                     value: str = "token_confidence") -> DataFrame:
    """Sliding mean over the last ``window`` tokens, full windows only.
    A trace is cut into blocks of ``BLOCK`` positions; the last ``window - 1``
    tokens of a block are copied into the next, so a long trace is many tasks."""
    own = tokens.select(key, pos, value).withColumn("_block", F.floor(F.col(pos) / BLOCK)).withColumn("_copy", F.lit(False))
    copies = own.where(F.col(pos) % BLOCK >= BLOCK - (window - 1)).withColumn("_block", F.col("_block") + 1).withColumn("_copy", F.lit(True))
    w = Window.partitionBy(key, "_block").orderBy(pos).rowsBetween(-(window - 1), 0)
    g = own.unionByName(copies).withColumn("group_confidence", F.avg(value).over(w))
    return g.where(~F.col("_copy") & (F.col(pos) >= window - 1)).select(key, pos, value, "group_confidence")


def trace_statistics(tokens: DataFrame, window: int, key: str = "trace_id", pos: str = "pos",
                     value: str = "token_confidence") -> DataFrame:
    """Per trace: average token confidence, bottom-10% group mean
    (max(1, groups // 10) lowest groups), lowest and current (last) group,
    token and group counts; 0 where a trace has no full group."""
    groups = group_confidence(tokens, window, key, pos, value)
    per_group = groups.groupBy(key).agg(F.count(F.lit(1)).alias("num_groups"))
    ranked = rank_within(groups.join(per_group, key), key, ["group_confidence", pos], "_r", value_bucket(F.col("group_confidence")))
    gstats = ranked.groupBy(key).agg(
        F.avg(F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("num_groups") / 10)), F.col("group_confidence")))
         .alias("bottom_10_percent"),
        F.min("group_confidence").alias("lowest_group"),
        F.max_by("group_confidence", pos).alias("current_group"),
        F.first("num_groups").alias("num_groups"))
    tstats = tokens.groupBy(key).agg(F.avg(value).alias("average_confidence"), F.count(F.lit(1)).alias("num_tokens"))
    out = tstats.join(gstats, key, "left")
    z = F.lit(0.0)
    return out.select(key, F.round("average_confidence", 9).alias("average_confidence"),
                      F.round(F.coalesce("bottom_10_percent", z), 9).alias("bottom_10_percent"),
                      F.round(F.coalesce("lowest_group", z), 9).alias("lowest_group"),
                      F.round(F.coalesce("current_group", z), 9).alias("current_group"),
                      "num_tokens", F.coalesce(F.col("num_groups"), F.lit(0)).cast("bigint").alias("num_groups"))


def calibrate_threshold(stats: DataFrame, metric: str = "average_confidence") -> DataFrame:
    """Thresholds from warm-up trace statistics: 'low' = 90th and 'high'
    = 10th percentile, linear interpolation (numpy's default)."""
    return stats.agg(F.percentile(metric, F.lit(0.9)).alias("threshold_low"),
                     F.percentile(metric, F.lit(0.1)).alias("threshold_high"))


def early_termination(tokens: DataFrame, threshold: DataFrame, window: int, min_length: int,
                      key: str = "trace_id", pos: str = "pos", value: str = "token_confidence") -> DataFrame:
    """I8: first 0-based position >= ``min_length`` whose group confidence is
    below the threshold; that token is not kept. Per trace: stop position,
    kept tokens, flag. ``threshold`` is a table of one row and one column."""
    g = group_confidence(tokens, window, key, pos, value).join(F.broadcast(threshold.toDF("_threshold")))
    stop = g.where((F.col(pos) >= min_length) & (F.col("group_confidence") < F.col("_threshold"))) \
        .groupBy(key).agg(F.min(pos).alias("stop_pos"))
    n = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("num_tokens"))
    out = n.join(stop, key, "left")
    return out.select(key, "stop_pos", F.coalesce(F.col("stop_pos"), F.col("num_tokens")).cast("bigint").alias("kept_tokens"),
                      F.col("stop_pos").isNotNull().alias("terminated_early"))


def online_consensus(traces: DataFrame, key: str, pos: str, answer: str, warmup: int,
                     threshold: float = 0.95) -> DataFrame:
    """Traces used until the top answer's share reaches ``threshold``;
    warm-up traces count but the test runs only after each later trace.
    The top count after trace t is the running max of each trace's own
    running answer count."""
    t = rank_within(traces.select(key, pos, answer), [key, answer], [pos], "_c")
    t = rank_within(t, key, [pos], "_t")
    t = running(t, [key], [pos], F.col("_c"), "max", F.floor(F.col(pos) / BUCKET_WIDTH), "_top")
    hit = (F.col("_t") > warmup) & (F.col("_top") / F.col("_t") >= threshold)
    g = t.groupBy(key).agg(F.min(F.when(hit, F.col("_t"))).alias("_stop"), F.count(F.lit(1)).alias("available"))
    return g.select(key, F.coalesce("_stop", "available").cast("bigint").alias("traces_used"),
                    F.col("_stop").isNotNull().alias("consensus_reached"))


def prompt_temperature(tokens_per_doc: DataFrame, key: str, token: str, base: float = 0.7) -> DataFrame:
    """Token-frequency entropy (nats) of a prompt and the temperature
    factor clip(base * clip(n/100, .5, 2) * clip(H/4, .5, 1.5), .1, 2)."""
    counts = tokens_per_doc.groupBy(key, token).agg(F.count(F.lit(1)).alias("_k"))
    n = counts.groupBy(key).agg(F.sum("_k").alias("_n"))
    c = counts.join(n, key).withColumn("_p", F.col("_k") / F.col("_n"))
    h = c.groupBy(key).agg(F.first("_n").alias("num_tokens"), (-F.sum(F.col("_p") * F.log("_p"))).alias("token_entropy"))
    lf = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("num_tokens") / 100.0))
    ef = F.greatest(F.lit(0.5), F.least(F.lit(1.5), F.col("token_entropy") / 4.0))
    temp = F.greatest(F.lit(0.1), F.least(F.lit(2.0), F.lit(base) * lf * ef))
    return h.select(key, "num_tokens", F.round("token_entropy", 9).alias("token_entropy"),
                    F.round(temp, 9).alias("temperature"))


def top_alternatives(steps: DataFrame, key: str, logits: str, k: int = 3) -> DataFrame:
    """Per step, the ``k`` most likely tokens other than the chosen one
    (the arg-max, first index on ties) with their log-probabilities."""
    lp = steps.select(key, F.posexplode(log_softmax(F.col(logits))).alias("token_index", "logprob"))
    w = Window.partitionBy(key).orderBy(F.col("logprob").desc(), F.col("token_index"))
    r = lp.withColumn("_r", F.row_number().over(w))
    return r.where((F.col("_r") > 1) & (F.col("_r") <= k + 1)).select(
        key, (F.col("_r") - 1).alias("alt_rank"), "token_index", F.round("logprob", 9).alias("logprob"))


# Phrases that mark a thought switch.
THOUGHT_SWITCH_MARKERS = ["Wait,", "Alternatively,", "However,", "Additionally,"]


def thought_switches(text: Column) -> Column:
    """struct(count, first_pos): occurrences of switch phrases and the
    1-based character position of the first one (0 if none)."""
    cnt = None
    first = None
    for m in THOUGHT_SWITCH_MARKERS:
        c = F.regexp_count(text, F.lit(m.replace(",", "\\,")))
        p = F.locate(m, text)
        cnt = c if cnt is None else cnt + c
        pm = F.when(p > 0, p)
        first = pm if first is None else F.least(first, pm)
    return F.struct(cnt.cast("bigint").alias("n_switches"), F.coalesce(first, F.lit(0)).alias("first_switch_pos"))


def rolling_mean_last_n(df: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Mean of the last ``n`` values per key in ``order``, exact and
    skew-safe. Positions come from time buckets; the rows of a key are then cut
    into blocks of ``BLOCK`` positions, the last ``n - 1`` rows of a block are
    copied into the next, and a frame inside the block does the rest."""
    ranked = rank_within(df.select(key, *order, value), key, list(order), "_p")
    block = F.floor((F.col("_p") - 1) / BLOCK)
    own = ranked.withColumn("_block", block).withColumn("_copy", F.lit(False))
    copies = own.where((F.col("_p") - 1) % BLOCK >= BLOCK - (n - 1)).withColumn("_block", F.col("_block") + 1).withColumn("_copy", F.lit(True))
    last = Window.partitionBy(key, "_block").orderBy("_p").rowsBetween(-(n - 1), 0)
    out = own.unionByName(copies).withColumn("rolling_mean", F.avg(value).over(last))
    return out.where(~F.col("_copy")).select(key, *order, value, "rolling_mean")
