"""Dataset curation.

All filters are plain Column predicates so Catalyst pushes them into the
Parquet scan; set differences are ``left_anti`` joins (the right side is
broadcast only when it is a bounded id list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chars_div4
from .ranking import global_rank


def slice_records(df: DataFrame, key: str = "idx", start: int = 0, end: int | None = None,
                  limit: int | None = None) -> DataFrame:
    """Rows whose position key is in [start, stop). ``end`` is inclusive;
    with both ``end`` and ``limit`` the smaller stop wins."""
    stop = None
    if limit and end is not None:
        stop = min(start + limit, end + 1)
    elif end is not None:
        stop = end + 1
    elif limit:
        stop = start + limit
    cond = F.col(key) >= start
    if stop is not None:
        cond = cond & (F.col(key) < stop)
    return df.where(cond)


def select_columns(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Keep only ``keep`` or drop heavy columns (column pruning)."""
    if keep:
        df = df.select(*keep)
    if drop:
        df = df.drop(*drop)
    return df


def resume(df: DataFrame, done: DataFrame, key: str = "idx", mode: str = "anti") -> DataFrame:
    """Rows still to process. ``anti`` skips every processed key;
    ``max_index`` skips everything up to the largest processed key (the
    reference's resume rule)."""
    if mode == "max_index":
        top = done.agg(F.max(key).alias("_top"))  # one row
        return df.join(F.broadcast(top)).where(F.col("_top").isNull() | (F.col(key) > F.col("_top"))).drop("_top")
    return df.join(done.select(key), key, "left_anti")


def portable_hash(key: Column, seed: int) -> Column:
    """Deterministic hash both Spark and SQL engines compute identically
    (one MINSTD step, a bijection of integer keys below 2^31 - 1)."""
    return F.pmod(key.cast("long") * 48271 + F.lit(seed), F.lit(2147483647))


def sample_percent(df: DataFrame, percent: float, seed: int = 42, key: str = "idx") -> DataFrame:
    """A10: exactly max(1, ceil(N * p / 100)) rows without replacement,
    ordered by key. Membership is the n smallest hashes; ranks come from
    buckets of the hash (its high bits), not from one task."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    h = df.withColumn("_h", portable_hash(F.col(key), seed))
    ranked = global_rank(h, ["_h", key], "_r", F.shiftright("_h", 18))
    n = F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(percent) / 100.0))
    return ranked.join(F.broadcast(total)).where(F.col("_r") <= n).drop("_h", "_r", "_total")


def normalize_samples(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve field aliases, trim, split into valid rows and errors.

    ``df`` must carry a ``_pos`` (0-based position). Question = first
    non-empty of prompt/Prompt/question/Question; answer = ModelAnswer or
    llm_response; ground truth = Answer/ground_truth else label (bool);
    sample_id defaults to position + 1.
    """
    cols = set(df.columns)

    def first_nonempty(*names):
        present = [F.when(F.length(F.col(n).cast("string")) > 0, F.col(n).cast("string")) for n in names if n in cols]
        return F.coalesce(*present, F.lit(None).cast("string")) if present else F.lit(None).cast("string")

    q = first_nonempty("prompt", "Prompt", "question", "Question")
    a = first_nonempty("ModelAnswer", "llm_response")
    ctx = first_nonempty("Context", "context")
    gt_src = first_nonempty("Answer", "ground_truth")
    if "label" in cols:
        gt_src = F.coalesce(gt_src, F.col("label").cast("string"))
    gt = F.when(gt_src.isNull(), F.lit(None).cast("boolean")).otherwise(
        ~gt_src.isin("", "0", "false", "False"))
    sid = F.col("sample_id").cast("string") if "sample_id" in cols else F.lit(None).cast("string")
    decision = first_nonempty("evaluation_decision", "GraderDecision")
    base = df.select(
        F.col("_pos"),
        F.coalesce(sid, (F.col("_pos") + 1).cast("string")).alias("sample_id"),
        q.alias("_q"), a.alias("_a"), ctx.alias("_c"), gt.alias("ground_truth"),
        F.create_map(F.lit("evaluation_decision"), decision,
                     F.lit("evaluation_explanation"), first_nonempty("evaluation_explanation", "GraderExplanation"),
                     F.lit("reasoning_type"), first_nonempty("reasoning_type", "ReasoningTypes")).alias("metadata"),
    )
    ok = base["_q"].isNotNull() & base["_a"].isNotNull()
    valid = base.where(ok).select(
        "sample_id", F.trim("_q").alias("question"), F.trim("_a").alias("answer"),
        F.coalesce(F.trim("_c"), F.lit("")).alias("context"), "ground_truth",
        F.col("ground_truth").isNotNull().alias("has_label"), "metadata")
    errors = base.where(~ok).select(
        F.col("_pos").alias("position"),
        F.format_string("Sample %d: Missing question/answer", F.col("_pos")).alias("error"))
    return valid, errors


def drop_bad_records(df: DataFrame, bad_ids: DataFrame, key: str = "idx") -> DataFrame:
    """Remove listed ids (the reference pops while iterating and can
    skip a neighbour; this filters every listed id)."""
    return df.join(bad_ids.select(key), key, "left_anti")


def filter_output_tokens(df: DataFrame, col: str, limit: int = 4000) -> DataFrame:
    """Drop only rows whose numeric token count exceeds ``limit``;
    rows with a missing count stay."""
    return df.where(F.col(col).isNull() | (F.col(col) <= limit))


def output_token_filter_counts(df: DataFrame, col: str, limit: int = 4000) -> DataFrame:
    removed = F.sum(F.when(F.col(col) > limit, 1).otherwise(0)).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_input"), removed.alias("n_removed")) \
        .withColumn("n_kept", F.col("n_input") - F.col("n_removed"))


def filter_empty_grades(df: DataFrame, col: str = "grader_decision") -> DataFrame:
    """Remove rows whose grade is exactly '' (null grades stay)."""
    return df.where(~F.coalesce(F.col(col) == "", F.lit(False)))


def skip_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows where any of ``cols`` is null or blank."""
    cond = None
    for c in cols:
        p = F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))
        cond = p if cond is None else cond & p
    return df.where(cond)


def over_budget(df: DataFrame, limit: int, cols: list[str], key: str = "idx",
                counter=chars_div4) -> DataFrame:
    """Records whose prompt + answer + context tokens exceed
    int(limit * 0.75)."""
    total = None
    for c in cols:
        t = counter(F.col(c))
        total = t if total is None else total + t
    budget = int(limit * 0.75)
    return df.select(F.col(key), total.alias("total_tokens")).where(F.col("total_tokens") > budget)


def filter_link_count(df: DataFrame, links: Column, n: int) -> DataFrame:
    """Records with exactly ``n`` links."""
    return df.where(F.size(links) == n)
