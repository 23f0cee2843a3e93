"""Strategy ledgers, effectiveness and selection.

Strategy state is not mutated in place: the attempt log is the fact table
and every counter (uses, successes, EMA confidence, last use) is an
aggregate over it. Time-dependent scores take an explicit ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger(attempts: DataFrame, key: str = "strategy_id", order: list[str] = ("ts", "event_id"),
           alpha: float = 0.1, start: float = 0.5) -> DataFrame:
    """Per strategy: attempts, successes, success rate, first and last
    use, and the EMA confidence c <- (1 - alpha) c + alpha s (start 0.5),
    evaluated in closed form: (1-a)^n * c0 + sum_i a (1-a)^(n-i) s_i.

    Position i comes from time buckets (a strategy with a third of all
    attempts is spread over many tasks). The closed form then reduces in hash
    aggregates."""
    from .ranking import rank_within

    ranked = rank_within(attempts, key, list(order), "_i")
    a = ranked.join(attempts.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
    s = F.col("success").cast("double")
    term = F.lit(alpha) * F.pow(F.lit(1 - alpha), (F.col("_n") - F.col("_i")).cast("double")) * s
    g = a.groupBy(key).agg(
        F.min("problem_type").alias("problem_type"),
        F.count(F.lit(1)).alias("total_attempts"), F.sum(s).cast("bigint").alias("success_count"),
        F.min("ts").alias("created_at"), F.max("ts").alias("last_used"),
        (F.sum(term) + F.pow(F.lit(1 - alpha), F.max("_n").cast("double")) * start).alias("confidence"))
    return g.withColumn("success_rate", F.col("success_count") / F.col("total_attempts")) \
        .withColumn("confidence", F.round("confidence", 9))


def recency_score(last_used: Column, as_of: Column, horizon_days: float = 30.0) -> Column:
    days = F.floor((as_of.cast("double") - last_used.cast("double")) / 86400.0)
    return F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), days / horizon_days))


def selection_score(rate: Column, last_used: Column, as_of: Column) -> Column:
    """0.7 * success rate + 0.3 * recency (linear over 30 days)."""
    return F.lit(0.7) * rate + F.lit(0.3) * recency_score(last_used, as_of)


def effectiveness(attempts: DataFrame) -> DataFrame:
    """H9: per (strategy, problem type): successes, failures, uses, mean
    confidence and success rate."""
    s = F.col("success").cast("int")
    g = attempts.groupBy("strategy_id", "problem_type").agg(
        F.sum(s).cast("bigint").alias("success_count"), F.sum(1 - s).cast("bigint").alias("failure_count"),
        F.count(F.lit(1)).alias("total_uses"), F.round(F.avg("confidence"), 9).alias("avg_confidence"))
    return g.withColumn("success_rate", F.round(F.col("success_count") / F.col("total_uses"), 9))


def top_strategies(eff: DataFrame, n: int = 5, min_uses: int = 2) -> DataFrame:
    """Best ``n`` strategies with at least ``min_uses`` uses."""
    return eff.where(F.col("total_uses") >= min_uses) \
        .orderBy(F.col("success_rate").desc(), F.col("total_uses").desc(), F.col("strategy_id")).limit(n)


def effective_strategies(led: DataFrame, problem_type: str, min_confidence: float = 0.6,
                         fallback_n: int = 2) -> DataFrame:
    """H8: strategies of the same (or unknown) type with confidence >=
    ``min_confidence``; when none qualify, the ``fallback_n`` most confident."""
    same = led.where(F.col("problem_type").isin(problem_type, "unknown"))
    good = same.where(F.col("confidence") >= min_confidence)
    # Top-n over the typed pool (per-partition top-n, then a bounded merge);
    # consulted only when ``good`` is empty.
    fallback = same.orderBy(F.col("confidence").desc(), F.col("strategy_id")).limit(fallback_n)
    none = good.agg(F.count(F.lit(1)).alias("_good")).where("_good = 0")  # one row or none
    return good.unionByName(fallback.join(F.broadcast(none)).drop("_good"))


# The valid problem types, in the reference's order; the last
# one is the fallback.
VALID_PROBLEM_TYPES = [
    "arithmetic_calculation",
    "algebraic_equation",
    "statistical_analysis",
    "logical_reasoning",
    "word_problem",
    "coding_problem",
    "algorithm_design",
    "creative_writing",
    "text_summarization",
    "information_retrieval",
    "planning_task",
    "decision_making",
    "knowledge_question",
    "language_translation",
    "sequence_completion",
    "general_problem",
]
DEFAULT_PROBLEM_TYPE = "general_problem"


def coerce_problem_type(c: Column, valid: list[str] = VALID_PROBLEM_TYPES,
                        default: str = DEFAULT_PROBLEM_TYPE) -> Column:
    """A type outside the valid list becomes ``default``."""
    return F.when(c.isin(*valid), c).otherwise(F.lit(default))


def classify_problem_type(text: Column, valid: list[str] = VALID_PROBLEM_TYPES,
                          default: str = DEFAULT_PROBLEM_TYPE) -> Column:
    """A classifier reply -> type: exact (trimmed, lower-cased) match,
    else the first valid type contained in it, else ``default``."""
    t = F.lower(F.trim(text))
    contained = None
    for v in valid:
        contained = F.when(t.contains(v), F.lit(v)) if contained is None else contained.when(t.contains(v), F.lit(v))
    return F.when(t.isin(*valid), t).otherwise(contained.otherwise(F.lit(default)))


def effective_from_reply(text: Column) -> Column:
    """Strategy judged effective when 'YES' appears in the reply after
    the last ``</think>`` (upper-cased)."""
    final = F.when(text.rlike(r"(?s)<think>.*?</think>"), F.substring_index(text, "</think>", -1)).otherwise(text)
    return F.upper(F.trim(final)).contains("YES")


def last_examples(attempts: DataFrame, key: str, text: str, order: list[str], n: int = 5) -> DataFrame:
    """The last ``n`` non-blank reasoning examples per strategy."""
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    x = attempts.where(F.length(F.trim(F.col(text))) > 0)
    return x.withColumn("recency_rank", F.row_number().over(w)).where(F.col("recency_rank") <= n)


def distinct_examples(attempts: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Distinct examples per strategy, first occurrence kept."""
    return attempts.groupBy(key, text).agg(F.min(order).alias("first_seen"))


def prune(led: DataFrame, min_rate: float = 0.3, min_attempts: int = 5) -> DataFrame:
    """Drop strategies with enough attempts and a poor success rate."""
    return led.where((F.col("total_attempts") < min_attempts) | (F.col("success_rate") >= min_rate))


def cap_per_type(led: DataFrame, as_of: Column, max_per_type: int = 10) -> DataFrame:
    """Keep at most ``max_per_type`` strategies per type by selection
    score (stable: earlier strategy first on ties)."""
    scored = led.withColumn("score", selection_score(F.col("success_rate"), F.col("last_used"), as_of))
    w = Window.partitionBy("problem_type").orderBy(F.col("score").desc(), F.col("strategy_id"))
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_per_type).drop("_r")


def select_for_inference(led: DataFrame, problem_type: Column, as_of: Column, learning: bool = False,
                         min_rate: float = 0.4, min_attempts: int = 5, k: int = 3) -> DataFrame:
    """Qualified strategies of a type (rate >= ``min_rate`` with at least
    ``min_attempts`` attempts; in learning mode also newer ones), top ``k``
    by selection score."""
    q = (F.col("success_rate") >= min_rate) & (F.col("total_attempts") >= min_attempts)
    if learning:
        q = q | (F.col("total_attempts") < min_attempts)
    x = led.where((F.col("problem_type") == problem_type) & q) \
        .withColumn("score", selection_score(F.col("success_rate"), F.col("last_used"), as_of))
    w = Window.partitionBy("problem_type").orderBy(F.col("score").desc(), F.col("strategy_id"))
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def refinement_queue(attempts: DataFrame, key: str, order: list[str], every: int = 10) -> DataFrame:
    """Attempts after which a strategy is due for refinement (every
    ``every``-th attempt)."""
    from .ranking import rank_within

    x = rank_within(attempts, key, list(order), "attempt_no")
    return x.where(F.col("attempt_no") % every == 0)


def gap_priority_order(gaps: DataFrame, priority: str, pos: str) -> DataFrame:
    """HIGH, then MEDIUM, then anything else; ``search_order`` numbers the
    gaps in that order, stable on the whole-number position."""
    from .ranking import BUCKET_WIDTH, global_rank

    rank = F.when(F.upper(F.col(priority)) == "HIGH", 0).when(F.upper(F.col(priority)) == "MEDIUM", 1).otherwise(2)
    ranked = gaps.withColumn("priority_rank", rank)
    bucket = F.struct("priority_rank", F.floor(F.col(pos) / BUCKET_WIDTH).alias("b"))
    return global_rank(ranked, ["priority_rank", pos], "search_order", bucket)


def draft_stop(drafts: DataFrame, key: str, iteration: str, completeness: str) -> DataFrame:
    """First iteration where completeness > 0.9, or the improvement
    over the previous iteration is < 0.03 while completeness > 0.7."""
    from .ranking import rank_within

    # The previous draft by an equi join on positions, not a lag over a whole key.
    d = rank_within(drafts.select(key, iteration, completeness), key, [iteration], "_p")
    prev = d.select(key, (F.col("_p") + 1).alias("_p"), F.col(completeness).alias("_prev"))
    d = d.join(prev, [key, "_p"], "left")
    imp = F.col(completeness) - F.col("_prev")
    stop = (F.col(completeness) > 0.9) | (F.col("_prev").isNotNull() & (imp < 0.03) & (F.col(completeness) > 0.7))
    return d.where(stop).groupBy(key).agg(F.min(iteration).alias("stop_iteration"))


def fitness_multiplier(c: Column) -> Column:
    """Fitness multiplier clamped to [0.1, 2.0]."""
    return F.greatest(F.lit(0.1), F.least(F.lit(2.0), c))
