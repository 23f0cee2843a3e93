"""Voting and selection over candidate answers.

Shape: a candidates table with a group key (question), a position
(tie-break: first seen wins) and an answer/score column.

Scale: every arg-max is ``max(struct(score, -pos, ...))`` in a hash
aggregate, so each vote is two partially aggregated shuffles (per
(question, answer), then per question). A question holding a third of all
rows is combined map-side like any other; nothing collects a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A


def _argmax(key: str, order: list[Column], payload: dict[str, Column]):
    """Aggregate expression: the payload of the row with the largest
    ``order`` tuple inside each ``key`` group."""
    fields = [o.alias(f"_o{i}") for i, o in enumerate(order)] + [v.alias(k) for k, v in payload.items()]
    return F.max(F.struct(*fields))


def majority_vote(cands: DataFrame, key: str = "question_id", pos: str = "pos", text: str = "text",
                  answer: Column | None = None) -> DataFrame:
    """G1: most frequent normalised answer; ties -> first seen; the first
    original response with that answer is returned; empty answers do not
    vote; a question with no usable answer returns its first candidate.

    Output: key, answer, n_votes, n_candidates, response."""
    ans = answer if answer is not None else A.normalize_answer(A.extract_final_answer(F.col(text)))
    c = cands.select(F.col(key), F.col(pos), F.col(text), ans.alias("_ans"))
    votes = c.where(F.length("_ans") > 0).groupBy(key, "_ans").agg(
        F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"), F.min_by(text, pos).alias("_resp"))
    win = votes.groupBy(key).agg(
        _argmax(key, [F.col("_n"), -F.col("_first")], {"ans": F.col("_ans"), "resp": F.col("_resp")}).alias("_w"))
    allc = c.groupBy(key).agg(F.count(F.lit(1)).alias("n_candidates"), F.min_by(text, pos).alias("_first_resp"))
    out = allc.join(win, key, "left")
    return out.select(
        key, F.col("_w.ans").alias("answer"), F.coalesce(F.col("_w._o0"), F.lit(0)).alias("n_votes"),
        "n_candidates", F.coalesce(F.col("_w.resp"), F.col("_first_resp")).alias("response"))


def consensus(cands: DataFrame, key: str, pos: str, answer: Column, threshold: float = 0.95) -> DataFrame:
    """Top answer share (count desc, first seen) and whether it reaches
    ``threshold``."""
    c = cands.select(F.col(key), F.col(pos), answer.alias("_ans"))
    g = c.groupBy(key, "_ans").agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"))
    top = g.groupBy(key).agg(
        _argmax(key, [F.col("_n"), -F.col("_first")], {"ans": F.col("_ans")}).alias("_w"),
        F.sum("_n").alias("n_total"))
    ratio = F.col("_w._o0") / F.col("n_total")
    return top.select(key, F.col("_w.ans").alias("answer"), F.col("_w._o0").alias("n_votes"), "n_total",
                      F.round(ratio, 6).alias("consensus_ratio"), (ratio >= threshold).alias("has_consensus"))


def weighted_vote(cands: DataFrame, key: str, pos: str, answer: Column, confidence: str) -> DataFrame:
    """score = 0.7 * mean confidence + 0.3 * share; best answer (first
    seen on ties) and the number of distinct answers. The distribution
    itself is ``answer_distribution`` (a table, not a per-question list)."""
    g = answer_distribution(cands, key, pos, answer, confidence)
    best = g.groupBy(key).agg(
        _argmax(key, [F.round("score", 12), -F.col("first_pos")], {"ans": F.col("answer"), "score": F.col("score")}).alias("_w"),
        F.count(F.lit(1)).alias("num_unique_answers"))
    return best.select(key, F.col("_w.ans").alias("answer"), F.round(F.round("_w.score", 12), 6).alias("best_score"),
                       "num_unique_answers")


def answer_distribution(cands: DataFrame, key: str, pos: str, answer: Column, confidence: str) -> DataFrame:
    """G3 distribution: per (question, answer) count, mean confidence, share
    and weighted score."""
    c = cands.select(F.col(key), F.col(pos), answer.alias("answer"), F.col(confidence).alias("_conf"))
    g = c.groupBy(key, "answer").agg(F.count(F.lit(1)).alias("n"), F.avg("_conf").alias("avg_confidence"),
                                     F.min(pos).alias("first_pos"))
    tot = c.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    return g.join(tot, key).withColumn("share", F.col("n") / F.col("_total")) \
        .withColumn("score", F.col("avg_confidence") * 0.7 + F.col("share") * 0.3).drop("_total")


def score_sum_vote(cands: DataFrame, key: str, pos: str, answer: Column, score: str) -> DataFrame:
    """Answer with the largest summed score (first seen on ties)."""
    c = cands.select(F.col(key), F.col(pos), answer.alias("_ans"), F.col(score).alias("_s"))
    g = c.groupBy(key, "_ans").agg(F.sum("_s").alias("_sum"), F.min(pos).alias("_first"))
    w = g.groupBy(key).agg(_argmax(key, [F.round("_sum", 12), -F.col("_first")],
                                   {"ans": F.col("_ans"), "s": F.col("_sum")}).alias("_w"))
    return w.select(key, F.col("_w.ans").alias("answer"), F.round("_w.s", 6).alias("total_score"))


def max_confidence_vote(cands: DataFrame, key: str, pos: str, answer: Column, confidence: str) -> DataFrame:
    """Answer whose best confidence is highest, then most frequent,
    then first seen."""
    c = cands.select(F.col(key), F.col(pos), answer.alias("_ans"), F.col(confidence).alias("_c"))
    g = c.groupBy(key, "_ans").agg(F.max("_c").alias("_max"), F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"))
    w = g.groupBy(key).agg(_argmax(key, [F.col("_max"), F.col("_n"), -F.col("_first")],
                                   {"ans": F.col("_ans")}).alias("_w"))
    return w.select(key, F.col("_w.ans").alias("answer"), F.col("_w._o0").alias("max_confidence"),
                    F.col("_w._o1").alias("n_votes"))


def numeric_vote(cands: DataFrame, key: str, pos: str, number: Column, confidence: str,
                 solution: str) -> DataFrame:
    """Integer answers vote; a winner needs at least two numeric answers
    and at least two agreeing; its most confident solution is returned.
    Otherwise ``fallback`` is true and no answer is given."""
    c = cands.select(F.col(key), F.col(pos), F.col(solution).alias("_sol"), F.col(confidence).alias("_c"),
                     number.alias("_num"))
    numeric = c.where(F.col("_num").isNotNull())
    g = numeric.groupBy(key, "_num").agg(
        F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"),
        F.max(F.struct(F.col("_c"), -F.col(pos), F.col("_sol"))).alias("_best"))
    w = g.groupBy(key).agg(
        _argmax(key, [F.col("_n"), -F.col("_first")], {"num": F.col("_num"), "best": F.col("_best")}).alias("_w"),
        F.sum("_n").alias("n_numeric"))
    allq = c.select(key).distinct()
    out = allq.join(w, key, "left")
    ok = F.coalesce((F.col("n_numeric") >= 2) & (F.col("_w._o0") >= 2), F.lit(False))
    return out.select(
        key, F.when(ok, F.col("_w.num")).alias("answer"), F.when(ok, F.col("_w._o0")).alias("n_votes"),
        F.when(ok, F.col("_w.best._sol")).alias("solution"), F.when(ok, F.col("_w.best._c")).alias("confidence"),
        (~ok).alias("fallback"))


def rating_argmax(cands: DataFrame, key: str, pos: str, rating: Column, payload: str) -> DataFrame:
    """The candidate with the highest rating, first on ties."""
    c = cands.select(F.col(key), F.col(pos), rating.alias("_r"), F.col(payload).alias("_p"))
    w = c.groupBy(key).agg(_argmax(key, [F.col("_r"), -F.col(pos)], {"p": F.col("_p"), "pos": F.col(pos)}).alias("_w"))
    return w.select(key, F.col("_w.pos").alias("pos"), F.col("_w._o0").alias("rating"), F.col("_w.p").alias(payload))


def pairwise_wins(cands: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Round-robin over all ordered pairs (i, j), i != j; the pair's
    winner is the higher value, the first of the pair on ties. Wins are
    counted exactly without materialising pairs: candidate i wins
    2 * #{j: v_j < v_i} + #{j != i: v_j = v_i}.

    Counts below come from distinct (question, value) rows in buckets of the
    value, so neither duplicates nor a hot question meet in one task."""
    from .ranking import running, value_bucket

    c = cands.select(F.col(key), F.col(pos), F.col(value).alias("_v"))
    per_val = c.groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_k"))
    below = running(per_val, [key], ["_v"], F.col("_k"), "sum", value_bucket(F.col("_v").cast("double")), "_below", inclusive=False) \
        .withColumn("_below", F.coalesce("_below", F.lit(0)))
    scored = c.join(below, [key, "_v"]).withColumn("wins", (2 * F.col("_below") + F.col("_k") - 1).cast("bigint"))
    best = scored.groupBy(key).agg(_argmax(key, [F.col("wins"), -F.col(pos)], {"pos": F.col(pos)}).alias("_w"))
    return scored.join(best.select(key, F.col("_w.pos").alias("_best_pos")), key) \
        .select(key, pos, "wins", (F.col(pos) == F.col("_best_pos")).alias("is_best"))


def majority_longest(cands: DataFrame, key: str, pos: str, answer: Column, response: str) -> DataFrame:
    """Majority answer (first seen on ties), then among its responses
    the longest (first on ties)."""
    c = cands.select(F.col(key), F.col(pos), answer.alias("_ans"), F.col(response).alias("_r"))
    g = c.groupBy(key, "_ans").agg(
        F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"),
        F.max(F.struct(F.length("_r").alias("len"), (-F.col(pos)).alias("npos"), F.col("_r").alias("r"))).alias("_long"))
    w = g.groupBy(key).agg(_argmax(key, [F.col("_n"), -F.col("_first")], {"ans": F.col("_ans"), "long": F.col("_long")}).alias("_w"))
    return w.select(key, F.col("_w.ans").alias("answer"), F.col("_w._o0").alias("n_votes"),
                    (-F.col("_w.long.npos")).alias("pos"), F.col("_w.long.len").alias("response_length"))


def consensus_counts(solutions: DataFrame, key: str, verified: str, answer: str, min_verified: int = 2) -> DataFrame:
    """Per question and answer, verified solution counts; consensus
    when at least ``min_verified`` verified solutions agree."""
    g = solutions.where(F.col(verified)).groupBy(key, answer).agg(F.count(F.lit(1)).alias("n_verified"))
    return g.withColumn("is_consensus", F.col("n_verified") >= min_verified)


def best_solution(solutions: DataFrame, key: str, pos: str, verified: str, confidence: str,
                  vscore: str) -> DataFrame:
    """Best verified solution by confidence; without verified ones, the
    best by verification score (first on ties)."""
    s = solutions.select(F.col(key), F.col(pos), F.col(verified).cast("int").alias("_v"),
                         F.when(F.col(verified), F.col(confidence)).otherwise(F.col(vscore)).alias("_score"))
    w = s.groupBy(key).agg(_argmax(key, [F.col("_v"), F.col("_score"), -F.col(pos)], {"pos": F.col(pos)}).alias("_w"))
    return w.select(key, F.col("_w.pos").alias("pos"), (F.col("_w._o0") == 1).alias("from_verified"),
                    F.col("_w._o1").alias("score"))


def select_by_index(selections: DataFrame, cands: DataFrame, key: str, index: str, pos: str) -> DataFrame:
    """Join a chosen 0-based index back to the candidate at that
    1-based position."""
    s = selections.select(F.col(key), (F.col(index) + 1).alias(pos))
    return s.join(cands, [key, pos], "inner")


def synthesis_input(cands: DataFrame, key: str, pos: str, answer: str, k: int = 3) -> DataFrame:
    """The first ``k`` solutions per question and their answers as one
    comma-separated text. Needs positions 1..n per question (``pos``)."""
    top = cands.where(F.col(pos) <= k)
    g = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(pos), F.col(answer)))).alias("_l"))
    return g.select(key, F.size("_l").alias("n_solutions"),
                    F.array_join(F.transform("_l", lambda x: x[answer]), ", ").alias("answers_text"))
