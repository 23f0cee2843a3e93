"""Catalog entries for streaming operators.

``*_batch`` keys run the batch twin; ``*_stream`` keys run the Structured
Streaming operator over the events table as a stream (``availableNow``,
file sink or ``foreachBatch`` under the checkpoint folder) and return what
it wrote. Where the streamed result equals the batch semantics the same
oracle SQL checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import streams as ST
from .catalog import Ctx, register


#: The streams' watermark at the end of the table: rows after it still wait.
_END = "(SELECT date_trunc('milliseconds', max(CAST(ts AS TIMESTAMP))) - INTERVAL 1 HOUR FROM events)"


def _requests(events: DataFrame) -> DataFrame:
    """V_requests as a pure projection (valid on a stream)."""
    kind = (F.when(F.col("event_type") == "signup", "start")
             .when(F.col("event_type").isin("click", "view"), "provider_call")
             .when(F.col("event_type") == "purchase", "final").otherwise("error"))
    return events.select(F.col("user_id").alias("request_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                         kind.alias("kind"),
                         F.concat(F.lit("model_"), (F.col("user_id") % 3).cast("string"), F.lit(":approach_"),
                                  (F.col("user_id") % 4).cast("string")).alias("group_key"))


_CONV_SQL = """
    r AS (SELECT *, CAST(sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY ts, event_id
                                                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS conv_no
          FROM v_requests),
    r2 AS (SELECT *, sum(CASE WHEN kind IN ('final', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY request_id, conv_no ORDER BY ts, event_id
                                                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                     - CASE WHEN kind IN ('final', 'error') THEN 1 ELSE 0 END AS prev_terms FROM r),
    conv AS (SELECT request_id, conv_no, min(CASE WHEN kind = 'start' THEN ts END) AS start_ts,
                    CAST(sum(CASE WHEN kind = 'provider_call' THEN 1 ELSE 0 END) AS BIGINT) AS n_calls,
                    max(CASE WHEN kind IN ('final', 'error') THEN kind END) AS end_kind,
                    max(CASE WHEN kind IN ('final', 'error') THEN ts END) AS end_ts
             FROM r2 WHERE conv_no > 0 AND prev_terms = 0 GROUP BY 1, 2),
    convd AS (SELECT *, CASE WHEN end_ts IS NOT NULL THEN CAST(epoch_us(end_ts) - epoch_us(start_ts) AS DOUBLE) / 1000 END AS duration_ms FROM conv)"""


@register("l1_conversations_batch", f"WITH {_CONV_SQL} SELECT * FROM convd")
def l1(c: Ctx) -> DataFrame:
    conv, _ = ST.conversations_batch(_requests(c.t.events))
    return conv


@register("l1_rejected_rows_batch", f"""
    WITH {_CONV_SQL}
    SELECT request_id, count(*) AS n_rejected FROM r2 WHERE NOT (conv_no > 0 AND prev_terms = 0) GROUP BY 1""")
def l1_rej(c: Ctx) -> DataFrame:
    _, rej = ST.conversations_batch(_requests(c.t.events))
    return rej.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_rejected"))


@register("l1_conversations_stream", f"""
    WITH {_CONV_SQL.replace('FROM v_requests', f'FROM v_requests WHERE ts <= {_END}')}
    SELECT request_id, conv_no, start_ts, n_calls, end_kind, end_ts, duration_ms FROM convd WHERE end_kind IS NOT NULL""")
def l1_stream(c: Ctx) -> DataFrame:
    s = ST.conversations_stream(_requests(ST.event_stream(c.spark, c.sf_dir)))
    out = ST.run_to_table(s, "l1")
    return out.where(~F.col("rejected")).drop("rejected")


@register("l2_daily_log_stream", """
    SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS log_date, count(*) AS n_entries FROM events GROUP BY 1""")
def l2(c: Ctx) -> DataFrame:
    s = ST.daily_log(ST.event_stream(c.spark, c.sf_dir))
    out = ST.run_to_table(s, "l2", fmt="json", partition_by=["log_date"])
    return out.groupBy(F.col("log_date").cast("string").alias("log_date")).agg(F.count(F.lit(1)).alias("n_entries"))


_SESS_SQL = """
    s0 AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts,
                  CASE WHEN lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                            OR CAST(ts AS TIMESTAMP) >= lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE
                       THEN 1 ELSE 0 END AS new_s, event_id FROM events),
    s1 AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM s0),
    sess AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events,
                    min(ts) AS first_ts, max(ts) AS last_ts FROM s1 GROUP BY user_id, sid)"""


@register("l3_session_expiry_batch", f"WITH {_SESS_SQL} SELECT * FROM sess")
def l3(c: Ctx) -> DataFrame:
    e = c.t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.session_expiry(e, "user_id")


@register("l3_session_expiry_stream", f"WITH {_SESS_SQL} SELECT * FROM sess WHERE session_end <= {_END}")
def l3_stream(c: Ctx) -> DataFrame:
    # Sessions still open when the stream ends stay in state (append mode
    # emits a session only after the watermark passes its end).
    return ST.run_to_table(ST.session_expiry(ST.event_stream(c.spark, c.sf_dir), "user_id"), "l3")


_PACK_SQL = f"""
    WITH RECURSIVE e AS (SELECT model || ':' || approach AS group_key, ts, row_number() OVER (PARTITION BY model, approach ORDER BY ts, event_id) AS rn
                         FROM v_requests WHERE ts <= {_END}),
    f AS (SELECT a.group_key, a.rn, any_value(a.ts) AS first_ts, count(*) AS size, max(b.ts) AS last_ts,
                 (SELECT max(rn) FROM e x WHERE x.group_key = a.group_key) AS n
          FROM e a JOIN e b ON a.group_key = b.group_key AND b.rn BETWEEN a.rn AND a.rn + 3 AND b.ts < a.ts + INTERVAL 1 HOUR GROUP BY a.group_key, a.rn),
    k AS (SELECT *, CAST(0 AS BIGINT) AS batch_no FROM f WHERE rn = 1
          UNION ALL SELECT f.*, k.batch_no + 1 FROM k JOIN f ON f.group_key = k.group_key AND f.rn = k.rn + k.size),
    p AS (SELECT group_key, batch_no, first_ts, size, CAST(epoch_us(last_ts) - epoch_us(first_ts) AS DOUBLE) / 1000 AS wait_ms FROM k
          WHERE size = 4 OR rn + size <= n OR first_ts + INTERVAL 1 HOUR <= {_END})"""


@register("l4_batch_packing_stream", f"{_PACK_SQL} SELECT * FROM p")
def l4(c: Ctx) -> DataFrame:
    s = ST.batch_packing_stream(_requests(ST.event_stream(c.spark, c.sf_dir)), "group_key", 4, "1 hour")
    return ST.run_to_table(s, "l4")


@register("l4_batch_packing_stats", f"""{_PACK_SQL}
    SELECT group_key, count(*) AS n_batches, round(avg(size), 9) AS mean_size, round(avg(wait_ms), 6) AS mean_wait_ms FROM p GROUP BY 1""")
def l4_stats(c: Ctx) -> DataFrame:
    s = ST.batch_packing_stream(_requests(ST.event_stream(c.spark, c.sf_dir)), "group_key", 4, "1 hour")
    return ST.batch_packing_stats(ST.run_to_table(s, "l4s"))


@register("l5_progress_counters_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def l5(c: Ctx) -> DataFrame:
    return ST.run_updates(ST.progress_counters(ST.event_stream(c.spark, c.sf_dir)), "l5", ["event_type"])


def _i9_sql(warmup: int, threshold: float) -> str:
    return f"""
    WITH t AS (SELECT question_id, pos, answer,
                      count(*) OVER (PARTITION BY question_id, answer ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
                      row_number() OVER (PARTITION BY question_id ORDER BY pos) AS t FROM v_candidates WHERE ts <= {_END}),
    m AS (SELECT *, max(c) OVER (PARTITION BY question_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM t)
    SELECT question_id, CAST(coalesce(min(CASE WHEN t > {warmup} AND top / t >= {threshold} THEN t END), count(*)) AS BIGINT) AS traces_used,
           min(CASE WHEN t > {warmup} AND top / t >= {threshold} THEN t END) IS NOT NULL AS consensus_reached
    FROM m GROUP BY 1"""


@register("l6_online_consensus_stream", _i9_sql(3, 0.5))
def l6(c: Ctx) -> DataFrame:
    e = ST.event_stream(c.spark, c.sf_dir).select(F.col("user_id").alias("question_id"), "event_id", "ts",
                                                  F.col("event_type").alias("answer"))
    out = ST.run_to_table(ST.online_consensus_stream(e, 3, 0.5), "l6")
    return ST.latest(out, ["question_id"], "traces_used")


@register("l7_online_trace_stream", f"""
    WITH v AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS token_confidence
               FROM events WHERE CAST(ts AS TIMESTAMP) <= {_END}),
    g AS (SELECT trace_id, pos, avg(token_confidence) OVER (PARTITION BY trace_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS g
               FROM v),
    st AS (SELECT trace_id, min(pos) AS stop_pos FROM g WHERE pos >= 20 AND pos >= 15 AND g < 200.0 GROUP BY 1),
    nt AS (SELECT trace_id, count(*) AS n FROM v GROUP BY 1)
    SELECT nt.trace_id, st.stop_pos, CAST(coalesce(st.stop_pos, nt.n) AS BIGINT) AS num_tokens, st.stop_pos IS NOT NULL AS terminated_early
    FROM nt LEFT JOIN st USING (trace_id)""")
def l7(c: Ctx) -> DataFrame:
    e = ST.event_stream(c.spark, c.sf_dir).select(F.col("user_id").alias("trace_id"), "event_id", "ts",
                                                  F.col("value").alias("token_confidence"))
    out = ST.run_to_table(ST.online_trace_stream(e, 16, 20, 200.0), "l7")
    return ST.latest(out, ["trace_id"], "num_tokens")


@register("l8_ema_ledger_stream", f"""
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY ts, event_id) AS i,
                      count(*) OVER (PARTITION BY strategy_id) AS n FROM v_attempts WHERE ts <= {_END})
    SELECT strategy_id, count(*) AS attempts, CAST(sum(CAST(success AS INTEGER)) AS BIGINT) AS successes,
           round(sum(0.1 * pow(0.9, n - i) * CAST(success AS DOUBLE)) + pow(0.9, max(n)) * 0.5, 9) AS confidence
    FROM a GROUP BY 1""")
def l8(c: Ctx) -> DataFrame:
    e = ST.event_stream(c.spark, c.sf_dir).select(F.col("user_id").alias("strategy_id"), "event_id", "ts",
                                                  F.col("event_type").isin("purchase", "click").alias("success"))
    out = ST.latest(ST.run_to_table(ST.ema_ledger_stream(e), "l8"), ["strategy_id"], "attempts")
    return out.withColumn("confidence", F.round("confidence", 9))


@register("l9_dedupe_within_watermark_stream", f"""
    WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS signature, event_id, CAST(ts AS TIMESTAMP) AS ts FROM events
                         WHERE CAST(ts AS TIMESTAMP) <= {_END}),
    k AS (SELECT signature, min(ts) AS ts FROM e GROUP BY 1
          UNION ALL SELECT k.signature, min(e.ts) FROM k JOIN e ON e.signature = k.signature AND e.ts > k.ts + INTERVAL 1 DAY GROUP BY k.signature, k.ts)
    SELECT signature, min(event_id) AS event_id, ts FROM k JOIN e USING (signature, ts) GROUP BY signature, ts""")
def l9(c: Ctx) -> DataFrame:
    e = ST.event_stream(c.spark, c.sf_dir)
    r = e.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("signature"), "event_id", "ts")
    return ST.run_to_table(ST.dedupe_within_horizon(r, "1 day"), "l9")


_WIN_SQL = """
    SELECT time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) AS window_start,
           time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) + INTERVAL 1 DAY AS window_end,
           event_type, count(*) AS n, round(sum(value), 6) AS value_sum
    FROM events GROUP BY 1, 2, 3"""


@register("l10_windowed_counts_batch", _WIN_SQL)
def l10(c: Ctx) -> DataFrame:
    return ST.windowed_counts(c.t.events.withColumn("ts", F.col("ts").cast("timestamp")))


@register("l10_windowed_counts_stream", f"SELECT * FROM ({_WIN_SQL}) WHERE window_end <= {_END}")
def l10_stream(c: Ctx) -> DataFrame:
    return ST.run_to_table(ST.windowed_counts(ST.event_stream(c.spark, c.sf_dir)), "l10")


_HEALTH_SQL = """
    WITH h AS (SELECT 'p' || (user_id % 3) AS provider, event_id, CAST(ts AS TIMESTAMP) AS ts, event_type <> 'error' AS up FROM events),
    l AS (SELECT *, lag(up) OVER (PARTITION BY provider ORDER BY ts, event_id) AS prev FROM h)
    SELECT provider, event_id, ts, up FROM l WHERE prev IS NULL OR prev <> up"""


def _health(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), "event_id",
                         F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("up"))


@register("l11_health_transitions_batch", _HEALTH_SQL)
def l11(c: Ctx) -> DataFrame:
    h = _health(c.t.events)
    return ST.health_transitions(h, "provider", ["ts", "event_id"], F.col("up")).select("provider", "event_id", "ts", "up")


@register("l11_health_transitions_stream", _HEALTH_SQL.replace("FROM events)", f"FROM events WHERE CAST(ts AS TIMESTAMP) <= {_END})"))
def l11_stream(c: Ctx) -> DataFrame:
    return ST.run_to_table(ST.health_transitions_stream(_health(ST.event_stream(c.spark, c.sf_dir))), "l11")
