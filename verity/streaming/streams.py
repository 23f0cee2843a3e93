"""Structured Streaming operators and their batch twins.

Every operator here is written once against the DataFrame API and runs on
a streaming DataFrame (``readStream``) or, as its batch twin, on a static
one. Stateful operators (``applyInPandasWithState``) handle each key's rows in
event-time order behind a watermark; a key's state is its own few fields and
the rows that may still be overtaken, lies with those of its group of keys, and goes when the key rests. The classes
here run on the executors, which need the package on their path (a wheel or
``--py-files``).

Event time: ``events.ts`` is TIMESTAMP_NTZ, which ``withWatermark``
rejects, so sources cast it to TIMESTAMP (session time zone UTC).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ensure_checkpoint_dir

# ---------------------------------------------------------------------------
# sources and sinks
# ---------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", max_files: int = 1) -> DataFrame:
    """Stream the rows of a provided table (new files in its folder are
    picked up as they arrive); ``ts`` cast to TIMESTAMP for watermarks."""
    folder = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # A streaming file source watches a folder; the glob keeps it to this
    # table's files (an event log folder would simply be streamed whole).
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
         .option("pathGlobFilter", f"{table}*.parquet").parquet(folder))
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def run_to_table(stream: DataFrame, name: str, mode: str = "append", fmt: str = "parquet",
                 partition_by: list[str] | None = None) -> DataFrame:
    """Run a stream to completion (``availableNow``) into files under the
    shared checkpoint folder and return the written table. The checkpoint
    makes the run restartable after a lost executor or driver."""
    spark = stream.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/stream-{name}-{uuid.uuid4().hex[:10]}"
    w = (stream.writeStream.format(fmt).outputMode(mode)
         .option("checkpointLocation", f"{run}/_checkpoint").option("path", f"{run}/data"))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    reader = spark.read.format(fmt)
    if fmt == "json":
        return reader.json(f"{run}/data")
    return reader.load(f"{run}/data")


def latest(out: DataFrame, keys: list[str], rising: str) -> DataFrame:
    """Of an append-only table of a key's successive rows, the one with the
    largest ``rising`` value."""
    rest = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), rising).alias("_l")).select(*keys, "_l.*")


def run_updates(stream: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Run an update-mode stream to completion; every micro-batch's updates
    are appended with their batch id (``foreachBatch``), and the latest
    update per key is returned."""
    spark = stream.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/stream-{name}-{uuid.uuid4().hex[:10]}"

    def sink(df: DataFrame, batch_id: int) -> None:
        df.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(f"{run}/data")

    q = (stream.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{run}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{run}/data")
    cols = [c for c in out.columns if c not in key and c != "_batch"]
    latest = out.groupBy(*key).agg(F.max_by(F.struct(*cols), "_batch").alias("_l"))
    return latest.select(*key, *[F.col(f"_l.{c}").alias(c) for c in cols])


# ---------------------------------------------------------------------------
# stateless / windowed operators (same code for stream and batch)
# ---------------------------------------------------------------------------


def daily_log(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the UTC day label used to partition the append log."""
    return events.withColumn("log_date", F.date_format(F.col(ts), "yyyy-MM-dd"))


def progress_counters(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Running count per progress event kind."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", delay: str = "1 hour",
                    size: str = "1 day") -> DataFrame:
    """Tumbling per-day counts and value sums; rows later than the
    watermark delay are dropped in streaming (no-op in batch)."""
    w = events.withWatermark(ts, delay)
    g = w.groupBy(F.window(ts, size).alias("win"), key).agg(F.count(F.lit(1)).alias("n"),
                                                             F.sum("value").alias("value_sum"))
    return g.select(F.col("win.start").alias("window_start"), F.col("win.end").alias("window_end"), key, "n",
                    F.round("value_sum", 6).alias("value_sum"))


def session_expiry(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes",
                   delay: str = "1 hour") -> DataFrame:
    """L3: sessions per key; a session closes once idle for ``gap`` and is
    emitted when the watermark passes its end."""
    w = events.withWatermark(ts, delay)
    g = w.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events"),
                                                                  F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return g.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "n_events", "first_ts", "last_ts")


# ---------------------------------------------------------------------------
# batch twins of stateful operators
# ---------------------------------------------------------------------------


def health_transitions(events: DataFrame, key: str, order: list[str], is_up) -> DataFrame:
    """L11 (batch): rows where a provider's up/down state changes (the first
    observation counts as a change). Providers are few, so each is a hot
    key: positions come from ``rank_within``'s time buckets and the previous observation is an equi join on (provider, position - 1)
    rather than a ``lag`` over one provider's whole history in one task."""
    from ..operators.ranking import rank_within

    s = rank_within(events.withColumn("up", is_up), key, list(order), "_p")
    prev = s.select(F.col(key), (F.col("_p") + 1).alias("_p"), F.col("up").alias("_prev"))
    j = s.join(prev, [key, "_p"], "left")
    return j.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("up"))).drop("_prev", "_p")


def conversations_batch(req: DataFrame, key: str = "request_id", order: tuple[str, ...] = ("ts", "event_id")) -> tuple[DataFrame, DataFrame]:
    """L1 (batch twin): a 'start' opens a conversation, 'provider_call' rows
    are numbered calls, the first 'final' or 'error' closes it. Rows with no
    open conversation are rejected. Returns (conversations, rejects)."""
    from ..operators.ranking import running

    hour = F.date_trunc("hour", order[0])
    r = running(req, [key], list(order), F.when(F.col("kind") == "start", 1).otherwise(0), "sum", hour, "conv_no")
    term = F.col("kind").isin("final", "error")
    # Terminal rows seen in this conversation before (and including) the row.
    r = running(r, [key, "conv_no"], list(order), F.when(term, 1).otherwise(0), "sum", hour, "_terms")
    r = r.withColumn("_prev_terms", F.col("_terms") - F.when(term, 1).otherwise(0))
    active = (F.col("conv_no") > 0) & (F.col("_prev_terms") == 0)
    rejects = r.where(~active).select(key, *order, "kind")
    ok = r.where(active)
    conv = ok.groupBy(key, "conv_no").agg(
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("start_ts"),
        F.sum(F.when(F.col("kind") == "provider_call", 1).otherwise(0)).cast("bigint").alias("n_calls"),
        F.max(F.when(term, F.col("kind"))).alias("end_kind"),
        F.max(F.when(term, F.col("ts"))).alias("end_ts"))
    dur = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000.0
    return conv.withColumn("duration_ms", F.when(F.col("end_ts").isNotNull(), dur)), rejects


# ---------------------------------------------------------------------------
# stateful streaming operators
# ---------------------------------------------------------------------------

#: How late a row may come, and how long a key may rest before its state goes.
DELAY, IDLE = "1 hour", "60 days"


#: Groups that the keys of a stream are dealt over. A call of a group's function costs about as
#: much as some hundred keys, so that it is the groups, not the keys, that are called.
BUCKETS = 4096

#: Arrow types of keys, of their own fields and of what rows carry besides their time and id.
ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "timestamp": pa.timestamp("us")}
ARROW |= {f"array<{t}>": pa.list_(ARROW[t]) for t in ("string", "double", "long")}


def _schema(ddl: str) -> list[tuple[str, pa.DataType]]:
    return [(name, ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))]


def _bytes(table: pa.Table) -> bytes | None:
    """A table in Arrow's stream format; None if it has no rows."""
    if not len(table):
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _table(saved: bytes | None, schema: pa.Schema) -> pa.Table:
    return pa.ipc.open_stream(bytes(saved)).read_all() if saved else schema.empty_table()


class InOrder:
    """Keyed processing in event-time order.

    Rows wait in the state until the watermark has passed them and are
    then handled in (ts, event_id) order, whatever batches, files or Arrow
    frames they came in; later rows than the delay allows are dropped by the
    watermark. ``step(key, state, rows)`` and ``tick(key, state, watermark)``
    (which does nothing before ``due(state)``) return (state, output
    rows). A key that rests for ``idle`` is ticked once more and forgotten.

    Keys are dealt over ``BUCKETS`` groups. State per group: an Arrow table in bytes of its
    keys (the operator's own fields, when it was last handled, how many rows wait), and one of the rows
    inside the delay, key by key.
    """

    #: Rows that a step takes at once; None: all that are ready.
    piece: int | None = None
    #: Rows that are taken out of Arrow at once, but for a longer step.
    rows_at_once = 20_000

    def __init__(self, key: str, fields: str, out: str, payload: list[tuple[str, str]], idle: str = IDLE):
        self.key, self.fields, self.out, self.payload = key, fields, out, payload
        self.idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, key, state, rows) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def tick(self, key, state, watermark: pd.Timestamp, idle: bool) -> tuple[tuple, list[tuple]]:
        return state, []

    def due(self, state) -> pd.Timestamp | None:
        return None

    def pieces(self, rows: pa.Table, cuts: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
        """(run, its rows as tuples) of the runs between cuts: each whole, or ``piece`` rows at a time where
        a step is a plain fold. Short runs leave Arrow together."""
        def tuples(lo: int, hi: int) -> list[tuple]:
            # Null doubles are NaN, as in a frame.
            return list(zip(*(c.to_numpy().tolist() if pa.types.is_floating(c.type) else c.to_pylist() for c in rows.slice(lo, hi - lo).columns)))

        run = 0
        while run < len(cuts) - 1:
            lo = int(cuts[run])
            end = max(run + 1, int(np.searchsorted(cuts, lo + self.rows_at_once, side="right")) - 1)
            if end == run + 1:
                hi = int(cuts[end])
                for at in range(lo, hi, self.piece or hi - lo):
                    yield run, tuples(at, min(hi, at + (self.piece or hi - lo)))
            else:
                part, at = tuples(lo, int(cuts[end])), (cuts[run:end + 1] - lo).tolist()
                yield from ((run + i, part[at[i]:at[i + 1]]) for i in range(end - run))
            run = end

    def __call__(self, group, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        key_type = _schema(self.out)[0][1]
        schema = pa.schema([("ts", pa.timestamp("us")), ("event_id", pa.int64()), *[(c, ARROW[t]) for c, t in self.payload]])
        fresh = pa.schema([*schema, (self.key, key_type)])
        own = _schema(self.fields)
        kept = pa.schema([(self.key, key_type), *own, ("last_ms", pa.int64()), ("waits", pa.int64())])
        saved = state.get if state.exists else (None, None)
        held, waiting = _table(saved[0], kept), _table(saved[1], schema)
        # Frames without the key's column are of one key, the group.
        came = [pdf if self.key in pdf else pdf.assign(**{self.key: group[0]}) for pdf in pdfs if len(pdf)]
        came = [pa.Table.from_pandas(pdf[fresh.names], fresh, preserve_index=False) for pdf in came]
        new = pa.concat_tables(came) if came else fresh.empty_table()

        # Keys are numbered: those of the state, then new ones.
        coded = pa.chunked_array([*held[self.key].chunks, *new[self.key].chunks], key_type).combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        # Null keys have a group of their own.
        shown = [None] * len(names) if pd.isna(group[0]) else names
        codes = coded.indices.to_numpy().astype(np.int64)
        codes = np.concatenate([np.repeat(codes[:len(held)], held["waits"].to_numpy()), codes[len(held):]])
        rows = pa.concat_tables([waiting, new.select(schema.names)]).append_column("_k", pa.array(codes))
        rows = rows.sort_by([("_k", "ascending"), ("ts", "ascending"), ("event_id", "ascending")])
        codes, rows = rows["_k"].to_numpy(), rows.drop_columns("_k")
        us = pc.fill_null(rows["ts"].cast(pa.int64()), np.iinfo(np.int64).max).to_numpy()
        more = len(names) - len(held)
        states = [*(zip(*(held[c].to_pylist() for c, _ in own))), *(self.start() for _ in range(more))]
        last = [*held["last_ms"].to_pylist(), *[None] * more]

        now_ms = state.getCurrentWatermarkMs()
        now = pd.Timestamp(now_ms, unit="ms")
        late = us > now_ms * 1000
        ready, ready_codes, at = rows.filter(pa.array(~late)), codes[~late], us[~late] // 1000
        # A key that has rested for too long starts anew.
        turns = (np.diff(ready_codes) != 0) | (np.diff(at) >= self.idle_ms)
        cuts = np.concatenate([[0], np.flatnonzero(turns) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
        first, final, of = at[cuts[:-1]].tolist(), at[cuts[1:] - 1].tolist(), ready_codes[cuts[:-1]].tolist()
        columns = [c for c, _ in _schema(self.out)]
        full: list[pd.DataFrame] = []
        out: list[tuple] = []
        for run, piece in self.pieces(ready, cuts):
            k = of[run]
            if last[k] and first[run] >= last[k] + self.idle_ms:
                states[k] = self.start()
            states[k], made = self.step(shown[k], states[k], piece)
            last[k] = final[run]
            out += made
            if len(out) >= self.rows_at_once // 4:
                full.append(pd.DataFrame(out, columns=columns))
                out = []

        rows, codes, us = rows.filter(pa.array(late)), codes[late], us[late]
        waits = np.bincount(codes, minlength=len(names)).tolist()
        alive: list[int] = []
        times = [int(us.min() // 1000) - 1] if len(us) else []
        for k, name in enumerate(shown):
            resting = not waits[k] and bool(last[k]) and now_ms >= last[k] + self.idle_ms
            states[k], made = self.tick(name, states[k], now, resting)
            out += made
            if resting:
                continue
            alive.append(k)
            if not waits[k]:
                times.append(last[k] + self.idle_ms - 1)
            if (due := self.due(states[k])) is not None:
                times.append(int(due.value // 1_000_000) - 1)
        if out or not full:
            full.append(pd.DataFrame(out, columns=columns))
        if alive:
            fields = zip(*(states[k] for k in alive))
            held = pa.table([pa.array([names[k] for k in alive], key_type), *(pa.array(list(v), t) for v, (_, t) in zip(fields, own)),
                             pa.array([last[k] for k in alive], pa.int64()), pa.array([waits[k] for k in alive], pa.int64())], schema=kept)
            state.update((_bytes(held), _bytes(rows)))
            state.setTimeoutTimestamp(max(min(times), now_ms + 1))
        else:
            state.remove()
        yield from full

    def run(self, rows: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
        key = F.col(keys[0])
        none = F.lit(0 if _schema(self.out)[0][1] == pa.int64() else "")
        bucket = F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
        r = rows.select(bucket.alias("_bucket"), F.coalesce(key, none).alias(self.key), "ts", "event_id", *(c for c, _ in self.payload))
        return r.withWatermark("ts", delay).groupBy("_bucket").applyInPandasWithState(
            self, self.out, "keys binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def _ms(t0, t1) -> float:
    """Milliseconds between two timestamps, from whole microseconds."""
    return ((pd.Timestamp(t1) - pd.Timestamp(t0)) // pd.Timedelta(microseconds=1)) / 1000.0


class Conversations(InOrder):
    """A 'start' opens a conversation, calls are counted, 'final' or 'error'
    closes and emits it; rows without an open one are emitted as rejected."""

    def __init__(self):
        super().__init__("request_id", "conv_no long, active boolean, start_ts timestamp, n_calls long",
                         "request_id long, conv_no long, start_ts timestamp, n_calls long, end_kind string, end_ts timestamp, duration_ms double, rejected boolean",
                         [("kind", "string")])

    def start(self):
        return 0, False, None, 0

    def step(self, key, state, rows):
        conv_no, active, start_ts, n_calls = state
        out = []
        for ts, _, kind in rows:
            if kind == "start":
                conv_no, active, start_ts, n_calls = conv_no + 1, True, ts, 0
            elif not active:
                out.append((key, conv_no, None, None, kind, ts, None, True))
            elif kind == "provider_call":
                n_calls += 1
            else:
                out.append((key, conv_no, start_ts, n_calls, kind, ts, _ms(start_ts, ts), False))
                active = False
        return (conv_no, active, start_ts, n_calls), out


def conversations_stream(req: DataFrame, key: str = "request_id") -> DataFrame:
    """L1 (stream): conversation assembly; closed conversations and rejected
    rows are emitted as they complete."""
    return Conversations().run(req, [key])


class Packing(InOrder):
    """Requests in batches that close when full, when the next request comes
    too long after the first, or when the watermark shows that time is up."""

    piece = 20_000

    def __init__(self, max_size: int, max_wait: str):
        super().__init__("group_key", "batch_no long, first_ts timestamp, size long, last_ts timestamp",
                         "group_key string, batch_no long, first_ts timestamp, size long, wait_ms double", [])
        self.max_size, self.max_wait = max_size, pd.Timedelta(max_wait)

    def start(self):
        return 0, None, 0, None

    def due(self, state):
        return pd.Timestamp(state[1]) + self.max_wait if state[2] else None

    def close(self, key, state):
        batch_no, first, size, last = state
        return (batch_no + 1, None, 0, None), (key, batch_no, first, size, _ms(first, last))

    def step(self, key, state, rows):
        out = []
        for ts, _ in rows:
            if state[2] and pd.Timestamp(ts) >= self.due(state):
                state, row = self.close(key, state)
                out.append(row)
            state = (state[0], state[1] if state[2] else ts, state[2] + 1, ts)
            if state[2] == self.max_size:
                state, row = self.close(key, state)
                out.append(row)
        return state, out

    def tick(self, key, state, watermark, idle):
        if state[2] and watermark >= self.due(state):
            state, row = self.close(key, state)
            return state, [row]
        return state, []


def batch_packing_stream(req: DataFrame, key: str, max_size: int = 4, max_wait: str = "1 hour") -> DataFrame:
    """L4 (stream): pack requests per ``model:approach`` into batches of
    ``max_size`` or ``max_wait`` after the batch's first one."""
    return Packing(max_size, max_wait).run(req, [key])


def batch_packing_stats(batches: DataFrame, key: str = "group_key") -> DataFrame:
    """L4 stats: closed batches, mean size and mean wait per group."""
    return batches.groupBy(key).agg(F.count(F.lit(1)).alias("n_batches"),
                                    F.round(F.avg("size"), 9).alias("mean_size"),
                                    F.round(F.avg("wait_ms"), 6).alias("mean_wait_ms"))


class Ledger(InOrder):
    """EMA ledger: attempts, successes and confidence after the rows so far."""

    def __init__(self, alpha: float, first: float):
        super().__init__("strategy_id", "attempts long, successes long, confidence double",
                         "strategy_id long, attempts long, successes long, confidence double", [("success", "boolean")])
        self.alpha, self.first = alpha, first

    def start(self):
        return 0, 0, self.first

    def step(self, key, state, rows):
        n, s, c = state
        for _, _, success in rows:
            n, s = n + 1, s + int(bool(success))
            c = (1 - self.alpha) * c + self.alpha * (1.0 if success else 0.0)
        return (n, s, c), [(key, n, s, c)]


def ema_ledger_stream(attempts: DataFrame, alpha: float = 0.1, start: float = 0.5) -> DataFrame:
    """The EMA strategy ledger; a key's row with the most attempts is its latest."""
    return Ledger(alpha, start).run(attempts, ["strategy_id"])


class Consensus(InOrder):
    """Traces used until an answer's share reaches the threshold after the warm-up."""

    def __init__(self, warmup: int, threshold: float):
        super().__init__("question_id", "seen long, done boolean, answers array<string>, counts array<long>",
                         "question_id long, traces_used long, consensus_reached boolean", [("answer", "string")])
        self.warmup, self.threshold = warmup, threshold

    def start(self):
        return 0, False, [], []

    def step(self, key, state, rows):
        seen, done, answers, counts = state
        if done:
            return state, []
        votes = dict(zip(answers, (int(c) for c in counts)))
        for _, _, answer in rows:
            seen += 1
            votes[answer] = votes.get(answer, 0) + 1
            if seen > self.warmup and max(votes.values()) / seen >= self.threshold:
                done = True
                break
        return (seen, done, list(votes), list(votes.values())), [(key, seen, done)]


def online_consensus_stream(traces: DataFrame, warmup: int, threshold: float = 0.95) -> DataFrame:
    """Online consensus stop; the number of distinct answers bounds the state."""
    return Consensus(warmup, threshold).run(traces, ["question_id"])


class Trace(InOrder):
    """First position whose mean over the last ``window`` confidences is below
    the threshold; the running sum moves by one token at a time."""

    def __init__(self, window: int, min_length: int, threshold: float):
        super().__init__("trace_id", "n long, stop long, ring array<double>",
                         "trace_id long, stop_pos long, num_tokens long, terminated_early boolean", [("token_confidence", "double")])
        self.window, self.min_length, self.threshold = window, min_length, threshold

    def start(self):
        return 0, -1, []

    def step(self, key, state, rows):
        from collections import deque

        n, stop, ring = state
        if stop >= 0:
            return state, []
        held = deque((float(x) for x in ring), maxlen=self.window)
        total = sum(held)
        for _, _, value in rows:
            total += float(value) - (held[0] if len(held) == self.window else 0.0)
            held.append(float(value))
            if n >= self.min_length and len(held) == self.window and total / self.window < self.threshold:
                stop = n
                break
            n += 1
        return (n, stop, list(held)), [(key, stop if stop >= 0 else None, n, stop >= 0)]


def online_trace_stream(tokens: DataFrame, window: int, min_length: int, threshold: float) -> DataFrame:
    """Online group confidence with a ring of the last ``window`` token
    confidences per trace."""
    return Trace(window, min_length, threshold).run(tokens, ["trace_id"])


class Health(InOrder):
    """A row whenever a provider's up/down state changes."""

    piece = 20_000

    def __init__(self):
        super().__init__("provider", "up boolean", "provider string, event_id long, ts timestamp, up boolean", [("up", "boolean")])

    def start(self):
        return (None,)

    def step(self, key, state, rows):
        prev, out = state[0], []
        for ts, event_id, up in rows:
            if prev is None or bool(up) != prev:
                out.append((key, event_id, ts, bool(up)))
            prev = bool(up)
        return (prev,), out


def health_transitions_stream(events: DataFrame) -> DataFrame:
    """L11 (stream): emit a row whenever a provider's up/down state changes."""
    return Health().run(events, ["provider"])


class Reuse(InOrder):
    """The first request of a signature passes, and every one that comes more
    than the horizon after the last that passed."""

    piece = 20_000

    def __init__(self, horizon: str):
        super().__init__("signature", "kept timestamp", "signature string, event_id long, ts timestamp", [])
        self.horizon = pd.Timedelta(horizon).to_pytimedelta()

    def start(self):
        return (None,)

    def step(self, key, state, rows):
        kept, out = state[0], []
        for ts, event_id in rows:
            if kept is None or ts > kept + self.horizon:
                kept = ts
                out.append((key, event_id, ts))
        return (kept,), out


def dedupe_within_horizon(requests: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Response-cache reuse: requests (signature, event_id, ts) that are not
    served from a response at most ``horizon`` old."""
    return Reuse(horizon).run(requests, ["signature"])
