"""Stateful streams over several files in any order, late rows, idle state."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verity.session import ensure_checkpoint_dir
from verity.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1)


def events(n=4000, users=12, seed=3):
    rng = random.Random(seed)
    at, out = T0, []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 5, 90, 400]))
        out.append((i, at, rng.randrange(users), rng.choice(["signup", "click", "view", "purchase", "error"]), rng.uniform(0, 500)))
    return out


@pytest.fixture
def streamed(spark, tmp_path):
    """Rows as a stream of several files whose rows overlap in time by less than the delay."""
    def make(rows, files, delay=dt.timedelta(minutes=50)):
        rng = random.Random(7)
        shuffled = sorted(rows, key=lambda r: r[1] + rng.random() * delay)  # rows come up to ``delay`` late
        cut = -(-len(rows) // files)
        for i in range(files):
            part = shuffled[i * cut:(i + 1) * cut]
            rng.shuffle(part)
            spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string, value double") \
                .coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
        schema = spark.read.parquet(str(tmp_path / "in/000")).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    return make


def watermark(rows):
    top = max(r[1] for r in rows)
    return top - dt.timedelta(hours=1, microseconds=top.microsecond % 1000)


@pytest.mark.parametrize("files", [1, 6])
def test_packing_against_a_loop(streamed, files):
    rows = events()
    end, wait = watermark(rows), dt.timedelta(hours=1)
    want, state = set(), {}
    for i, ts, user, *_ in sorted((r for r in rows if r[1] <= end), key=lambda r: (r[1], r[0])):
        key = f"g{user % 3}"
        no, batch = state.get(key, (0, []))
        if batch and ts >= batch[0] + wait:
            want.add((key, no, batch[0], len(batch)))
            no, batch = no + 1, []
        batch = [*batch, ts]
        if len(batch) == 4:
            want.add((key, no, batch[0], 4))
            no, batch = no + 1, []
        state[key] = (no, batch)
    want |= {(k, no, b[0], len(b)) for k, (no, b) in state.items() if b and b[0] + wait <= end}
    s = streamed(rows, files).select(F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("group_key"), "event_id", "ts")
    got = ST.run_to_table(ST.batch_packing_stream(s, "group_key", 4, "1 hour"), "t4").collect()
    assert {(r.group_key, r.batch_no, r.first_ts, r.size) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("files", [1, 6])
def test_ledger_trace_and_health_against_loops(streamed, files):
    rows = events()
    end = watermark(rows)
    ordered = sorted((r for r in rows if r[1] <= end), key=lambda r: (r[1], r[0]))
    s = streamed(rows, files)
    ema, prev, changes = {}, {}, set()
    for i, ts, user, kind, _ in ordered:
        n, ok, c = ema.get(user, (0, 0, 0.5))
        ema[user] = (n + 1, ok + (kind == "purchase"), 0.9 * c + 0.1 * (kind == "purchase"))
        if prev.get(user) != (kind != "error"):
            changes.add((i, kind != "error"))
        prev[user] = kind != "error"
    out = ST.run_to_table(ST.ema_ledger_stream(s.select(F.col("user_id").alias("strategy_id"), "event_id", "ts",
                                                        (F.col("event_type") == "purchase").alias("success"))), "t8")
    got = {r.strategy_id: (r.attempts, r.successes, r.confidence) for r in ST.latest(out, ["strategy_id"], "attempts").collect()}
    assert got.keys() == ema.keys()
    for k, (n, ok, c) in ema.items():
        assert got[k][:2] == (n, ok) and abs(got[k][2] - c) < 1e-9
    h = s.select(F.col("user_id").cast("string").alias("provider"), "event_id", "ts", (F.col("event_type") != "error").alias("up"))
    assert {(r.event_id, r.up) for r in ST.run_to_table(ST.health_transitions_stream(h), "t11").collect()} == changes


def test_idle_state_goes(streamed):
    """A signature that rests for longer than the idle time is forgotten; its key starts anew."""
    rows = [(0, T0, 1, "a", 0.0), (1, T0 + dt.timedelta(days=100), 2, "a", 0.0), (2, T0 + dt.timedelta(days=100, hours=2), 1, "a", 0.0),
            (3, T0 + dt.timedelta(days=101), 2, "a", 0.0)]
    s = streamed(rows, 4, dt.timedelta(0)).select(F.col("user_id").alias("strategy_id"), "event_id", "ts", F.lit(True).alias("success"))
    got = [(r.strategy_id, r.attempts) for r in ST.run_to_table(ST.ema_ledger_stream(s), "idle").collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 1)]


def test_checkpoint_folder_is_required_off_local_mode():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

        @property
        def sparkContext(self):
            raise RuntimeError

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


class _State:
    """What ``InOrder`` uses of a key's state."""

    def __init__(self):
        self.exists, self.get, self.watermark = False, None, 0

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms


def test_waiting_rows_are_bytes_and_handled_in_pieces():
    """50,000 waiting rows of one key are under 20 bytes each in its state, and come out in order over several steps."""
    import pandas as pd

    from verity.streaming import streams as ST

    n = 50_000
    order = [(i * 7919) % n for i in range(n)]
    up = lambda i: i // 3 % 2 == 0
    pdf = pd.DataFrame({"provider": "p", "event_id": order, "ts": pd.to_datetime([1_700_000_000_000 + i for i in order], unit="ms"), "up": [up(i) for i in order]})
    health, state = ST.Health(), _State()
    assert sum(len(x) for x in health(("p",), iter([pdf[:30_000], pdf[30_000:]]), state)) == 0
    assert isinstance(state.get[-1], bytes) and len(state.get[-1]) < 20 * n
    state.watermark = 1_700_000_000_000 + n - 101
    frames = list(health(("p",), iter([]), state))
    got = pd.concat(frames)
    assert len(frames) > 1 and got.event_id.tolist() == list(range(0, n - 100, 3)) and got.up.tolist() == [up(i) for i in range(0, n - 100, 3)]
    packing, state = ST.Packing(4, "1 hour"), _State()
    list(packing(("g",), iter([pdf]), state))
    state.watermark = 1_700_000_000_000 + n
    got = pd.concat(packing(("g",), iter([]), state))
    assert got["size"].tolist() == [4] * (n // 4) and got.batch_no.tolist() == list(range(n // 4)) and set(got.wait_ms) == {3.0}


def _reused(rows, end):
    """(signature, event_id) that pass: a loop over all requests up to ``end``."""
    kept, out = {}, []
    for i, ts, signature in sorted((r for r in rows if r[1] <= end), key=lambda r: (r[1], r[0])):
        if signature not in kept or ts > kept[signature] + dt.timedelta(days=1):
            kept[signature] = ts
            out.append((signature, i))
    return sorted(out, key=str)


def test_many_keys_in_one_call():
    """One call handles the rows of 2,000 signatures in order, from a state of two tables."""
    import pandas as pd

    rng = random.Random(5)
    rows = [(i, T0 + dt.timedelta(seconds=rng.randrange(20 * 86_400)), f"s{rng.randrange(2_000)}") for i in range(9_000)]
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "signature"])
    reuse, state, got = ST.Reuse("1 day"), _State(), []
    for day, part in ((6, pdf[:4_000]), (13, pdf[4_000:]), (19, pdf[:0])):
        # Rows of the second part may be older than those handled in the first: keep those that may still come.
        part = part[part.ts > pd.Timestamp(state.watermark, unit="ms")]
        rows = [r for r in rows if r[0] < 4_000 or r[1] > pd.Timestamp(state.watermark, unit="ms") or day != 13]
        state.watermark = int(pd.Timestamp(T0 + dt.timedelta(days=day)).value // 1_000_000)
        got += [(r.signature, r.event_id) for f in reuse((0,), iter([part[:1_500], part[1_500:]]), state) for r in f.itertuples()]
    assert sorted(got, key=str) == _reused(rows, T0 + dt.timedelta(days=19))
    assert len(state.get) == 2 and all(isinstance(x, bytes) for x in state.get)


def test_reuse_of_null_and_shared_buckets(streamed, monkeypatch):
    monkeypatch.setattr(ST, "BUCKETS", 3)
    rows = [(i, ts + dt.timedelta(hours=i // 40), user, kind, value) for i, ts, user, kind, value in events(1500, 20)]
    signature = F.when(F.col("user_id") == 3, F.lit(None)).when(F.col("user_id") == 4, "").otherwise(F.col("user_id").cast("string"))
    s = streamed(rows, 3).select(signature.alias("signature"), "event_id", "ts")
    got = ST.run_to_table(ST.dedupe_within_horizon(s, "1 day"), "reuse").collect()
    plain = [(i, ts, None if user == 3 else "" if user == 4 else str(user)) for i, ts, user, *_ in rows]
    assert sorted(((r.signature, r.event_id) for r in got), key=str) == _reused(plain, watermark(rows))
