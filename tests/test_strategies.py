"""Every strategy of the table is a query and an item; the blocks of H14-H16 and H18."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tests.test_retrieval import brute
from tests.test_similarity import cosine
from verity.operators import retrieval as RT
from verity.operators import similarity as SM
from verity.plans import catalog

KEYS = ("h14_similar_strategies", "h15_best_similar", "h15_best_similar_examples", "h16_create_or_update")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Types of 30, 12, 4 and 1 strategies, with exact copies, a text without words and ids that 20 divides or not."""
    rng = random.Random(3)
    text = lambda k: " ".join(f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(k))
    rows = [(i, text(rng.randint(3, 30)), "en", "large" if i < 30 else "full" if i < 42 else "few" if i < 46 else "one", 0) for i in range(47)]
    rows[7] = (7, rows[22][1], *rows[7][2:])
    rows[9] = (9, rows[10][1] + " " + rows[11][1], *rows[9][2:])
    rows[33] = (33, "? !", *rows[33][2:])
    at = tmp_path_factory.mktemp("strategies")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at), rows


@pytest.mark.parametrize("key", KEYS)
def test_every_strategy_is_a_query(spark, folder, key):
    at, rows = folder
    got = sorted(map(tuple, catalog.queries()[key](spark, at).collect()))
    asked = {r[0] for r in got}
    assert asked >= {r[0] for r in rows if r[3] == "large"}
    if key == "h16_create_or_update":
        assert asked == set(range(47))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(catalog.oracle_sql()[key]).fetchall())


def test_similar_strategies_against_every_pair(spark, folder):
    at, rows = folder
    strategies = [(r[3], r[0], r[1]) for r in rows]
    got = catalog.queries()["h14_similar_strategies"](spark, at).collect()
    assert sorted(map(tuple, got)) == brute(strategies, strategies, 3, True)


def test_waves_of_blocks(spark, monkeypatch):
    """Blocks that meet in several waves, items as queries: keys on two rows, without a key, copies in every block."""
    for name, size in (("ITEMS", 16), ("QUERIES", 8), ("WAVE", 1)):
        monkeypatch.setattr(RT, name, size)
    rng = random.Random(8)
    text = lambda k: " ".join(f"w{int(rng.paretovariate(0.4)) % 900}" for _ in range(k))
    items = [("m", i, text(rng.randint(1, 40))) for i in range(90)]
    items += [("m", 200 + i, items[0][2]) for i in range(30)] + [("o", i, text(9)) for i in range(5)]
    d = spark.createDataFrame(items, "mem string, i long, text string").repartition(3)
    got = RT.retrieve(d, None, "mem", "i", "text", "q", "text", 3, others=True).collect()
    assert sorted(map(tuple, got)) == brute(items, items, 3, True)
    waves = RT._best_in_blocks(RT.bags(d, "mem", "i", "text"), None, "mem", 3, True)
    assert sum(w.count() > 0 for w in waves) > 1
    # The rows of a key are one item, a memory without a name is none.
    cut = [("m", i, t) for i, t in ((5, items[5][2]), (5, items[6][2]), (7, items[7][2]), (8, items[6][2] + " " + items[5][2]))]
    twice = spark.createDataFrame([*cut, (None, 9, items[5][2])], "mem string, i long, text string")
    best = RT._best_in_blocks(RT.bags(twice, "mem", "i", "text"), None, "mem", 1, True)
    assert {(r._q, r._i) for w in best for r in w.collect() if round(r.score, 9) == 1} == {(5, 8), (8, 5)}


@pytest.mark.parametrize("heavy, tile, cells, chunk", [(3, 5, 64, 7), (0, 2, 1, 2), (512, 256, 1 << 16, 2048)])
def test_block_finds_what_all_pairs_find(monkeypatch, heavy, tile, cells, chunk):
    """However few terms are dense and however few vectors are taken at once, and with equal texts among items and queries."""
    for name, size in (("HEAVY", heavy), ("TILE", tile), ("CELLS", cells), ("CHUNK", chunk)):
        monkeypatch.setattr(RT, name, size)
    rng = random.Random(heavy)
    text = lambda k: " ".join(f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(k))
    items = [("m", i, text(rng.randint(1, 30))) for i in range(70)] + [("m", 100 + i, "w1 w2 w3") for i in range(9)]
    queries = [("m", i, text(rng.randint(1, 20))) for i in range(30)] + [("m", 100 + i, "w3 w1 w2") for i in range(4)] + [("m", 500, "unknown")]
    bags = lambda rows: [(i, sorted(Counter(hash(w) for w in t.split()).items())) for _, i, t in rows]
    df = sorted(Counter(w for _, bag in bags(items) for w, _ in bag).items())
    lists = pa.list_(pa.int64()), pa.list_(pa.int32())
    rows = lambda keys, bags, n: pa.table({"mem": ["m"] * len(bags), "a": pa.array([0] * len(bags)), "_k": pa.array(keys, pa.int64()),
                                           "ids": pa.array([[w for w, _ in b] for b in bags], lists[0]),
                                           "c": pa.array([[c for _, c in b] for b in bags], lists[1]), "_rows": pa.array([n] * len(bags), pa.int64())})
    packed = pa.schema([("mem", pa.string()), ("a", pa.int64()), ("keys", pa.list_(lists[0])), ("lens", lists[1]), ("l", pa.list_(pa.float64())),
                        ("ranks", pa.binary()), ("counts", pa.binary()), ("ends", lists[1]), ("idfs", pa.list_(pa.float64()))])
    sides = []
    for side, given in enumerate((items, queries)):
        keys, each = zip(*bags(given))
        batches = [b for t in (rows([None], [df], len(items)), rows(keys, each, None)) for b in t.to_batches()]
        t = pa.Table.from_batches(RT._packer("mem", packed, 64)(iter(batches)))
        sides.append(t.append_column("side", pa.array([side] * len(t))))
    out = pa.schema([("mem", pa.string()), ("_q", pa.int64()), ("_i", pa.int64()), ("_s", pa.float64())])
    for n in (1, 3):
        got = RT._best_of_block(n, True, "mem", out)(pa.concat_tables(sides)).to_pylist()
        want = [x for x in brute(items, queries, n, True) if x[3] > 0]
        assert sorted((r["_q"], r["_i"], round(r["_s"], 9)) for r in got) == sorted((q, i, s) for q, _, i, s in want)


def test_merge_in_waves(spark, monkeypatch):
    """Blocks that meet in many waves merge what one wave merges; equal texts, rows that come twice, a null text and kind."""
    rng = random.Random(21)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for group in range(60):
        base = rng.sample(words, 20)
        for _ in range(rng.randint(1, 4)):
            rows.append((len(rows), f"t{group % 2}", " ".join(w if rng.random() > 0.12 else rng.choice(words) for w in base)))
    rows += [(200 + i, "t0", rows[0][2]) for i in range(3)] + [rows[5], (300, "t1", None), (301, None, "some words"), (302, "t1", "- !")]
    df = spark.createDataFrame([(*r, 1, 2, r[0], r[0], 0.5) for r in rows], "strategy_id long, problem_type string, strategy_text string, success_count long, "
                               "total_attempts long, created_at long, last_used long, confidence double")
    merged = lambda: sorted(map(tuple, SM.merge_similar_strategies(df, "problem_type", "strategy_id", "strategy_text").collect()))
    whole = merged()
    waves = []
    stored = SM.stored
    for name, size in (("HUBS", 4), ("BLOCK", 16), ("WAVE", 1)):
        monkeypatch.setattr(SM, name, size)
    monkeypatch.setattr(SM, "stored", lambda d: (waves.append(1) if d.columns == ["a", "b"] else None, stored(d))[1])
    assert merged() == whole and len(waves) > 4
    assert sum(r[3] for r in whole) == len(rows) - 2 and any(r[3] > 1 for r in whole)
    label = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if a[1] and a[1] == b[1] and a[2] and b[2] and label[i] != label[j] and (a[2] == b[2] or cosine(a[2], b[2]) >= 0.6):
                label = [label[j] if x == label[i] else x for x in label]
    assert len(whole) == len({x for x, r in zip(label, rows) if r[1] and r[2]})
