"""Every registered query against its DuckDB oracle (or a row-count smoke
check when it has none), on the smallest provided tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check_oracle import OTHER_TESTS, compare
from tests.conftest import SF_SMALL
from verity.plans import catalog

QUERIES = catalog.queries()
SQLS = catalog.oracle_sql()


def test_every_query_is_checked():
    assert set(QUERIES) - set(SQLS) == set(OTHER_TESTS)
    for where in OTHER_TESTS.values():
        module, name = where.split(".")
        assert hasattr(__import__(f"tests.{module}", fromlist=[name]), name)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    line, ok = compare(spark, duck, key, QUERIES[key], SQLS.get(key), SF_SMALL)
    assert ok, line


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(QUERIES)


def test_queries_pin_utc(spark):
    """Day labels are UTC even when the caller's session uses another zone."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    first = QUERIES["f17_log_entries_per_day"](spark, SF_SMALL).orderBy("log_date").first()
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert str(first.log_date) == "2024-01-01"


def test_catalog_imports_without_spark():
    """The driver may ask for oracle SQL before any session exists."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), len(s))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n_q, n_s = map(int, out.stdout.split())
    assert n_q == len(entry.queries()) and n_s == len(entry.oracle_sql())


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 10
    assert df.columns == ["category", "kind", "n_total", "n_correct", "accuracy", "accuracy_text"]
