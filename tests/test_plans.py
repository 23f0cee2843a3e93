"""Plan assertions: native operators stay in the JVM, filters and column
pruning reach the Parquet scan, pair-free operators have no cartesian
products."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from verity.plans import catalog

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")

# Python workers run in the stateful streams only.
NATIVE = sorted(k for k in catalog.queries() if not k.endswith("_stream")
                and not k.startswith("l4_") and not k.startswith("a1_") and not k.startswith("a2_")
                and not k.startswith("a3_") and not k.startswith("a19_"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", NATIVE)
def test_native_operators_have_no_python_nodes(spark, key):
    plan = _plan(entry.queries()[key](spark, SF_SMALL))
    assert not any(n in plan for n in PY_NODES), key
    assert "CartesianProduct" not in plan, key


def test_filter_and_projection_reach_the_scan(spark):
    plan = _plan(entry.queries()["a7_slice_records"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,5), LessThan(doc_id,15)]" in plan
    plan = _plan(entry.queries()["a13_filter_output_tokens"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan


def test_votes_use_partial_aggregates_not_group_windows(spark):
    # The arg-max buffer holds strings, so Spark picks a sort-based aggregate;
    # either way it is partial (map-side) aggregation, never a group window.
    plan = _plan(entry.queries()["g1_majority_vote"](spark, SF_SMALL))
    assert ("HashAggregate" in plan or "SortAggregate" in plan) and "Window" not in plan
