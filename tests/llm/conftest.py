from __future__ import annotations

import pytest


@pytest.fixture
def rows_of(spark):
    """DataFrame of rows with string columns for everything but the named longs."""
    def make(columns, rows, longs=("doc_id",)):
        return spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in longs else 'string'}" for c in columns))
    return make
