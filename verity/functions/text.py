"""Column expressions over text shared by several operators.

Every function returns a ``Column`` built from Spark built-ins, so it runs
inside whole-stage codegen. Regular expressions are kept RE2-compatible
(no lookaround) so the DuckDB oracle can use the same pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_link_list(c: Column) -> Column:
    """B1: Python list literal (single or double quotes) -> array<string>.

    A scalar string literal becomes a one-element array; anything that does
    not parse becomes null (callers count those as failures)."""
    as_list = F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
    scalar = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", {"allowSingleQuotes": "true"})
    trimmed = F.trim(c)
    return F.when(trimmed.startswith("["), as_list).when(
        trimmed.startswith("'") | trimmed.startswith('"'), scalar)


def word_tokens(c: Column) -> Column:
    """Lower-case word tokens (``\\w+`` in Unicode mode)."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0)


def split_words(c: Column) -> Column:
    """Whitespace split with empties removed."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: F.length(x) > 0)


def chars_div4(c: Column) -> Column:
    """Default token count = characters // 4 (the reference fallback)."""
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("bigint")


def word_count(c: Column) -> Column:
    """Word-count token estimate."""
    return F.size(split_words(c)).cast("bigint")
