"""DuckDB SQL twins of the Column expressions in ``verity.functions``.

Used only to build oracle SQL strings. Each function takes an SQL
expression (text) and returns an SQL expression (text). Patterns are the
RE2 forms of the Java patterns used on the Spark side.
"""

from __future__ import annotations

from ..functions import answers as A


EMPTY = "''"
COLON = "':'"
RATING_RE = r"Rating: \[\[(\d+)\]\]"
SCORE_RE = r"Score:\s*(\d+(\.\d+)?)"
BETTER_RE = r"Better Response: \[\[(\d+)\]\]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+\\z', '', 'g')"


def nonempty(x: str) -> str:
    return f"nullif({x}, '')"


def first_match(x: str, patterns: list[str], flags: str = "") -> str:
    parts = [nonempty(f"regexp_extract({x}, {q(flags + p)}, 1)") for p in patterns]
    return f"coalesce({', '.join(parts)})"


def last_match(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, 1)[-1]"


def strip_think(x: str) -> str:
    return f"regexp_replace({x}, '(?s)<think>.*?</think>', '', 'g')"


def after_last_close(x: str) -> str:
    return f"CASE WHEN strpos({x}, '</think>') > 0 THEN regexp_extract({x}, '(?s)^.*</think>(.*)$', 1) ELSE {x} END"


def after_first_close(x: str) -> str:
    return f"CASE WHEN strpos({x}, '</think>') > 0 THEN substring({x}, strpos({x}, '</think>') + 8) ELSE {x} END"


def clean_reasoning_tags(x: str) -> str:
    out = x
    for t in A.REASONING_TAGS:
        out = f"regexp_replace({out}, '(?si)<{t}>.*?</{t}>', '', 'g')"
    out = f"regexp_replace({out}, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g')"
    out = f"regexp_replace({out}, '  +', ' ', 'g')"
    return py_strip(out)


def thinking_text(x: str) -> str:
    closed = f"array_to_string(regexp_extract_all({x}, '(?s)<think>(.*?)</think>', 1), '')"
    tail = after_last_close(x)
    unclosed = f"CASE WHEN strpos({tail}, '<think>') > 0 THEN substring({tail}, strpos({tail}, '<think>') + 7) ELSE '' END"
    return f"({closed} || {unclosed})"


def reasoning_tokens(x: str) -> str:
    n = f"length({py_strip(thinking_text(x))})"
    return f"CAST(CASE WHEN {x} IS NULL THEN 0 WHEN {n} > 0 THEN greatest(1, floor({n} / 4)) ELSE 0 END AS BIGINT)"


def tagged_section(x: str, tag: str) -> str:
    m = f"regexp_extract({x}, '(?s)<{tag}>(.*?)(?:</{tag}>|\\z)', 1)"
    return f"CASE WHEN strpos({x}, '<{tag}>') > 0 THEN {py_strip(m)} END"


def normalize_answer(x: str) -> str:
    y = f"lower({py_strip(strip_think(f'coalesce({x}, {EMPTY})'))})"
    y = f"regexp_replace({y}, '[.,;:!?]+\\z', '', 'g')"
    return py_strip(f"regexp_replace({y}, '\\s+', ' ', 'g')")


def normalize_plain(x: str) -> str:
    y = f"regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
    return py_strip(f"regexp_replace({y}, '\\s+', ' ', 'g')")


def extract_final_answer(x: str) -> str:
    body = py_strip(strip_think(x))
    return f"coalesce({py_strip(first_match(body, A.FINAL_ANSWER_PATTERNS, '(?im)'))}, {body})"


def extract_answer_uncertain(x: str) -> str:
    part = py_strip(after_first_close(x))
    lines = f"list_transform(string_split({part}, chr(10)), lambda s: {py_strip('s')})"
    long_line = f"list_filter({lines}, lambda s: length(s) > 10)[1]"
    return f"coalesce({py_strip(first_match(part, A.UNCERTAIN_ANSWER_PATTERNS, '(?i)'))}, {long_line}, substring({part}, 1, 200))"


def numeric_answer(x: str) -> tuple[str, str]:
    by = first_match(x, A.NUMERIC_ANSWER_PATTERNS)
    last = last_match(x, r"(\d+)")
    return (f"coalesce({by}, {last}, '')",
            f"CAST(CASE WHEN {by} IS NOT NULL THEN 1.0 WHEN {last} IS NOT NULL THEN 0.5 ELSE 0.0 END AS DOUBLE)")


def _aime_range(s: str) -> str:
    return f"CASE WHEN TRY_CAST({s} AS INTEGER) BETWEEN 0 AND 999 THEN TRY_CAST({s} AS INTEGER) END"


def extract_aime(x: str) -> str:
    picks = [_aime_range(last_match(x, "(?i)" + p)) for p in A.AIME_PATTERNS]
    picks.append(_aime_range(last_match(x, r"(\d+)")))
    return f"coalesce({', '.join(picks)})"


def last_sentence(x: str) -> str:
    s = py_strip(x)
    parts = f"string_split({s}, '.')"
    tail = py_strip(f"{parts}[-1]")
    right50 = f"right({s}, 50)"
    return f"CASE WHEN len({parts}) > 1 THEN coalesce(nullif({tail}, ''), {right50}) ELSE {right50} END"


def python_blocks(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s)```python\\n(.*?)```', 1)"


def first_code_block(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '(?s)```[a-zA-Z0-9_+-]*\\n.*?```') "
            f"THEN regexp_extract({x}, '(?s)```[a-zA-Z0-9_+-]*\\n(.*?)```', 1) END")


def _after_colon(line: str) -> str:
    return f"substring({line}, strpos({line}, ':') + 1)"


def grade_lines(x: str) -> tuple[str, str]:
    ls = f"string_split({py_strip(x)}, chr(10))"
    dec = f"list_filter({ls}, lambda s: starts_with(s, 'Decision:'))[-1]"
    exp = f"list_filter({ls}, lambda s: starts_with(s, 'Explanation:'))[-1]"
    return (f"coalesce(upper({py_strip(f'split_part({dec}, {COLON}, 2)')}), 'FALSE')",
            f"coalesce({py_strip(_after_colon(exp))}, '')")


def grade_ci(x: str) -> tuple[str, str]:
    body = py_strip(f"coalesce({x}, '')")
    ls = f"string_split({body}, chr(10))"
    dec = f"list_filter({ls}, lambda s: starts_with(lower(s), 'decision:'))[-1]"
    exp = f"list_filter({ls}, lambda s: starts_with(lower(s), 'explanation:'))[-1]"
    return (f"CASE WHEN length({body}) = 0 THEN 'ERROR' ELSE coalesce(upper({py_strip(_after_colon(dec))}), 'FALSE') END",
            f"CASE WHEN length({body}) = 0 THEN 'Empty or invalid response from evaluator.' ELSE coalesce({py_strip(_after_colon(exp))}, '') END")


def rating_absolute(x: str) -> str:
    m = nonempty(f"regexp_extract({x}, {q(RATING_RE)}, 1)")
    return f"coalesce(TRY_CAST({m} AS DOUBLE), -1.0)"


def rating_score(x: str) -> str:
    m = nonempty(f"regexp_extract({x}, {q(SCORE_RE)}, 1)")
    return f"coalesce(TRY_CAST({m} AS DOUBLE), 0.0)"


def _py_float(s: str) -> str:
    return (f"CASE WHEN regexp_matches({s}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z') "
            f"THEN TRY_CAST({s} AS DOUBLE) END")


def rating_bare(x: str) -> str:
    return f"coalesce({_py_float(py_strip(x))}, 0.0)"


def rating_unit(x: str) -> str:
    v = _py_float(py_strip(x))
    return f"coalesce(greatest(0.0, least({v}, 1.0)), 0.5)"


def better_response(x: str) -> str:
    m = nonempty(f"regexp_extract({x}, {q(BETTER_RE)}, 1)")
    return f"coalesce(TRY_CAST({m} AS INTEGER), 0)"


def selected_candidate(x: str, n: str) -> str:
    def valid(e):
        v = f"(TRY_CAST(nullif({e}, '') AS INTEGER) - 1)"
        return f"CASE WHEN {v} >= 0 AND {v} < {n} THEN {v} END"

    picks = [valid(f"regexp_extract({x}, '(?i)BEST CANDIDATE:\\s*(\\d+)', 1)")]
    picks += [valid(f"regexp_extract({x}, {q(p)}, 1)") for p in A.SELECTION_FALLBACKS]
    return f"coalesce({', '.join(picks)}, 0)"


def _contains_any(s: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({s}, {q(w)})" for w in words) + ")"


def parse_verification(x: str) -> dict[str, str]:
    low = f"lower({x})"
    c, i, inc = f"contains({low}, 'correct')", f"contains({low}, 'incorrect')", f"contains({low}, 'incomplete')"
    assess = f"CASE WHEN {c} AND NOT {i} THEN 'CORRECT' WHEN {i} THEN 'INCORRECT' ELSE 'INCOMPLETE' END"
    base = f"CASE WHEN {c} AND NOT {i} THEN 0.8 WHEN {i} THEN 0.8 WHEN {inc} THEN 0.6 ELSE 0.5 END"
    pat = q(r"confidence.*?(\d+).*?(?:out of|/)\s*(\d+)")
    num = f"TRY_CAST(nullif(regexp_extract({low}, {pat}, 1), '') AS DOUBLE)"
    den = f"TRY_CAST(nullif(regexp_extract({low}, {pat}, 2), '') AS DOUBLE)"
    conf = f"CAST(coalesce(CASE WHEN {den} <> 0 THEN {num} / {den} END, {base}) AS DOUBLE)"
    ls = f"string_split({x}, chr(10))"
    issues = f"list_transform(list_filter({ls}, lambda s: {_contains_any('lower(s)', A.ISSUE_WORDS)}), lambda s: {py_strip('s')})"
    sugg = f"list_transform(list_filter({ls}, lambda s: {_contains_any('lower(s)', A.SUGGESTION_WORDS)}), lambda s: {py_strip('s')})"
    return {"assessment": assess, "confidence": conf, "issues": issues, "suggestions": sugg}
