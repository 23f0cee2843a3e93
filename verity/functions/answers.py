"""Answer, grade and rating parsers as Column expressions.

Parsers are not row-at-a-time helpers: each is a Catalyst expression built
from ``regexp_*``, ``split`` and higher-order array functions, applied to a
whole completions table. Java regex notes:

* ``(?d)`` (UNIX_LINES) makes ``.``, ``^`` and ``$`` treat only ``\\n`` as a
  line end, as Python does.
* ``\\z`` is used for "end of text" (``$`` also matches before a final
  newline in Java).
* literal braces are escaped (``\\{``), which Java requires.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_re(p: str) -> Column:
    return F.lit(p)


# The ASCII whitespace set (what ``\s`` matches in Java regex).
ASCII_WHITESPACE = " \t\n\x0b\f\r"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (``btrim``, no regex)."""
    return F.btrim(c, F.lit(ASCII_WHITESPACE))


def nonempty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def first_match(text: Column, patterns: list[str], flags: str = "", group: int = 1) -> Column:
    """Group of the first pattern (in list order) that matches; null if none.

    Every pattern's group must be non-empty when it matches."""
    return F.coalesce(*[nonempty(F.regexp_extract(text, f"{flags}{p}", group)) for p in patterns])


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the last (non-overlapping, left-to-right) match; null if none."""
    return F.try_element_at(F.regexp_extract_all(text, lit_re(pattern), group), F.lit(-1))


# --- thinking blocks (T3, T4) -------------------------------------------------

THINK_BLOCK = r"(?s)<think>.*?</think>"


def strip_think_blocks(c: Column) -> Column:
    """T4 (a): remove every closed ``<think>...</think>`` block."""
    return F.regexp_replace(c, THINK_BLOCK, "")


def after_last_think_close(c: Column) -> Column:
    """T4 (b): text after the last ``</think>`` (whole text when absent)."""
    return F.substring_index(c, "</think>", -1)


def after_first_think_close(c: Column) -> Column:
    """T4 (c): text after the first ``</think>`` (whole text when absent)."""
    pos = F.locate("</think>", c)
    return F.when(pos > 0, c.substr(pos + 8, F.lit(2147483647))).otherwise(c)


# Reasoning tag names removed by the report cleaner (T4 d).
REASONING_TAGS = ["think", "thinking", "reasoning", "thought", "reflect", "reflection"]


def clean_reasoning_tags(c: Column) -> Column:
    """T4 (d): drop six reasoning tag blocks (case-insensitive), fold 3+ line
    breaks with blank lines to one blank line, collapse runs of spaces, strip."""
    out = c
    for t in REASONING_TAGS:
        out = F.regexp_replace(out, f"(?si)<{t}>.*?</{t}>", "")
    out = F.regexp_replace(out, r"\n\s*\n\s*\n+", "\n\n")
    out = F.regexp_replace(out, r"  +", " ")
    return py_strip(out)


def thinking_text(c: Column) -> Column:
    """Content of closed think blocks plus an unclosed trailing block."""
    closed = F.array_join(F.regexp_extract_all(c, F.lit(r"(?s)<think>(.*?)</think>"), 1), "")
    tail = F.substring_index(c, "</think>", -1)
    open_pos = F.locate("<think>", tail)
    unclosed = F.when(open_pos > 0, tail.substr(open_pos + 7, F.lit(2147483647))).otherwise(F.lit(""))
    return F.concat(closed, unclosed)


def reasoning_tokens(c: Column) -> Column:
    """Chars // 4 of the thinking content, at least 1 when non-empty."""
    n = F.length(py_strip(thinking_text(c)))
    return F.when(c.isNull(), F.lit(0)).when(n > 0, F.greatest(F.lit(1), F.floor(n / 4).cast("int"))) \
        .otherwise(F.lit(0)).cast("bigint")


def tagged_section(c: Column, tag: str) -> Column:
    """T5: text inside ``<tag>`` up to ``</tag>`` or the end; null if no tag."""
    m = F.regexp_extract(c, f"(?s)<{tag}>(.*?)(?:</{tag}>|\\z)", 1)
    return F.when(F.locate(f"<{tag}>", c) > 0, py_strip(m))


# --- normalisation and generic extraction (T6-T9) -----------------------------

def normalize_answer(c: Column) -> Column:
    """Strip think blocks, trim, lower, drop trailing .,;:!? , collapse spaces."""
    x = F.lower(py_strip(strip_think_blocks(F.coalesce(c, F.lit("")))))
    x = F.regexp_replace(x, r"[.,;:!?]+\z", "")
    return py_strip(F.regexp_replace(x, r"\s+", " "))


def normalize_answer_plain(c: Column) -> Column:
    """Lower-case, remove punctuation (anything not letter, digit, _ or
    space), collapse whitespace."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", "")
    return py_strip(F.regexp_replace(x, r"\s+", " "))


# Final-answer patterns, tried in order (case-insensitive, multiline).
FINAL_ANSWER_PATTERNS = [
    r"(?:final answer|answer):\s*(.+?)(?:\n|$)",
    r"(?:the answer is|answer is)\s*(.+?)(?:\n|$)",
    r"###\s*(.+?)(?:\n|$)",
    r"^([A-E])\b",
    r"\b([A-E])\b\s*$",
]


def extract_final_answer(c: Column) -> Column:
    """First matching pattern's group (stripped), else the whole text
    with think blocks removed."""
    body = py_strip(strip_think_blocks(c))
    return F.coalesce(py_strip(first_match(body, FINAL_ANSWER_PATTERNS, "(?imd)")), body)


# Answer patterns of the uncertainty router (case-insensitive).
UNCERTAIN_ANSWER_PATTERNS = [
    r"(?:the )?(?:final )?answer is:?\s*(.+?)(?:\n|$)",
    r"(?:therefore|thus|so),?\s*(?:the )?(?:answer is:?\s*)?(.+?)(?:\n|$)",
    r"(?:conclusion|result):?\s*(.+?)(?:\n|$)",
]


def extract_answer_uncertain(c: Column) -> Column:
    """After the first ``</think>``; 3 patterns; else first stripped line
    longer than 10 chars; else the first 200 characters."""
    part = py_strip(after_first_think_close(c))
    lines = F.transform(F.split(part, "\n"), lambda s: py_strip(s))
    long_line = F.try_element_at(F.filter(lines, lambda s: F.length(s) > 10), F.lit(1))
    return F.coalesce(py_strip(first_match(part, UNCERTAIN_ANSWER_PATTERNS, "(?id)")), long_line,
                      F.substring(part, 1, 200))


# --- numeric answers (T10-T12) ------------------------------------------------

# Fixed values: "the answer is N" phrasings, tried in order (case-sensitive).
NUMERIC_ANSWER_PATTERNS = [
    r"The answer is (\d+)",
    r"The final answer is (\d+)",
    r"Therefore, the answer is (\d+)",
    r"So, the answer is (\d+)",
    r"Thus, the answer is (\d+)",
    r"In conclusion, the answer is (\d+)",
]


def extract_numeric_answer(c: Column) -> Column:
    """struct(answer string, confidence double): pattern 1.0, last
    number 0.5, nothing '' and 0.0."""
    by_pattern = first_match(c, NUMERIC_ANSWER_PATTERNS)
    last_num = last_match(c, r"(\d+)")
    answer = F.coalesce(by_pattern, last_num, F.lit(""))
    conf = F.when(by_pattern.isNotNull(), 1.0).when(last_num.isNotNull(), 0.5).otherwise(0.0)
    return F.struct(answer.alias("answer"), conf.alias("confidence"))


# AIME answer patterns in priority order (case-insensitive);
# braces are escaped for the Java engine.
AIME_PATTERNS = [
    r"\$n=\\boxed\{(\d+)\}\$",
    r"\\\[\\boxed\{(\d+)\}\\\]",
    r"\\\[\\boxed\{(\d+)\}\.\\\]",
    r"\\boxed\{(\d+)\}",
    r"\$\\boxed\{(\d+)\}\$",
    r"boxed\{(\d+)\}",
    r"\\boxed\s*\{\s*(\d+)\s*\}",
    r"\bboxed\s*\{\s*(\d+)\s*\}",
    r"final answer is[^\d]*(\d+)",
    r"answer is[^\d]*(\d+)",
    r"answer:[^\d]*(\d+)",
    r"= ?(\d+)$",
]


def _in_aime_range(s: Column) -> Column:
    v = s.try_cast("int")
    return F.when((v >= 0) & (v <= 999), v)


def extract_aime(c: Column) -> Column:
    """Per pattern in order take its last match; the first in 0..999
    wins; else the last number if in range; else null."""
    picks = [_in_aime_range(last_match(c, "(?i)" + p)) for p in AIME_PATTERNS]
    picks.append(_in_aime_range(last_match(c, r"(\d+)")))
    return F.coalesce(*picks)


# General answer patterns (case-insensitive), last match wins.
GENERAL_PATTERNS = [
    (r"\\boxed\{([^}]+)\}", "boxed"),
    (r"boxed\{([^}]+)\}", "boxed"),
    (r"(?:the\s+)?answer\s+is\s+([^\n.!?]+)", "text"),
    (r"(?:final\s+)?answer:\s*([^\n.!?]+)", "text"),
    (r"therefore,?\s+([^\n.!?]+)", "text"),
    (r"thus,?\s+([^\n.!?]+)", "text"),
    (r"=\s*([^\n.!?]+)$", "text"),
]


def general_pick(c: Column) -> Column:
    """T12 step 1: struct(k, v) for the last match of the first pattern with
    non-empty content (k = 'boxed' or 'text'); null when nothing matches."""
    cands = []
    for p, kind in GENERAL_PATTERNS:
        content = nonempty(py_strip(last_match(c, "(?i)" + p)))
        cands.append(F.when(content.isNotNull(), F.struct(F.lit(kind).alias("k"), content.alias("v"))))
    return F.coalesce(*cands)


def parse_general(pick: Column) -> Column:
    """T12 step 2: struct(kind, num, num_set, text); boxed content parsed as
    int / float / set of ints / string, other patterns stay strings."""
    v = pick["v"]
    is_boxed = pick["k"] == "boxed"
    as_int = F.when(v.rlike(r"^[0-9]+\z"), v.try_cast("double"))
    as_float = v.try_cast("double")
    is_set = v.startswith("{") & v.endswith("}") & v.contains(",")
    inner = F.regexp_replace(F.regexp_replace(v, r"^\{", ""), r"\}\z", "")
    set_vals = F.transform(F.filter(F.transform(F.split(inner, ","), lambda s: py_strip(s)),
                                    lambda s: s.rlike(r"^[0-9]+\z")), lambda s: s.cast("int"))
    kind = (F.when(pick.isNull(), F.lit(None))
             .when(~is_boxed, F.lit("str"))
             .when(as_int.isNotNull(), F.lit("int"))
             .when(as_float.isNotNull(), F.when(as_float == F.floor(as_float), F.lit("int")).otherwise(F.lit("float")))
             .when(is_set, F.lit("set"))
             .otherwise(F.lit("str")))
    num = F.when(kind == "int", F.coalesce(as_int, F.floor(as_float).cast("double"))).when(kind == "float", as_float)
    return F.struct(kind.alias("kind"), num.alias("num"),
                    F.when(kind == "set", F.array_sort(F.array_distinct(set_vals))).alias("num_set"),
                    F.when(pick.isNotNull(), v).alias("text"))


def with_general_answer(df, text: str, out: str = "general"):
    """T12 on a table: pick, then parse, as two projections so the seven
    pattern scans run once per row."""
    return df.withColumn("_gpick", general_pick(F.col(text))) \
        .withColumn(out, parse_general(F.col("_gpick"))).drop("_gpick")


def last_sentence(c: Column) -> Column:
    """Text after the last '.', stripped; else the last 50 characters."""
    parts = F.split(py_strip(c), r"\.")
    tail = py_strip(F.try_element_at(parts, F.lit(-1)))
    return F.when(F.size(parts) > 1, F.coalesce(nonempty(tail), F.substring(py_strip(c), -50, 50))) \
        .otherwise(F.substring(py_strip(c), -50, 50))


# --- answer mode (T14) -------------------------------------------------------

# Indicators, markers and patterns of the answer-mode cleaner.
CODE_INDICATORS = ["```", "def ", "import ", "class ", "return ", "for ", "while "]
MATH_INDICATORS = ["\\boxed", "\\frac", "\\sum", "\\int", "$$", "$\\"]
PROOF_INDICATORS = ["proof", "QED", "proven", "demonstrate", "show that", "prove that"]
CONCLUSION_MARKERS = ["In conclusion", "Therefore", "Thus", "Hence", "Finally", "The answer is", "The final answer"]
MATH_FINAL_PATTERNS = [
    r"[Ff]inal answer[:\s]+(.+?)(?:\n|$)",
    r"[Tt]he answer is[:\s]+(.+?)(?:\n|$)",
    r"[Tt]herefore[,\s]+(.+?)(?:\n|$)",
]
CODE_BLOCK_RE = r"(?s)```(?:python|cpp|java|javascript|go|rust)?\n(.*?)\n```"
CODE_SECTION_RE = r"(?i)\n#+\s+(?:Final Solution|Solution|Implementation|Code)\s*\n"


def _any(text: Column, words: list[str], lower: bool = False) -> Column:
    t = F.lower(text) if lower else text
    out = None
    for w in words:
        c = t.contains(w.lower() if lower else w)
        out = c if out is None else (out | c)
    return out


def answer_mode(text: Column) -> Column:
    """T14: 'code', 'math' or 'generic' from indicator substrings."""
    return F.when(_any(text, CODE_INDICATORS), "code").when(_any(text, MATH_INDICATORS), "math").otherwise("generic")


def _paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), py_strip), lambda p: F.length(p) > 0)


def _last(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def clean_answer(text: Column, mode: Column | None = None) -> Column:
    """The final answer by mode. code: last fenced block (re-fenced as
    python), else text after the last solution heading, else after the last
    '###'; math: last boxed value, else the last final-answer phrase, else
    the last paragraph; generic: text after the last conclusion marker (first
    paragraph, if longer than 20 characters), else the last three paragraphs
    of a proof, else the last paragraph."""
    m = answer_mode(text) if mode is None else mode
    blocks = F.regexp_extract_all(text, F.lit(CODE_BLOCK_RE), 1)
    sections = F.split(text, CODE_SECTION_RE)
    hashes = F.split(text, "###")
    code = (F.when(F.size(blocks) > 0, F.concat(F.lit("```python\n"), py_strip(_last(blocks)), F.lit("\n```")))
             .when(F.size(sections) > 1, py_strip(_last(sections)))
             .when(F.size(hashes) > 1, py_strip(_last(hashes))).otherwise(text))
    boxed = _last(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^}]+)\}"), 1))
    finals = [py_strip(_last(F.regexp_extract_all(text, F.lit("(?d)" + p), 1))) for p in MATH_FINAL_PATTERNS]
    paras = _paragraphs(text)
    math = F.coalesce(F.concat(F.lit("The final answer is $\\boxed{"), boxed, F.lit("}$")), *finals, _last(paras), text)
    concl = []
    for mk in CONCLUSION_MARKERS:
        first = py_strip(F.split_part(py_strip(F.substring_index(text, mk, -1)), F.lit("\n\n"), F.lit(1)))
        concl.append(F.when(text.contains(mk) & (F.length(first) > 20), first))
    sentences = F.filter(F.transform(F.split(text, r"\."), py_strip), lambda s: F.length(s) > 0)
    proof = _any(text, PROOF_INDICATORS, lower=True)
    generic = F.coalesce(*concl, F.when(proof & (F.size(paras) >= 3), F.array_join(F.slice(paras, -3, 3), "\n\n"))
                         .when(proof & (F.size(paras) > 0), text),
                         _last(paras), F.concat(_last(sentences), F.lit(".")), text)
    return F.when(m == "code", code).when(m == "math", math).otherwise(generic)


# --- multiple choice (T15) ---------------------------------------------------

_W = r"(?:\*{1,2}|_{1,2})"   # markdown wrapper: * ** _ __
_NB = r"(?:^|[^A-Za-z0-9])"   # "not preceded by a letter/digit" (consuming form)
_NA = r"(?:[^A-Za-z0-9]|$)"   # "not followed by a letter/digit" (consuming form)

# Multiple-choice declaration patterns in priority order, as
# (flags, pattern). Look-arounds are written in consuming form (same first
# match and letter) so the patterns also run on RE2.
MCQ_PATTERNS = [
    ("(?i)", _W + r"Answers?\s*[:\-–]?" + _W + r"\s*([ABCD])\b"),
    ("(?im)", r"^\s*" + _W + r"?Answer:?" + _W + r"?\s*:?\s*" + _W + r"?([ABCD])" + _W + r"?\s*"),
    ("(?i)", r"\bAnswers?\b\s*[:\-–]?\s*\(\s*([ABCD])\s*\)"),
    ("(?i)", r"\bAnswers?\b\s*[:\-–]?\s*([ABCD])\b"),
    ("(?i)", r"\b(?:Option|Choice)\b\s*[:\-–]?\s*([ABCD])\b"),
    ("(?m)", r"\\boxed\{[^}]*?([ABCD])[^}]*\}"),
    ("(?m)", r"\\boxed\{[^}]*?\\textbf\{[^}]*?([ABCD])[^}]*\}[^}]*\}"),
    ("(?m)", r"\\boxed\{[^}]*?\\text\{[^}]*?([ABCD])[^}]*\}[^}]*\}"),
    ("", _NB + r"[\(\[]\s*([ABCD])\s*[\)\]]" + _NA),
    ("", _NB + _W + r"([ABCD])" + _W + _NA),
    ("", r"\\textbf\{[^}]*?([ABCD])[^}]*\}"),
    ("", _NB + _W + r"\s*([ABCD])\)[^*_\n]+?" + _W + _NA),
    ("(?m)", r"^\s*" + _W + r"?([ABCD])" + _W + r"?\s*[\.\)\-–:]?\s*.*$"),
]


def mcq_letter(text: Column, last_n: int = 100) -> Column:
    """The letter of the first pattern (priority order) that matches the
    last ``last_n`` characters, upper-cased; else the first character after
    a leading '**'."""
    t = F.substring(text, -last_n, last_n)
    picks = [F.upper(nonempty(F.regexp_extract(t, (fl.replace("m", "md") if "m" in fl else fl) + p, 1)))
             for fl, p in MCQ_PATTERNS]
    fallback = F.substring(F.regexp_replace(t, r"^\*\*", ""), 1, 1)
    return F.coalesce(*picks, fallback)


# --- code blocks (T17) -------------------------------------------------------

def python_blocks(c: Column) -> Column:
    """Contents of all ```python fenced blocks."""
    return F.regexp_extract_all(c, F.lit(r"(?s)```python\n(.*?)```"), 1)


def first_code_block(c: Column) -> Column:
    """Content of the first fenced block of any language (null if none)."""
    m = F.regexp_extract(c, r"(?s)```[a-zA-Z0-9_+-]*\n(.*?)```", 1)
    return F.when(c.rlike(r"(?s)```[a-zA-Z0-9_+-]*\n.*?```"), m)


# --- grades (T19) ------------------------------------------------------------

def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def grade_decision_lines(c: Column) -> Column:
    """T19 (a): struct(decision, explanation) from lines starting with
    'Decision:' / 'Explanation:'; the last such line wins; default FALSE / ''."""
    ls = _lines(py_strip(c))
    dec = F.try_element_at(F.filter(ls, lambda s: s.startswith("Decision:")), F.lit(-1))
    exp = F.try_element_at(F.filter(ls, lambda s: s.startswith("Explanation:")), F.lit(-1))
    d = F.upper(py_strip(F.split_part(dec, F.lit(":"), F.lit(2))))
    e = py_strip(exp.substr(F.locate(":", exp) + 1, F.lit(2147483647)))
    return F.struct(F.coalesce(d, F.lit("FALSE")).alias("decision"), F.coalesce(e, F.lit("")).alias("explanation"))


def grade_decision_ci(c: Column) -> Column:
    """T19 (b): case-insensitive 'decision:' lines, last wins; empty text ->
    ERROR."""
    body = py_strip(F.coalesce(c, F.lit("")))
    ls = _lines(body)
    dec = F.try_element_at(F.filter(ls, lambda s: F.lower(s).startswith("decision:")), F.lit(-1))
    exp = F.try_element_at(F.filter(ls, lambda s: F.lower(s).startswith("explanation:")), F.lit(-1))
    d = F.upper(py_strip(dec.substr(F.locate(":", dec) + 1, F.lit(2147483647))))
    e = py_strip(exp.substr(F.locate(":", exp) + 1, F.lit(2147483647)))
    empty = F.length(body) == 0
    return F.struct(
        F.when(empty, F.lit("ERROR")).otherwise(F.coalesce(d, F.lit("FALSE"))).alias("decision"),
        F.when(empty, F.lit("Empty or invalid response from evaluator.")).otherwise(F.coalesce(e, F.lit(""))).alias("explanation"))


def grade_yes(c: Column) -> Column:
    """T19 (c): 'Yes' anywhere -> TRUE, else FALSE; explanation = whole text."""
    return F.struct(F.when(F.coalesce(c.contains("Yes"), F.lit(False)), "TRUE").otherwise("FALSE").alias("decision"),
                    c.alias("explanation"))


def grade_json(c: Column) -> Column:
    """T19 (d): JSON object with a ``decision`` field (fences stripped);
    unparsable -> ERROR."""
    body = F.regexp_replace(F.regexp_replace(py_strip(c), r"^```(?:json)?\s*", ""), r"\s*```\z", "")
    parsed = F.from_json(body, "decision string, explanation string")
    ok = parsed.isNotNull() & parsed["decision"].isNotNull()
    return F.struct(F.when(ok, F.upper(parsed["decision"])).otherwise(F.lit("ERROR")).alias("decision"),
                    F.when(ok, F.coalesce(parsed["explanation"], F.lit(""))).otherwise(F.lit("")).alias("explanation"))


# --- ratings (T20) -----------------------------------------------------------

def rating_absolute(c: Column) -> Column:
    """``Rating: [[n]]`` -> n, else -1."""
    m = nonempty(F.regexp_extract(c, r"Rating: \[\[(\d+)\]\]", 1))
    return F.coalesce(m.try_cast("double"), F.lit(-1.0))


def rating_score(c: Column) -> Column:
    """``Score: x`` -> x, else 0."""
    m = nonempty(F.regexp_extract(c, r"Score:\s*(\d+(\.\d+)?)", 1))
    return F.coalesce(m.try_cast("double"), F.lit(0.0))


def rating_bare(c: Column) -> Column:
    """The whole stripped text as a float, else 0."""
    return F.coalesce(_py_float(py_strip(c)), F.lit(0.0))


def rating_unit(c: Column) -> Column:
    """Whole text as a float clamped to [0, 1], else 0.5."""
    v = _py_float(py_strip(c))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(v, F.lit(1.0))), F.lit(0.5))


def _py_float(s: Column) -> Column:
    """float(s) for plain decimal / exponent notation (no inf/nan words)."""
    ok = s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    return F.when(ok, s.try_cast("double"))


def better_response(c: Column) -> Column:
    """``Better Response: [[i]]`` -> i, else 0 (first of the pair)."""
    m = nonempty(F.regexp_extract(c, r"Better Response: \[\[(\d+)\]\]", 1))
    return F.coalesce(m.try_cast("int"), F.lit(0))


# Fallback selection phrasings (after "BEST CANDIDATE: n").
SELECTION_FALLBACKS = [
    r"[Cc]andidate\s+(\d+)\s+is\s+(?:the\s+)?best",
    r"[Ii]\s+(?:would\s+)?select\s+[Cc]andidate\s+(\d+)",
    r"[Tt]he\s+best\s+(?:response|candidate)\s+is\s+(?:number\s+)?(\d+)",
]


def selected_candidate(c: Column, n_candidates: Column) -> Column:
    """0-based chosen index: 'BEST CANDIDATE: n' then three fallbacks, each
    only when 1 <= n <= n_candidates; else 0."""
    def valid(s):
        v = nonempty(s).try_cast("int") - 1
        return F.when((v >= 0) & (v < n_candidates), v)

    picks = [valid(F.regexp_extract(c, r"(?i)BEST CANDIDATE:\s*(\d+)", 1))]
    picks += [valid(F.regexp_extract(c, p, 1)) for p in SELECTION_FALLBACKS]
    return F.coalesce(*picks, F.lit(0))


# --- verification text (T21) -------------------------------------------------

# Issue and suggestion cue words.
ISSUE_WORDS = ["error", "mistake", "incorrect", "wrong", "issue"]
SUGGESTION_WORDS = ["suggest", "recommend", "should", "could improve"]


def _contains_any(s: Column, words: list[str]) -> Column:
    out = None
    for w in words:
        p = s.contains(w)
        out = p if out is None else (out | p)
    return out


def parse_verification(c: Column) -> Column:
    """struct(assessment, confidence, issues, suggestions)."""
    low = F.lower(c)
    has_c, has_i, has_inc = low.contains("correct"), low.contains("incorrect"), low.contains("incomplete")
    assess = F.when(has_c & ~has_i, "CORRECT").when(has_i, "INCORRECT").otherwise("INCOMPLETE")
    base = F.when(has_c & ~has_i, 0.8).when(has_i, 0.8).when(has_inc, 0.6).otherwise(0.5)
    pat = r"(?d)confidence.*?(\d+).*?(?:out of|/)\s*(\d+)"
    num = nonempty(F.regexp_extract(low, pat, 1)).try_cast("double")
    den = nonempty(F.regexp_extract(low, pat, 2)).try_cast("double")
    conf = F.coalesce(F.try_divide(num, den), base)
    ls = F.split(c, "\n")
    issues = F.transform(F.filter(ls, lambda s: _contains_any(F.lower(s), ISSUE_WORDS)), py_strip)
    sugg = F.transform(F.filter(ls, lambda s: _contains_any(F.lower(s), SUGGESTION_WORDS)), py_strip)
    return F.struct(assess.alias("assessment"), conf.alias("confidence"), issues.alias("issues"),
                    sugg.alias("suggestions"))


NUMBER_RE = r"-?[0-9]+(?:\.[0-9]+)?"


def last_number(text: Column, tail: int) -> Column:
    """The last number in the last ``tail`` characters; null without one,
    which is an answer of its own."""
    found = F.regexp_extract_all(F.right(text, F.lit(tail)), F.lit(NUMBER_RE), 0)
    return F.try_element_at(found, F.lit(-1)).try_cast("double")
