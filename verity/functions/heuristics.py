"""Keyword heuristics and report hygiene as Column expressions
(SURVEY 2.E: T24-T26, T31-T33, T41)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import py_strip

# Complexity indicators.
COMPLEXITY_INDICATORS = [
    "explain", "analyze", "compare", "evaluate", "synthesize",
    "how", "why", "complex", "detail", "thorough", "comprehensive",
    "step by step", "calculate", "prove", "justify", "multiple",
    "consequences", "implications", "differentiate", "frameworks",
]


def complexity(text: Column) -> Column:
    """struct(label, score): indicators present (substring, lower-case)
    and length factor; HIGH when min(len/100, 2) * min(count/3, 1.5) > 1."""
    low = F.lower(text)
    count = sum(F.when(low.contains(w), 1).otherwise(0) for w in COMPLEXITY_INDICATORS)
    score = F.least(F.length(text) / 100.0, F.lit(2.0)) * F.least(count / 3.0, F.lit(1.5))
    return F.struct(F.when(score > 1.0, "HIGH").otherwise("LOW").alias("label"), score.alias("score"),
                    count.alias("n_indicators"))


# Fixed values: (min, max) thinking-token budgets by complexity label.
COMPLEXITY_BUDGETS = {"HIGH": (1024, 4096), "LOW": (256, 1024)}
# Share of max_tokens by reasoning effort (min share is 10%).
EFFORT_MAX_SHARE = {"low": 0.33, "medium": 0.66, "high": 0.90}
EFFORT_MIN_SHARE = 0.10


def effort_budget(effort: Column, max_tokens: Column) -> Column:
    """struct(min_tokens, max_tokens) for a reasoning effort (unknown
    efforts use 'low')."""
    e = F.lower(effort)
    share = F.when(e == "medium", EFFORT_MAX_SHARE["medium"]).when(e == "high", EFFORT_MAX_SHARE["high"]) \
        .otherwise(EFFORT_MAX_SHARE["low"])
    return F.struct(F.floor(max_tokens * EFFORT_MIN_SHARE).cast("bigint").alias("min_tokens"),
                    F.floor(max_tokens * share).cast("bigint").alias("max_tokens"))


def complexity_budget(label: Column) -> Column:
    """struct(min_tokens, max_tokens) for a complexity label."""
    hi, lo = COMPLEXITY_BUDGETS["HIGH"], COMPLEXITY_BUDGETS["LOW"]
    return F.struct(F.when(label == "HIGH", hi[0]).otherwise(lo[0]).cast("bigint").alias("min_tokens"),
                    F.when(label == "HIGH", hi[1]).otherwise(lo[1]).cast("bigint").alias("max_tokens"))


def solution_confidence(text: Column) -> Column:
    """0.5 plus cues (boxed, therefore/thus, proof, > 200 words,
    let + assume) minus hedges (might/possibly, unsure/not sure), clamped to
    [0.1, 1.0]."""
    low = F.lower(text)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0))
    c = (F.lit(0.5)
         + F.when(text.contains("\\boxed{"), 0.2).otherwise(0.0)
         + F.when(low.contains("therefore") | low.contains("thus"), 0.1).otherwise(0.0)
         + F.when(low.contains("proof"), 0.1).otherwise(0.0)
         + F.when(words > 200, 0.1).otherwise(0.0)
         + F.when(low.contains("let") & low.contains("assume"), 0.1).otherwise(0.0)
         - F.when(low.contains("might") | low.contains("possibly"), 0.1).otherwise(0.0)
         - F.when(low.contains("unsure") | low.contains("not sure"), 0.2).otherwise(0.0))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), c))


# Task-type keyword groups, in priority order.
TASK_KEYWORDS = [
    ("mathematical", ["solve", "calculate", "equation", "math", "number", "formula"]),
    ("analytical", ["analyze", "evaluate", "assess", "examine", "compare"]),
    ("creative", ["create", "design", "generate", "brainstorm", "invent"]),
    ("logical", ["reason", "logic", "prove", "deduce", "conclude"]),
    ("planning", ["plan", "strategy", "approach", "method", "steps"]),
    ("problem_solving", ["problem", "solution", "solve", "fix", "resolve"]),
]


def task_types(text: Column) -> Column:
    """Every task type whose keywords occur (lower-case substring), in
    group order; the first is the primary type."""
    low = F.lower(text)
    tags = []
    for name, words in TASK_KEYWORDS:
        hit = None
        for w in words:
            c = low.contains(w)
            hit = c if hit is None else (hit | c)
        tags.append(F.when(hit, F.lit(name)))
    return F.filter(F.array(*tags), lambda x: x.isNotNull())


# Placeholder tag patterns removed from final reports (T31),
# matched case-insensitively.
PLACEHOLDER_PATTERNS = [
    r"\[NEEDS RESEARCH[^\]]*\]",
    r"\[SOURCE NEEDED[^\]]*\]",
    r"\[RESEARCH NEEDED[^\]]*\]",
    r"\[CITATION NEEDED[^\]]*\]",
    r"\[MORE RESEARCH NEEDED[^\]]*\]",
    r"\[REQUIRES INVESTIGATION[^\]]*\]",
    r"\[TO BE RESEARCHED[^\]]*\]",
    r"\[VERIFY[^\]]*\]",
    r"\[CHECK[^\]]*\]",
    r"\[Placeholder for[^\]]+\]",
    r"\[\d+\]\s*\[Placeholder[^\]]+\]",
    r"\[Insert citation[^\]]*\]",
    r"\[Add reference[^\]]*\]",
    r"\[Reference needed[^\]]*\]",
    r"\[To be completed[^\]]*\]",
    r"\[Under development[^\]]*\]",
    r"\[Coming soon[^\]]*\]",
    r"\[TBD[^\]]*\]",
    r"\[TODO[^\]]*\]",
    r"\[Question \d+[^\]]*\]",
    r"\[Research question[^\]]*\]",
]
# The subset that marks placeholder citations.
PLACEHOLDER_CITATION_PATTERNS = PLACEHOLDER_PATTERNS[9:12] + PLACEHOLDER_PATTERNS[13:14]


def placeholder_counts(text: Column) -> Column:
    """Occurrences of each placeholder pattern (pattern order)."""
    return F.array(*[F.regexp_count(text, F.lit("(?i)" + p)) for p in PLACEHOLDER_PATTERNS])


def cleanup_placeholders(text: Column) -> Column:
    """Remove placeholder tags in pattern order, drop lines left with
    only punctuation, fold runs of blank lines, strip."""
    t = text
    for p in PLACEHOLDER_PATTERNS:
        t = F.regexp_replace(t, "(?i)" + p, "")
    lines = F.filter(F.split(t, "\n"), lambda ln: (F.length(py_strip(ln)) == 0) |
                     ~py_strip(ln).rlike(r"^[\s\-\*\.\,\;\:]*\z"))
    t = F.array_join(lines, "\n")
    t = F.regexp_replace(t, r"\n\s*\n\s*\n+", "\n\n")
    return py_strip(t)


def strip_references(text: Column) -> Column:
    """Remove an existing '## References' section (up to the next '##'
    or the end), a bare 'References' list of [n] lines, and fold blank
    lines."""
    t = F.regexp_replace(text, r"(?s)##\s*References.*?(##|\z)", "$1")
    t = F.regexp_replace(t, r"(?m)^References\s*\n\s*(?:\[\d+\]\s*\n)+", "")
    return F.regexp_replace(t, r"\n\s*\n\s*\n+", "\n\n")


def reference_line(num: Column, title: Column, url: Column, accessed: Column) -> Column:
    """T33: '[n] title. Available at: <url> [Accessed: date]' + blank line."""
    return F.concat(F.lit("["), num.cast("string"), F.lit("] "), F.coalesce(title, F.lit("Untitled")),
                    F.lit(". Available at: <"), url, F.lit("> [Accessed: "), accessed, F.lit("]\n\n"))


# Prompt templates for the batch evaluation.
NAIVE_PROMPT = """You are a helpful and accurate assistant.
Please answer the following question based on your knowledge.
Question: {question}
Answer:"""
ORACLE_PROMPT = """Background information:\n{background_info}\n\n
You are a helpful and accurate assistant.
Please answer the following question based on your knowledge and the background information.
Question: {question}
Answer:"""
GRADER_PROMPT = """===Task===
I need your help in evaluating an answer provided by an LLM against a ground truth
answer. Your task is to determine if the ground truth answer is present in the LLM's response.
Please analyze the provided data and make a decision.

===Instructions===
1. Carefully compare the "Predicted Answer" with the "Ground Truth Answer".
2. Consider the substance of the answers - look for equivalent information or correct answers. Do
not focus on exact wording unless the exact wording is crucial to the meaning.
3. Your final decision should be based on whether the meaning and the vital facts of the "Ground
Truth Answer" are present in the "Predicted Answer:"

===Input Data===
- Question: {question}
- Predicted Answer: {LLM_response}
- Ground Truth Answer: {ground_truth_answer}

===Output Format===
Provide your final evaluation in the following format:
"Explanation:" (How you made the decision?)
"Decision:" ("TRUE" or "FALSE" )

Please proceed with the evaluation. """


def template_pieces(template: str) -> list[tuple[str, str]]:
    """Split a {name} template into ('lit', text) / ('var', name) pieces."""
    import re
    out = []
    pos = 0
    for m in re.finditer(r"\{([A-Za-z_]+)\}", template):
        out.append(("lit", template[pos:m.start()]))
        out.append(("var", m.group(1)))
        pos = m.end()
    out.append(("lit", template[pos:]))
    return [p for p in out if p != ("lit", "")]


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill a template with columns (all placeholders at once, like
    str.format)."""
    return F.concat(*[F.lit(v) if k == "lit" else values[v] for k, v in template_pieces(template)])


SECTION_PLACEHOLDER = r"(?i)\[[^\]]*(?:placeholder|needed|research|todo|tbd)[^\]]*\]"


def report_sections(text: Column) -> Column:
    """Sections of a markdown report: array of struct(title, body) for each
    '##' heading followed by whitespace, up to the next '##'."""
    parts = F.split(text, "##")
    body = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    secs = F.filter(body, lambda p: p.rlike(r"(?s)^\s+[^#\n]+\n"))
    return F.transform(secs, lambda p: F.struct(
        py_strip(F.regexp_extract(p, r"(?s)^\s+([^#\n]+)\n", 1)).alias("title"),
        F.regexp_extract(p, r"(?s)^\s+[^#\n]+\n(.*)\z", 1).alias("body")))


# The section of open questions, and the issue texts of the audit.
QUESTION_SECTION_RE = r"(?s)## Research Questions for Investigation[^#]*(?:#[^#]+)*"
ISSUE_CITATIONS = "Found %d placeholder citations"
ISSUE_SECTION = ("Section '", "' is mostly placeholders")
ISSUE_QUESTIONS = "Report contains unanswered research questions section"
ISSUE_BRACKETS = "Unmatched brackets detected - possible incomplete citations"
ISSUE_SHORT = "Report appears to be very short, possibly incomplete"


def report_audit(text: Column) -> Column:
    """struct(issues, word_count, section_count, is_complete)."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0))
    secs = report_sections(text)
    issues = []
    for p in PLACEHOLDER_CITATION_PATTERNS:
        n = F.regexp_count(text, F.lit("(?i)" + p))
        issues.append(F.when(n > 0, F.format_string(ISSUE_CITATIONS, n)))
    heavy = F.transform(
        F.filter(secs, lambda s: F.regexp_count(s["body"], F.lit(SECTION_PLACEHOLDER))
                 > F.size(F.filter(F.split(s["body"], "\n"), lambda ln: F.length(py_strip(ln)) > 0)) / 3.0),
        lambda s: F.concat(F.lit(ISSUE_SECTION[0]), s["title"], F.lit(ISSUE_SECTION[1])))
    asked = F.regexp_extract(text, QUESTION_SECTION_RE, 0)
    marks = F.size(F.filter(F.transform(F.split(asked, "\n"), py_strip), lambda ln: ln.startswith("*") | ln.startswith("-")))
    issues.append(F.when(marks > 3, F.lit(ISSUE_QUESTIONS)))
    opens = F.length(text) - F.length(F.replace(text, F.lit("["), F.lit("")))
    closes = F.length(text) - F.length(F.replace(text, F.lit("]"), F.lit("")))
    tail = [F.when(opens != closes, F.lit(ISSUE_BRACKETS)),
            F.when(words < 500, F.lit(ISSUE_SHORT))]
    all_issues = F.concat(F.filter(F.array(*issues), lambda x: x.isNotNull()), heavy,
                          F.filter(F.array(*tail), lambda x: x.isNotNull()))
    return F.struct(all_issues.alias("issues"), words.cast("bigint").alias("word_count"),
                    F.size(secs).cast("bigint").alias("section_count"), (F.size(all_issues) == 0).alias("is_complete"))
