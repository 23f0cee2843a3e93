"""Composition of table transforms and message handling
(T27-T29, T36, T37, T18, T22).

An approach is a named ``DataFrame -> DataFrame`` transform. Pipelines are
text: ``a&b`` applies ``b`` after ``a``; ``a|b`` runs both on the same input
and unions the results with a ``branch`` column. Repetition explodes a
sample index (no cross join).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.answers import py_strip

Transform = Callable[[DataFrame], DataFrame]
APPROACHES: dict[str, Transform] = {}


def approach(name: str):
    """M1: register a transform under a slug."""
    def deco(fn: Transform) -> Transform:
        APPROACHES[name] = fn
        return fn
    return deco


@approach("strip_think")
def _strip_think(df: DataFrame) -> DataFrame:
    return df.withColumn("text", A.strip_think_blocks(F.col("text")))


@approach("final_answer")
def _final_answer(df: DataFrame) -> DataFrame:
    return df.withColumn("text", A.extract_final_answer(F.col("text")))


@approach("normalize")
def _normalize(df: DataFrame) -> DataFrame:
    return df.withColumn("text", A.normalize_answer(F.col("text")))


@approach("plain")
def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("text", A.normalize_answer_plain(F.col("text")))


def apply_approach(df: DataFrame, name: str) -> DataFrame:
    if name not in APPROACHES:
        raise KeyError(f"unknown approach {name}")
    return df.transform(APPROACHES[name])


def run_pipeline(df: DataFrame, spec: str) -> DataFrame:
    """M2: 'a&b' = sequential, 'a|b' = parallel branches (all kept)."""
    if "|" in spec:
        outs = [run_pipeline(df, part).withColumn("branch", F.lit(part)) for part in spec.split("|")]
        out = outs[0]
        for o in outs[1:]:
            out = out.unionByName(o)
        return out
    for name in spec.split("&"):
        df = apply_approach(df, name.strip())
    return df


def repeat(df: DataFrame, n: int, col: str = "sample_id") -> DataFrame:
    """M3: each row n times with a 0-based sample index."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


APPROACH_TAG = "approach"


def extract_approach(text: Column, tag: str = APPROACH_TAG) -> Column:
    """struct(content without the tag, approach or null)."""
    pat = f"<{tag}>(.*?)</{tag}>"
    has = text.rlike(pat)
    return F.struct(F.when(has, py_strip(F.regexp_replace(text, pat, ""))).otherwise(text).alias("content"),
                    F.when(has, F.regexp_extract(text, pat, 1)).alias("approach"))


def choose_approach(tag: Column, column: Column, default: str) -> Column:
    """M4: in-message tag, else request column, else the default."""
    return F.coalesce(tag, column, F.lit(default))


def assign_round_robin(ranked: DataFrame, rank: str, variants: list[str]) -> DataFrame:
    """M5: variant = variants[(rank - 1) mod n] over a global rank."""
    arr = F.array(*[F.lit(v) for v in variants])
    return ranked.withColumn("variant", F.element_at(arr, (F.pmod(F.col(rank) - 1, F.lit(len(variants))) + 1).cast("int")))


def assign_weighted(df: DataFrame, key: str, weights: dict[str, float], seed: int = 11) -> DataFrame:
    """M5: weighted assignment: a deterministic hash bucket in [0, 1)
    against cumulative weights (a fixed, tiny lookup evaluated inline)."""
    total = sum(weights.values())
    u = F.pmod(F.col(key).cast("long") * 48271 + seed, F.lit(2147483647)) / 2147483647.0
    expr = None
    acc = 0.0
    for name, w in weights.items():
        acc += w / total
        expr = F.when(u < acc, F.lit(name)) if expr is None else expr.when(u < acc, F.lit(name))
    return df.withColumn("variant", expr.otherwise(F.lit(list(weights)[-1])))


def flatten_conversation(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per conversation, the system prompt (last system message, tag
    stripped), the 'User: ...' / 'Assistant: ...' transcript joined by
    newlines, and the approach tag (system first, else first user tag)."""
    ex = extract_approach(F.col("text"))
    t = turns.select(key, order, "role", ex["content"].alias("content"), ex["approach"].alias("tag"))
    line = F.when(F.col("role") == "user", F.concat(F.lit("User: "), F.col("content"))) \
        .when(F.col("role") == "assistant", F.concat(F.lit("Assistant: "), F.col("content")))
    g = t.groupBy(key).agg(
        F.max_by(F.when(F.col("role") == "system", F.struct(F.col("content").alias("c"), F.col("tag").alias("a"))),
                 F.when(F.col("role") == "system", F.col(order))).alias("_sys"),
        F.min_by(F.col("tag"), F.when((F.col("role") == "user") & F.col("tag").isNotNull(), F.col(order))).alias("_utag"),
        F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct(F.col(order), line.alias("l"))))).alias("_lines"))
    return g.select(key, F.coalesce(F.col("_sys.c"), F.lit("")).alias("system_prompt"),
                    F.array_join(F.transform("_lines", lambda x: x["l"]), "\n").alias("initial_query"),
                    F.when(F.col("_sys").isNotNull(), F.col("_sys.a")).otherwise(F.col("_utag")).alias("approach"))


def split_transcript(text: Column) -> Column:
    """T28: 'User: ...' / 'Assistant: ...' transcript -> array of
    struct(role, content); a separator is inserted before each tag."""
    marked = F.regexp_replace(text, r"(^|\n)(User|Assistant): ", "$1\u0001$2\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: F.length(p) > 0)
    return F.transform(parts, lambda p: F.struct(
        F.lower(F.split_part(p, F.lit("\u0002"), F.lit(1))).alias("role"),
        F.regexp_replace(F.split_part(p, F.lit("\u0002"), F.lit(2)), r"\n\z", "").alias("content")))


def response_contents(resp: Column) -> Column:
    """First choice's message content and usage of a chat response."""
    return F.struct(F.get_json_object(resp, "$.choices[0].message.content").alias("content"),
                    F.get_json_object(resp, "$.usage.prompt_tokens").cast("bigint").alias("prompt_tokens"),
                    F.get_json_object(resp, "$.usage.completion_tokens").cast("bigint").alias("completion_tokens"))


def few_shot_pairs(text: Column) -> Column:
    """The JSON array inside <output> as array of struct(question, answer)."""
    body = A.tagged_section(text, "output")
    return F.from_json(body, "array<struct<question:string,answer:string>>")


def parse_vector(text: Column) -> Column:
    """T37: '[1, 2, 3]' (JSON) or '1,2,3' (bracket-less CSV) -> array<double>;
    null when any element is not a number."""
    t = py_strip(text)
    js = F.from_json(t, "array<double>")
    csv = F.transform(F.split(F.regexp_replace(t, r"^\[|\]\z", ""), ","), lambda s: py_strip(s).try_cast("double"))
    csv_ok = F.when(F.forall(csv, lambda x: x.isNotNull()), csv)
    return F.coalesce(F.when(t.startswith("["), js), csv_ok)


# The structure that stands in when no JSON can be read.
DEFAULT_STRUCTURE = (
    '{"problem_understanding":"Analyze and understand the problem requirements",'
    '"solution_approach":"Determine the best approach based on problem characteristics",'
    '"step_by_step_reasoning":"Work through the problem systematically",'
    '"verification":"Verify the solution is correct and complete",'
    '"final_answer":"State the final answer clearly"}')
NESTED_OBJECT_RE = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
CODE_BLOCK_RES = (r"(?s)```json\s*([^`]+)```", r"(?s)```\s*([^`]+)```", r"(?s)`([^`]+)`")
#: Quotes, bare names, trailing and repeated commas, in this order.
JSON_REPAIRS = ((r"([^\\])'([^']*)'(\s*[,}])", r'$1"$2"$3'), (r"([{,]\s*)([a-zA-Z_][a-zA-Z0-9_]*)\s*:", r'$1"$2":'),
                (r",\s*([}\]])", "$1"), (r",,+", ","))


def balanced_object(text: Column) -> Column:
    """The text from the first opening brace to the closing one that balances it, or null."""
    rest = F.substring(text, F.locate("{", text), F.length(text))
    parts = F.split(rest, r"\}", -1)
    opened = lambda p: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit("")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("open"), F.lit(0).alias("end"))

    def step(a, p):
        left = a["open"] + opened(p) - 1
        n = a["n"] + F.length(p) + 1
        return F.struct(n.alias("n"), left.alias("open"), F.when((a["end"] == 0) & (left == 0), n).otherwise(a["end"]).alias("end"))

    end = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["end"]
    return F.when((F.locate("{", text) > 0) & (end > 0), F.substring(rest, F.lit(1), end))


def json_from_text(text: Column) -> Column:
    """struct(strategy, json): the first candidate that is an object with
    at least one field: 1 the first balanced braces, 2 the first nested
    pattern, 3 a code block, 4 the outermost braces after repairs; else 5, the
    default structure."""
    span = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    for pattern, to in JSON_REPAIRS:
        span = F.regexp_replace(span, pattern, to)
    candidates = [(1, balanced_object(text)), (2, F.regexp_extract(text, NESTED_OBJECT_RE, 0)),
                  *[(3, py_strip(F.regexp_extract(text, p, 1))) for p in CODE_BLOCK_RES], (4, span)]
    # The parser stops after one value: inside brackets, what follows it shows.
    one = lambda c: F.size(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")) == 1
    whole = lambda c: c.startswith("{") & c.endswith("}") & F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull() & one(c)
    found = [F.when(whole(c) & ~c.rlike(r"^\{\s*\}$"),
                    F.struct(F.lit(k).alias("strategy"), c.alias("json"))) for k, c in candidates]
    return F.coalesce(*found, F.struct(F.lit(5).alias("strategy"), F.lit(DEFAULT_STRUCTURE).alias("json")))


def key_values(text: Column) -> Column:
    """T22: 'KEY: value' lines -> array of struct(k, v) (keys upper-cased
    and trimmed); read a key with ``kv_get`` (later lines win)."""
    lines = F.filter(F.split(text, "\n"), lambda ln: ln.contains(":"))
    entries = F.transform(lines, lambda ln: F.struct(F.upper(py_strip(F.split_part(ln, F.lit(":"), F.lit(1)))).alias("k"),
                                                       py_strip(ln.substr(F.locate(":", ln) + 1, F.lit(2147483647))).alias("v")))
    return F.filter(entries, lambda e: F.length(e["k"]) > 0)


def kv_get(entries: Column, key: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(-1))["v"]


def score_value(v: Column, default: float = 0.5) -> Column:
    """A score field; unparsable -> ``default``."""
    return F.coalesce(F.regexp_extract(v, r"([0-9]*\.?[0-9]+)", 1).try_cast("double"), F.lit(default))
