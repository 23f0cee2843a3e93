"""Quality rules by robust multivariate outliers.

Each text gives counts (words, their characters, symbols, repeated lines,
words in repeated eight-word windows). Texts that are very short or mostly
repeat themselves fail outright. The others are judged per language and
source: their transformed counts get a minimum-covariance-determinant estimate
(centre and covariance of the ``COVER`` share of rows that lie closest
together), and a text goes if its Mahalanobis distance is beyond ``CUTOFF``.

The estimate starts from two deterministic guesses per group (medians with
quartile spreads, and plain moments) and concentrates each ``STEPS`` times:
distances, their ``COVER`` quantile, moments of the rows within; the smaller
determinant wins. Moments and histogram quantiles are partial aggregates, so a
group of a third of all rows costs no more than its rows. A floor on every
spread keeps counts that are almost always zero from making the covariance
singular. Every group has an estimate, whatever its size: a language's is mixed
with that of all rows, and a group's with its language's, the finer one with
weight n / (n + ``PRIOR``) for its n rows (mean and covariance of the mixture),
so a verdict changes smoothly as a group grows and no size switches it.

Only DataFrame functions. Edge cases: a null or empty text has no words and
fails; a null language or source is the empty one; repeated rows all count; an
empty table gives an empty result; input columns named like an output column
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW = 8
#: Base rule: fewer words, or a larger percentage of them in repeated windows, fails.
MIN_WORDS, MAX_REPEAT = 20, 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Share of a group that the estimate covers, concentration steps, and the rows that weigh as much as the coarser estimate.
COVER, STEPS, PRIOR = 0.75, 4, 100
#: Least spread of each transformed count (natural logarithms).
FLOORS = (0.6, 0.1, 0.35, 0.6, 0.6)
#: Makes the covariance of the closest 75 % of five normal dimensions consistent.
CONSISTENCY = 1.41
#: Squared distance beyond which a text goes: chi-square of five degrees, tail 1e-7.
CUTOFF = 41.5

N = len(FLOORS)
X = [f"_x{i}" for i in range(N)]
#: Histogram bins a unit.
BINS = 200


def _repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Words inside windows that occur more than once. Window hashes come from
    three doublings; only texts with an equal pair of hashes sort theirs. Each
    array is a column of its own, used twice, so that none is computed anew
    inside a lambda."""
    df = df.withColumn("_h0", F.transform(words, lambda w: F.xxhash64(w)))
    for i, step in enumerate((1, 2, 4)):
        h, n = f"_h{i}", F.size(f"_h{i}") - step
        df = df.withColumn(f"_h{i + 1}", F.when(n > 0, F.zip_with(F.slice(h, 1, n), F.slice(h, F.lit(1 + step), n),
                                                                  lambda a, b: F.xxhash64(a, b))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h3")) < F.size("_h3"), F.array_sort(F.arrays_zip(
        F.col("_h3").alias("h"), F.sequence(F.lit(0), F.size("_h3") - 1).alias("p")))))
    # Neighbours in hash order: an entry repeats if its hash equals the one before or after.
    n = F.size("_s")
    df = df.withColumn("_z", F.arrays_zip(
        F.col("_s").alias("c"), F.concat(F.slice("_s", 1, 1), F.slice("_s", F.lit(1), n - 1)).alias("b"),
        F.concat(F.slice("_s", F.lit(2), n - 1), F.slice("_s", n, F.lit(1))).alias("a")))
    at = F.transform(F.filter("_z", lambda z: ((z["c"]["h"] == z["b"]["h"]) & (z["c"]["p"] != z["b"]["p"]))
                              | ((z["c"]["h"] == z["a"]["h"]) & (z["c"]["p"] != z["a"]["p"]))), lambda z: z["c"]["p"])
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(at)))
    gaps = F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")),
                      lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)
    return df.withColumn(out, F.coalesce(total, F.lit(0).cast("long"))) \
        .drop("_h0", "_h1", "_h2", "_h3", "_s", "_z", "_p")


def measured(df: DataFrame, text: str) -> DataFrame:
    """Add the five counts of the whole text and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(BLANKS))
    out = common.without(df, *COUNTS, "base_failed", "_words", "_lines") \
        .withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, common.SPACE, -1)))
    out = _repeat_words(out, "_words", "n_repeat_words") \
        .withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")) \
        .withColumn("n_words", F.size("_words").cast("long")) \
        .withColumn("word_chars", F.char_length(F.translate(t, BLANKS, "")).cast("long")) \
        .withColumn("n_symbols", (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long")) \
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")) \
        .drop("_words", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def transformed() -> list[Column]:
    """Logarithms of length, word length, and of rates per hundred words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c: F.log1p(100.0 * F.col(c) / n)
    return [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]


def _bin_quantiles(df: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Per key, the lower end of the bin in which each share of the rows is reached."""
    bins = df.groupBy(*keys, F.floor(value * BINS).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    run = bins.withColumn("_run", F.sum("_n").over(w.orderBy("_b"))).withColumn("_all", F.sum("_n").over(w))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("_run") >= p * F.col("_all"), F.col("_b"))).alias(name)
                                    for name, p in shares.items()])


def _cholesky(moments: DataFrame) -> DataFrame:
    """(…, _m*, _f**, _det): factor of the covariance ``_v**`` with the floors added."""
    f: dict[tuple[int, int], str] = {}
    out = moments
    for i in range(N):
        for j in range(i + 1):
            rest = F.col(f"_v{j}{i}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f[i, k]) * F.col(f[j, k])
            f[i, j] = f"_f{i}{j}"
            # The floors bound every pivot from below; the guard is against rounding.
            value = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f[j, j])
            out = out.withColumn(f[i, j], value)
    det = F.lit(0.0)
    for i in range(N):
        det = det + F.log(F.col(f"_f{i}{i}"))
    return out.withColumn("_det", det).drop(*[f"_v{j}{i}" for i in range(N) for j in range(i + 1)])


def _moments(df: DataFrame, keys: list[str]) -> DataFrame:
    aggs = [F.avg(x).alias(f"_m{i}") for i, x in enumerate(X)]
    aggs += [F.covar_pop(X[j], X[i]).alias(f"_v{j}{i}") for i in range(N) for j in range(i + 1)]
    return _cholesky(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *aggs))


def _with_distance(df: DataFrame) -> DataFrame:
    """Add ``_d``, the squared distance, by forward substitution."""
    for i in range(N):
        rest = F.col(X[i]) - F.col(f"_m{i}")
        for k in range(i):
            rest = rest - F.col(f"_f{i}{k}") * F.col(f"_y{k}")
        df = df.withColumn(f"_y{i}", rest / F.col(f"_f{i}{i}"))
    d = F.lit(0.0)
    for i in range(N):
        d = d + F.col(f"_y{i}") * F.col(f"_y{i}")
    return df.withColumn("_d", d).drop(*[f"_y{i}" for i in range(N)])


PARAMS = ["_det", *[f"_m{i}" for i in range(N)], *[f"_f{i}{j}" for i in range(N) for j in range(i + 1)]]


def mcd(rows: DataFrame) -> DataFrame:
    """Centre and factor per ``_g`` of rows (_g, _x*): the estimate of the smaller determinant."""
    tall = rows.select("_g", F.posexplode(F.array(*X)).alias("_i", "_v"))
    q = _bin_quantiles(tall, ["_g", "_i"], F.col("_v"), {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    wide = q.groupBy("_g").agg(*[F.max(F.when(F.col("_i") == i, F.col("_q2") / BINS)).alias(f"_m{i}") for i in range(N)],
                               *[F.max(F.when(F.col("_i") == i, F.pow((F.col("_q3") - F.col("_q1")) / (1.349 * BINS), 2)))
                                 .alias(f"_v{i}{i}") for i in range(N)])
    for i in range(N):
        for j in range(i):
            wide = wide.withColumn(f"_v{j}{i}", F.lit(0.0))
    columns = ["_g", "_start", *PARAMS]
    params = common.written(
        _cholesky(wide).withColumn("_start", F.lit(0)).select(columns)
        .unionAll(_moments(rows, ["_g"]).withColumn("_start", F.lit(1)).select(columns)), "mcd")
    for _ in range(STEPS):
        far = _with_distance(rows.join(params, "_g")).select("_g", "_start", "_d", *X)
        log_d = F.log(F.greatest(F.col("_d"), F.lit(1e-12)))
        edge = common.written(_bin_quantiles(far, ["_g", "_start"], log_d, {"_q": COVER}), "mcd")
        near = far.join(edge, ["_g", "_start"]).where(F.floor(log_d * BINS) <= F.col("_q"))
        params = common.written(_moments(near, ["_g", "_start"]).select(columns), "mcd")
    best = params.groupBy("_g").agg(F.min_by(F.struct(*PARAMS), F.struct("_det", "_start")).alias("_p"))
    return best.select("_g", "_p.*")


def _estimates(rows: DataFrame) -> DataFrame:
    """(_g, _n, _m*, _v**): size, centre and covariance (without the floors) per ``_g``."""
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    f = lambda i, k: F.col(f"_f{i}{k}")
    covariance = [(sum((f(i, k) * f(j, k) for k in range(1, j + 1)), f(i, 0) * f(j, 0)) - (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"_v{j}{i}")
                  for i in range(N) for j in range(i + 1)]
    return mcd(rows).join(sizes, "_g").select("_g", "_n", *[f"_m{i}" for i in range(N)], *covariance)


def _mixed(df: DataFrame, prior: float) -> DataFrame:
    """Replace ``_m*`` and ``_v**`` by those of the mixture with the coarser
    estimate in the columns of the same names with ``_o`` in front."""
    w = F.col("_n") / (F.col("_n") + F.lit(float(prior)))
    mix = lambda c: w * F.col(c) + (1 - w) * F.col(f"_o{c}")
    apart = lambda i: F.col(f"_m{i}") - F.col(f"_o_m{i}")
    new = {f"_m{i}": mix(f"_m{i}") for i in range(N)}
    new |= {f"_v{j}{i}": mix(f"_v{j}{i}") + w * (1 - w) * apart(i) * apart(j) for i in range(N) for j in range(i + 1)}
    kept = [c for c in df.columns if c not in new and not c.startswith("_o_") and c != "_n"]
    return df.select(*kept, *[x.alias(c) for c, x in new.items()])


def judged(df: DataFrame, lang: str, source: str, prior: float = PRIOR) -> DataFrame:
    """``df`` of ``measured`` with kept and distance (null: failed).
    ``df`` is read several times: pass a written table."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = common.without(df, "kept", "distance", "_l", "_c", "_g").withColumn("_l", key(lang)).withColumn("_c", key(source))
    good = rows.where(~F.col("base_failed")).select("_l", "_c", *[x.alias(n) for x, n in zip(transformed(), X)])
    good = common.written(good, "vectors")
    names = {"all": F.lit("[]"), "lang": F.to_json(F.array("_l")), "group": F.to_json(F.array("_l", "_c"))}
    found = common.written(_estimates(good.select(F.explode(F.array(*names.values())).alias("_g"), *X)), "estimates")
    groups = good.select("_l", "_c").distinct().withColumns({f"_{n}": c for n, c in names.items() if n != "all"})
    whole = found.where("_g = '[]'").select(*[F.col(c).alias(f"_o{c}") for c in found.columns if c not in ("_g", "_n")])  # one row
    langs = groups.select("_l", F.col("_lang").alias("_g")).distinct().join(found, "_g").drop("_g")
    langs = _mixed(langs.crossJoin(F.broadcast(whole)), prior)
    coarse = langs.select("_l", *[F.col(c).alias(f"_o{c}") for c in langs.columns if c != "_l"])
    fine = groups.select("_l", "_c", F.col("_group").alias("_g")).join(found, "_g").drop("_g").join(coarse, "_l")
    params = common.written(_cholesky(_mixed(fine, prior)).select("_l", "_c", *PARAMS), "mcd")
    out = rows.withColumns(dict(zip(X, transformed()))).join(params, ["_l", "_c"], "left")
    out = _with_distance(out).withColumn("distance", F.when(~F.col("base_failed"), F.col("_d") / CONSISTENCY))
    kept = ~F.col("base_failed") & (F.col("distance") <= CUTOFF)
    return out.withColumn("kept", kept).drop("_l", "_c", "_d", *X, *PARAMS)


def op8_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    counts = common.written(measured(docs, "text").drop("text"), "counts")
    return judged(counts, "lang", "source").select("doc_id", *COUNTS, "base_failed", "kept", "distance")
