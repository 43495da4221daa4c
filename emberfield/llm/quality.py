"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only.

Base rules reject short texts and texts that repeat themselves.  Every document's statistics are then
transformed to a vector (log word count, log word length, log shares of symbols, of repeated lines
and of repeated words), and minimum-covariance-determinant estimates are fitted per language and
source: from three starts (mean and covariance of all rows; median and spread per coordinate; mean and
covariance of an eighth of the rows, by hash) concentration steps refit mean and covariance to the
``coverage`` share of rows nearest by Mahalanobis distance until the determinants settle, and the start
with the smallest determinant stays.  A ridge, the tolerance of each statistic, keeps covariances
regular where one is constant.  Rows farther than ``cutoff`` (a squared distance, after scaling the
median distance to its chi-square value) are rejected.  The default cutoff is the multivariate Chebyshev
bound: whatever its distribution, a vector of p statistics is beyond p / share with at most that share
(5 / 0.01).  A chi-square quantile would not do, as shares of symbols and repeats are zero in most rows.

Each concentration step is one grouped sum over distance classes (1/64 octave wide): counts, sums and
cross products per class are combined before the shuffle, and the classes of a group are then
accumulated up to the coverage.  So a group of any size costs a bounded number of rows.

A source with fewer than ``least`` rows is judged by the estimate of all rows of its language, and a
language with fewer than that by the estimate of all rows; so every row is judged, at any table size.

Defined results: a null text has no words and fails the base rules; null languages and sources
form a group each; rows that fail the base rules take no part in the estimates; repeated rows count
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, materialize, words

DIMS = 5
#: Median of the chi-square distribution with five degrees of freedom.
CHI2_MEDIAN = 4.351460191
RIDGE = (0.05, 0.02, 0.05, 0.3, 0.3)


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(*carry, "doc_id", "lang", "source", text.alias("text"))
    df = df.select(
        *carry, "doc_id", "lang", "source",
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("lines"),
        F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"),
    )
    last = F.size("w") - 3
    windows = F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        *carry, "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("t"),
    )
    return df.select(
        *carry, "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size(F.array_distinct("t")) < F.size("t"), _covered("t")).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _covered(windows: str) -> Column:
    """Words within the three-word windows that occur twice or more: equal windows are sorted together."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(s: Column) -> Column:
        size = F.size(s)
        again = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda k: ((k > 0) & (F.get(s, k).h == F.get(s, k - 1).h)) | ((k < size - 1) & (F.get(s, k).h == F.get(s, k + 1).h)),
        )
        return F.sort_array(F.transform(again, lambda k: F.get(s, k).i))

    # One-element array to name the sorted array within the expression.
    positions = F.get(F.transform(F.array(placed), marked), 0)
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    total = F.aggregate(
        positions, start, lambda a, p: F.struct(p.alias("at"), (a.n + F.least(F.lit(3), p - a["at"])).alias("n"))
    )
    return total["n"]


def vectors(stats: DataFrame) -> DataFrame:
    """Adds base_failed and the transformed statistics x0 ... x4."""
    n, c = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    x = [
        F.log1p(F.col("n_words").cast("double")) * 0.5,
        F.log(c / n),
        F.log1p(20 * F.col("n_symbols") / c),
        F.log1p(20 * F.col("n_dup_lines") / n),
        F.log1p(5 * F.col("n_repeat_words") / n),
    ]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).select("*", *(v.alias(f"x{i}") for i, v in enumerate(x)))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _moments(x: str = "x") -> list[Column]:
    own = lambda i: F.col(f"{x}{i}")
    return [
        F.count("*").alias("n"),
        *(F.sum(own(i)).alias(f"s{i}") for i in range(DIMS)),
        *(F.sum(own(i) * own(j)).alias(f"s{i}_{j}") for i, j in _pairs()),
    ]


def _factored(sums: DataFrame, *keys: str) -> DataFrame:
    """Mean, Cholesky factor and log determinant of the ridged covariance from grouped sums."""
    n = F.greatest("n", F.lit(1)).cast("double")
    df = sums.select(*keys, "n", *((F.col(f"s{i}") / n).alias(f"m{i}") for i in range(DIMS)), *(
        (F.col(f"s{i}_{j}") / n - F.col(f"s{i}") * F.col(f"s{j}") / (n * n) + F.lit(RIDGE[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}")
        for i, j in _pairs()
    ))
    return _cholesky(df)


def _cholesky(df: DataFrame) -> DataFrame:
    """From columns c{i}_{j} to the lower factor l{i}_{j} and logdet, one column of it at a time."""
    for j in range(DIMS):
        inner = functools.reduce(operator.add, (F.col(f"l{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        floor = F.lit(RIDGE[j] ** 2 * 0.01)
        df = df.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(F.col(f"c{j}_{j}") - inner, floor)))
        for i in range(j + 1, DIMS):
            cross = functools.reduce(operator.add, (F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l{i}_{j}", (F.col(f"c{i}_{j}") - cross) / F.col(f"l{j}_{j}"))
    logdet = functools.reduce(operator.add, (2 * F.log(f"l{j}_{j}") for j in range(DIMS)))
    return df.withColumn("logdet", logdet).drop(*(f"c{i}_{j}" for i, j in _pairs()))


def _with_distance(df: DataFrame, name: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    for i in range(DIMS):
        inner = functools.reduce(operator.add, (F.col(f"l{i}_{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - inner) / F.col(f"l{i}_{i}"))
    total = functools.reduce(operator.add, (F.col(f"z{i}") ** 2 for i in range(DIMS)))
    return df.withColumn(name, total).drop(*(f"z{i}" for i in range(DIMS)))


def _class(d2: str = "d2") -> Column:
    return F.floor(64 * F.log2(F.col(d2) + 1e-6)).cast("int")


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], most: int = 20_000) -> DataFrame:
    """Rows with their group's values: groups are broadcast only where their number is small enough."""
    return rows.join(F.broadcast(groups) if groups.count() <= most else groups.hint("merge"), keys)


def groups(base: DataFrame, least: int) -> DataFrame:
    """(lang_key, source_key) -> grp, whose estimate judges its rows, and fits, the groups that its rows help to fit."""
    sizes = base.groupBy("lang_key", "source_key").agg(F.count("*").alias("n")).withColumn("large", F.col("n") >= least)
    langs = sizes.groupBy("lang_key").agg(F.sum("n").alias("of_lang"), F.bool_and("large").alias("no_pool"))
    langs = materialize(langs, "languages")
    pooled = langs.filter(f"not no_pool and of_lang < {int(least)}").limit(1).count() > 0
    own = F.concat(F.lit("s:"), F.length("lang_key"), F.lit(":"), "lang_key", F.lit(":"), "source_key")
    lang = F.concat(F.lit("l:"), "lang_key")
    both = _joined(sizes, langs, ["lang_key"])
    enough = F.col("of_lang") >= least
    fits = F.array(F.when(F.col("large"), own), F.when(enough & ~F.col("no_pool"), lang), F.lit("all" if pooled else None))
    return both.select(
        "lang_key", "source_key", F.when(F.col("large"), own).when(enough, lang).otherwise("all").alias("grp"),
        F.array_compact(fits.cast("array<string>")).alias("fits"),
    )


def _spread_start(base: DataFrame) -> DataFrame:
    """Median and scaled median deviation of each coordinate, from classes 1/128 wide."""
    long = base.select("grp", F.expr(f"stack({DIMS}, " + ", ".join(f"{i}, x{i}" for i in range(DIMS)) + ") as (k, x)"))

    def median(df: DataFrame, value: Column) -> DataFrame:
        counted = df.groupBy("grp", "k", F.floor(value * 128).alias("b")).agg(F.count("*").alias("n"))
        upto = Window.partitionBy("grp", "k").orderBy("b")
        counted = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("grp", "k")))
        return counted.filter(2 * F.col("upto") >= F.col("all")).groupBy("grp", "k").agg(((F.min("b") + 0.5) / 128).alias("mid"))

    mids = materialize(median(long, F.col("x")), "medians")
    away = median(_joined(long, mids, ["grp", "k"]), F.abs(F.col("x") - F.col("mid"))).withColumnRenamed("mid", "mad")
    both = mids.join(away.hint("merge"), ["grp", "k"])
    flat = both.groupBy("grp").agg(
        *(F.max(F.when(F.col("k") == i, F.col("mid"))).alias(f"m{i}") for i in range(DIMS)),
        *(F.max(F.when(F.col("k") == i, F.col("mad"))).alias(f"d{i}") for i in range(DIMS)),
    )
    return flat.select("grp", *(f"m{i}" for i in range(DIMS)), *(
        (F.lit(0.0) if i != j else (1.4826 * F.col(f"d{i}")) ** 2 + RIDGE[i] ** 2).alias(f"c{i}_{j}") for i, j in _pairs()
    ))


def estimates(base: DataFrame, coverage: float = 0.75, steps: int = 20, settled: float = 1e-2) -> DataFrame:
    """Per group: mean m*, factor l*_*, and the factor ``scale`` of its distances; base has grp and x0 ... x4.

    Steps end when no determinant's logarithm falls by more than ``settled``.
    """
    shape = ["grp", "start", *(f"m{i}" for i in range(DIMS)), *(f"l{i}_{j}" for i, j in _pairs()), "logdet"]
    classical = _factored(base.groupBy("grp").agg(*_moments()), "grp").withColumn("start", F.lit(0)).select(*shape)
    spread = _cholesky(_spread_start(base)).withColumn("start", F.lit(1)).select(*shape)
    eighth = base.filter(F.pmod(F.xxhash64(*(f"x{i}" for i in range(DIMS))), F.lit(8)) == 0)
    some = _factored(eighth.groupBy("grp").agg(*_moments()), "grp").withColumn("start", F.lit(2)).select(*shape)
    now = materialize(classical.unionByName(spread).unionByName(some), "estimates")
    by_group = Window.partitionBy("grp", "start")
    for _ in range(steps):
        near = _with_distance(_joined(base, now, ["grp"])).groupBy("grp", "start", _class().alias("b"))
        near = near.agg(*_moments(), F.max("logdet").alias("was"))
        near = near.withColumn("before", F.sum("n").over(by_group.orderBy("b")) - F.col("n"))
        near = near.withColumn("all", F.sum("n").over(by_group)).filter(F.col("before") < coverage * F.col("all"))
        sums = near.groupBy("grp", "start").agg(
            F.max("was").alias("was"),
            *(F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(DIMS)), *(f"s{i}_{j}" for i, j in _pairs())]),
        )
        now = materialize(_factored(sums, "grp", "start", "was").select(*shape, "was"), "estimates")
        fallen = now.agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        now = now.drop("was")
        if fallen is None or fallen <= settled:
            break
    best = now.groupBy("grp").agg(F.min_by(F.struct(*shape[1:]), F.struct("logdet", "start")).alias("e")).select("grp", "e.*")
    best = materialize(best.drop("start", "logdet"), "estimates")
    far = _with_distance(_joined(base, best, ["grp"])).groupBy("grp", _class().alias("b")).agg(F.count("*").alias("n"))
    upto = far.withColumn("upto", F.sum("n").over(Window.partitionBy("grp").orderBy("b")))
    upto = upto.withColumn("all", F.sum("n").over(Window.partitionBy("grp"))).filter(2 * F.col("upto") >= F.col("all"))
    middle = upto.groupBy("grp").agg(F.min("b").alias("b"))
    scale = middle.select("grp", (CHI2_MEDIAN / F.pow(F.lit(2.0), (F.col("b") + 0.5) / 64)).alias("scale"))
    return materialize(best.join(scale.hint("merge"), "grp"), "estimates")


def quality(docs: DataFrame, least: int = 200, cutoff: float = DIMS / 0.01, coverage: float = 0.75, carry: str | None = None) -> DataFrame:
    """Statistics, base_failed, distance and kept for every document, and the column ``carry`` as it was."""
    carried = [carry] if carry else []
    keys = [F.coalesce(c, F.lit("\x00null")).alias(f"{c}_key") for c in ("lang", "source")]
    stats = materialize(vectors(statistics(docs, *carried)).select("*", *keys), "statistics")
    base = stats.filter(~F.col("base_failed"))
    named = materialize(groups(base, least), "groups")
    x = [f"x{i}" for i in range(DIMS)]
    to_fit = _joined(base.select("lang_key", "source_key", *x), named.select("lang_key", "source_key", "fits"), ["lang_key", "source_key"])
    fitted = estimates(to_fit.select(F.explode("fits").alias("grp"), *x), coverage)
    named = named.drop("fits")
    most = 20_000
    hint = lambda t: F.broadcast(t) if t.count() <= most else t.hint("merge")
    marked = stats.join(hint(named), ["lang_key", "source_key"], "left").join(hint(fitted), "grp", "left")
    marked = _with_distance(marked).withColumn("distance2", F.col("d2") * F.col("scale"))
    return marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("distance2") <= cutoff)).alias("kept"),
        F.when(~F.col("base_failed"), F.col("distance2")).alias("distance2"), *carried,
    )
