"""Quality rules: base counts, and robust multivariate outliers per language and source.

Everything is DataFrame and SQL expressions. Counts of a text come from higher-order
functions over its own words, so no word leaves its row. The outlier rule is a minimum
covariance determinant estimate a group, from three deterministic starts about the median:
independent coordinates, correlations of hyperbolic tangents, and spatial signs. Concentration
steps take the share ``h`` of a group's rows that are nearest and estimate mean and covariance
anew from these, until no determinant falls any more; of the starts the one with the least
determinant wins. A row's distance is by its group's covariance and the row's own
resolution: the variance that a coordinate has by counting so few words, characters or lines,
1 / 4n for the root of a share. Groups and starts are rows of a small table, broadcast after
their number is known; a step is two partial aggregates (the h-quantile, then sums), so a group
that holds a third of all rows is no task's burden.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm._shared import Scratch, small

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Coordinates of the statistic vector, and a least standard deviation that keeps covariances invertible:
#: log of the mean word length, and roots of the shares of symbols, of repeated words and of repeated lines.
COORDINATES = {"x1": 0.01, "x2": 0.01, "x3": 0.01, "x4": 0.01}
#: Words that one repetition takes: a phrase of six words that is there twice.
REPETITION = 12
#: Variance of each coordinate by one row's counts; word lengths vary by about half their mean.
RESOLUTION = {"x1": (0.25, "n_words"), "x2": (0.25, "word_chars"), "x3": (0.25 * REPETITION, "n_words"), "x4": (0.25, "n_lines")}
_D = len(COORDINATES)
_STARTS = 3


def _bind(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row: a lambda variable is not inlined again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word run found twice or more among the words ``w``."""
    runs = lambda w: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))
    twice = lambda s: F.sort_array(F.filter(F.transform(s, lambda x, i: F.when((x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h), x.p)), lambda p: p.isNotNull()))
    span = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a.n + F.least(F.lit(3), x - a.last)).alias("n"), x.alias("last")), lambda a: a.n)
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_bind(runs(w), lambda s: span(twice(s))))


def text_statistics(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines> of a text; all 0 for null."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    chars = F.length(F.translate(t, SPACE, ""))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    lines = _bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    counts = _bind(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep")))
    return _bind(F.struct(counts.alias("c"), lines.alias("l")), lambda s: F.struct(
        s.c.n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        s.l.dup.cast("long").alias("n_dup_lines"), s.c.rep.cast("long").alias("n_repeat_words"), s.l.n.cast("long").alias("n_lines"),
    ))


def _chi2_cdf(x: float, dof: int) -> float:
    """For even dof."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, dof) < p else (lo, mid)
    return lo


def _pairs():
    xs = list(COORDINATES)
    return [(i, j, xs[i], xs[j]) for i in range(_D) for j in range(i + 1)]


def _covariance(sums: DataFrame, scale: float) -> DataFrame:
    """Mean m_i and covariance c_ij (scaled, with the coordinates' floors) from n, s_i and q_ij."""
    xs, floors = list(COORDINATES), list(COORDINATES.values())
    cov = lambda x, y: F.expr(f"q_{x}_{y} / n - s_{x} * s_{y} / n / n")
    return sums.select("g", "start", *(F.expr(f"s_{x} / n").alias(f"m_{x}") for x in xs), *((F.greatest(cov(x, y), F.lit(0)) * scale + floors[i] ** 2 if i == j else cov(x, y) * scale).alias(f"c_{i}{j}") for i, j, x, y in _pairs()))


def _factored(rows: DataFrame, own: bool) -> DataFrame:
    """rows with l_ij, the Cholesky factor of c_ij; own: columns r_ add a row's own variances to the diagonal."""
    floors = list(COORDINATES.values())
    for i, j, x, _ in _pairs():
        c = F.col(f"c_{i}{j}") + F.col(f"r_{x}") if own and i == j else F.col(f"c_{i}{j}")
        for k in range(j):
            c = c - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
        rows = rows.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(c, F.lit(floors[i] ** 2 / 2))) if i == j else c / F.col(f"l_{j}{j}"))
    return rows


def _log_determinant() -> Column:
    return sum((F.log(f"l_{i}{i}") for i in range(1, _D)), F.log("l_00")) * 2


def _distance(rows: DataFrame, fit: DataFrame, own: bool = False) -> DataFrame:
    """rows joined with their groups' estimates, and d2, the squared Mahalanobis distance; other columns of fit but g and start go."""
    out = _factored(rows.join(fit, "g", "left"), own)
    for i, x in enumerate(COORDINATES):
        z = F.col(x) - F.col(f"m_{x}")
        for k in range(i):
            z = z - F.col(f"l_{i}{k}") * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", z / F.col(f"l_{i}{i}"))
    return out.select(*rows.columns, "start", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, _D)), F.col("z_0") * F.col("z_0")).alias("d2"))


def _starts(scratch: Scratch, rows: DataFrame, groups: int) -> DataFrame:
    """(g, start, m_, c_): three estimates a group, all at the medians and with deviations from the median absolute ones."""
    xs, floors = list(COORDINATES), list(COORDINATES.values())
    median = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(10000))
    middle = small(scratch.written(rows.groupBy("g").agg(*(median(x).alias(f"m_{x}") for x in xs)), "medians"), groups)
    away = rows.join(middle, "g").groupBy("g").agg(*(F.first(f"m_{x}").alias(f"m_{x}") for x in xs), *((median(F.abs(F.col(x) - F.col(f"m_{x}"))) * 1.4826 + floors[i]).alias(f"d_{x}") for i, x in enumerate(xs)))
    away = scratch.written(away, "deviations")
    u = rows.join(small(away, groups), "g").select("g", *(((F.col(x) - F.col(f"m_{x}")) / F.col(f"d_{x}")).alias(x) for x in xs))
    norm = F.sqrt(sum((F.col(x) * F.col(x) for x in xs[1:]), F.col(xs[0]) * F.col(xs[0])))
    kinds = {1: F.tanh, 2: lambda x: F.when(norm > 0, F.col(x) / norm).otherwise(0.0)}
    sums = u.groupBy("g").agg(*(F.avg(kinds[1](x)).alias(f"t_{i}") for i, x in enumerate(xs)), *(F.avg(f(x) * f(y)).alias(f"k{s}_{i}{j}") for s, f in kinds.items() for i, j, x, y in _pairs()))
    # tangents about their means, signs about zero
    products = {1: lambda i, j: F.col(f"k1_{i}{j}") - F.col(f"t_{i}") * F.col(f"t_{j}"), 2: lambda i, j: F.col(f"k2_{i}{j}")}

    def correlation(s, i, j):  # 0 where a coordinate is constant
        p = products[s]
        return F.coalesce(F.try_divide(p(i, j), F.sqrt(F.greatest(p(i, i) * p(j, j), F.lit(0.0)))), F.lit(0.0))

    fit = away.join(small(sums, groups), "g")
    parts = [fit.select("g", F.lit(s).alias("start"), *(f"m_{x}" for x in xs), *((F.col(f"d_{x}") * F.col(f"d_{y}") * (F.lit(1.0) if i == j else correlation(s, i, j) if s else F.lit(0.0))).alias(f"c_{i}{j}") for i, j, x, y in _pairs())) for s in range(_STARTS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mcd(scratch: Scratch, rows: DataFrame, groups: int, h: float = 0.75, most_steps: int = 30) -> DataFrame:
    """The estimate of each group g of rows (g, x1..): mean m_, covariance c_, the winning start and log_det; groups: their number.

    The steps end when no group's and start's determinant falls by more than a millionth, or after
    most_steps; a determinant that rises, as ties at the quantile can make it, keeps what was.
    """
    xs = list(COORDINATES)
    rows = rows.select("g", *xs)
    # makes the covariance of the nearest share h of normal rows that of all
    scale = h / _chi2_cdf(chi2_quantile(h, _D), _D + 2)
    columns = ["g", "start", *(f"m_{x}" for x in xs), *(f"c_{i}{j}" for i, j, _, _ in _pairs())]
    fit = scratch.written(_starts(scratch, rows, groups).withColumn("log_det", F.lit(1e300)).withColumn("moves", F.lit(True)), "fit")
    for _ in range(most_steps):
        d = _distance(rows, small(fit.where("moves").select(columns), _STARTS * groups)).where("start IS NOT NULL")
        limit = d.groupBy("g", "start").agg(F.percentile_approx("d2", F.lit(h), F.lit(10000)).alias("limit"))
        near = d.join(small(limit, _STARTS * groups), ["g", "start"]).where("d2 <= limit")
        sums = near.groupBy("g", "start").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s_{x}") for x in xs), *(F.sum(F.col(x) * F.col(y)).alias(f"q_{x}_{y}") for _, _, x, y in _pairs()))
        new = _factored(_covariance(sums, scale), False).select(*columns, _log_determinant().alias("log_det"))
        old = fit.select("g", "start", F.col("log_det").alias("was"), F.struct(*columns[2:], "log_det").alias("kept"))
        falls = F.col("log_det") < F.col("was") - 1e-6
        both = small(new, _STARTS * groups).join(old, ["g", "start"], "right").select("g", "start", F.coalesce(falls, F.lit(False)).alias("moves"), F.struct(*columns[2:], "log_det").alias("new"), "kept")
        nxt = scratch.written(both.select("g", "start", F.when(F.col("moves"), F.col("new")).otherwise(F.col("kept")).alias("f"), "moves").select("g", "start", "f.*", "moves"), "fit")
        scratch.drop(fit)
        fit = nxt
        if not fit.where("moves").count():
            break
    best = fit.groupBy("g").agg(F.min(F.struct("log_det", "start", *columns[2:])).alias("f"))
    return scratch.written(best.select("g", "f.*"), "best")


def quality_rules(spark: SparkSession, docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, confidence: float = 0.975, h: float = 0.75, min_group: int = 50, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, counts, base_failed, distance and kept of each row of ``docs``.

    Estimates are made from the rows that pass the base rules, of one language and source.
    Sources with fewer than ``min_group`` such rows are pooled by language; where even that
    gives fewer, nothing is an outlier. Null languages and sources are groups like others.
    Null texts are empty and fail the base rules; null and repeated doc_ids are rows like
    any others. A text of any length is one row's work: its words are an array within the row. An empty table gives no rows; other columns are not read.
    """
    with Scratch(spark) as scratch:
        null = F.lit("\x00")
        lang, source = (F.coalesce(F.col(c).cast("string"), null) for c in (lang_col, source_col))
        src = docs.select(F.col(id_col).alias("doc_id"), F.to_json(F.struct(lang.alias("l"), source.alias("s"))).alias("g"), lang.alias("lang"), text_statistics(F.col(text_col)).alias("t"))
        stats = src.select("doc_id", "g", "lang", "t.*")
        failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
        share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
        stats = stats.select("*", failed.alias("base_failed")).select("*", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))).alias("x1"), share("n_symbols", "word_chars").alias("x2"), share("n_repeat_words", "n_words").alias("x3"), share("n_dup_lines", "n_lines").alias("x4"))
        stats = scratch.written(stats, "statistics")

        sizes = stats.where("NOT base_failed").groupBy("g", "lang").agg(F.count("*").alias("n"))
        pooled = sizes.selectExpr("g", "n", "lang", f"sum(CASE WHEN n < {min_group} THEN n ELSE 0 END) OVER (PARTITION BY lang) AS pool")
        name = F.when(F.col("n") >= min_group, F.col("g")).when(F.col("pool") >= min_group, F.concat(F.lit("lang "), F.col("lang")))
        names = scratch.written(pooled.select("g", name.alias("group")), "groups")
        n_names, groups = names.agg(F.count("*"), F.countDistinct("group")).first()
        own = [(F.lit(v) / F.greatest(F.col(n), F.lit(1))).alias(f"r_{x}") for x, (v, n) in RESOLUTION.items()]
        named = stats.join(small(names, n_names), "g", "left")
        fit = mcd(scratch, named.where("NOT base_failed AND group IS NOT NULL").select(F.col("group").alias("g"), *COORDINATES), groups, h)
        rows = named.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *COORDINATES, *own, F.col("group").alias("g"))
        out = _distance(rows, small(fit, groups), own=True)
        kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(confidence, _D))
        return scratch.keep(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(~F.col("base_failed"), F.sqrt("d2")).alias("distance"), kept.alias("kept")), "quality")
