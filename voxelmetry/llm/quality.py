"""Quality rules: base counts of a text, and robust multivariate outliers among its transformed statistics.

Everything is DataFrame expressions. For every language and source the minimum-covariance-determinant estimate of
centre and covariance is found by concentration steps, and rows far from it by Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelmetry.llm.common import pick, words
from voxelmetry.session import cut_lineage

SYMBOLS = "#*$%&|<>"
SHINGLE = 3


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words to ``docs`` (column text), drops text.

    Repeated windows are found by sorting the hashes of a text's windows with their positions: equal neighbours are
    repeats. The covered words are counted from the sorted positions, as every window covers up to the next one.
    """
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.btrim(x, F.lit(" \t\n\x0b\x0c\r")).alias("inner"))), lambda x: x["inner"] != "")
    cut = docs.select(
        *others, words(text).alias("w"), F.transform(lines, lambda x: x["line"]).alias("lines"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    windows = F.when(F.size("w") < SHINGLE, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(SHINGLE)]))
    )
    hashed = cut.select(
        *others, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("lines")).cast("long").alias("_lines"), windows.alias("h"),
    )
    # most texts repeat nothing, and a set of hashes says so at once
    placed = F.when(F.size(F.array_distinct("h")) == F.size("h"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    ordered = hashed.withColumn("s", placed).drop("h")
    before, after = lambda i: F.get(F.col("s"), i - 1)["h"], lambda i: F.get(F.col("s"), i + 1)["h"]
    same = F.filter("s", lambda x, i: x["h"].eqNullSafe(before(i)) | x["h"].eqNullSafe(after(i)))
    repeats = ordered.select(*[c for c in ordered.columns if c != "s"], F.sort_array(F.transform(same, lambda x: x["i"])).alias("at"))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, i: F.struct((a["n"] + i + SHINGLE - F.greatest(a["to"], i)).alias("n"), (i + SHINGLE).alias("to")), lambda a: a["n"].cast("long"),
    )
    return repeats.select(*others, "n_words", "word_chars", "n_symbols", "n_lines", (F.col("n_lines") - F.col("_lines")).alias("n_dup_lines"), covered.alias("n_repeat_words"))


# transformed statistics and the least spread that counts as ordinary in each: (expression, floor). The floors of repeats
# are the spread of rounding to one repeat, step / sqrt(12): a line in 18, or a window pair (6 words) in 157 words. With them
# each statistic alone can pass the limit of TAIL; floors from 0.77 and 0.66 up would keep every repeat
STATISTICS = [
    ("ln(1 + n_words)", 0.5),
    ("ln((1 + word_chars) / (1 + n_words))", 0.06),
    ("ln(1 + 100 * n_symbols / (1 + word_chars))", 0.25),
    ("ln(1 + 100 * n_dup_lines / greatest(1, n_lines))", 0.55),
    ("ln(1 + 100 * n_repeat_words / greatest(1, n_words))", 0.45),
]
DIMENSIONS = len(STATISTICS)
# statistics are whole multiples of 1 / SCALE, so that their sums are exact and don't depend on the order of rows
SCALE = 1 << 16
# groups with fewer rows are pooled by language, then over all languages
SMALLEST = 40
# distances are compared in steps of this part of a doubling
BINS = 32
# share of ordinary rows beyond the limit, were they normally distributed
TAIL = 1e-6


def chi_square_below(x: float, freedom: int) -> float:
    """P(X <= x), by the series of the incomplete gamma function."""
    a, x = freedom / 2, x / 2
    term = total = 1 / a
    k = 0
    while term > 1e-17 * total:
        k += 1
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_point(share: float, freedom: int) -> float:
    low, high = 1e-9, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, freedom) < share else (low, mid)
    return (low + high) / 2


def consistency(share: float, freedom: int) -> float:
    """What the covariance of the innermost ``share`` of normal rows must be multiplied by."""
    return share / chi_square_below(chi_square_point(share, freedom), freedom + 2)


X = [f"x{i}" for i in range(DIMENSIONS)]
M = [f"m{i}" for i in range(DIMENSIONS)]
L = {(i, j): f"l{i}_{j}" for i in range(DIMENSIONS) for j in range(i + 1)}


def _factored(groups: DataFrame, factor: float) -> DataFrame:
    """g, centre M and Cholesky factor L of factor * covariance + floors, from count, sums and sums of products."""
    n = F.col("n").cast("double")
    mean = lambda i: F.col(f"s{i}").cast("double") / n
    out = groups.select("g", *[mean(i).alias(f"c{i}") for i in range(DIMENSIONS)], *[
        (factor * (F.col(f"s{i}_{j}").cast("double") / n - mean(i) * mean(j)) / SCALE**2 + (STATISTICS[i][1] ** 2 if i == j else 0.0)).alias(f"v{i}_{j}") for i, j in L
    ])
    for (i, j), name in L.items():
        rest = F.col(f"v{i}_{j}")
        for k in range(j):
            rest = rest - F.col(L[i, k]) * F.col(L[j, k])
        out = out.withColumn(name, F.sqrt(rest) if i == j else rest / F.col(L[j, j]))
    return out.select("g", *[(F.col(f"c{i}") / SCALE).alias(M[i]) for i in range(DIMENSIONS)], *L.values())


def _distances(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Adds d2, the squared Mahalanobis distance of (x) from the estimate of the row's group."""
    out = rows.join(estimates, "g", how)
    for i in range(DIMENSIONS):
        rest = F.col(X[i]) / SCALE - F.col(M[i])
        for k in range(i):
            rest = rest - F.col(L[i, k]) * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(L[i, i]))
    return out.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIMENSIONS)), F.col("z0") * F.col("z0")))


def _moments() -> list[Column]:
    whole = lambda c: c.cast("decimal(20,0)")
    return [
        F.count(F.lit(1)).alias("n"), *[F.sum(whole(F.col(X[i]))).alias(f"s{i}") for i in range(DIMENSIONS)],
        *[F.sum(whole(F.col(X[i]) * F.col(X[j]))).alias(f"s{i}_{j}") for i, j in L],
    ]


def _small(groups: DataFrame, name: str) -> DataFrame:
    """A written table of one row a group, in few files: many tiny ones would look too large to broadcast."""
    return cut_lineage(groups.coalesce(8), name)


def _totals() -> list[Column]:
    return [F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(DIMENSIONS)], *[f"s{i}_{j}" for i, j in L]]]


def robust_estimates(rows: DataFrame, steps: int = 5) -> DataFrame:
    """g, centre and factor of the covariance of every group, by minimum covariance determinant.

    ``rows``: a written table of g and the statistics X. From medians and quartiles as the start, each concentration step
    fits the half of a group's rows that is nearest to the last estimate; its determinant never grows. A step is one
    aggregation: moments are summed by group and step of distance, with partial sums before the shuffle, and the
    nearest half is read off the running counts of those few rows. The last fit weighs out rows beyond the 97.5 %
    point. So a group of any size costs one pass a step and is never in one task.
    """
    q = lambda x, floor: F.percentile(F.round(F.col(x) * (8 / (floor * SCALE))), F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    start = rows.groupBy("g").agg(*[q(x, f).alias(f"q{i}") for i, (x, (_, f)) in enumerate(zip(X, STATISTICS))])
    now = start.select(
        "g", *[(F.col(f"q{i}")[1] * (f / 8)).alias(M[i]) for i, (_, f) in enumerate(STATISTICS)],
        *[
            F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) * (STATISTICS[i][1] / 8 / 1.349), 2) + STATISTICS[i][1] ** 2).alias(n) if i == j else F.lit(0.0).alias(n)
            for (i, j), n in L.items()
        ],
    )
    half = consistency(0.5, DIMENSIONS)
    running = W.partitionBy("g").orderBy("bin")
    for _ in range(steps):
        now = _small(now, "estimates")
        bin_of = F.floor(F.log2(F.col("d2") + 1) * BINS).cast("int")
        # written first: else the planner deals partial sums by group alone, and a large group's meet in one task
        bins = cut_lineage(_distances(rows, now).groupBy("g", bin_of.alias("bin")).agg(*_moments()), "bins")
        counted = bins.withColumn("_upto", F.sum("n").over(running)).withColumn("_all", F.sum("n").over(W.partitionBy("g")))
        inner = counted.where(2 * (F.col("_upto") - F.col("n")) < F.col("_all") + DIMENSIONS + 1)
        now = _factored(inner.groupBy("g").agg(*_totals()), half)
    now = _small(now, "estimates")
    ordinary = _distances(rows, now).where(F.col("d2") <= chi_square_point(0.975, DIMENSIONS)).groupBy("g").agg(*_moments())
    return _small(_factored(ordinary, consistency(0.975, DIMENSIONS)), "estimates")


def _grouped(rows: DataFrame, smallest: int) -> DataFrame:
    """Adds g: language and source, or a pool of small ones; null where even the pool of all is too small."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = rows.withColumn("_l", name("lang")).withColumn("_s", name("source"))
    sizes = rows.where("not base_failed").groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.where(F.col("n") < smallest).groupBy("_l").agg(F.sum("n").alias("pool"))
    names = sizes.join(small, "_l", "left").withColumn("_tier", F.when(F.col("n") >= smallest, 0).when(F.col("pool") >= smallest, 1).otherwise(2))
    names = _small(names, "groups")
    rest = names.where("_tier = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    key = F.when(F.col("_tier") == 0, F.concat_ws("\x1f", "_l", "_s")).when(F.col("_tier") == 1, F.col("_l"))
    if rest >= smallest:
        key = F.coalesce(key, F.lit(""))
    return rows.join(names.select("_l", "_s", key.alias("g")), ["_l", "_s"], "left").drop("_l", "_s")


def robust_outliers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", smallest: int = SMALLEST, tail: float = TAIL
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and distance (squared Mahalanobis distance) of every row.

    A row fails the base if it has fewer than 50 words or over half of its words are in repeated windows of three. All
    other rows of a (language, source) take part in its estimate; nulls are a group of their own. Groups of fewer than
    ``smallest`` rows are pooled by language, then over all; where even that is too small no row is rejected and distance is
    null, as it is for rows that fail the base. Null text has no words. Null ids and repeated rows pass through; an
    empty table gives an empty result; other columns are never read.
    """
    counts = base_counts(pick(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fixed = [F.round(F.expr(e) * SCALE).cast("long").alias(x) for x, (e, _) in zip(X, STATISTICS)]
    rows = cut_lineage(counts.select("*", failed.alias("base_failed"), *fixed), "statistics")
    rows = cut_lineage(_grouped(rows, smallest), "grouped")
    estimates = robust_estimates(rows.where("not base_failed and g is not null").select("g", *X))
    judged = _distances(rows, estimates, "left")
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= chi_square_point(1 - tail, DIMENSIONS), F.lit(True))).alias("kept"),
        distance.alias("distance"),
    )
