"""Rank-based tests, correlations and ranked-review measures, all over distributed cumulative counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as _w
from pyspark.sql.types import DoubleType

from voxelmetry.functions.expr import ratio
from voxelmetry.operators.distribution import cumulative, medians, mid_ranks, quantiles, unpivot
from voxelmetry.session import cut_lineage

W = _w.Window


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p of a z score; Spark has no error function. Runs on one row per test."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2.0)))


def mann_whitney(df: DataFrame, value: str, flag: Column, by: Sequence[str] = (), with_p: bool = False) -> DataFrame:
    """U of the flagged rows against the others, with tie correction: n1, n2, u, auc, z (and p)."""
    cum = mid_ranks(cumulative(df, value, by, {"n1": F.when(flag, 1).otherwise(0)}))
    n = F.col("n").cast("double")
    s = cum.groupBy(*by).agg(
        F.max("total_n1").alias("n1"),
        (F.max("total") - F.max("total_n1")).alias("n2"),
        F.sum(F.col("n1") * F.col("mid_rank")).alias("_r1"),
        F.sum(n * n * n - n).alias("_tie"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - F.try_divide(F.col("_tie"), (n1 + n2) * (n1 + n2 - 1))))
    out = s.select(*by, "n1", "n2", u.alias("u"), ratio(u, n1 * n2).alias("auc"), F.try_divide(u - n1 * n2 / 2, sd).alias("z"))
    return out.withColumn("p", two_sided_p("z")) if with_p else out


def mann_whitney_features(df: DataFrame, features: Sequence[str], flag: str, with_p: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """The same test for each feature column, in long form."""
    long = unpivot(df, features, [*by, flag])
    return mann_whitney(long, "value", F.col(flag), [*by, "field"], with_p)



def wilcoxon(df: DataFrame, difference: str, by: Sequence[str] = (), with_p: bool = False) -> DataFrame:
    """Signed-rank test of paired differences: zeros dropped, mid-ranks of |d|, normal approximation."""
    d = df.where(F.col(difference) != 0).withColumn("_abs", F.abs(F.col(difference)))
    cum = mid_ranks(cumulative(d, "_abs", by, {"n_up": F.when(F.col(difference) > 0, 1).otherwise(0)}))
    c = F.col("n").cast("double")
    s = cum.groupBy(*by).agg(
        F.max("total").alias("n"),
        F.sum(F.col("n_up") * F.col("mid_rank")).alias("w_plus"),
        F.sum((F.col("n") - F.col("n_up")) * F.col("mid_rank")).alias("w_minus"),
        F.sum(c * c * c - c).alias("_tie"),
    )
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie") / 48
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(var))
    out = s.select(*by, "n", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("statistic"), z.alias("z"))
    return out.withColumn("p", two_sided_p("z")) if with_p else out


def paired_arms(df: DataFrame, unit: str, arm: str, endpoints: Sequence[str], a: str, b: str, min_pairs: int = 10) -> DataFrame:
    """Two arms on common units: mean over repeats first, then one row (unit, field, a, b) per pair.

    Fields with fewer than ``min_pairs`` common units are left out.
    """
    means = unpivot(df.where(F.col(arm).isin(a, b)), endpoints, [unit, arm]).groupBy(unit, "field").agg(
        F.avg(F.when(F.col(arm) == a, F.col("value"))).alias("a"), F.avg(F.when(F.col(arm) == b, F.col("value"))).alias("b")
    )
    pairs = means.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    enough = pairs.groupBy("field").agg(F.count(F.lit(1)).alias("n_pairs")).where(F.col("n_pairs") >= min_pairs)
    return pairs.join(enough, "field").withColumn("d", F.col("b") - F.col("a"))


def compare_arms(pairs: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Median of each arm, delta of the medians, signed-rank test and verdict per field."""
    med = medians(pairs, ["a", "b"], ["field"], "side").groupBy("field").agg(
        F.max(F.when(F.col("side") == "a", F.col("median"))).alias("median_a"),
        F.max(F.when(F.col("side") == "b", F.col("median"))).alias("median_b"),
    )
    test = wilcoxon(pairs, "d", ["field"], with_p=True)
    delta = F.col("median_b") - F.col("median_a")
    floor = F.lit(None).cast("double")
    for field, limit in floors.items():
        floor = F.when(F.col("field") == field, F.lit(limit)).otherwise(floor)
    verdict = (
        F.when(F.abs(delta) < floor, "null_below_floor")
        .when(F.col("p") < 0.05, F.when(delta > 0, "b_better").otherwise("b_worse"))
        .otherwise("not_significant")
    )
    return med.join(test, "field", "left").select("field", "n", "median_a", "median_b", delta.alias("delta"), "z", "p", verdict.alias("verdict"))


def seed_spread(df: DataFrame, arm: str, seed: str, metrics: Sequence[str], baseline: str) -> DataFrame:
    """Arms against a baseline over seeds: mean, sample sd, verdict against the spread, gain per headroom."""
    per_seed = df.groupBy(arm, seed).agg(*[F.avg(m).alias(m) for m in metrics])
    s = unpivot(per_seed, metrics, [arm], "metric").groupBy(arm, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("seeds")
    )
    base = s.where(F.col(arm) == baseline).select("metric", F.col("mean").alias("base_mean"), F.col("sd").alias("base_sd"))
    j = s.where(F.col(arm) != baseline).join(base, "metric")
    delta, spread = F.col("mean") - F.col("base_mean"), F.greatest("sd", "base_sd")
    verdict = F.when(F.abs(delta) <= spread, "not_demonstrated").when(delta > 0, "better").otherwise("worse")
    return j.select(
        arm, "metric", "seeds", "base_mean", "mean", delta.alias("delta"), spread.alias("spread"), verdict.alias("verdict"),
        F.when(F.col("base_mean") < 1, ratio(delta, 1 - F.col("base_mean"))).alias("headroom_gain"),
    )


def arm_warnings(spread: DataFrame, arm: str, faint: str, others: Sequence[str], recall: str, dice: str) -> DataFrame:
    """Per arm what its gains must not be taken for, from a ``seed_spread`` table.

    ``not_selective``: the gain per headroom is not highest for the ``faint`` stratum, so a uniform bias would look the
    same. ``traded_precision``: recall rose while Dice fell, which a moved threshold does as well.
    """
    of = lambda metric, column: F.max(F.when(F.col("metric") == metric, F.col(column)))
    best = F.greatest(*[F.col(f"_o{k}") for k in range(len(others))]) if len(others) > 1 else F.col("_o0")
    row = spread.groupBy(arm).agg(
        of(faint, "headroom_gain").alias("faint_gain"), *[of(o, "headroom_gain").alias(f"_o{k}") for k, o in enumerate(others)],
        of(recall, "delta").alias("recall_delta"), of(dice, "delta").alias("dice_delta"),
    )
    return row.select(
        arm, "faint_gain", best.alias("other_gain"), (F.col("faint_gain") <= best).alias("not_selective"),
        "recall_delta", "dice_delta", ((F.col("recall_delta") > 0) & (F.col("dice_delta") < 0)).alias("traded_precision"),
    )


def pearson_table(df: DataFrame, y: str, features: Sequence[str], by: Sequence[str] = (), min_n: int = 20) -> DataFrame:
    """Correlation of y with each feature over finite pairs; fields with too few pairs or no spread are left out."""
    long = unpivot(df, features, [*by, y]).where(F.col("value").isNotNull() & ~F.isnan("value") & F.col(y).isNotNull())
    s = long.groupBy(*by, "field").agg(F.count(F.lit(1)).alias("n"), F.corr(y, "value").alias("r"), F.stddev_pop("value").alias("_sd"))
    return s.where((F.col("n") >= min_n) & (F.col("_sd") > 0)).select(*by, "field", "n", "r")


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of mid-ranks. Equal pairs are counted first; ranks are centred, so large groups keep precision."""
    by = list(by)
    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = ok.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("_pairs"))

    def centred(c: str, name: str) -> DataFrame:
        ranks = mid_ranks(cumulative(ok, c, by))
        return ranks.select(*by, c, (F.col("mid_rank") - (F.col("total") + 1) / 2).alias(name))

    j = pairs.join(centred(a, "_ra"), [*by, a]).join(centred(b, "_rb"), [*by, b])
    w = F.col("_pairs")
    return j.groupBy(*by).agg(
        F.sum(w).alias("n"),
        ratio(
            F.sum(w * F.col("_ra") * F.col("_rb")),
            F.sqrt(F.sum(w * F.col("_ra") * F.col("_ra"))) * F.sqrt(F.sum(w * F.col("_rb") * F.col("_rb"))),
        ).alias("rho"),
    )


def rank_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Adds ``rank`` (1-based) and ``n_in_group`` for any sort order, also when one group is a third of the table.

    Rows are range-partitioned by (group, order) and written once, so every run sees the same pieces; a row's rank is
    its place in its piece plus the sizes of the group's earlier pieces.
    """
    by = list(by)
    pieces = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(pieces, *by, *order).withColumn("_piece", F.spark_partition_id())
    placed = cut_lineage(placed, "ranked")
    sizes = placed.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    group = W.partitionBy(*by)
    before = sizes.select(
        *by, "_piece", (F.sum("_size").over(group.orderBy("_piece")) - F.col("_size")).alias("_before"), F.sum("_size").over(group).alias("n_in_group")
    )
    here = F.row_number().over(W.partitionBy(*by, "_piece").orderBy(*order))
    return placed.join(before, [*by, "_piece"]).withColumn("rank", here + F.col("_before")).drop("_piece", "_before")


def selected_within(budget: float) -> Column:
    """rank <= max(1, half-even round of budget * n)."""
    return F.col("rank") <= F.greatest(F.lit(1), F.bround(F.lit(budget) * F.col("n_in_group")))


def lift_at(ranked: DataFrame, by: Sequence[str], y: str, budgets: Sequence[float]) -> DataFrame:
    """Per group and budget: k, positives found, lift over the base rate. One pass for all budgets."""
    k = lambda b: F.greatest(F.lit(1), F.bround(F.lit(b) * F.col("n_in_group"))).cast("long")
    found = [F.sum(F.when(F.col("rank") <= k(b), F.col(y)).otherwise(0)).alias(f"f{i}") for i, b in enumerate(budgets)]
    wide = ranked.groupBy(*by).agg(F.max("n_in_group").alias("n_in_group"), F.sum(y).alias("n_bad"), *found)
    each = F.array(
        *[F.struct(F.lit(float(b)).alias("budget"), k(b).alias("k"), F.col(f"f{i}").alias("found")) for i, b in enumerate(budgets)]
    )
    long = wide.select(*by, F.col("n_in_group").alias("n"), "n_bad", F.inline(each))
    base = F.col("n_bad") / F.col("n").cast("double")
    return long.withColumn("lift", F.col("found") / F.col("k").cast("double") / F.greatest(base, F.lit(1e-9)))


def lift_curve(lifts: DataFrame) -> DataFrame:
    """Per budget: mean, median and size-weighted lift over groups, share selected, share of positives found."""
    n = F.col("n").cast("double")
    s = lifts.groupBy("budget").agg(
        ratio(F.sum("k"), F.sum("n")).alias("selected_fraction"),
        F.avg("lift").alias("mean_lift"),
        ratio(F.sum(F.col("lift") * n), F.sum(n)).alias("weighted_lift"),
        ratio(F.sum("found"), F.sum("n_bad")).alias("bad_recall"),
    )
    return s.join(quantiles(lifts, "lift", {"median_lift": 0.5}, ["budget"]).drop("n"), "budget")


def slab_lift_summary(lifts: DataFrame, floor: float = 2.0) -> DataFrame:
    """One row over groups with a positive: mean, median, weighted, range, SEM, 95% interval, groups at the floor.

    ``lifts`` has slab, n, n_bad, lift, mean_score.
    """
    rows = lifts.where("n_bad > 0")
    n = F.col("n").cast("double")
    rate = F.col("n_bad") / n
    s = rows.agg(
        F.count(F.lit(1)).alias("n_slabs"),
        F.avg("lift").alias("mean"),
        ratio(F.sum(F.col("lift") * n), F.sum(n)).alias("weighted"),
        F.min("lift").alias("min"),
        F.max("lift").alias("max"),
        (F.stddev_samp("lift") / F.sqrt(F.count(F.lit(1)))).alias("sem"),
        F.count(F.when(F.col("lift") >= floor, 1)).alias("n_at_floor"),
        F.corr(F.col("mean_score"), rate).alias("corr_score_rate"),
    )
    median = quantiles(rows, "lift", {"median": 0.5}).select("median").scalar()
    return s.select(
        "*", median.alias("median"), (F.col("mean") - 1.96 * F.col("sem")).alias("ci_lo"), (F.col("mean") + 1.96 * F.col("sem")).alias("ci_hi")
    )


def two_peaks(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 50, top: float = 25.0, apart: float = 4.0, dip_share: float = 0.6) -> DataFrame:
    """Equal-width histogram on [0, top], its two largest peaks at least ``apart`` away, and the dip between.

    The histogram is a fixed 50 numbers per group, so it is handled as one small array.
    """
    width = top / bins
    inside = df.where((F.col(value) >= 0) & (F.col(value) <= top))
    b = F.least(F.floor(F.col(value) / width).cast("int"), F.lit(bins - 1))
    counts = inside.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("n"))
    hist = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)))
    order = lambda h: F.array_sort(F.transform(h, lambda c, i: F.struct((-c).alias("c"), i.alias("i"))))
    peaks = packed.withColumn("hist", hist).withColumn("ordered", order(F.col("hist"))).withColumn("p1", F.get("ordered.i", 0))
    far = F.filter("ordered", lambda s: F.abs(s["i"] - F.col("p1")) * width >= apart)
    peaks = peaks.withColumn("p2", F.get(far, 0)["i"])
    lo, hi = F.least("p1", "p2"), F.greatest("p1", "p2")
    smaller = F.least(F.get("hist", F.col("p1")), F.get("hist", F.col("p2")))
    dip = F.array_min(F.slice("hist", lo + 1, hi - lo + 1))
    centre = lambda i: (i + 0.5) * width
    return peaks.select(
        *by, "n", centre(F.col("p1")).alias("peak"), centre(hi).alias("upper_peak"), dip.alias("dip"), smaller.alias("smaller"),
        F.coalesce(dip < dip_share * smaller, F.lit(False)).alias("bimodal"), F.coalesce(centre(hi) >= 3.0, F.lit(False)).alias("upper_ok"),
    )
