"""Scoring a probability volume against labels: counts, ratios, sweeps, matched budgets.

All measures of one volume come from one histogram over (volume, probability) that Spark combines before the
shuffle, so any number of thresholds costs one pass over the voxels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmetry.functions.expr import count_if, ratio, rows_of, share
from voxelmetry.operators.distribution import cumulative, quantiles, quantiles_from, unpivot
from voxelmetry.session import cut_lineage

THRESHOLD = 0.2
BUDGET = 0.12
# fixed values: the 39 cuts of the threshold sweep
SWEEP_CUTS = [round(0.01 * i, 2) for i in range(1, 10)] + [round(0.1 + 0.02 * i, 2) for i in range(21)] + [
    round(0.55 + 0.05 * i, 2) for i in range(9)
]

SHEET, IGNORE = 1, 2
_COUNTS = ["n_all", "n_scored", "n_sheet", "n_ignore", "n_empty"]


def score_histogram(df: DataFrame, by: Sequence[str], p: str = "p", label: str = "label", ct: str = "ct") -> DataFrame:
    """Voxels per (by, probability): all, scored (class 2 left out), sheet, ignored, on empty scan."""
    lab = F.col(label)
    return df.groupBy(*by, p).agg(
        F.count(F.lit(1)).alias("n_all"),
        count_if(lab != IGNORE).alias("n_scored"),
        count_if(lab == SHEET).alias("n_sheet"),
        count_if(lab == IGNORE).alias("n_ignore"),
        count_if(F.col(ct) == 0).alias("n_empty"),
    )


def confusion(hist: DataFrame, by: Sequence[str], cut: Column | float, p: str = "p", prefix: str = "") -> list[Column]:
    """Aggregate columns tp, fn, fp, n_pred, fp_in_ignore, on_empty for ``p > cut`` over a histogram."""
    pred = F.col(p) > cut
    hit = lambda c: F.coalesce(F.sum(F.when(pred, F.col(c))), F.lit(0))
    return [
        hit("n_sheet").alias(f"{prefix}tp"),
        (F.sum("n_sheet") - hit("n_sheet")).alias(f"{prefix}fn"),
        (hit("n_scored") - hit("n_sheet")).alias(f"{prefix}fp"),
        hit("n_scored").alias(f"{prefix}n_pred"),
        hit("n_ignore").alias(f"{prefix}fp_in_ignore"),
        hit("n_empty").alias(f"{prefix}on_empty"),
    ]


def confusion_counts(df: DataFrame, by: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """tp, fn, fp, n_pred, n_scored, n_sheet, fp_in_ignore, on_empty per group at one threshold."""
    return score_histogram(df, by).groupBy(*by).agg(
        *confusion(None, by, threshold), F.sum("n_scored").alias("n_scored"), F.sum("n_sheet").alias("n_sheet")
    )


def _ratios(prefix: str) -> dict[str, Column]:
    c = lambda n: F.col(prefix + n)
    base = ratio("n_sheet", "n_scored")
    precision = share(c("tp"), c("tp") + c("fp"))
    return {
        f"{prefix}recall": share(c("tp"), c("tp") + c("fn")),
        f"{prefix}precision": precision,
        f"{prefix}positive_fraction": ratio(c("n_pred"), "n_scored"),
        f"{prefix}precision_lift": precision / F.greatest(base, F.lit(1e-9)),
        f"{prefix}on_empty_share": share(c("on_empty"), c("n_pred")),
        f"{prefix}ignore_share": share(c("fp_in_ignore"), c("n_pred") + c("fp_in_ignore")),
    }


def endpoints(
    df: DataFrame,
    by: Sequence[str],
    threshold: float = THRESHOLD,
    budget: float = BUDGET,
    min_sheet: int = 200,
    min_scored: int = 1000,
) -> DataFrame:
    """Every endpoint per volume, at the fixed threshold and at the matched budget, with a status."""
    by = list(by)
    # written once: the budget cut and the counts read different columns of it, and would scan the voxels twice
    hist = cut_lineage(score_histogram(df, by), "histogram")
    cuts = budget_thresholds(hist, by, budget)
    # the cut table has one row per volume; the adaptive planner broadcasts it only while it is small
    counts = hist.join(cuts, by, "left").groupBy(*by).agg(
        *confusion(hist, by, threshold),
        *confusion(hist, by, F.col("budget_threshold"), prefix="budget_"),
        F.sum("n_scored").alias("n_scored"),
        F.sum("n_sheet").alias("n_sheet"),
        F.max("budget_threshold").alias("budget_threshold"),
    )
    ok = (F.col("n_sheet") >= min_sheet) & (F.col("n_scored") >= min_scored)
    values = {
        "base_rate": ratio("n_sheet", "n_scored"),
        "budget_threshold": F.col("budget_threshold"),
        **_ratios(""),
        **_ratios("budget_"),
    }
    return counts.select(
        *by,
        F.when(ok, "ok").otherwise("no_sheet").alias("status"),
        "n_scored",
        "n_sheet",
        *[F.when(ok, c).alias(k) for k, c in values.items()],
    )


def budget_thresholds(hist: DataFrame, by: Sequence[str], budget: float = BUDGET, p: str = "p") -> DataFrame:
    """The (1 - budget) quantile of the probability over scored voxels, exact, per group."""
    cum = cumulative(hist.where("n_scored > 0"), p, by, weight=F.col("n_scored"))
    return quantiles_from(cum, p, {"budget_threshold": 1.0 - budget}, by).drop("n")


def calibrate_threshold(df: DataFrame, by: Sequence[str], budget: float = BUDGET) -> DataFrame:
    """One row: median and q10/q90 over volumes of the per-volume budget threshold."""
    per = budget_thresholds(score_histogram(df, by), by, budget)
    return quantiles(per, "budget_threshold", {"threshold": 0.5, "q10": 0.1, "q90": 0.9})


def recall_by_threshold(df: DataFrame, by: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    """``recall_by_threshold`` as a map from the cut to recall, one pass."""
    sheet = df.where(F.col("label") == SHEET)
    hits = [share(count_if(F.col("p") > c), F.count(F.lit(1))) for c in cuts]
    return sheet.groupBy(*by).agg(
        F.map_from_arrays(F.array(*[F.lit(str(c)) for c in cuts]), F.array(*hits)).alias("recall_by_threshold")
    )


def mask_agreement(df: DataFrame, by: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Dice, IoU, agreement and disagreement of two masks; two empty masks agree fully."""
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(a).alias("n_a"),
        count_if(b).alias("n_b"),
        count_if(a & b).alias("n_both"),
    )
    total, union = F.col("n_a") + F.col("n_b"), F.col("n_a") + F.col("n_b") - F.col("n_both")
    return counts.select(
        *by,
        "n",
        "n_a",
        "n_b",
        (union - F.col("n_both")).alias("disagreeing"),
        F.when(total == 0, 1.0).otherwise(ratio(2 * F.col("n_both"), total)).alias("dice"),
        F.when(union == 0, 1.0).otherwise(ratio("n_both", union)).alias("iou"),
        (1 - ratio(union - F.col("n_both"), "n")).alias("agreement"),
    )


def threshold_sweep(
    df: DataFrame, by: Sequence[str], mask: Column, p: str = "p", cuts: Sequence[float] = tuple(SWEEP_CUTS)
) -> DataFrame:
    """Dice of ``p > cut`` against ``mask`` for every cut: by, ordinal, cut, n_pred, n_both, n_mask, dice.

    Each voxel is counted once under the number of cuts below it; a suffix sum over those at most
    len(cuts) + 1 counts gives all cuts.
    """
    passed = sum((F.when(F.col(p) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    bins = df.groupBy(*by, passed.alias("passed")).agg(
        F.count(F.lit(1)).alias("n"), count_if(mask).alias("n_mask")
    )
    per = bins.groupBy(*by).agg(
        F.collect_list(F.struct("passed", "n", "n_mask")).alias("bins"), F.sum("n_mask").alias("n_mask")
    )
    rows = per.select(*by, "bins", "n_mask", F.posexplode(F.array(*[F.lit(float(c)) for c in cuts])).alias("ordinal", "cut"))
    above = lambda f: F.aggregate(
        F.filter("bins", lambda b: b["passed"] > F.col("ordinal")), F.lit(0).cast("long"), lambda s, b: s + b[f]
    )
    out = rows.select(*by, "ordinal", "cut", above("n").alias("n_pred"), above("n_mask").alias("n_both"), "n_mask")
    total = F.col("n_pred") + F.col("n_mask")
    return out.withColumn("dice", F.when(total == 0, 1.0).otherwise(ratio(2 * F.col("n_both"), total)))


def best_threshold(sweep: DataFrame, base: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Best Dice over the cuts and its headroom over ``base.dice``; the first strictly better cut wins."""
    best = sweep.groupBy(*by).agg(F.max(F.struct("dice", -F.col("ordinal"), "cut")).alias("b"))
    better = F.col("b.dice") > F.col("dice")
    return base.select(*by, "dice").join(best, list(by)).select(
        *by,
        "dice",
        F.when(better, F.col("b.dice")).otherwise(F.col("dice")).alias("best_dice"),
        F.when(better, F.col("b.cut")).otherwise(F.lit(threshold)).alias("best_threshold"),
        F.when(better, F.col("b.dice") - F.col("dice")).otherwise(0.0).alias("headroom"),
    )


def near_threshold_share(
    df: DataFrame, by: Sequence[str], mask: Column, threshold: float, eps: Sequence[float] = (0.01, 0.05, 0.15)
) -> DataFrame:
    """Share of disagreeing voxels whose probability lies within eps of the threshold."""
    bad = df.where((F.col("p") > threshold) != mask)
    d = F.abs(F.col("p") - threshold)
    return bad.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[ratio(count_if(d < e), F.count(F.lit(1))).alias(f"within_{e}".replace(".", "_")) for e in eps],
    )


def verdict(dice: Column, best: Column) -> Column:
    """reproduced / structural_difference / calibration_difference."""
    return (
        F.when(dice > 0.99, "reproduced")
        .when(best - dice < 0.02, "structural_difference")
        .otherwise("calibration_difference")
    )


def population_report(df: DataFrame, values: Sequence[str], groups: Sequence[tuple[str, Column]]) -> DataFrame:
    """Medians of ``values`` per (overlapping) population; ``groups`` are (name, condition) pairs."""
    tagged = df.withColumn(
        "population", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups])))
    )
    return quantiles(unpivot(tagged, values, ["population"]), "value", {"median": 0.5}, ["population", "field"])


def summary(df: DataFrame, value: str, by: Sequence[str] = (), below: Sequence[float] = (0.8, 0.7, 0.5)) -> DataFrame:
    """n, mean, median, quartiles, p5, p90 and the share below given limits."""
    qs = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}
    v = F.col(value).cast("double")
    low = {f"below_{b}".replace(".", "_"): F.when(v < b, F.col("n")).otherwise(0) for b in below}
    cum = cumulative(df, value, by)
    part = quantiles_from(cum, value, qs, by)
    rest = cum.groupBy(*by).agg(
        ratio(F.sum(v * F.col("n")), F.sum("n")).alias("mean"),
        *[ratio(F.sum(c), F.sum("n")).alias(k) for k, c in low.items()],
    )
    if by:
        return part.join(rest, list(by))
    names = rest.columns
    return part.withColumn("_rest", rest.select(F.struct(*names)).scalar()).select("*", "_rest.*").drop("_rest")


def by_thresholds(df: DataFrame, by: Sequence[str], cuts: Sequence[float], p: Column, ct: str = "ct") -> DataFrame:
    """Sheet, phantom (on empty scan) and real voxels per group and threshold, from one pass."""
    cols = []
    for i, c in enumerate(cuts):
        cols += [count_if(p > c).alias(f"s{i}"), count_if((p > c) & (F.col(ct) == 0)).alias(f"e{i}")]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_if(F.col(ct) == 0).alias("n_empty"), *cols)
    per_cut = F.array(
        *[
            F.struct(F.lit(float(c)).alias("cut"), F.col(f"s{i}").alias("sheet"), F.col(f"e{i}").alias("phantom"))
            for i, c in enumerate(cuts)
        ]
    )
    long = wide.select(*by, "n", "n_empty", F.inline(per_cut))
    return long.select(
        *by,
        "cut",
        "sheet",
        "phantom",
        (F.col("sheet") - F.col("phantom")).alias("real"),
        ratio("phantom", "n").alias("frac_of_region"),
        F.coalesce(ratio("phantom", "sheet"), F.lit(0.0)).alias("frac_of_sheet"),
        F.coalesce(ratio(F.col("sheet") - F.col("phantom"), F.col("n") - F.col("n_empty")), F.lit(0.0)).alias("frac_of_scanned"),
    )


def with_parameters(df: DataFrame, items: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Every row next to each row of a small fixed parameter table."""
    return df.select("*", F.inline(rows_of(items, names)))


def margin_enrichment(voxels: DataFrame, by: Sequence[str], pred: Column, margin: Column) -> DataFrame:
    """Per volume: how much likelier a scored false positive lies in the margin than non-sheet in general.

    ``degenerate`` without false positives, scored non-sheet or margin; ``margin`` is counted among scored non-sheet.
    """
    by = list(by)
    bg = F.col("label") == 0
    wrong, inside = bg & pred, bg & margin
    n = voxels.groupBy(*by).agg(
        count_if(wrong).alias("n_fp"), count_if(bg).alias("_ns"), count_if(inside).alias("n_margin"), count_if(wrong & margin).alias("_hit")
    )
    ok = (F.col("n_fp") > 0) & (F.col("_ns") > 0) & (F.col("n_margin") > 0)
    where = lambda c: F.when(ok, c)
    shares = ratio("_hit", "n_fp"), ratio("n_margin", "_ns")
    return n.select(
        *by, F.when(ok, "ok").otherwise("degenerate").alias("status"), "n_fp", "n_margin",
        where(shares[0]).alias("fp_share_in_margin"), where(shares[1]).alias("margin_share_of_nonsheet"), where(shares[0] / shares[1]).alias("enrichment"),
        where(ratio("_hit", "n_margin")).alias("margin_hit_rate"),
        where((F.col("n_fp") - F.col("_hit")) / F.greatest(F.col("_ns") - F.col("n_margin"), F.lit(1))).alias("nonmargin_fp_rate"),
    )
