"""Registered gates over a population of volumes: one row of statistics, the named checks and whether all pass.

Every gate takes one row per volume; its medians and quantiles are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmetry.functions.expr import count_if, ratio
from voxelmetry.operators.distribution import quantiles
from voxelmetry.operators.stats import spearman
from voxelmetry.session import cut_lineage


def _population(volumes: DataFrame, value: str, qs: dict[str, float], *more: Column) -> DataFrame:
    """One row: quantiles of ``value`` over the volumes that have it, beside the aggregates ``more`` of all of them."""
    q = quantiles(volumes, value, qs).drop("n").select(F.struct(*qs).alias("q"))
    return volumes.agg(F.count(F.lit(1)).alias("n_volumes"), *more).withColumn("q", q.scalar()).select("*", "q.*").drop("q")


def _gated(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    named = row.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in checks.items()})
    passed = F.lit(True)
    for k in checks:
        passed = passed & F.col(k)
    return named.withColumn("gate_passed", passed)


def close_pair_gate(volumes: DataFrame, pairs: str = "close_pairs", components: str = "components", least_pairs: float = 5, least_share: float = 0.6) -> DataFrame:
    """Do volumes have close component pairs often enough? Median, mean, share of volumes with a pair, median components."""
    volumes = cut_lineage(volumes.select(F.col(pairs).alias("_p"), F.col(components).alias("_c")), "gate")
    row = _population(volumes, "_p", {"median_close_pairs": 0.5}, F.avg("_p").alias("mean_close_pairs"), ratio(count_if(F.col("_p") >= 1), F.count(F.lit(1))).alias("share_with_pair"))
    middle = quantiles(volumes, "_c", {"m": 0.5}).select("m").scalar()
    row = row.withColumn("median_components", middle)
    return _gated(row, {"gate_median_pairs": F.col("median_close_pairs") >= least_pairs, "gate_share_with_pair": F.col("share_with_pair") >= least_share})


def resolvability_gate(volumes: DataFrame, value: str = "median_resolvability", density: str = "sheet_fraction", least_spread: float = 1.5, most_rho: float = 0.7) -> DataFrame:
    """Does resolvability spread over volumes, and is it more than a proxy of sheet density?"""
    volumes = cut_lineage(volumes.select(F.col(value).alias("_v"), F.col(density).alias("_d")), "gate")
    row = _population(volumes, "_v", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    row = row.withColumns({"iqr_ratio": F.col("q75") / F.greatest("q25", F.lit(1e-9)), "rho": spearman(volumes, "_v", "_d").select("rho").scalar()})
    return _gated(row, {"gate_spread": F.col("iqr_ratio") >= least_spread, "gate_not_density": F.abs("rho") <= most_rho})


def margin_gate(volumes: DataFrame, share: str = "frac_background", ignored: str = "vol_frac_ignore", least: float = 0.8, middle: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """Is the class outside sheet margins background nearly everywhere? With the share of volumes in the middle of the
    range, which a bimodal population leaves empty, and the correlation with how much of a volume is ignored."""
    volumes = cut_lineage(volumes.select(F.col(share).alias("_s"), F.col(ignored).cast("double").alias("_i")), "gate")
    inside = (F.col("_s") > middle[0]) & (F.col("_s") < middle[1])
    n = F.count(F.lit(1))
    row = _population(
        volumes, "_s", {"median": 0.5, "q10": 0.1, "q90": 0.9},
        F.avg("_s").alias("mean"), ratio(count_if(F.col("_s") >= least), n).alias("share_high"), ratio(count_if(inside), n).alias("share_middle"), F.corr("_s", "_i").alias("corr_ignore"),
    )
    return _gated(row, {"gate_median": F.col("median") >= least})
