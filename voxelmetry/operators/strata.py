"""Stratified measures: lift over dense scan, decile and tercile profiles, disagreement profiles, noise, Otsu."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as _w

from voxelmetry.functions.expr import count_if, ratio
from voxelmetry.operators.distribution import cumulative, interval_of, quantiles, quantiles_from, unpivot

W = _w.Window


def dense_lift(df: DataFrame, by: Sequence[str], hot: Column, ct: str = "ct") -> DataFrame:
    """P(hot | top decile of the scan) over P(hot | at most its median), per volume."""
    cum = cumulative(df, ct, by, {"n_hot": F.when(hot, 1).otherwise(0)})
    cuts = quantiles_from(cum, ct, {"hi": 0.9, "lo": 0.5}, by).drop("n")
    j = cum.join(cuts, list(by)).groupBy(*by).agg(
        F.sum(F.when(F.col(ct) >= F.col("hi"), F.col("n"))).alias("n_hi"),
        F.sum(F.when(F.col(ct) >= F.col("hi"), F.col("n_hot"))).alias("hot_hi"),
        F.sum(F.when(F.col(ct) <= F.col("lo"), F.col("n"))).alias("n_lo"),
        F.sum(F.when(F.col(ct) <= F.col("lo"), F.col("n_hot"))).alias("hot_lo"),
        F.sum("n_hot").alias("n_hot"),
    )
    p_hi, p_lo = ratio("hot_hi", "n_hi"), ratio("hot_lo", "n_lo")
    return j.select(
        *by, p_hi.alias("p_dense"), p_lo.alias("p_sparse"), ratio(p_hi, p_lo).alias("dense_lift"), F.coalesce(ratio("hot_hi", "n_hot"), F.lit(0.0)).alias("hot_in_dense")
    )


def quantile_profile(df: DataFrame, by: Sequence[str], ct: str, bins: int, p: str, hot: Column) -> DataFrame:
    """Mean probability and hot share per quantile bin of the scan value; the last bin is closed."""
    cum = cumulative(df, ct, by, {"sum_p": F.col(p), "n_hot": F.when(hot, 1).otherwise(0)})
    qs = {f"e{i}": i / bins for i in range(1, bins)}
    binned = interval_of(cum.withColumnRenamed("n", "n_voxels"), ct, quantiles_from(cum, ct, qs, by).drop("n"), by, list(qs))
    return binned.groupBy(*by, (F.col("stratum") + 1).alias("bin")).agg(
        F.sum("n_voxels").alias("n_voxels"),
        F.min(ct).alias("lo"),
        F.max(ct).alias("hi"),
        ratio(F.sum("sum_p"), F.sum("n_voxels")).alias("mean_p"),
        ratio(F.sum("n_hot"), F.sum("n_voxels")).alias("hot_share"),
    )


def tercile_recall(df: DataFrame, by: Sequence[str], value: str, found: Column, min_voxels: int = 30) -> DataFrame:
    """Recall of sheet voxels by dark / mid / bright tercile inside each window, pooled over windows."""
    cum = cumulative(df, value, by, {"hit": F.when(found, 1).otherwise(0)})
    cuts = quantiles_from(cum, value, {"lo": 0.333, "hi": 0.667}, by).where(F.col("n") >= min_voxels).drop("n")
    j = cum.join(cuts, list(by))
    name = F.when(F.col(value) <= F.col("lo"), "dark").when(F.col(value) <= F.col("hi"), "mid").otherwise("bright")
    return j.groupBy(name.alias("tercile")).agg(F.sum("hit").alias("hits"), F.sum("n").alias("n"), ratio(F.sum("hit"), F.sum("n")).alias("recall"))


def matched_strata(df: DataFrame, covariate: str, value: str, flag: Column, strata: int = 5) -> DataFrame:
    """Quantile strata of a covariate; inside each, the medians of both groups, their gap and the rank test."""
    from voxelmetry.operators.stats import mann_whitney

    edges = quantiles(df, covariate, {f"e{i}": i / strata for i in range(1, strata)})
    cuts = [f"e{i}" for i in range(1, strata)]
    # the cut points are one row of four numbers, read as one scalar subquery
    cut = edges.select(F.struct(*cuts)).scalar()
    stratum = sum((F.when(F.col(covariate) >= cut[c], 1).otherwise(0) for c in cuts), F.lit(1))
    tagged = df.withColumn("stratum", stratum).withColumn("_side", F.when(flag, "in").otherwise("out"))
    med = quantiles(tagged, value, {"median": 0.5}, ["stratum", "_side"]).groupBy("stratum").agg(
        *[F.max(F.when(F.col("_side") == s, F.col(c))).alias(f"{k}_{s}") for s in ("in", "out") for c, k in (("n", "n"), ("median", "median"))]
    )
    test = mann_whitney(tagged, value, F.col("_side") == "in", ["stratum"]).select("stratum", "z")
    return med.join(test, "stratum", "left").withColumn("gap", F.col("median_out") - F.col("median_in"))


def axis_deciles(df: DataFrame, by: Sequence[str], shape: Sequence[int], flag: Column) -> DataFrame:
    """Share of flagged voxels per decile of each axis."""
    parts = [
        F.struct(F.lit(a).alias("axis"), (F.ceil(F.lit(10) * (F.col(a) + 1) / n) - 1).cast("int").alias("decile")) for a, n in zip("zyx", shape)
    ]
    each = df.select(*by, flag.alias("_f"), F.inline(F.array(*parts)))
    return each.groupBy(*by, "axis", "decile").agg(F.count(F.lit(1)).alias("n"), ratio(count_if(F.col("_f")), F.count(F.lit(1))).alias("share"))


def face_distance(df: DataFrame, by: Sequence[str], shape: Sequence[int], flag: Column, edges: Sequence[int]) -> DataFrame:
    """Share of flagged voxels by distance to the nearest face of the box."""
    d = F.least(*[c for a, n in zip("zyx", shape) for c in (F.col(a), n - 1 - F.col(a))])
    b = sum((F.when(d >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return df.groupBy(*by, b.alias("ring")).agg(F.count(F.lit(1)).alias("n"), ratio(count_if(flag), F.count(F.lit(1))).alias("share"))


def stride_phase(df: DataFrame, by: Sequence[str], stride: int, origin: Sequence[int], flag: Column, bins: int = 8) -> DataFrame:
    """Share of flagged voxels by position within the window stride, in ``bins`` equal phases per axis."""
    parts = [
        F.struct(F.lit(a).alias("axis"), F.floor(F.pmod(F.col(a) + o, F.lit(stride)) * bins / stride).cast("int").alias("phase")) for a, o in zip("zyx", origin)
    ]
    each = df.select(*by, flag.alias("_f"), F.inline(F.array(*parts)))
    return each.groupBy(*by, "axis", "phase").agg(F.count(F.lit(1)).alias("n"), ratio(count_if(F.col("_f")), F.count(F.lit(1))).alias("share"))


def paired_contrast(df: DataFrame, by: Sequence[str], properties: Sequence[str], missed: Column) -> DataFrame:
    """Per group and property: median of missed and of found rows, and their difference over the spread of found."""
    long = unpivot(df.withColumn("_missed", missed), properties, [*by, "_missed"])
    keys = [*by, "field", "_missed"]
    med = quantiles(long, "value", {"median": 0.5}, keys)
    sd = long.groupBy(*keys).agg(F.stddev_pop("value").alias("sd"))
    pick = lambda c, m: F.max(F.when(F.col("_missed") == m, F.col(c)))
    j = med.join(sd, keys).groupBy(*by, "field").agg(
        pick("median", True).alias("missed_median"), pick("median", False).alias("found_median"), pick("sd", False).alias("found_sd")
    )
    ok = j.where(F.col("missed_median").isNotNull() & F.col("found_median").isNotNull())
    z = (F.col("missed_median") - F.col("found_median")) / (F.col("found_sd") + 1e-6)
    return ok.select(*by, "field", "missed_median", "found_median", z.alias("delta_z"))


def noise_sigma(voxels: DataFrame, by: Sequence[str], shape: Sequence[int], block: int = 16, pct: float = 0.1, ct: str = "ct") -> DataFrame:
    """Noise from the quietest blocks: a low quantile of the spread inside whole blocks."""
    at = [F.floor(F.col(a) / block).alias(f"b{a}") for a in "zyx"]
    whole = F.lit(True)
    for a, n in zip("zyx", shape):
        whole = whole & (F.col(a) < n // block * block)
    sd = voxels.where(whole).groupBy(*by, *at).agg(F.stddev_pop(ct).alias("sd"))
    return quantiles(sd, "sd", {"sigma": pct}, by).select(*by, F.greatest("sigma", F.lit(1e-3)).alias("sigma"))


def noise_sigma_mad(voxels: DataFrame, by: Sequence[str], ct: str = "ct") -> DataFrame:
    """Older estimate: scaled median absolute deviation of first differences along z (kept for comparison)."""
    line = W.partitionBy(*by, "y", "x").orderBy("z")  # one column of a volume
    d = voxels.select(*by, F.when(F.lead("z").over(line) == F.col("z") + 1, F.lead(ct).over(line) - F.col(ct)).alias("d")).where("d IS NOT NULL")
    centre = quantiles(d, "d", {"m": 0.5}, by).drop("n")
    dev = d.join(centre, list(by)).withColumn("dev", F.abs(F.col("d") - F.col("m")))
    return quantiles(dev, "dev", {"mad": 0.5}, by).select(*by, (F.col("mad") * 1.4826 / F.sqrt(F.lit(2.0))).alias("sigma"))


def otsu(voxels: DataFrame, by: Sequence[str], ct: str = "ct") -> DataFrame:
    """Threshold with the largest between-class variance of an integer histogram (at most 256 rows per volume)."""
    hist = voxels.groupBy(*by, ct).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by)
    run = w.orderBy(ct)
    s = hist.select(
        *by, ct,
        F.sum("n").over(run).alias("w0"), F.sum(F.col("n") * F.col(ct)).over(run).alias("s0"),
        F.sum("n").over(w).alias("N"), F.sum(F.col("n") * F.col(ct)).over(w).alias("S"),
    ).where("w0 < N")
    w0, w1 = F.col("w0").cast("double"), (F.col("N") - F.col("w0")).cast("double")
    gap = F.col("s0") / w0 - (F.col("S") - F.col("s0")) / w1
    best = F.max_by(F.col(ct), F.struct(F.round(w0 * w1 * gap * gap, 3), -F.col(ct)))
    return s.groupBy(*by).agg(best.alias("threshold"))
