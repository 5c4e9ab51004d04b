"""Line profiles across the sheet and what is read off them.

A block kernel finds the across-sheet direction of each point and samples the profile; every measure after that is an
expression on the short profile array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelmetry.functions.expr import count_if, ratio
from voxelmetry.operators import volumes as V
from voxelmetry.operators.blocks import Block, KernelSpec, across_sheet_normals, gaussian_filter, nothing, run_kernel, sample_lines
from voxelmetry.operators.distribution import quantiles
from voxelmetry.session import cut_lineage

STEP = 0.25


def offsets(half: float, step: float = STEP) -> list[float]:
    return [float(v) for v in np.arange(-half, half + 1e-9, step)]


def sample_profiles(
    voxels: DataFrame,
    by: Sequence[str],
    shape: Sequence[int],
    points: str,
    half: float = 4.0,
    step: float = STEP,
    sigma: float = 1.0,
    smooth: bool = True,
    direction: tuple[float, float, float] | None = None,
    side: int | None = None,
    field: str = "ct",
) -> DataFrame:
    """by..., z, y, x, nz, ny, nx, profile (scan, trilinear) and labels (nearest) at every voxel where ``points`` is 1.

    The direction is the field's own across-sheet normal unless one is given.
    """
    ts = np.array(offsets(half, step))
    reach = int(np.ceil(half)) + 1

    def kernel(b: Block) -> pd.DataFrame:
        pts = b.core_points(b.arrays["_point"] == 1)
        names = ["z", "y", "x", "nz", "ny", "nx", "profile", "labels"]
        if len(pts) == 0:
            return nothing(names)
        scan = b.arrays[field]
        n = np.tile(np.array(direction, float), (len(pts), 1)) if direction else across_sheet_normals(scan, pts - b.origin, sigma)
        prof = sample_lines(gaussian_filter(scan, sigma) if smooth else scan, b, pts, n, ts)
        labs = sample_lines(b.arrays["label"], b, pts, n, ts, nearest=True)
        cols = [*pts.T.astype("int32"), *n.T, list(prof), list(labs.astype("int32"))]
        return pd.DataFrame(dict(zip(names, cols)))

    spec = KernelSpec("profiles", int(4 * sigma + 0.5) + reach + 2, "nz DOUBLE, ny DOUBLE, nx DOUBLE, profile ARRAY<DOUBLE>, labels ARRAY<INT>", kernel)
    marked = voxels.withColumn("_point", F.when(F.expr(points), 1).otherwise(0))
    return run_kernel(marked, by, shape, list(dict.fromkeys([field, "label", "_point"])), spec, side)


# ---- expressions on one profile array -------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once per row: inside a lambda a plain expression would run per element."""
    return F.get(F.transform(F.array(value), body), 0)


def array_median(a: Column) -> Column:
    mid = lambda s, k: F.get(s, k.cast("int"))
    return let(F.array_sort(a), lambda s: (mid(s, F.floor((F.size(s) - 1) / 2)) + mid(s, F.floor(F.size(s) / 2))) / 2)


def peak_index(profile: Column) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(profile, F.array_max(profile)).cast("int") - 1


def ridge_offset(profile: Column, half: float, step: float = STEP) -> Column:
    """Signed sub-voxel distance to the ridge by a parabola through the peak; NULL where the peak is on the edge."""

    def refine(k: Column) -> Column:
        y0, y1, y2 = (F.get(profile, k + d) for d in (-1, 0, 1))
        den = y0 - 2 * y1 + y2
        shift = F.when(F.abs(den) > 1e-9, 0.5 * (y0 - y2) / den).otherwise(0.0)
        shift = F.least(F.greatest(shift, F.lit(-1.0)), F.lit(1.0))
        return F.when((k > 0) & (k < F.size(profile) - 1), -half + step * k + shift * step)

    return let(peak_index(profile), refine)


def _to_false(flags: Column) -> tuple[Column, Column, Column]:
    """Centre index, and how many steps left and right of it the nearest false value lies (0: none)."""
    mid = F.floor(F.size(flags) / 2).cast("int")
    left = F.array_position(F.reverse(F.slice(flags, F.lit(1), mid)), F.lit(False)).cast("int")
    right = F.array_position(F.slice(flags, mid + 2, F.size(flags) - mid - 1), F.lit(False)).cast("int")
    return mid, left, right


def centre_run(flags: Column) -> Column:
    """struct(lo, hi): the run of true values through the centre; NULL if the centre is false or the run meets an end.

    The nearest false value on each side bounds the run, so no sample is visited in a loop.
    """

    def run(f: Column) -> Column:
        mid, left, right = _to_false(f)
        ends = F.struct((mid - left + 1).alias("lo"), (mid + right - 1).alias("hi"))
        return F.when(F.get(f, mid) & (left > 0) & (right > 0), ends)

    return let(flags, run)


def sheet_contrast(profile: Column, half: float, noise: Column, window: float = 1.5, step: float = STEP) -> Column:
    """(peak near the centre - lowest value) / noise."""
    ts = offsets(half, step)
    first = next(i for i, t in enumerate(ts) if t >= -window - 1e-9)
    count = sum(1 for t in ts if abs(t) <= window + 1e-9)
    return (F.array_max(F.slice(profile, first + 1, count)) - F.array_min(profile)) / F.greatest(noise, F.lit(1e-6))


def resolvability(profile: Column, half: float = 5.0, shoulder: float = 0.7, step: float = STEP) -> Column:
    """Ridge prominence over the noise read from the profile's second difference."""
    outer = [i for i, t in enumerate(offsets(half, step)) if abs(t) >= shoulder * half]
    prominence = F.array_max(profile) - array_median(F.transform(F.array(*[F.lit(i) for i in outer]), lambda i: F.get(profile, i)))
    return prominence / second_difference_noise(profile)


def second_difference_noise(profile: Column) -> Column:
    d2 = F.transform(
        F.sequence(F.lit(0), F.size(profile) - 3), lambda i: F.get(profile, i) - 2 * F.get(profile, i + 1) + F.get(profile, i + 2)
    )
    mad = let(d2, lambda d: let(array_median(d), lambda c: array_median(F.transform(d, lambda v: F.abs(v - c)))))
    return F.greatest(1.4826 * mad / F.sqrt(F.lit(6.0)), F.lit(1e-3))


def half_max_width(profile: Column, step: float = STEP) -> Column:
    """Width of the run above half maximum through the centre (published as unreliable: depends on the window)."""
    level = F.array_min(profile) + 0.5 * (F.array_max(profile) - F.array_min(profile))

    def width(f: Column) -> Column:
        mid, left, right = _to_false(f)
        # here a run that meets the end of the profile counts up to the end
        lo, hi = F.when(left > 0, mid - left + 1).otherwise(0), F.when(right > 0, mid + right - 1).otherwise(F.size(f) - 1)
        return F.when(F.get(f, mid), (hi - lo + 1) * step)

    return let(let(level, lambda v: F.transform(profile, lambda p: p >= v)), width)


# ---- measures over tables of profiles -----------------------------------------------------------------------


def offset_summary(profiles: DataFrame, by: Sequence[str], half: float = 4.0, min_points: int = 200) -> DataFrame:
    """Median |ridge offset| per group with enough bracketed points."""
    off = profiles.select(*by, F.abs(ridge_offset(F.col("profile"), half)).alias("offset")).where("offset IS NOT NULL")
    return quantiles(off, "offset", {"median_offset": 0.5}, by).where(F.col("n") >= min_points)


def localisation_error(profiles: DataFrame, by: Sequence[str], half: float = 4.0, min_points: int = 200) -> DataFrame:
    """Median |t| of the profile maximum at predicted voxels."""
    t = F.abs(peak_index(F.col("profile")) * STEP - half)
    return quantiles(profiles.select(*by, t.alias("t")), "t", {"loc_error": 0.5}, by).where(F.col("n") >= min_points)


def label_runs(profiles: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Label run through each point: keep..., run.lo, run.hi."""
    return profiles.select(*keep, "profile", "labels", centre_run(F.transform("labels", lambda v: v == 1)).alias("run"))


def label_placement(profiles: DataFrame, by: Sequence[str], half: float = 4.0, min_runs: int = 150) -> DataFrame:
    """Ridge minus run centre: signed and absolute medians per volume."""
    runs = label_runs(profiles, by).where("run IS NOT NULL")
    d = (ridge_offset(F.col("profile"), half) - (-half + STEP * (F.col("run.lo") + F.col("run.hi")) / 2)).alias("d")
    off = cut_lineage(runs.select(*by, d).where("d IS NOT NULL"), "placement")
    signed = quantiles(off, "d", {"median_signed": 0.5}, by)
    absolute = quantiles(off.withColumn("d", F.abs("d")), "d", {"median_absolute": 0.5}, by).drop("n")
    return signed.join(absolute, list(by)).where(F.col("n") >= min_runs)


def margin_classes(profiles: DataFrame, by: Sequence[str], min_margins: int = 100) -> DataFrame:
    """Class of the voxel just outside each label run: shares per volume."""
    runs = label_runs(profiles, by).where("run IS NOT NULL")
    each = runs.select(*by, F.explode(F.array(F.get("labels", F.col("run.lo") - 1), F.get("labels", F.col("run.hi") + 1))).alias("c"))
    s = each.groupBy(*by).agg(F.count(F.lit(1)).alias("n_margins"), *[ratio(count_if(F.col("c") == k), F.count(F.lit(1))).alias(f"frac_{n}") for k, n in ((0, "background"), (2, "ignore"), (1, "surface"))])
    return s.where(F.col("n_margins") >= min_margins)


def thin_labels(profiles: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """Label voxels with ``kept`` and the thickness of their run.

    A voxel goes only if its run is wider than ``width`` and its centre lies farther than width/2 away; a run that
    leaves the profile is kept rather than guessed.
    """
    half = (F.size("labels") - 1) / 2 * STEP
    thick = (F.col("run.hi") - F.col("run.lo")) * STEP + STEP
    centre = -half + STEP * (F.col("run.lo") + F.col("run.hi")) / 2
    kept = F.col("run").isNull() | (thick <= width) | (F.abs(centre) <= width / 2)
    return label_runs(profiles, [*by, *V.AT]).select(*by, *V.AT, kept.alias("kept"), thick.alias("thickness"))


def thinning_stats(thinned: DataFrame, by: Sequence[str]) -> DataFrame:
    return thinned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_label"), count_if(F.col("kept")).alias("n_kept"), F.avg("thickness").alias("mean_thickness_before"), F.count("thickness").alias("n_runs_measured")
    )


def relabel_margin(voxels: DataFrame, profiles: DataFrame, by: Sequence[str], shape: Sequence[int]) -> DataFrame:
    """Class 0 one step along either side of a sheet voxel's normal becomes class 2; 1 and 2 stay as they are."""
    here = [*by, *V.AT]
    ends = F.array(
        *[
            F.struct(*[F.least(F.greatest(F.rint(F.col(a) + s * F.col(f"n{a}")), F.lit(0)), F.lit(n - 1)).cast("int").alias(a) for a, n in zip(V.AT, shape)])
            for s in (1, -1)
        ]
    )
    touched = profiles.select(*by, F.inline(ends)).distinct().withColumn("_touched", F.lit(True))
    out = voxels.join(touched, here, "left")
    return out.withColumn("label", F.when((F.col("label") == 0) & F.col("_touched"), 2).otherwise(F.col("label"))).drop("_touched")


def contrast_by_volume(sheet: DataFrame, background: DataFrame, noise: DataFrame, by: Sequence[str], half: float = 4.0) -> DataFrame:
    """Sheet recall at each volume's own background q99 of the contrast.

    ``sheet``, ``background``: profiles; ``noise``: by..., sigma.
    """
    value = lambda df: df.join(noise, list(by)).select(*by, sheet_contrast(F.col("profile"), half, F.col("sigma")).alias("c"))
    bg, sh = cut_lineage(value(background), "contrast-bg"), cut_lineage(value(sheet), "contrast-sheet")
    cut = quantiles(bg, "c", {"bg_median": 0.5, "threshold": 0.99}, by).withColumnRenamed("n", "n_bg")
    med = quantiles(sh, "c", {"sheet_median": 0.5}, by).drop("n")
    hits = sh.join(cut.select(*by, "threshold"), list(by)).groupBy(*by).agg(ratio(count_if(F.col("c") >= F.col("threshold")), F.count(F.lit(1))).alias("recall"))
    return cut.join(med, list(by)).join(hits, list(by))


def hashed_directions(seed: int, at: np.ndarray) -> np.ndarray:
    """A unit vector for each position, uniform on the sphere, that depends on seed and position only."""

    def mixed(v: np.ndarray) -> np.ndarray:  # fixed values: the finalizer of SplitMix64
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))

    golden, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
    step = np.uint64(golden)
    key = np.full(len(at), seed, np.uint64)
    for axis in range(at.shape[1]):
        key = mixed(key + step + at[:, axis].astype(np.uint64))
    u, v = (mixed(key + np.uint64(k * golden & full)) / 2.0**64 for k in (1, 2))
    z, angle = 2 * u - 1, 2 * np.pi * v
    flat = np.sqrt(np.maximum(1 - z * z, 0))
    return np.stack([z, flat * np.cos(angle), flat * np.sin(angle)], axis=1)


def suppress_non_maxima(
    voxels: DataFrame, by: Sequence[str], shape: Sequence[int], low: float = 0.1, delta: float = 1.0, random_seed: int | None = None, side: int | None = None,
    direction: tuple[float, float, float] | None = None,
) -> DataFrame:
    """Voxels above ``low`` whose p is at least that of both neighbours at +-delta along p's own across-sheet normal.

    With a seed the directions are random instead (the control), and depend on the position only; or one is given.
    """

    def kernel(b: Block) -> pd.DataFrame:
        p = b.arrays["p"]
        pts = b.core_points(p > low)
        if len(pts) == 0:
            return nothing(["z", "y", "x", "kept"])
        if direction is not None:
            n = np.tile(np.array(direction, float), (len(pts), 1))
        else:
            n = across_sheet_normals(p, pts - b.origin) if random_seed is None else hashed_directions(random_seed, pts)
        side_values = sample_lines(p, b, pts, n, np.array([-delta, delta]))
        here = p[tuple((pts - b.origin).T)]
        return pd.DataFrame({**dict(zip("zyx", pts.T.astype("int32"))), "kept": (here[:, None] >= side_values).all(axis=1)})

    spec = KernelSpec("nms", 8, "kept BOOLEAN", kernel)
    return run_kernel(voxels, by, shape, ["p"], spec, side)


# fixed values: cuts of the thinned mask, and of the plain thresholds it is held against
NMS_CUTS = (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98)
PLAIN_CUTS = tuple(float(c) for c in np.linspace(0.02, 0.99, 60))


def thinning_gain(scored: DataFrame, by: Sequence[str], kept: str = "kept", least_recall: float = 0.05, min_sheet: int = 200) -> DataFrame:
    """Does the thinned mask beat every plain threshold? by..., cut, recall, precision, plain_precision, gain of the best cut.

    ``scored``: p, label and the flag ``kept`` of all voxels. Both sweeps are points of one table in falling order of
    recall; the running maximum of the plain precision is what thresholds reach at no less than a point's recall.
    Volumes with less than ``min_sheet`` sheet voxels are left out; a volume without a comparable cut has no row.
    """
    from voxelmetry.operators.score import threshold_sweep

    by = list(by)
    v = scored.where("label <> 2")
    is_sheet = F.col("label") == 1
    sheet = v.groupBy(*by).agg(count_if(is_sheet).alias("n_sheet")).where(F.col("n_sheet") >= min_sheet)
    point = lambda df, cuts, thinned: threshold_sweep(df, by, is_sheet, cuts=cuts).join(sheet, by).select(
        *by, F.lit(thinned).alias("thinned"), "ordinal", "cut", (F.col("n_both") / F.col("n_sheet")).alias("recall"), ratio("n_both", F.greatest("n_pred", F.lit(1))).alias("precision")
    )
    points = point(v, PLAIN_CUTS, False).unionByName(point(v.where(kept), NMS_CUTS, True))
    upto = W.partitionBy(*by).orderBy(F.desc("recall"), "thinned").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = points.withColumn("plain_precision", F.max(F.when(~F.col("thinned"), F.col("precision"))).over(upto)).where("thinned")
    met = met.where((F.col("recall") >= least_recall) & F.col("plain_precision").isNotNull()).withColumn("gain", F.col("precision") - F.col("plain_precision"))
    best = F.max_by(F.struct("cut", "recall", "precision", "plain_precision", "gain"), F.struct("gain", -F.col("ordinal")))
    return met.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def calibrate_contrast(
    sheet: DataFrame, background: DataFrame, noise: DataFrame, by: Sequence[str], half: float = 4.0, floor: float = 0.5, least: int = 400
) -> tuple[DataFrame, DataFrame]:
    """(per volume, pooled): contrast of labelled sheet against the background far from any label.

    ``sheet``, ``background``: profiles; ``noise``: by..., sigma. A volume's threshold is the 99th percentile of its own
    background, the global one that of all backgrounds. Volumes with less than ``least`` sheet profiles are left out;
    with less background their threshold and recall are null and they take no part in the mean recall.
    """
    by = list(by)
    value = lambda df: df.join(noise, by).select(*by, sheet_contrast(F.col("profile"), half, F.col("sigma")).alias("c"))
    sh, bg = cut_lineage(value(sheet), "contrast-sheet"), cut_lineage(value(background), "contrast-bg")
    med = quantiles(sh, "c", {"contrast_sheet_median": 0.5}, by).where(F.col("n") >= least).withColumnRenamed("n", "n_sheet")
    cut = quantiles(bg, "c", {"contrast_bg_median": 0.5, "threshold": 0.99}, by).where(F.col("n") >= least).withColumnRenamed("n", "n_bg")
    sh, bg = sh.join(med.select(*by), by, "left_semi"), bg.join(med.select(*by), by, "left_semi").join(cut.select(*by), by, "left_semi")
    hits = sh.join(cut.select(*by, "threshold"), by).groupBy(*by).agg(ratio(count_if(F.col("c") >= F.col("threshold")), F.count(F.lit(1))).alias("recall"))
    rows = med.join(noise, by).join(cut, by, "left").join(hits, by, "left").withColumn("n_bg", F.coalesce("n_bg", F.lit(0).cast("long")))
    rows = cut_lineage(rows, "contrast-volumes")
    p = quantiles(sh, "c", {"sheet_contrast_median": 0.5, "sheet_contrast_q05": 0.05, "sheet_contrast_q95": 0.95}).drop("n")
    n = quantiles(bg, "c", {"bg_contrast_median": 0.5, "global_threshold": 0.99}).drop("n")
    one = lambda df: df.select(F.struct("*")).scalar()
    found = rows.agg(F.count(F.lit(1)).alias("n_volumes"), F.avg("recall").alias("per_volume_recall"))
    reached = cut_lineage(found.withColumns({"p": one(p), "q": one(n)}).select("n_volumes", "per_volume_recall", "p.*", "q.*"), "contrast-pooled")
    kept = sh.agg(ratio(count_if(F.col("c") >= reached.select("global_threshold").scalar()), F.count(F.lit(1)))).scalar()
    return rows, reached.select("*", kept.alias("global_recall"), (F.col("per_volume_recall") >= floor).alias("leg_usable"))


def precision_at_recall(df: DataFrame, by: Sequence[str], target: DataFrame, cuts: int = 60) -> DataFrame:
    """Best precision any global threshold reaches at no less than the target recall (by..., recall)."""
    from voxelmetry.operators.score import threshold_sweep

    grid = [float(c) for c in np.linspace(0.02, 0.99, cuts)]
    scored = df.where("label <> 2")
    sweep = threshold_sweep(scored, by, F.col("label") == 1, cuts=grid)
    r, pc = ratio("n_both", F.greatest("n_mask", F.lit(1))), ratio("n_both", F.greatest("n_pred", F.lit(1)))
    return sweep.join(target.withColumnRenamed("recall", "_t"), list(by)).where(r >= F.col("_t")).groupBy(*by).agg(F.max(pc).alias("best_precision"))


def attenuate_sheet(voxels: DataFrame, by: Sequence[str], shape: Sequence[int], strength: float, sigma: float = 2.5, mask: str = "label = 1", side: int | None = None) -> DataFrame:
    """Scan value darkened around the sheet by a blurred mask, peak one per volume; clipped to [0, 1]."""

    def kernel(b: Block) -> pd.DataFrame:
        soft = gaussian_filter(b.arrays["_m"], sigma)
        pts = b.core_points(b.arrays["_stored"] == 1)
        core = soft[tuple(slice(lo, hi) for lo, hi in zip(b.core_lo - b.origin, b.core_hi - b.origin))]
        return pd.DataFrame({**dict(zip("zyx", pts.T.astype("int32"))), "soft": soft[tuple((pts - b.origin).T)], "top": core.max()})

    marked = voxels.withColumns({"_m": F.when(F.expr(mask), 1).otherwise(0), "_stored": F.lit(1)})
    soft = cut_lineage(run_kernel(marked, by, shape, ["_m", "_stored"], KernelSpec("soft", int(4 * sigma + 0.5), "soft DOUBLE, top DOUBLE", kernel), side), "soft")
    peak = soft.groupBy(*by).agg(F.max("top").alias("_peak"))
    j = voxels.join(soft.drop("top"), [*by, *V.AT]).join(peak, list(by))
    dark = F.col("ct") * (1 - strength * F.coalesce(F.try_divide(F.col("soft"), F.col("_peak")), F.lit(0.0)))
    return j.withColumn("ct", F.least(F.greatest(dark, F.lit(0.0)), F.lit(1.0))).drop("soft", "_peak")
