"""Profile measures along a given direction, which SQL can follow sample by sample, and the gates over their volumes.

The queries of ``volume_queries`` take the direction from the field itself; these go along x through the plain field, so
that every number after the sampling can be asked again as SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmetry.functions.expr import count_if, r6, ratio
from voxelmetry.operators import components as C
from voxelmetry.operators import gates as GT
from voxelmetry.operators import profiles as PR
from voxelmetry.operators import score as S
from voxelmetry.operators import strata as ST
from voxelmetry.operators import volumes as V
from voxelmetry.operators.distribution import quantiles
from voxelmetry.plans.registry import query
from voxelmetry.plans.score_queries import _rounded
from voxelmetry.plans.volume_queries import BY, DENSE, GRID, HERE, SHAPE, SHEET, SIDE, comp_sql, sheet
from voxelmetry.session import cut_lineage

HALF = 2.0
ALONG_X = (0, 0, 1)

LABELS = "dl AS (SELECT gr.vol, gr.z, gr.y, gr.x, coalesce(label, 0) AS label FROM gr LEFT JOIN vox USING (vol, z, y, x))"


def profile_sql(name: str, points: str) -> str:
    """``name``: vol, z, y, x, prof and labs of 17 samples, a quarter voxel apart; positions beyond the volume are clamped."""
    return f"""{name}t AS (SELECT vol, z, y, x, k, least(greatest(x + (k * 0.25::DOUBLE - 2.0::DOUBLE), 0), 7)::DOUBLE AS px FROM ({points}), (SELECT unnest(range(17)) AS k)),
 {name}s AS (SELECT a.vol, a.z, a.y, a.x, k, l.v * (1 - (px - least(floor(px), 6))) + h.v * (px - least(floor(px), 6)) AS v, b.label FROM {name}t a
   JOIN dn l ON l.vol = a.vol AND l.z = a.z AND l.y = a.y AND l.x = least(floor(px), 6) JOIN dn h ON h.vol = a.vol AND h.z = a.z AND h.y = a.y AND h.x = least(floor(px), 6) + 1
   JOIN dl b ON b.vol = a.vol AND b.z = a.z AND b.y = a.y AND b.x = least(floor(px + 0.5::DOUBLE), 7)),
 {name} AS (SELECT vol, z, y, x, list(v ORDER BY k) AS prof, list(label ORDER BY k) AS labs FROM {name}s GROUP BY 1, 2, 3, 4)"""


ON_SHEET = DENSE + ", " + LABELS + ", " + profile_sql("pf", "SELECT vol, z, y, x FROM vox WHERE label = 1")
# signed ridge offset of each profile, NULL at the edges
RIDGE = """rg AS (SELECT *, CASE WHEN k > 1 AND k < 17 THEN -2.0::DOUBLE + 0.25::DOUBLE * (k - 1) + 0.25::DOUBLE * least(greatest(CASE WHEN abs(y0 - 2 * y1 + y2) > 1e-9 THEN 0.5::DOUBLE * (y0 - y2) / (y0 - 2 * y1 + y2) ELSE 0 END, -1), 1) END AS off
  FROM (SELECT *, prof[k - 1] AS y0, prof[k] AS y1, prof[k + 1] AS y2 FROM (SELECT *, list_position(prof, list_max(prof)) AS k FROM pf)))"""
# first and last sample (from 0) of the label run through the centre, NULL where it meets an end of the profile
RUN = """rn AS (SELECT *, CASE WHEN labs[9] = 1 AND l IS NOT NULL AND r IS NOT NULL THEN l + 1 END AS lo, CASE WHEN labs[9] = 1 AND l IS NOT NULL AND r IS NOT NULL THEN r - 1 END AS hi
  FROM (SELECT *, list_max([i for i in range(8) if labs[i + 1] <> 1]) AS l, list_min([i for i in range(9, 17) if labs[i + 1] <> 1]) AS r FROM {src}))"""


def along_x(t, points="label = 1"):
    return cut_lineage(PR.sample_profiles(t.vox, BY, SHAPE, points, half=HALF, smooth=False, direction=ALONG_X, side=SIDE), "along-x")


@query("v14_ridge_along_x", ON_SHEET + ", " + RIDGE + " SELECT vol, count(*) AS n, round(median(abs(off)), 6) AS median_offset FROM rg WHERE off IS NOT NULL GROUP BY 1 HAVING count(*) >= 20")
def v14x(t):
    return _rounded(PR.offset_summary(along_x(t), BY, half=HALF, min_points=20))


@query(
    "v17_placement_along_x",
    ON_SHEET + ", " + RIDGE + ", " + RUN.format(src="rg") + """, d AS (SELECT vol, off - (-2.0::DOUBLE + 0.25::DOUBLE * (lo + hi) / 2) AS d FROM rn WHERE lo IS NOT NULL AND off IS NOT NULL)
 SELECT vol, count(*) AS n, round(median(d), 6) AS median_signed, round(median(abs(d)), 6) AS median_absolute FROM d GROUP BY 1 HAVING count(*) >= 5""",
)
def v17x(t):
    return _rounded(PR.label_placement(along_x(t), BY, half=HALF, min_runs=5))


@query(
    "v18_relabel_along_x",
    SHEET + """, tc AS (SELECT DISTINCT vol, z, y, least(greatest(x + s, 0), 7) AS x FROM sh, (SELECT unnest([1, -1]) AS s))
 SELECT vol, z, y, x, (CASE WHEN label = 0 AND tc.vol IS NOT NULL THEN 2 ELSE label END)::INT AS label FROM vox LEFT JOIN tc USING (vol, z, y, x)""",
)
def v18x(t):
    out = PR.relabel_margin(t.vox.select(*HERE, "label"), along_x(t), BY, SHAPE)
    return out.select(*HERE, F.col("label").cast("int").alias("label"))


@query(
    "v19_thinning_along_x",
    ON_SHEET + ", " + RUN.format(src="pf") + """, th AS (SELECT *, (hi - lo) * 0.25::DOUBLE + 0.25::DOUBLE AS thick, -2.0::DOUBLE + 0.25::DOUBLE * (lo + hi) / 2 AS mid FROM rn)
 SELECT vol, z, y, x, lo IS NULL OR thick <= 1 OR abs(mid) <= 0.5 AS kept, round(thick, 6) AS thickness FROM th""",
)
def v19x(t):
    return _rounded(PR.thin_labels(along_x(t), BY, width=1.0))


@query("v22_localisation_along_x", DENSE + ", " + LABELS + ", " + profile_sql("pf", "SELECT vol, z, y, x FROM vox WHERE pred") + " SELECT vol, count(*) AS n, round(median(abs((list_position(prof, list_max(prof)) - 1) * 0.25::DOUBLE - 2)), 6) AS loc_error FROM pf GROUP BY 1 HAVING count(*) >= 20")
def v22x(t):
    return _rounded(PR.localisation_error(along_x(t, "pred"), BY, half=HALF, min_points=20))


@query(
    "v24_width_along_x",
    ON_SHEET + """, hm AS (SELECT *, list_min(prof) + 0.5::DOUBLE * (list_max(prof) - list_min(prof)) AS level FROM pf),
 ed AS (SELECT vol, prof, level, coalesce(list_max([i for i in range(8) if prof[i + 1] < level]) + 1, 0) AS lo, coalesce(list_min([i for i in range(9, 17) if prof[i + 1] < level]) - 1, 16) AS hi FROM hm)
 SELECT vol, count(*) AS n, round(median((hi - lo + 1) * 0.25::DOUBLE), 6) AS fwhm_median FROM ed WHERE prof[9] >= level GROUP BY 1""",
)
def v24x(t):
    w = along_x(t).select("vol", PR.half_max_width(F.col("profile")).alias("w")).where("w IS NOT NULL")
    return _rounded(quantiles(w, "w", {"fwhm_median": 0.5}, BY))


MARGINS = ON_SHEET + ", " + RUN.format(src="pf") + """, mg AS (SELECT vol, unnest([labs[lo], labs[hi + 2]]) AS c FROM rn WHERE lo IS NOT NULL),
 mv AS (SELECT vol, count(*) AS n_margins, count(*) FILTER (WHERE c = 0) / count(*)::DOUBLE AS frac_background, count(*) FILTER (WHERE c = 2) / count(*)::DOUBLE AS frac_ignore, count(*) FILTER (WHERE c = 1) / count(*)::DOUBLE AS frac_surface FROM mg GROUP BY 1 HAVING count(*) >= 10)"""


def margins(t):
    return PR.margin_classes(along_x(t), BY, min_margins=10)


@query("a50_margins_along_x", MARGINS + " SELECT vol, n_margins, round(frac_background, 6) AS frac_background, round(frac_ignore, 6) AS frac_ignore, round(frac_surface, 6) AS frac_surface FROM mv")
def a50x(t):
    return _rounded(margins(t))


@query(
    "a50_margin_gate",
    MARGINS + """, ig AS (SELECT vol, count(*) FILTER (WHERE label = 2) / count(*)::DOUBLE AS vol_frac_ignore FROM vox GROUP BY 1)
 SELECT count(*) AS n_volumes, round(median(frac_background), 6) AS median, round(quantile_cont(frac_background, 0.1), 6) AS q10, round(quantile_cont(frac_background, 0.9), 6) AS q90, round(avg(frac_background), 6) AS mean,
  round(count(*) FILTER (WHERE frac_background >= 0.8) / count(*)::DOUBLE, 6) AS share_high, round(count(*) FILTER (WHERE frac_background > 0.2 AND frac_background < 0.8) / count(*)::DOUBLE, 6) AS share_middle,
  round(corr(frac_background, vol_frac_ignore), 6) AS corr_ignore, median(frac_background) >= 0.8 AS gate_median, median(frac_background) >= 0.8 AS gate_passed FROM mv JOIN ig USING (vol)""",
)
def a50g(t):
    ignored = t.vox.groupBy("vol").agg(ratio(count_if(F.col("label") == 2), F.count("*")).alias("vol_frac_ignore"))
    return _rounded(GT.margin_gate(margins(t).join(ignored, "vol")))


NOISE = """nb AS (SELECT vol, stddev_pop(ct) AS sd FROM vox WHERE z < 6 GROUP BY vol, z // 2, y // 2, x // 2), ns AS (SELECT vol, greatest(quantile_cont(sd, 0.1), 1e-3) AS sigma FROM nb GROUP BY 1)"""
FAR = "SELECT a.vol, a.z, a.y, a.x FROM vox a WHERE label = 0 AND NOT EXISTS (SELECT 1 FROM vox b WHERE b.vol = a.vol AND b.label IN (1, 2) AND power(a.z - b.z, 2) + power(a.y - b.y, 2) + power(a.x - b.x, 2) < 1.21::DOUBLE)"
CONTRAST = ON_SHEET + ", " + NOISE + ", " + profile_sql("bp", FAR) + """,
 cs AS (SELECT vol, (list_max(prof[3:15]) - list_min(prof)) / greatest(sigma, 1e-6) AS c FROM pf JOIN ns USING (vol)), cb AS (SELECT vol, (list_max(prof[3:15]) - list_min(prof)) / greatest(sigma, 1e-6) AS c FROM bp JOIN ns USING (vol)),
 ms AS (SELECT vol, count(*) AS n_sheet, median(c) AS contrast_sheet_median FROM cs GROUP BY 1 HAVING count(*) >= 20), mb AS (SELECT vol, count(*) AS n_bg, median(c) AS contrast_bg_median, quantile_cont(c, 0.99) AS threshold FROM cb SEMI JOIN ms USING (vol) GROUP BY 1 HAVING count(*) >= 20),
 hr AS (SELECT vol, count(*) FILTER (WHERE c >= threshold) / count(*)::DOUBLE AS recall FROM cs JOIN mb USING (vol) GROUP BY 1),
 rw AS (SELECT vol, n_sheet, contrast_sheet_median, sigma, coalesce(n_bg, 0) AS n_bg, contrast_bg_median, threshold, recall FROM ms JOIN ns USING (vol) LEFT JOIN mb USING (vol) LEFT JOIN hr USING (vol))"""


def contrasts(t):
    """Sheet against background at least 1.1 away from sheet and from ignored voxels (6 on real volumes)."""
    labelled = t.vox.where("label IN (1, 2)").select(*HERE)
    far = V.distance(t.vox.where("label = 0").select(*HERE), labelled, BY, SHAPE, limit=1.1).where("distance IS NULL OR distance >= 1.1").select(*HERE, F.lit(1).alias("far"))
    marked = cut_lineage(t.vox.join(far, HERE, "left"), "far")
    background = PR.sample_profiles(marked, BY, SHAPE, "far = 1", half=HALF, smooth=False, direction=ALONG_X, side=SIDE)
    return PR.calibrate_contrast(along_x(t), background, ST.noise_sigma(t.vox, BY, SHAPE, block=2), BY, half=HALF, least=20)


@query("v15_contrast_by_volume", CONTRAST + " SELECT vol, n_sheet, round(contrast_sheet_median, 6) AS contrast_sheet_median, round(sigma, 6) AS sigma, n_bg, round(contrast_bg_median, 6) AS contrast_bg_median, round(threshold, 6) AS threshold, round(recall, 6) AS recall FROM rw")
def v15x(t):
    return _rounded(contrasts(t)[0])


@query(
    "v15_contrast_pooled",
    CONTRAST + """, pk AS (SELECT c FROM cs SEMI JOIN ms USING (vol)), bk AS (SELECT c FROM cb SEMI JOIN mb USING (vol)), gt AS (SELECT quantile_cont(c, 0.99) AS g, median(c) AS m FROM bk)
 SELECT (SELECT count(*) FROM rw) AS n_volumes, round((SELECT avg(recall) FROM rw), 6) AS per_volume_recall, round(median(c), 6) AS sheet_contrast_median, round(quantile_cont(c, 0.05), 6) AS sheet_contrast_q05, round(quantile_cont(c, 0.95), 6) AS sheet_contrast_q95,
  round(any_value(m), 6) AS bg_contrast_median, round(any_value(g), 6) AS global_threshold, round(count(*) FILTER (WHERE c >= g) / count(*)::DOUBLE, 6) AS global_recall, (SELECT avg(recall) FROM rw) >= 0.5 AS leg_usable FROM pk, gt""",
)
def v15p(t):
    return _rounded(contrasts(t)[1])


RESOLVED = ON_SHEET + """, d2 AS (SELECT vol, prof, [prof[i] - 2 * prof[i + 1] + prof[i + 2] for i in range(1, 16)] AS d FROM pf), md AS (SELECT *, list_aggregate(d, 'median') AS m FROM d2),
 rs AS (SELECT vol, (list_max(prof) - list_aggregate([prof[1], prof[2], prof[3], prof[15], prof[16], prof[17]], 'median')) / greatest(1.4826::DOUBLE * list_aggregate([abs(v - m) for v in d], 'median') / sqrt(6.0::DOUBLE), 1e-3) AS r FROM md),
 rv AS (SELECT vol, count(*) AS n, median(r) AS median_resolvability FROM rs GROUP BY 1 HAVING count(*) >= 20), sf AS (SELECT vol, count(*) FILTER (WHERE label = 1) / greatest(count(*) FILTER (WHERE label <> 2), 1)::DOUBLE AS sheet_fraction FROM vox GROUP BY 1)"""


def resolved(t):
    r = along_x(t).select("vol", PR.resolvability(F.col("profile"), half=HALF).alias("r"))
    each = quantiles(r, "r", {"median_resolvability": 0.5}, BY).where("n >= 20")
    share = t.vox.groupBy("vol").agg(ratio(count_if(F.col("label") == 1), F.greatest(count_if(F.col("label") != 2), F.lit(1))).alias("sheet_fraction"))
    return each.join(share, "vol")


@query("v16_resolvability_along_x", RESOLVED + " SELECT vol, n, round(median_resolvability, 4) AS median_resolvability, round(sheet_fraction, 6) AS sheet_fraction FROM rv JOIN sf USING (vol)")
def v16x(t):
    return resolved(t).select("vol", "n", F.round("median_resolvability", 4).alias("median_resolvability"), r6("sheet_fraction").alias("sheet_fraction"))


@query(
    "v16_resolvability_gate",
    RESOLVED + """, rk AS (SELECT *, rank() OVER (ORDER BY median_resolvability) + (count(*) OVER (PARTITION BY median_resolvability) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY sheet_fraction) + (count(*) OVER (PARTITION BY sheet_fraction) - 1) / 2.0::DOUBLE AS b FROM rv JOIN sf USING (vol)),
 st AS (SELECT count(*) AS n_volumes, median(median_resolvability) AS m, quantile_cont(median_resolvability, 0.25) AS q1, quantile_cont(median_resolvability, 0.75) AS q3, corr(a, b) AS rho FROM rk)
 SELECT n_volumes, round(m, 6) AS median, round(q1, 6) AS q25, round(q3, 6) AS q75, round(q3 / greatest(q1, 1e-9), 6) AS iqr_ratio, round(rho, 6) AS rho, q3 / greatest(q1, 1e-9) >= 1.5 AS gate_spread, coalesce(abs(rho) <= 0.7, false) AS gate_not_density,
  q3 / greatest(q1, 1e-9) >= 1.5 AND coalesce(abs(rho) <= 0.7, false) AS gate_passed FROM st""",
)
def v16g(t):
    return _rounded(GT.resolvability_gate(resolved(t)))


@query(
    "v21_close_pair_gate",
    SHEET + ", " + comp_sql("cc", "sh")
    + """, sz AS (SELECT vol, component FROM cc GROUP BY 1, 2 HAVING count(*) >= 4), kk AS (SELECT * FROM cc SEMI JOIN sz USING (vol, component)),
 gp AS (SELECT a.vol, a.component AS a, b.component AS b FROM kk a JOIN kk b ON a.vol = b.vol AND a.component < b.component GROUP BY 1, 2, 3 HAVING sqrt(min(power(a.z - b.z, 2) + power(a.y - b.y, 2) + power(a.x - b.x, 2))) <= 1.5),
 pv AS (SELECT n.vol, n.components, count(gp.a) AS p FROM (SELECT vol, count(*) AS components FROM sz GROUP BY 1) n LEFT JOIN gp ON gp.vol = n.vol GROUP BY 1, 2)
 SELECT count(*) AS n_volumes, round(median(p), 6) AS median_close_pairs, round(avg(p), 6) AS mean_close_pairs, round(count(*) FILTER (WHERE p >= 1) / count(*)::DOUBLE, 6) AS share_with_pair, round(median(components), 6) AS median_components,
  median(p) >= 5 AS gate_median_pairs, count(*) FILTER (WHERE p >= 1) / count(*)::DOUBLE >= 0.6 AS gate_share_with_pair, median(p) >= 5 AND count(*) FILTER (WHERE p >= 1) / count(*)::DOUBLE >= 0.6 AS gate_passed FROM pv""",
)
def v21g(t):
    return _rounded(GT.close_pair_gate(C.close_pairs(sheet(t), BY, near=1.5, min_size=4, block=SIDE)))


_PASSED = lambda cuts: " + ".join(f"(p > {c!r}::DOUBLE)::INT" for c in cuts)


def sweep_sql(name: str, source: str, cuts) -> str:
    return f"""{name}b AS (SELECT vol, {_PASSED(cuts)} AS k, count(*) AS n, count(*) FILTER (WHERE label = 1) AS s FROM {source} GROUP BY 1, 2),
 {name} AS (SELECT v.vol, c.ordinal, c.cut, coalesce(sum(n) FILTER (WHERE k > ordinal), 0) AS n_pred, coalesce(sum(s) FILTER (WHERE k > ordinal), 0) AS n_both, any_value(n_sheet) AS n_sheet
   FROM tot v CROSS JOIN (SELECT unnest(range({len(cuts)})) AS ordinal, unnest({[float(c) for c in cuts]}::DOUBLE[]) AS cut) c JOIN {name}b ON {name}b.vol = v.vol GROUP BY 1, 2, 3)"""


@query(
    "v20_gain_along_x",
    GRID + """, pg AS (SELECT gr.vol, gr.z, gr.y, gr.x, coalesce(p, 0) AS p FROM gr LEFT JOIN vox USING (vol, z, y, x)),
 nm AS (SELECT a.vol, a.z, a.y, a.x, a.p >= l.p AND a.p >= h.p AS kept FROM pg a JOIN pg l ON l.vol = a.vol AND l.z = a.z AND l.y = a.y AND l.x = greatest(a.x - 1, 0) JOIN pg h ON h.vol = a.vol AND h.z = a.z AND h.y = a.y AND h.x = least(a.x + 1, 7) WHERE a.p > 0.1),
 sc AS (SELECT v.vol, v.p, v.label, coalesce(kept, false) AS kept FROM vox v LEFT JOIN nm ON nm.vol = v.vol AND nm.z = v.z AND nm.y = v.y AND nm.x = v.x WHERE label <> 2), kp AS (SELECT * FROM sc WHERE kept),
 tot AS (SELECT vol, count(*) FILTER (WHERE label = 1) AS n_sheet FROM sc GROUP BY 1 HAVING count(*) FILTER (WHERE label = 1) >= 20), """
    + sweep_sql("pl", "sc", PR.PLAIN_CUTS) + ", " + sweep_sql("th", "kp", PR.NMS_CUTS)
    + """, pr AS (SELECT vol, n_both / n_sheet::DOUBLE AS r, n_both / greatest(n_pred, 1)::DOUBLE AS pc FROM pl), tr AS (SELECT vol, ordinal, cut, n_both / n_sheet::DOUBLE AS r, n_both / greatest(n_pred, 1)::DOUBLE AS pc FROM th),
 cm AS (SELECT tr.vol, ordinal, cut, tr.r, tr.pc, max(pr.pc) AS ref FROM tr JOIN pr ON pr.vol = tr.vol AND pr.r >= tr.r WHERE tr.r >= 0.05 GROUP BY ALL)
 SELECT vol, round(cut, 6) AS cut, round(r, 6) AS recall, round(pc, 6) AS "precision", round(ref, 6) AS plain_precision, round(pc - ref, 6) AS gain FROM cm QUALIFY row_number() OVER (PARTITION BY vol ORDER BY pc - ref DESC, ordinal) = 1""",
)
def v20x(t):
    kept = PR.suppress_non_maxima(t.vox, BY, SHAPE, side=SIDE, direction=ALONG_X).where("kept")
    return _rounded(PR.thinning_gain(thinned(t, kept), BY, min_sheet=20))


def thinned(t, kept):
    return cut_lineage(t.vox.join(kept, HERE, "left").withColumn("kept", F.coalesce("kept", F.lit(False))), "thinned")


@query("v20_gain_of_both_arms")
def v20g(t):
    """Across the sheet, and in random directions as the control."""
    arms = {"hessian": None, "random": 20}
    out = None
    for arm, seed in arms.items():
        kept = PR.suppress_non_maxima(t.vox, BY, SHAPE, side=SIDE, random_seed=seed).where("kept")
        gain = PR.thinning_gain(thinned(t, kept), BY, min_sheet=20).withColumn("arm", F.lit(arm))
        out = gain if out is None else out.unionByName(gain)
    return _rounded(out)


DISPLACED = """o AS (SELECT unnest(range(-2, 3)) AS d), dd AS (SELECT a.d::INT AS dz, b.d::INT AS dy, c.d::INT AS dx FROM o a, o b, o c), m AS (SELECT vol, z, y, x FROM vox WHERE label = 1),
 dp AS (SELECT dz, dy, dx, count(*) AS n_on, sum(v.ct)::DOUBLE AS s_on FROM m, dd JOIN vox v ON v.vol = m.vol AND v.z = m.z - dz AND v.y = m.y - dy AND v.x = m.x - dx GROUP BY 1, 2, 3)"""


@query("j19_displacement_table", DISPLACED + " SELECT * FROM dp")
def j19d(t):
    from voxelmetry.operators.alignment import displacements

    return displacements(t.vox, sheet(t), BY, reach=2).where("n_on > 0")
