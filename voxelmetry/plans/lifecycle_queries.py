"""The end-to-end jobs on the tables at hand."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from voxelmetry.plans import lifecycle
from voxelmetry.plans.patch_queries import ADJ, FEAT_DEFAULT, NEAR, SAME, SMALL
from voxelmetry.plans.registry import query
from voxelmetry.plans.score_queries import BEST, ENDPOINTS_E, _rounded
from voxelmetry.session import checkpoint_root
from voxelmetry.sources.patches import valid_node
from voxelmetry.plans.volume_queries import DENSE, GRID, SHEET, comp_sql, nearest, smooth_sql

LOGIT_BEST = BEST.replace("FROM vox", "FROM lp")


@query(
    "e1_regional_match",
    "lp AS (SELECT vol, 1 / (1 + exp(l0 - l1)) AS p, pred FROM vox), " + LOGIT_BEST
    + """ SELECT vol, n, n_a, n_b, disagreeing, round(v.dice, 6) AS dice, round(CAST(n_both AS DOUBLE) / (n_a + n_b - n_both), 6) AS iou, round(1 - CAST(disagreeing AS DOUBLE) / n, 6) AS agreement,
  round(best_dice, 6) AS best_dice, best_threshold, round(headroom, 6) AS headroom, CASE WHEN v.dice > 0.99 THEN 'reproduced' WHEN best_dice - v.dice < 0.02 THEN 'structural_difference' ELSE 'calibration_difference' END AS verdict FROM a JOIN v USING (vol)""",
)
def e1(t):
    r = lifecycle.regional_match(t.vox, ["vol"], F.col("pred"), 0.2)
    return _rounded(r.select("vol", "n", "n_a", "n_b", "disagreeing", "dice", "iou", "agreement", "best_dice", "best_threshold", "headroom", "verdict"))


MODEL = {
    "features": ["degree", "clustering", "log_size"],
    "standardization_mean": [8.0, 0.4, 3.6],
    "standardization_sd": [4.0, 0.2, 0.1],
    "weights_intercept_then_features": [-1.0, 0.5, -0.25, 0.125],
}


# only the score is rounded, not the features it is made of
FEAT_EXACT = re.sub(r"round\((coalesce\(linked / CAST\(pairs AS DOUBLE\), 0\)|ln\(1 \+ size\)), 6\)", r"\1", FEAT_DEFAULT)


@query(
    "e2_patch_review",
    FEAT_EXACT + """, sc AS (SELECT slab, patch, round(-1 + 0.5::DOUBLE * (degree - 8) / 4 - 0.25::DOUBLE * (clustering - 0.4) / 0.2 + 0.125::DOUBLE * (log_size - 3.6) / 0.1, 4) AS score FROM ft),
 rk AS (SELECT *, row_number() OVER (PARTITION BY slab ORDER BY score DESC, patch) AS rank_within_slab, count(*) OVER (PARTITION BY slab) AS n_in_slab FROM sc)
 SELECT slab, patch, rank_within_slab, n_in_slab, rank_within_slab <= greatest(1, round_even(0.1::DOUBLE * n_in_slab, 0)) AS selected FROM rk""",
)
def e2(t):
    r = lifecycle.review_patches(t.pts, MODEL, 0.1, digits=4, adjacent=ADJ, same=SAME, near=NEAR, **SMALL)
    return r.select("slab", "patch", "rank_within_slab", "n_in_slab", "selected")


@query(
    "e2_skipped_patches",
    "SELECT slab, patch, count(*) AS n_nodes, 'too_few_nodes' AS reason FROM pts WHERE x > 0 AND y > 0 AND z > 0 GROUP BY 1, 2 HAVING count(*) < 4",
)
def e2s(t):
    """Of the nodes with a position, read back from what the report has written beside its ranking."""
    out = f"{checkpoint_root(t.spark)}/review-{uuid.uuid4().hex}"
    lifecycle.review_report(t.pts.where(valid_node()), MODEL, 0.1, out, 4, dict(min_nodes=4, min_interior=0, min_normals=0), adjacent=ADJ, same=SAME, near=NEAR)
    return t.spark.read.schema("slab INT, patch LONG, n_nodes LONG, reason STRING").json(f"{out}/skipped")


@query(
    "e3_recall_records",
    ENDPOINTS_E.replace("FROM scored", "FROM vs").replace("h.n_sheet >= 50 AND h.n_scored >= 100", "h.n_sheet >= 20 AND h.n_scored >= 50").replace("h AS (", "vs AS (SELECT vol AS volume_id, p, label, ct FROM vox), h AS (", 1)
    + ", " + SHEET + ", " + comp_sql("cc", "sh") + ", mis AS (SELECT vol, z, y, x FROM vox WHERE p <= 0.2 AND label = 1), prd AS (SELECT vol, z, y, x FROM vox WHERE p > 0.2), " + nearest("nd", "mis", "prd")
    + ", " + GRID + ", ns AS (SELECT * FROM gr ANTI JOIN sh USING (vol, z, y, x)), " + nearest("dp", "sh", "ns")
    + """, dm AS (SELECT vol, round(avg(d), 6) AS sheet_mean_depth FROM dp GROUP BY 1), mc AS (SELECT vol, count(*) AS nm FROM mis GROUP BY 1), sz AS (SELECT vol, component, count(*) AS size, count(*) FILTER (WHERE p > 0.2) AS found FROM cc JOIN vox USING (vol, z, y, x) GROUP BY 1, 2),
 oc AS (SELECT vol, count(*) AS components, count(*) FILTER (WHERE size >= 27) AS scored_components, count(*) FILTER (WHERE size >= 27 AND found / CAST(size AS DOUBLE) < 0.1) AS lost, round(max(size) / CAST(sum(size) AS DOUBLE), 6) AS largest_share, count(*) FILTER (WHERE size > 1000) AS over_1k FROM sz GROUP BY 1),
 od AS (SELECT vol, median(d) AS md, quantile_cont(d, 0.9) AS p90, count(*) FILTER (WHERE d <= 3) AS close FROM nd GROUP BY 1)
 SELECT e.* RENAME (volume_id AS vol), oc.* EXCLUDE (vol), CASE WHEN nm IS NULL THEN 0 ELSE round(md, 6) END AS orphan_dist_median, CASE WHEN nm IS NULL THEN 0 ELSE round(p90, 6) END AS orphan_dist_p90,
   CASE WHEN nm IS NULL THEN 0 ELSE round((nm - coalesce(close, 0)) / CAST(nm AS DOUBLE), 6) END AS missed_far_frac, sheet_mean_depth
 FROM e LEFT JOIN oc ON oc.vol = e.volume_id LEFT JOIN od ON od.vol = e.volume_id LEFT JOIN mc ON mc.vol = e.volume_id LEFT JOIN dm ON dm.vol = e.volume_id""",
)
def e3(t):
    return _rounded(lifecycle.recall_records(t.vox, ["vol"], (7, 8, 8), block=16, min_sheet=20, min_scored=50).where("status = 'ok'"))


FIFTH = [(o, 0.2) for o in range(-2, 3)]


@query(
    "e3_missed_contrasts",
    SHEET + ", " + comp_sql("cc", "sh") + ", " + DENSE + ", " + smooth_sql("g", "dn", FIFTH) + ", " + smooth_sql("h", "dn", FIFTH, "v * v")
    + ", ns AS (SELECT gr.* FROM gr ANTI JOIN sh USING (vol, z, y, x)), " + nearest("dp", "sh", "ns")
    + """, sz AS (SELECT *, CAST(count(*) OVER (PARTITION BY vol, component) AS DOUBLE) AS size FROM cc),
 al AS (SELECT dp.vol, vox.p <= 0.2 AS missed, d AS depth, CAST(vox.ct AS DOUBLE) AS ct, sqrt(greatest(h3.v - g3.v * g3.v, 0)) AS ct_local_std, size AS component_size
   FROM dp JOIN vox USING (vol, z, y, x) JOIN g3 USING (vol, z, y, x) JOIN h3 USING (vol, z, y, x) JOIN sz USING (vol, z, y, x)),
 ln AS (UNPIVOT al ON depth, ct, ct_local_std, component_size INTO NAME field VALUE v),
 st AS (SELECT vol, field, median(v) FILTER (WHERE missed) AS mm, median(v) FILTER (WHERE NOT missed) AS fm, stddev_pop(v) FILTER (WHERE NOT missed) AS sd FROM ln GROUP BY 1, 2)
 SELECT vol, field, round(mm, 5) AS missed_median, round(fm, 5) AS found_median, round((mm - fm) / (sd + 1e-6), 3) AS delta_z FROM st WHERE mm IS NOT NULL AND fm IS NOT NULL""",
)
def e3c(t):
    c = lifecycle.missed_contrasts(t.vox, ["vol"], (7, 8, 8), block=16)
    return c.select("vol", "field", F.round("missed_median", 5).alias("missed_median"), F.round("found_median", 5).alias("found_median"), F.round("delta_z", 3).alias("delta_z"))
