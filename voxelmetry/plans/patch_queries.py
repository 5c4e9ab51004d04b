"""Queries on patches: spatial joins, geometry, graph features, winding, review ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmetry.functions.expr import r6
from voxelmetry.operators import learn as L
from voxelmetry.operators import patches as G
from voxelmetry.operators import spatial as X
from voxelmetry.operators import stats as T
from voxelmetry.operators import winding as WD
from voxelmetry.plans.registry import query
from voxelmetry.plans.score_queries import _rounded
from voxelmetry.plans.stats_queries import FEATS, feat, mwu_sql
from voxelmetry.session import cut_lineage
from voxelmetry.sources.patches import slab_of, valid_node

ADJ, SAME, NEAR = 4.0, 3.0, 12.0
SMALL = dict(min_nodes=20, min_interior=5, min_normals=5)
BOX = """bx AS (SELECT slab, patch, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pts GROUP BY 1, 2),
 cd AS (SELECT * FROM (SELECT a.slab, a.patch AS a, b.patch AS b, sqrt(power(greatest(a.lx - b.hx, b.lx - a.hx, 0), 2) + power(greatest(a.ly - b.hy, b.ly - a.hy, 0), 2) + power(greatest(a.lz - b.hz, b.lz - a.hz, 0), 2)) AS box_gap
   FROM bx a JOIN bx b ON a.slab = b.slab AND a.patch < b.patch) WHERE box_gap <= 12)"""
PD = BOX + """, pd AS (SELECT cd.slab, a, b, sqrt(min(power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2))) AS distance FROM cd JOIN pts p ON p.patch = a JOIN pts q ON q.patch = b GROUP BY 1, 2, 3)"""
ED = PD + """, ed AS (SELECT slab, a, b FROM pd WHERE distance <= 4), adj AS (SELECT slab, a AS src, b AS dst FROM ed UNION ALL SELECT slab, b, a FROM ed)"""


@query("j8_box_proximity", BOX + " SELECT slab, a, b, round(box_gap, 6) AS box_gap FROM cd")
def j8(t):
    return _rounded(X.near_boxes(X.bounding_boxes(t.pts, ["slab", "patch"]), ["slab"], "patch", NEAR))


@query("j9_range_min", PD + " SELECT slab, a, b, round(distance, 6) AS distance FROM pd WHERE distance <= 12")
def j9(t):
    return _rounded(X.range_minimum(t.pts, ["slab"], "patch", NEAR, splits=(2,)))


def distances(t):
    return X.pair_distances(t.pts, ["slab"], "patch", NEAR, splits=(2,))


@query("j10_nearest_distance", PD + " SELECT slab, a, b, round(distance, 6) AS distance FROM pd")
def j10(t):
    return _rounded(distances(t))


@query("g3_pair_min_distances", PD + " SELECT slab, count(*) AS n_pairs, round(min(distance), 6) AS lo, round(max(distance), 6) AS hi FROM pd GROUP BY 1")
def g3(t):
    return _rounded(distances(t).groupBy("slab").agg(F.count("*").alias("n_pairs"), F.min("distance").alias("lo"), F.max("distance").alias("hi")))


WIT = BOX + """, wt AS (SELECT cd.slab, a, b, power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2) AS d2, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx_, q.y AS by_, q.z AS bz FROM cd JOIN pts p ON p.patch = a JOIN pts q ON q.patch = b
  QUALIFY row_number() OVER (PARTITION BY cd.slab, a, b ORDER BY d2, p.x, p.y, p.z, q.x, q.y, q.z) = 1)"""


@query("j11_witness", WIT + " SELECT slab, a, b, round(sqrt(d2), 6) AS distance, round(ax, 6) AS a_x, round(ay, 6) AS a_y, round(az, 6) AS a_z, round(bx_, 6) AS b_x, round(by_, 6) AS b_y, round(bz, 6) AS b_z FROM wt WHERE d2 <= 144")
def j11(t):
    return _rounded(X.range_minimum(t.pts, ["slab"], "patch", NEAR, splits=(2,), witness=True))


@query("g4_adjacency", PD + " SELECT slab, a, b FROM pd WHERE distance <= 4")
def g4(t):
    return X.range_minimum(t.pts, ["slab"], "patch", ADJ, splits=(2,)).select("slab", "a", "b")


J12 = ED + """, wd AS (SELECT l.slab, l.src, l.dst AS p, r.dst AS q FROM adj l JOIN adj r ON l.slab = r.slab AND l.src = r.src AND l.dst < r.dst),
 cm AS (SELECT slab, p, q, count(*) AS common FROM wd GROUP BY 1, 2, 3),
 np AS (SELECT wd.slab, src, count(*) AS pairs, count(ed.a) AS linked, count(*) FILTER (WHERE ed.a IS NULL AND common = 1) AS no_common FROM wd JOIN cm USING (slab, p, q) LEFT JOIN ed ON ed.slab = wd.slab AND ed.a = p AND ed.b = q GROUP BY 1, 2)"""


@query("j12_neighbour_pairs", J12 + " SELECT * FROM np")
def j12(t):
    edges = cut_lineage(distances(t).where(F.col("distance") <= ADJ).select("slab", "a", "b"), "edges")
    return G.neighbour_pairs(edges, ["slab"])


TAN = """tg AS (SELECT c.slab, c.patch, c.row, c.col, """ + ", ".join(f"(d.{a} - u.{a}) / 2 AS u{a}, (r.{a} - l.{a}) / 2 AS v{a}" for a in "zyx") + """
  FROM pts c JOIN pts u ON u.patch = c.patch AND u.row = c.row - 1 AND u.col = c.col JOIN pts d ON d.patch = c.patch AND d.row = c.row + 1 AND d.col = c.col
  JOIN pts l ON l.patch = c.patch AND l.row = c.row AND l.col = c.col - 1 JOIN pts r ON r.patch = c.patch AND r.row = c.row AND r.col = c.col + 1)"""
GEO = TAN + """, cr AS (SELECT slab, patch, row, col, uy * vx - ux * vy AS nz, ux * vz - uz * vx AS ny, uz * vy - uy * vz AS nx FROM tg),
 un AS (SELECT slab, patch, row, col, nz / l AS nz, ny / l AS ny, nx / l AS nx FROM (SELECT *, sqrt(nz * nz + ny * ny + nx * nx) AS l FROM cr) WHERE l > 1e-9),
 fs AS (SELECT patch, arg_min(nz, row * 100 + col) AS fz, arg_min(ny, row * 100 + col) AS fy, arg_min(nx, row * 100 + col) AS fx FROM un GROUP BY 1),
 tu AS (SELECT un.slab, un.patch, nz * s AS nz, ny * s AS ny, nx * s AS nx FROM (SELECT un.*, sign(nz * fz + ny * fy + nx * fx) AS s FROM un JOIN fs USING (patch)) un),
 mn AS (SELECT slab, patch, n, mz / l AS mz, my / l AS my, mx / l AS mx FROM (SELECT *, greatest(sqrt(mz * mz + my * my + mx * mx), 1e-9) AS l FROM (SELECT slab, patch, count(*) AS n, avg(nz) AS mz, avg(ny) AS my, avg(nx) AS mx FROM tu GROUP BY 1, 2))),
 sp AS (SELECT tu.patch, sqrt(avg(power(acos(least(greatest(nz * mz + ny * my + nx * mx, -1), 1)), 2))) AS normal_spread FROM tu JOIN mn ON tu.patch = mn.patch GROUP BY 1),
 bs AS (SELECT slab, patch, count(*) AS n_nodes, avg(z) AS c_z, avg(y) AS c_y, avg(x) AS c_x, sqrt(var_pop(z) + var_pop(y) + var_pop(x)) AS size FROM pts GROUP BY 1, 2),
 geo AS (SELECT bs.*, n AS n_normals, mz, my, mx, normal_spread FROM bs JOIN mn USING (patch) JOIN sp USING (patch))""".replace("bs.*, n AS", "bs.slab, bs.patch, n_nodes, c_z, c_y, c_x, size, n AS")


@query("w9_central_differences", TAN + " SELECT patch, row, col, " + ", ".join(f"round({t}{a}, 6) AS {t}{a}" for a in "zyx" for t in "uv") + " FROM tg")
def w9(t):
    return _rounded(G.central_differences(t.pts, ["patch"]).select("patch", "row", "col", *[f"{k}{a}" for a in "zyx" for k in "uv"]))


GEOCOLS = ["c_z", "c_y", "c_x", "size", "mz", "my", "mx", "normal_spread"]


@query("g1_patch_records", GEO + " SELECT slab, patch, n_nodes, n_normals, 'ok' AS status, " + ", ".join(f"round({c}, 6) AS {c}" for c in GEOCOLS) + " FROM geo")
def g1(t):
    g = G.geometry(t.pts, ["slab", "patch"], **SMALL)
    return _rounded(g.select("slab", "patch", "n_nodes", "n_normals", "status", *GEOCOLS))


@query(
    "g2_distortion",
    TAN + """, ef AS (SELECT patch, uz * uz + uy * uy + ux * ux AS e, uz * vz + uy * vy + ux * vx AS f, vz * vz + vy * vy + vx * vx AS g FROM tg),
 ev AS (SELECT patch, e, f, g, e * g - f * f AS det, (e + g) / 2 AS h, sqrt(greatest((e + g) * (e + g) / 4 - (e * g - f * f), 0)) AS rt FROM ef WHERE e > 1e-9 AND g > 1e-9),
 st AS (SELECT patch, sqrt((h + rt) / greatest(h - rt, 1e-12)) AS stretch, abs(f) / sqrt(e * g) AS shear, sqrt(greatest(det, 0)) AS area FROM ev)
 SELECT patch, count(*) AS n_nodes, round(median(stretch), 5) AS stretch_med, round(quantile_cont(stretch, 0.9), 5) AS stretch_q90, round(median(shear), 6) AS shear_med, round(quantile_cont(shear, 0.9), 6) AS shear_q90,
  round(stddev_pop(area) / greatest(avg(area), 1e-9), 6) AS area_cv FROM st GROUP BY 1""",
)
def g2(t):
    d = G.distortion(t.pts, ["patch"], min_nodes=5)
    coarse = {c: F.round(c, 5) for c in ("stretch_med", "stretch_q90")}  # the root of a small difference
    return d.withColumns(coarse).withColumns({c: r6(c) for c in ("shear_med", "shear_q90", "area_cv")})


FEAT = J12.replace("WITH", "") + ", " + GEO + """, dg AS (SELECT slab, src, count(*) AS degree FROM adj GROUP BY 1, 2),
 ar AS (SELECT adj.slab, adj.src, sqrt(avg(power(i.c_z - j.c_z, 2) + power(i.c_y - j.c_y, 2) + power(i.c_x - j.c_x, 2))) / greatest(max(i.size), 1e-6) AS neigh_spread,
   median(acos(least(greatest(abs(i.mz * j.mz + i.my * j.my + i.mx * j.mx), -1), 1))) AS nb_normal_angle, median(dg.degree) AS nb_degree_med
   FROM adj JOIN geo i ON i.patch = adj.src JOIN geo j ON j.patch = adj.dst JOIN dg ON dg.slab = adj.slab AND dg.src = adj.dst GROUP BY 1, 2),
 cl AS (SELECT slab, src, count(*) FILTER (WHERE distance < 3) / CAST(count(*) AS DOUBLE) AS frac_same FROM (SELECT slab, a AS src, distance FROM pd WHERE {where} UNION ALL SELECT slab, b, distance FROM pd WHERE {where}) GROUP BY 1, 2),
 ft AS (SELECT g.slab, g.patch, coalesce(degree, 0)::DOUBLE AS degree, round(coalesce(linked / CAST(pairs AS DOUBLE), 0), 6) AS clustering, round(coalesce(no_common / CAST(pairs AS DOUBLE), 0), 6) AS local_cut,
   round(coalesce(neigh_spread, 0), 6) AS neigh_spread, round(coalesce(frac_same, 0), 6) AS frac_same, round(normal_spread, 6) AS normal_spread, round(coalesce(nb_normal_angle, 0), 6) AS nb_normal_angle,
   round(coalesce(nb_degree_med, 0), 6) AS nb_degree_med, round(ln(1 + size), 6) AS log_size
   FROM geo g LEFT JOIN dg ON dg.src = g.patch LEFT JOIN np ON np.src = g.patch LEFT JOIN ar ON ar.src = g.patch LEFT JOIN cl ON cl.src = g.patch)"""
FEAT_DEFAULT = FEAT.format(where="distance <= 12")


def features(t):
    return _rounded(G.extract_features(t.pts, ["slab"], "patch", ADJ, SAME, NEAR, **SMALL))


@query("g5_features", FEAT_DEFAULT + " SELECT * FROM ft")
def g5(t):
    return features(t)


@query("g5_features_compat", FEAT.format(where="true") + " SELECT slab, patch, frac_same FROM ft")
def g5c(t):
    geo = G.geometry(t.pts, ["slab", "patch"], **SMALL)
    f = G.graph_features(geo, cut_lineage(distances(t), "distances"), ["slab"], "patch", ADJ, SAME, NEAR, compat=True)
    return _rounded(f.select("slab", "patch", "frac_same"))


G6L = FEAT_DEFAULT + ", lf AS (" + " UNION ALL ".join(f"SELECT patch % 6 = 0 AS bad, '{f}' AS field, {f} AS v FROM ft" for f in G.FEATURES) + "), "


@query("g6_feature_auc", G6L + mwu_sql("lf", "v", "bad", "field") + " SELECT field, n1, n2, round(auc, 6) AS auc, round(z, 6) AS z FROM mwu")
def g6(t):
    f = features(t).withColumn("bad", F.col("patch") % 6 == 0)
    return _rounded(T.mann_whitney_features(f, G.FEATURES, "bad").select("field", "n1", "n2", "auc", "z"))


MODEL = {
    "features": FEATS,
    "standardization_mean": [2000.0, 0.85, 0.1, 0.01],
    "standardization_sd": [3000.0, 0.02, 0.02, 0.005],
    "weights_intercept_then_features": [-1.5, 0.4, -0.3, 0.2, 0.1],
}
SCORE = "round(-1.5::DOUBLE + 0.4::DOUBLE * (round(n_chars, 9) - 2000) / 3000 - 0.3::DOUBLE * (round(dense, 9) - 0.85) / 0.02 + 0.2::DOUBLE * (round(vowel, 9) - 0.1) / 0.02 + 0.1::DOUBLE * (round(stops, 9) - 0.01) / 0.005, 6)"


@query("g9_score_rank_select", f"""rk AS (SELECT item, slab, {SCORE} AS score FROM feat), r2 AS (SELECT *, row_number() OVER (PARTITION BY slab ORDER BY score DESC, item) AS rank_within_slab, count(*) OVER (PARTITION BY slab) AS n_in_slab FROM rk)
 SELECT *, rank_within_slab <= greatest(1, round_even(0.1::DOUBLE * n_in_slab, 0)) AS selected FROM r2""")
def g9(t):
    scored = L.score_with(feat(t), MODEL).withColumn("score", F.round("score", 6))
    ranked = T.rank_rows(scored, ["slab"], [F.desc("score"), F.asc("item")])
    return ranked.select("item", "slab", "score", F.col("rank").alias("rank_within_slab"), F.col("n_in_group").alias("n_in_slab"), T.selected_within(0.1).alias("selected"))


@query("g7_fold_weights")
def g7(t):
    f = L.fit_folds(feat(t), "slab", FEATS, "y")
    return f.select("slab", *[F.round(F.get("weights", i), 4).alias(f"w{i}") for i in range(5)])


# the mean gradient of every fold's loss is zero at its weights, which no other weights have: the loss is convex
@query("g7_gradient_at_weights", "SELECT slab, (SELECT count(*) FROM feat) - count(*) AS n, 0.0::DOUBLE AS gradient FROM feat GROUP BY 1")
def g7g(t):
    f = cut_lineage(feat(t), "feat")
    return L.fold_gradients(f, "slab", FEATS, "y", L.fit_folds(f, "slab", FEATS, "y", iterations=12)).withColumn("gradient", F.abs(F.round("gradient", 7)))


@query("g8_deployment_model")
def g8(t):
    m = L.fit_deployment(feat(t), FEATS, "y")
    w = m["weights_intercept_then_features"]
    rows = [(f, float(a), float(b), round(float(c), 4)) for f, a, b, c in zip(m["features"], m["standardization_mean"], m["standardization_sd"], w[1:])]
    return t.spark.createDataFrame(rows, "feature STRING, mean DOUBLE, sd DOUBLE, weight DOUBLE")


_PARTS = " || '|' || ".join(f"CAST(CAST(round(round({c}, 9) * 1e9) AS HUGEINT) AS VARCHAR)" for c in FEATS)


@query(
    "g8_training_manifest",
    f"""r AS (SELECT slab, y, CAST('0x' || substr(md5(item || '|' || y || '|' || {_PARTS}), 1, 12) AS BIGINT) AS d FROM feat)
 SELECT slab, count(*) AS n, sum(y)::BIGINT AS n_bad, round(sum(y) / count(*)::DOUBLE, 6) AS bad_rate, CAST(sum(d) AS VARCHAR) AS digest FROM r GROUP BY 1""",
)
def g8m(t):
    return _rounded(L.training_manifest(feat(t), "slab", "item", FEATS, "y"))


@query("g10_held_out_evaluation")
def g10(t):
    f = feat(t)
    out = None
    for cols, tag in ((FEATS, "all"), (["n_chars"], "size only"), (["dense", "vowel"], "original")):
        e = _rounded(L.evaluate(f, "slab", "item", cols, "y", tag))
        out = e if out is None else out.unionByName(e)
    return out


@query("s10_feature_table", "SELECT slab, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_bad FROM feat GROUP BY 1")
def s10(t):
    from voxelmetry.sources.patches import enough_slabs

    return enough_slabs(t.feat).groupBy("slab").agg(F.count("*").alias("n"), F.sum("y").alias("n_bad"))


@query("s9_patch_slab", "SELECT patch, CAST(floor((min(z) + max(z)) / 2 / 5) AS INT) AS by_box, CAST(floor(avg(z) / 5) AS INT) AS by_mean FROM pts GROUP BY 1")
def s9(t):
    g = t.pts.groupBy("patch").agg(F.min("z").alias("a"), F.max("z").alias("b"), F.avg("z").alias("m"))
    none = F.lit(None).cast("double")
    return g.select("patch", slab_of(F.col("a"), F.col("b"), F.col("m"), 5).alias("by_box"), slab_of(none, none, F.col("m"), 5).alias("by_mean"))


@query("p12_valid_nodes", "SELECT patch, count(*) AS n FROM pts WHERE x > 0 AND y > 0 AND z > 0 GROUP BY 1")
def p12(t):
    return t.pts.where(valid_node()).groupBy("patch").agg(F.count("*").alias("n"))


@query("f6_vector_functions", GEO + " SELECT patch, round(acos(least(greatest(mz, -1), 1)), 6) AS tilt, round(sqrt(mz * mz + my * my + mx * mx), 6) AS length FROM geo")
def f6(t):
    from voxelmetry.functions.expr import clip, norm

    g = G.geometry(t.pts, ["slab", "patch"], **SMALL)
    return g.select("patch", r6(F.acos(clip(F.col("mz"), -1, 1))).alias("tilt"), r6(norm([F.col("mz"), F.col("my"), F.col("mx")])).alias("length"))


OFFS = "[" + ", ".join(f"{-30 + 5.0 * i}::DOUBLE" for i in range(13)) + "]"
AXIS = f"""md AS (SELECT slab, avg(y) AS my, avg(x) AS mx FROM pts GROUP BY 1), oy AS (SELECT unnest({OFFS}) AS dy, unnest(range(13)) AS oi), ox AS (SELECT unnest({OFFS}) AS dx, unnest(range(13)) AS oj),
 rd AS (SELECT pts.slab, oi * 13 + oj AS ordinal, md.my + dy AS cy, md.mx + dx AS cx, sqrt(power(y - md.my - dy, 2) + power(x - md.mx - dx, 2)) AS r FROM pts JOIN md USING (slab), oy, ox),
 en AS (SELECT slab, ordinal, min(r) AS lo, max(r) AS hi, count(*) AS n, any_value(cy) AS cy, any_value(cx) AS cx FROM rd GROUP BY 1, 2),
 hs AS (SELECT slab, ordinal, en.cy, en.cx, n, least(floor((r - lo) / (hi - lo) * 40), 39) AS b, count(*) AS c FROM rd JOIN en USING (slab, ordinal) GROUP BY ALL),
 sc AS (SELECT slab, ordinal, cy, cx, stddev_pop(c / CAST(n AS DOUBLE)) AS score FROM hs GROUP BY 1, 2, 3, 4),
 ax AS (SELECT slab, cy AS axis_y, cx AS axis_x, score FROM sc QUALIFY row_number() OVER (PARTITION BY slab ORDER BY round(score, 12), ordinal) = 1)"""


def axis(t):
    return WD.estimate_axis(t.pts, ["slab"], span=30.0)


@query("g12_axis_search", AXIS + " SELECT slab, round(axis_y, 6) AS axis_y, round(axis_x, 6) AS axis_x, round(score, 6) AS score FROM ax")
def g12(t):
    return _rounded(axis(t))


def wrap_edges(t):
    geo = cut_lineage(WD.outward_normals(G.geometry(t.pts, ["slab", "patch"], **SMALL), axis(t), ["slab"]), "normals")
    return geo, WD.wrap_edges(t.pts, geo, ["slab"], same=3.0, near=8.0)


@query(
    "g11_winding_edges",
    WIT + ", " + AXIS + ", " + GEO + """, og AS (SELECT geo.patch, CASE WHEN sqrt(power(c_y - axis_y, 2) + power(c_x - axis_x, 2)) > 1e-9 AND my * (c_y - axis_y) + mx * (c_x - axis_x) < 0 THEN -1 ELSE 1 END AS s, mz, my, mx FROM geo JOIN ax USING (slab)),
 of AS (SELECT wt.slab, a, b, sqrt(d2) AS distance, ((bz - az) * mz + (by_ - ay) * my + (bx_ - ax) * mx) * s AS off FROM wt JOIN og ON og.patch = wt.a WHERE d2 <= 64)
 SELECT slab, a, b, round(distance, 6) AS distance, round(off, 6) AS "offset", CASE WHEN distance <= 3 THEN 0 WHEN off > 0 THEN 1 ELSE -1 END AS delta FROM of WHERE distance <= 3 OR abs(off) >= 1""",
)
def g11(t):
    return _rounded(wrap_edges(t)[1])


@query("g13_wrap_potentials")
def g13(t):
    geo, edges = wrap_edges(t)
    w, forks = WD.solve_wraps(geo, cut_lineage(edges, "wrap-edges"), ["slab"])
    return _rounded(w.join(forks, ["slab", "patch"], "left"))
