"""Queries on voxel neighbourhoods: distance, components, morphology, smoothing, profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxelmetry.functions.expr import count_if, r6, ratio, sigmoid_of_logits
from voxelmetry.operators import blocks as B
from voxelmetry.operators import components as C
from voxelmetry.operators import profiles as PR
from voxelmetry.operators import score as S
from voxelmetry.operators import strata as ST
from voxelmetry.operators import volumes as V
from voxelmetry.operators.distribution import quantiles
from voxelmetry.plans.registry import query
from voxelmetry.plans.score_queries import _rounded
from voxelmetry.session import checkpoint_root, cut_lineage
from voxelmetry.sources.store import read_store, write_store

SHAPE, BY, HERE = (7, 8, 8), ["vol"], ["vol", "z", "y", "x"]
BLOCK = 4  # small blocks, so that v2 and v13 cross block borders on the small grids at hand
SIDE = 16  # one block per volume elsewhere, as block size only changes speed

GRID = "gr AS (SELECT vol, CAST(gz AS INT) AS z, CAST(gy AS INT) AS y, CAST(gx AS INT) AS x FROM (SELECT DISTINCT vol FROM vox), (SELECT unnest(range(7)) AS gz), (SELECT unnest(range(8)) AS gy), (SELECT unnest(range(8)) AS gx))"
FACES = "(VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) AS o(dz,dy,dx)"
FACES0 = "(VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) AS o(dz,dy,dx)"
IN = "z BETWEEN 0 AND 6 AND y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7"


def dilated(name: str, src: str, offs: str = FACES0) -> str:
    return f"{name} AS (SELECT DISTINCT vol, z, y, x FROM (SELECT vol, z + dz AS z, y + dy AS y, x + dx AS x FROM {src}, {offs}) WHERE {IN})"


def eroded(name: str, src: str, offs: str = FACES0, n: int = 7) -> str:
    return f"{name} AS (SELECT vol, z - dz AS z, y - dy AS y, x - dx AS x FROM {src}, {offs} GROUP BY 1, 2, 3, 4 HAVING count(*) = {n})"


SHEET = "sh AS (SELECT vol, z, y, x FROM vox WHERE label = 1)"


def sheet(t):
    return t.vox.where("label = 1").select(*HERE)


@query("v3_dilation", SHEET + ", " + dilated("d1", "sh") + ", " + dilated("d2", "d1") + " SELECT * FROM d2")
def v3(t):
    return V.dilate(sheet(t), BY, SHAPE, times=2)


@query("v3_erosion", "sh AS (SELECT vol, z, y, x FROM vox WHERE label <> 1), " + eroded("e1", "sh") + " SELECT * FROM e1")
def v3b(t):
    return V.erode(t.vox.where("label <> 1"), BY)


BALL = [o for o in V.ball(2)]
BALLSQL = "(VALUES " + ", ".join(str(o) for o in BALL) + ") AS o(dz,dy,dx)"


@query("v4_closing", SHEET + ", " + dilated("d1", "sh", BALLSQL) + ", " + eroded("c1", "d1", BALLSQL, len(BALL)) + " SELECT * FROM c1")
def v4(t):
    return V.close(sheet(t), BY, SHAPE, V.ball(2))


# the number of face steps between two cells is the sum of their coordinate differences
STEPS = "abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x)"


@query(
    "v9_contact_mask",
    SHEET + ", " + GRID + f""", rd AS (SELECT unnest([1, 2, 3, 5, 8, 12]) AS radius), sd AS (SELECT a.vol, a.z, a.y, a.x, min({STEPS}) AS d FROM gr a JOIN sh b ON a.vol = b.vol GROUP BY ALL),
 gp AS (SELECT a.vol, radius, a.z, a.y, a.x FROM sd a JOIN rd ON least(a.z, 6 - a.z, a.y, 7 - a.y, a.x, 7 - a.x) >= radius LEFT JOIN sd b ON b.vol = a.vol AND b.d > radius AND {STEPS} <= radius WHERE a.d > 0 GROUP BY ALL HAVING count(b.vol) = 0),
 ct AS (SELECT DISTINCT a.vol, radius, a.z, a.y, a.x FROM sh a JOIN gp b ON a.vol = b.vol AND {STEPS} <= radius)
 SELECT t.vol, CAST(rd.radius AS INT) AS radius, count(ct.vol) AS n_contact, round(count(ct.vol) / CAST(any_value(t.n) AS DOUBLE), 6) AS share
 FROM (SELECT vol, count(*) AS n FROM sh GROUP BY 1) t CROSS JOIN rd LEFT JOIN ct ON ct.vol = t.vol AND ct.radius = rd.radius GROUP BY 1, 2""",
)
def v9(t):
    return _rounded(V.contact_shares(sheet(t), BY, SHAPE, side=SIDE))


INTER = " , ".join(["em AS (SELECT vol, z, y, x FROM vox WHERE ct = 0)", dilated("de", "em"), "it AS (SELECT v.vol, v.z, v.y, v.x FROM vox v SEMI JOIN de USING (vol, z, y, x) WHERE v.ct <> 0)"])


def interface(t):
    return V.interface(t.vox, BY, SHAPE, F.col("ct") == 0).select(*HERE)


def nearest(name: str, src: str, dst: str) -> str:
    return f"{name} AS (SELECT a.vol, a.z, a.y, a.x, sqrt(min(power(a.z - b.z, 2) + power(a.y - b.y, 2) + power(a.x - b.x, 2))) AS d FROM {src} a JOIN {dst} b ON a.vol = b.vol GROUP BY 1, 2, 3, 4)"


@query("v1_distance", SHEET + ", pv AS (SELECT vol, z, y, x FROM vox), " + nearest("nd", "pv", "sh") + " SELECT vol, z, y, x, round(d, 6) AS distance FROM nd")
def v1(t):
    return _rounded(V.distance(t.vox.select(*HERE), sheet(t), BY, SHAPE))


@query("v1_bounded_distance", SHEET + ", pv AS (SELECT vol, z, y, x FROM vox), " + nearest("nd", "pv", "sh") + " SELECT vol, z, y, x, CASE WHEN d <= 2 THEN round(d, 6) END AS distance FROM nd")
def v1b(t):
    return _rounded(V.distance(t.vox.select(*HERE), sheet(t), BY, SHAPE, limit=2.0))


@query(
    "v8_scan_interface",
    INTER + ", rl AS (SELECT vol, z, y, x FROM vox WHERE pred AND ct <> 0), " + nearest("nd", "rl", "it")
    + " SELECT vol, (SELECT count(*) FROM it WHERE it.vol = nd.vol) AS interface_voxels, count(*) AS real_sheet, count(*) FILTER (WHERE d <= 1) AS near_boundary FROM nd GROUP BY 1",
)
def v8(t):
    it = cut_lineage(interface(t), "interface")
    real = t.vox.where("pred AND ct <> 0").select(*HERE)
    d = V.distance(real, it, BY, SHAPE).where("distance IS NOT NULL")
    near = d.groupBy("vol").agg(F.count("*").alias("real_sheet"), count_if(F.col("distance") <= 1).alias("near_boundary"))
    return it.groupBy("vol").agg(F.count("*").alias("interface_voxels")).join(near, "vol").select("vol", "interface_voxels", "real_sheet", "near_boundary")


@query(
    "p22_coverage_filter",
    INTER + """, rl AS (SELECT vol, z, y, x FROM vox WHERE pred AND ct <> 0), """ + nearest("nd", "rl", "it")
    + """, cv AS (SELECT vol, count(*) FILTER (WHERE ct = 0) / CAST(count(*) AS DOUBLE) AS empty, count(*) FILTER (WHERE pred AND ct = 0) AS phantom FROM vox GROUP BY 1), nb AS (SELECT vol, count(*) FILTER (WHERE d <= 1) AS near FROM nd GROUP BY 1)
 SELECT vol, round(empty, 6) AS empty, phantom, near FROM cv JOIN nb USING (vol) WHERE empty BETWEEN 0.1 AND 0.85 AND phantom > 0 AND near > 0""",
)
def p22(t):
    real = t.vox.where("pred AND ct <> 0").select(*HERE)
    near = V.distance(real, interface(t), BY, SHAPE).where("distance <= 1").groupBy("vol").agg(F.count("*").alias("near"))
    empty = F.col("ct") == 0
    cover = t.vox.groupBy("vol").agg(ratio(count_if(empty), F.count("*")).alias("empty"), count_if(F.col("pred") & empty).alias("phantom"))
    return _rounded(cover.join(near, "vol").where("empty BETWEEN 0.1 AND 0.85 AND phantom > 0"))


PHANTOM = "ph AS (SELECT vol, z, y, x FROM vox WHERE pred AND ct = 0), sc AS (SELECT vol, z, y, x FROM vox WHERE ct <> 0), " + nearest("nd", "ph", "sc")


def phantom_depth(t):
    return V.distance(t.vox.where("pred AND ct = 0").select(*HERE), t.vox.where("ct <> 0").select(*HERE), BY, SHAPE)


@query(
    "a22_depth_histogram",
    PHANTOM + " SELECT CASE WHEN d < 2 THEN '0-2' WHEN d < 4 THEN '2-4' WHEN d < 8 THEN '4-8' WHEN d < 16 THEN '8-16' ELSE '16-inf' END AS bin, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM nd) AS DOUBLE), 6) AS share FROM nd GROUP BY 1",
)
def a22(t):
    h = phantom_depth(t).groupBy(V.depth_bin(F.col("distance")).alias("bin")).agg(F.count("*").alias("n"))
    return _rounded(h.withColumn("share", ratio("n", h.agg(F.sum("n")).scalar())))


@query("a22_depth_histogram_compat", PHANTOM + " SELECT CASE WHEN d = 1 THEN '1-1' WHEN d = 2 THEN '2-2' WHEN d BETWEEN 3 AND 4 THEN '3-4' WHEN d BETWEEN 5 AND 8 THEN '5-8' END AS bin, count(*) AS n FROM nd WHERE d = 1 OR d = 2 OR d BETWEEN 3 AND 4 OR d BETWEEN 5 AND 8 GROUP BY 1")
def a22c(t):
    return phantom_depth(t).groupBy(V.depth_bin(F.col("distance"), compat=True).alias("bin")).agg(F.count("*").alias("n")).where("bin IS NOT NULL")


@query(
    "a24_enrichment_shells",
    SHEET + ", ns AS (SELECT vol, z, y, x, pred FROM vox WHERE label = 0), " + nearest("nd", "ns", "sh")
    + """, sl AS (SELECT nd.vol, CAST(ceil(d) AS INT) AS shell, pred FROM nd JOIN ns USING (vol, z, y, x) WHERE d <= 5), tt AS (SELECT vol, count(*) AS n_ns, count(*) FILTER (WHERE pred) AS n_fp FROM ns GROUP BY 1)
 SELECT vol, shell, count(*) AS n_shell, round((count(*) FILTER (WHERE pred) / CAST(any_value(n_fp) AS DOUBLE)) / (count(*) / CAST(any_value(n_ns) AS DOUBLE)), 6) AS enrichment FROM sl JOIN tt USING (vol) WHERE n_fp > 0 GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def a24(t):
    bg = t.vox.where("label = 0").select(*HERE, "pred")
    d = V.distance(bg, sheet(t), BY, SHAPE, limit=5.0).where("distance IS NOT NULL")
    shells = d.groupBy("vol", F.ceil("distance").cast("int").alias("shell")).agg(F.count("*").alias("n_shell"), count_if(F.col("pred")).alias("fp"))
    total = bg.groupBy("vol").agg(F.count("*").alias("n_ns"), count_if(F.col("pred")).alias("n_fp"))
    e = shells.join(total, "vol").where("n_fp > 0 AND n_shell >= 10")
    return e.select("vol", "shell", "n_shell", r6(ratio(ratio("fp", "n_fp"), ratio("n_shell", "n_ns"))).alias("enrichment"))


@query(
    "a24_margin_enrichment",
    """c AS (SELECT vol, count(*) AS n_ns, count(*) FILTER (WHERE pred) AS n_fp, count(*) FILTER (WHERE k % 5 < 2) AS n_margin, count(*) FILTER (WHERE pred AND k % 5 < 2) AS n_hit FROM vox WHERE label = 0 GROUP BY 1)
 SELECT v.vol, CASE WHEN coalesce(n_fp * n_ns * n_margin, 0) = 0 THEN 'degenerate' ELSE 'ok' END AS status, coalesce(n_fp, 0) AS n_fp, coalesce(n_margin, 0) AS n_margin,
   CASE WHEN n_fp * n_margin > 0 THEN round(n_hit / CAST(n_fp AS DOUBLE), 6) END AS fp_share_in_margin, CASE WHEN n_fp * n_margin > 0 THEN round(n_margin / CAST(n_ns AS DOUBLE), 6) END AS margin_share_of_nonsheet,
   CASE WHEN n_fp * n_margin > 0 THEN round((n_hit / CAST(n_fp AS DOUBLE)) / (n_margin / CAST(n_ns AS DOUBLE)), 6) END AS enrichment,
   CASE WHEN n_fp * n_margin > 0 THEN round(n_hit / CAST(n_margin AS DOUBLE), 6) END AS margin_hit_rate, CASE WHEN n_fp * n_margin > 0 THEN round((n_fp - n_hit) / greatest(CAST(n_ns - n_margin AS DOUBLE), 1), 6) END AS nonmargin_fp_rate
 FROM (SELECT DISTINCT vol FROM vox) v LEFT JOIN c USING (vol)""",
)
def a24m(t):
    return _rounded(S.margin_enrichment(t.vox, BY, F.col("pred"), (F.col("k") % 5 < 2) & (F.col("label") == 0)))


def comp_sql(name: str, src: str) -> str:
    """Reachability by smaller codes: enough to find each voxel's smallest reachable one."""
    return f"""{name}v AS (SELECT vol, z * 64 + y * 8 + x AS id, z, y, x FROM {src}), {name}e AS (SELECT a.vol, a.id AS a, b.id AS b FROM {name}v a, {FACES}, {name}v b WHERE b.vol = a.vol AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
 {name}r(vol, id, lab) AS (SELECT vol, id, id FROM {name}v UNION SELECT e.vol, e.b, r.lab FROM {name}r r JOIN {name}e e ON e.vol = r.vol AND e.a = r.id WHERE r.lab < e.b),
 {name}m AS (SELECT vol, id, min(lab) AS lab FROM {name}r GROUP BY 1, 2),
 {name} AS (SELECT v.vol, v.z, v.y, v.x, m.lab AS component FROM {name}v v JOIN {name}m m USING (vol, id))"""


def small_code(c):
    """The component's voxel code in the small grid's own numbering."""
    z, y, x = F.shiftright(c, 42), F.shiftright(c, 21).bitwiseAND(F.lit(2097151)), F.col(c).bitwiseAND(F.lit(2097151))
    return (z * 64 + y * 8 + x).cast("int")


def parts(t):
    return C.label_voxels(sheet(t), BY, SIDE)


@query("v2_components", SHEET + ", " + comp_sql("cc", "sh") + " SELECT * FROM cc")
def v2(t):
    return C.label_voxels(sheet(t), BY, BLOCK).withColumn("component", small_code("component"))


@query(
    "a26_component_outcomes",
    SHEET + ", " + comp_sql("cc", "sh")
    + """, sz AS (SELECT vol, component, count(*) AS size, count(*) FILTER (WHERE pred) AS found FROM cc JOIN vox USING (vol, z, y, x) GROUP BY 1, 2)
 SELECT vol, count(*) AS components, count(*) FILTER (WHERE size >= 3) AS scored_components, count(*) FILTER (WHERE size >= 3 AND found / CAST(size AS DOUBLE) < 0.1) AS lost, round(max(size) / CAST(sum(size) AS DOUBLE), 6) AS largest_share, count(*) FILTER (WHERE size > 1000) AS over_1k FROM sz GROUP BY 1""",
)
def a26(t):
    return _rounded(C.outcomes(parts(t), t.vox.where("pred"), BY, min_size=3))


@query(
    "v7_islands_fragments",
    SHEET + ", " + comp_sql("cc", "sh") + ", ps AS (SELECT vol, z, y, x FROM vox WHERE pred AND label <> 2), " + comp_sql("pc", "ps")
    + """, ir AS (SELECT p.vol, p.component, count(*) AS size, count(s.vol) AS n_s FROM pc p LEFT JOIN sh s USING (vol, z, y, x) GROUP BY 1, 2), isl AS (SELECT vol, CAST(sum(CASE WHEN n_s = 0 THEN size ELSE 0 END) AS DOUBLE) / sum(size) AS f FROM ir GROUP BY 1),
 ls AS (SELECT vol, component, count(*) AS size FROM cc GROUP BY 1, 2), fr AS (SELECT c.vol, c.component, greatest(count(DISTINCT p.component) - 1, 0) AS pieces FROM cc c JOIN ls ON ls.vol = c.vol AND ls.component = c.component AND size >= 5 LEFT JOIN pc p ON p.vol = c.vol AND p.z = c.z AND p.y = c.y AND p.x = c.x GROUP BY 1, 2)
 SELECT isl.vol, round(f, 6) AS island_fraction, m.measured, round(m.fr, 6) AS fragments FROM isl LEFT JOIN (SELECT vol, count(*) AS measured, avg(pieces) AS fr FROM fr GROUP BY 1) m USING (vol)""",
)
def v7(t):
    pred = C.label_voxels(t.vox.where("pred AND label <> 2").select(*HERE), BY, SIDE)
    isl = C.islands(pred, sheet(t), BY)
    frag = C.fragments(parts(t), pred, BY, min_size=5)
    return _rounded(isl.join(frag, "vol", "left"))


@query(
    "v6_cavity_fill",
    "pm AS (SELECT vol, z, y, x FROM vox WHERE p > 0.3), " + GRID + ", bg AS (SELECT * FROM gr ANTI JOIN pm USING (vol, z, y, x)), bd(vol, z, y, x) AS (SELECT vol, z, y, x FROM bg WHERE z IN (0, 6) OR y IN (0, 7) OR x IN (0, 7) UNION SELECT b.vol, b.z, b.y, b.x FROM bd JOIN "
    + FACES + " ON true JOIN bg b ON b.vol = bd.vol AND b.z = bd.z + dz AND b.y = bd.y + dy AND b.x = bd.x + dx), cv AS (SELECT * FROM bg ANTI JOIN bd USING (vol, z, y, x)) SELECT vol, count(*) AS n_cavity FROM cv GROUP BY 1",
)
def v6(t):
    return C.cavities(t.vox.where("p > 0.3"), t.vox, BY, SHAPE, SIDE).groupBy("vol").agg(F.count("*").alias("n_cavity"))


@query(
    "v6_hole_fraction",
    SHEET + ", pm AS (SELECT vol, z, y, x FROM vox WHERE p > 0.3), " + GRID + ", bg AS (SELECT * FROM gr ANTI JOIN pm USING (vol, z, y, x)), bd(vol, z, y, x) AS (SELECT vol, z, y, x FROM bg WHERE z IN (0, 6) OR y IN (0, 7) OR x IN (0, 7) UNION SELECT b.vol, b.z, b.y, b.x FROM bd JOIN "
    + FACES + " ON true JOIN bg b ON b.vol = bd.vol AND b.z = bd.z + dz AND b.y = bd.y + dy AND b.x = bd.x + dx), cv AS (SELECT * FROM bg ANTI JOIN bd USING (vol, z, y, x)) SELECT s.vol, round(count(cv.vol) / CAST(count(*) AS DOUBLE), 6) AS hole_frac FROM sh s LEFT JOIN cv USING (vol, z, y, x) GROUP BY 1",
)
def v6h(t):
    return _rounded(C.enclosed_misses(t.vox.where("p > 0.3"), sheet(t), BY, SHAPE, SIDE))


CLOSED = " , ".join(["bs AS (SELECT vol, z, y, x FROM vox WHERE p > 0.7)", dilated("d1", "bs"), eroded("cl", "d1")])


@query(
    "v5_close_and_trim",
    CLOSED + ", " + comp_sql("cc", "cl")
    + """, big AS (SELECT vol, component FROM cc GROUP BY 1, 2 HAVING count(*) >= 4), kp AS (SELECT vol, z, y, x FROM cc SEMI JOIN big USING (vol, component)),
 vv AS (SELECT v.vol, v.z, v.y, v.x, v.p, v.label, k.vol IS NOT NULL AS kept, CASE WHEN k.vol IS NOT NULL THEN greatest(v.p, 0.7::DOUBLE + 1e-6) ELSE 0 END AS score FROM vox v LEFT JOIN kp k ON k.vol = v.vol AND k.z = v.z AND k.y = v.y AND k.x = v.x),
 bu AS (SELECT vol, count(*) FILTER (WHERE p > 0.7) / greatest(CAST(count(*) AS DOUBLE), 1) AS budget, count(*) FILTER (WHERE kept) / greatest(CAST(count(*) AS DOUBLE), 1) AS extra FROM vv WHERE label <> 2 GROUP BY 1),
 ls AS (SELECT vol, list(score ORDER BY score) AS l FROM vv WHERE label <> 2 GROUP BY 1), qt AS (SELECT vol, budget, extra, l, (1 - budget) * (len(l) - 1) AS pos FROM bu JOIN ls USING (vol)),
 cu AS (SELECT vol, budget, extra, l[floor(pos)::INT + 1] + (l[ceil(pos)::INT + 1] - l[floor(pos)::INT + 1]) * (pos - floor(pos)) AS t2 FROM qt)
 SELECT vol, count(*) AS n_left FROM vv JOIN cu USING (vol) WHERE kept AND (extra <= budget OR score > t2) GROUP BY 1""",
)
def v5(t):
    v = t.vox.select(*HERE, "p", "label")
    return C.close_and_trim(v, BY, SHAPE, 0.7, V.FACES, 4, SIDE).groupBy("vol").agg(F.count("*").alias("n_left"))


@query(
    "v21_close_pairs",
    SHEET + ", " + comp_sql("cc", "sh")
    + """, sz AS (SELECT vol, component FROM cc GROUP BY 1, 2 HAVING count(*) >= 4), kk AS (SELECT * FROM cc SEMI JOIN sz USING (vol, component)),
 gp AS (SELECT a.vol, a.component AS a, b.component AS b, sqrt(min(power(a.z - b.z, 2) + power(a.y - b.y, 2) + power(a.x - b.x, 2))) AS d FROM kk a JOIN kk b ON a.vol = b.vol AND a.component < b.component GROUP BY 1, 2, 3)
 SELECT n.vol, n.components, count(gp.d) AS close_pairs, round(min(gp.d), 6) AS smallest_gap FROM (SELECT vol, count(*) AS components FROM sz GROUP BY 1) n LEFT JOIN gp ON gp.vol = n.vol AND gp.d <= 1.5 GROUP BY 1, 2""",
)
def v21(t):
    return _rounded(C.close_pairs(sheet(t), BY, near=1.5, min_size=4, block=SIDE))


@query(
    "a26_phantom_components",
    "pr AS (SELECT vol, z, y, x FROM vox WHERE pred), " + comp_sql("cc", "pr")
    + """, sz AS (SELECT vol, component, count(*) AS size, count(*) FILTER (WHERE ct = 0) AS n_e FROM cc JOIN vox USING (vol, z, y, x) GROUP BY 1, 2)
 SELECT vol, count(*) AS components, count(*) FILTER (WHERE n_e / CAST(size AS DOUBLE) >= 0.9) AS phantom_components, round(CAST(sum(CASE WHEN n_e / CAST(size AS DOUBLE) >= 0.9 THEN size ELSE 0 END) AS DOUBLE) / sum(size), 6) AS phantom_volume_share FROM sz GROUP BY 1""",
)
def a26b(t):
    p = C.label_voxels(t.vox.where("pred").select(*HERE), BY, SIDE)
    return _rounded(C.phantom_components(p, t.vox.where("ct = 0"), BY))


DENSE = GRID + ", dn AS (SELECT gr.vol, gr.z, gr.y, gr.x, coalesce(CAST(ct AS DOUBLE), 0) AS v FROM gr LEFT JOIN vox USING (vol, z, y, x))"


def smooth_sql(name: str, src: str, weights: list, expr: str = "v") -> str:
    """Three passes with mirrored borders."""
    w = "(VALUES " + ", ".join(f"({o}, {c!r}::DOUBLE)" for o, c in weights) + ") AS w(o, c)"
    mirror = lambda a, n: f"CASE WHEN s.{a} + o < 0 THEN -1 - (s.{a} + o) WHEN s.{a} + o > {n - 1} THEN {2 * n - 1} - (s.{a} + o) ELSE s.{a} + o END"
    out, last = [f"{name}0 AS (SELECT vol, z, y, x, {expr} AS v FROM {src})"], f"{name}0"
    for i, (a, n) in enumerate(zip("zyx", SHAPE), 1):
        keys = " AND ".join(f"q.{c} = " + (mirror(a, n) if c == a else f"s.{c}") for c in "zyx")
        out.append(f"{name}{i} AS (SELECT s.vol, s.z, s.y, s.x, sum(c * q.v) AS v FROM {last} s, {w}, {last} q WHERE q.vol = s.vol AND {keys} GROUP BY 1, 2, 3, 4)")
        last = f"{name}{i}"
    return ", ".join(out)


def dense(t):
    return cut_lineage(V.dense(t.vox, BY, SHAPE, "ct"), "dense")


@query("v11_gaussian", DENSE + ", " + smooth_sql("g", "dn", V.gaussian_weights(0.5)) + " SELECT vol, z, y, x, round(v, 6) AS ct FROM g3")
def v11(t):
    return _rounded(V.gaussian(dense(t), BY, SHAPE, 0.5, "ct"))


THIRD = [(-1, 1.0 / 3), (0, 1.0 / 3), (1, 1.0 / 3)]


@query("v10_box_statistics", DENSE + ", " + smooth_sql("g", "dn", THIRD) + ", " + smooth_sql("h", "dn", THIRD, "v * v") + " SELECT g3.vol, g3.z, g3.y, g3.x, round(g3.v, 5) AS local_mean, round(sqrt(greatest(h3.v - g3.v * g3.v, 0)), 4) AS local_std FROM g3 JOIN h3 USING (vol, z, y, x)")
def v10(t):
    b = V.box_statistics(dense(t), BY, SHAPE, "ct", 3)
    return b.select(*HERE, F.round("local_mean", 5).alias("local_mean"), F.round("local_std", 4).alias("local_std"))


GRAD = DENSE + ", gd AS (SELECT vol, z, y, x, " + ", ".join(
    f"(coalesce(lead(v) OVER w{a}, v) - coalesce(lag(v) OVER w{a}, v)) / CASE WHEN {a} IN (0, {n - 1}) THEN 1 ELSE 2 END AS g{a}" for a, n in zip("zyx", SHAPE)
) + " FROM dn WINDOW wz AS (PARTITION BY vol, y, x ORDER BY z), wy AS (PARTITION BY vol, z, x ORDER BY y), wx AS (PARTITION BY vol, z, y ORDER BY x))"


@query("v12_gradient", GRAD + " SELECT vol, z, y, x, round(gz, 6) AS gz, round(gy, 6) AS gy, round(gx, 6) AS gx FROM gd")
def v12(t):
    return _rounded(V.gradient(dense(t), BY, SHAPE, "ct"))


@query(
    "a29_structure_tensor",
    GRAD + """, nm AS (SELECT vol, gz / l AS nz, gy / l AS ny, gx / l AS nx FROM (SELECT *, sqrt(gz * gz + gy * gy + gx * gx) AS l FROM gd) WHERE l > 1e-3),
 tn AS (SELECT vol, count(*) AS n, avg(nz * nz) AS a, avg(ny * ny) AS b, avg(nx * nx) AS c, avg(nz * ny) AS d, avg(nz * nx) AS e, avg(ny * nx) AS f FROM nm GROUP BY 1),
 q AS (SELECT *, (a + b + c) / 3 AS q FROM tn), pp AS (SELECT *, sqrt((power(a - q, 2) + power(b - q, 2) + power(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
 rr AS (SELECT *, acos(least(greatest((((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (p * p * p)) / 2, -1), 1)) / 3 AS phi FROM pp)
 SELECT vol, n, round(q + 2 * p * cos(phi), 6) AS anisotropy, round(((q + 2 * p * cos(phi)) - (3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2.0943951023931953)))) / (3 * q), 6) AS flatness FROM rr""",
)
def a29(t):
    g = V.gradient(dense(t), BY, SHAPE, "ct")
    n = g.withColumn("_m", F.sqrt(F.col("gz") * F.col("gz") + F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx"))).where("_m > 1e-3")
    return _rounded(V.structure_tensor(n.select("vol", *[(F.col(f"g{a}") / F.col("_m")).alias(f"n{a}") for a in "zyx"]), BY))


@query(
    "v13_line_profile",
    DENSE + """, pt AS (SELECT vol, z, y, x FROM vox WHERE label = 1), tt AS (SELECT CAST(unnest(range(5)) AS INT) AS k), pl AS (SELECT pt.vol, pt.z, pt.y, pt.x, k, least(greatest(pt.x + (k - 2) * 0.5, 0), 7)::DOUBLE AS px FROM pt, tt)
 SELECT a.vol, a.z, a.y, a.x, k, round(l.v + (h.v - l.v) * (px - least(floor(px), 6)), 6) AS v FROM pl a JOIN dn l ON l.vol = a.vol AND l.z = a.z AND l.y = a.y AND l.x = least(floor(px), 6) JOIN dn h ON h.vol = a.vol AND h.z = a.z AND h.y = a.y AND h.x = least(floor(px), 6) + 1""",
)
def v13(t):
    p = PR.sample_profiles(t.vox, BY, SHAPE, "label = 1", half=1.0, step=0.5, smooth=False, direction=(0, 0, 1), side=BLOCK)
    return p.select(*HERE, F.posexplode("profile").alias("k", "v")).withColumn("v", r6("v"))


ROWS = DENSE + """, dl AS (SELECT gr.vol, gr.z, gr.y, gr.x, coalesce(label, 0) AS label FROM gr LEFT JOIN vox USING (vol, z, y, x)),
 ar AS (SELECT vol, y, x, list(v ORDER BY z) AS prof FROM dn GROUP BY 1, 2, 3)"""


def rows(t):
    """Profiles along z: the seven cells of each column (vol, y, x)."""
    d = V.dense(t.vox, BY, SHAPE, "ct").join(V.dense(t.vox, BY, SHAPE, "label").withColumnRenamed("label", "lab"), HERE)
    s = d.groupBy("vol", "y", "x").agg(F.sort_array(F.collect_list(F.struct("z", "ct", F.col("lab").cast("int").alias("lab")))).alias("s"))
    return s.select("vol", "y", "x", F.col("s.ct").alias("profile"), F.col("s.lab").alias("labels"))


@query(
    "w7_centre_run",
    ROWS + """, f AS (SELECT vol, y, x, bool_or(z = 3 AND label <> 2) AS mid, max(z) FILTER (WHERE z < 3 AND label = 2) AS l, min(z) FILTER (WHERE z > 3 AND label = 2) AS r FROM dl GROUP BY 1, 2, 3)
 SELECT vol, y, x, CASE WHEN mid AND l IS NOT NULL AND r IS NOT NULL THEN l + 1 END AS lo, CASE WHEN mid AND l IS NOT NULL AND r IS NOT NULL THEN r - 1 END AS hi FROM f""",
)
def w7(t):
    run = PR.centre_run(F.transform("labels", lambda v: v != 2))
    return rows(t).select("vol", "y", "x", run.alias("run")).select("vol", "y", "x", "run.lo", "run.hi")


@query(
    "w8_peak_refined",
    ROWS + """, pk AS (SELECT vol, y, x, prof, list_position(prof, list_max(prof)) AS k FROM ar), rf AS (SELECT *, prof[k - 1] AS y0, prof[k] AS y1, prof[k + 1] AS y2 FROM pk)
 SELECT vol, y, x, round(CASE WHEN k > 1 AND k < 7 THEN -3 + (k - 1) + least(greatest(CASE WHEN abs(y0 - 2 * y1 + y2) > 1e-9 THEN 0.5 * (y0 - y2) / (y0 - 2 * y1 + y2) ELSE 0 END, -1), 1) END, 6) AS "offset" FROM rf""",
)
def w8(t):
    return rows(t).select("vol", "y", "x", r6(PR.ridge_offset(F.col("profile"), 3.0, 1.0)).alias("offset"))


@query(
    "w10_second_difference",
    ROWS + """, dd AS (SELECT vol, y, x, prof, [prof[i] - 2 * prof[i + 1] + prof[i + 2] for i in range(1, 6)] AS d2 FROM ar), md AS (SELECT *, list_aggregate(d2, 'median') AS m FROM dd), q AS (SELECT *, list_aggregate([abs(v - m) for v in d2], 'median') AS mad FROM md)
 SELECT vol, y, x, round(greatest(1.4826::DOUBLE * mad / sqrt(6.0::DOUBLE), 1e-3), 6) AS noise, round((list_max(prof) - list_aggregate([prof[1], prof[7]], 'median')) / greatest(1.4826::DOUBLE * mad / sqrt(6.0::DOUBLE), 1e-3), 4) AS resolvability FROM q""",
)
def w10(t):
    p = F.col("profile")
    return rows(t).select("vol", "y", "x", r6(PR.second_difference_noise(p)).alias("noise"), F.round(PR.resolvability(p, half=3.0, shoulder=0.9, step=1.0), 4).alias("resolvability"))


def profiles(t, half=2.0, points="label = 1"):
    """Across-sheet profiles on whole volumes; written once, as several measures read them."""
    return cut_lineage(PR.sample_profiles(t.vox, BY, SHAPE, points, half=half, side=SIDE), "profiles")


@query("v12_across_sheet_normals")
def v12b(t):
    return profiles(t).select(*HERE, *[F.round(c, 4).alias(c) for c in ("nz", "ny", "nx")])


@query("v14_ridge_offset")
def v14(t):
    return _rounded(PR.offset_summary(profiles(t), BY, half=2.0, min_points=20))


@query("v15_sheet_contrast")
def v15(t):
    p = profiles(t, points="label <> 2").withColumn("_lab", F.get("labels", 8))
    noise = ST.noise_sigma(t.vox, BY, SHAPE, block=2)
    return _rounded(PR.contrast_by_volume(p.where("_lab = 1"), p.where("_lab = 0"), noise, BY, half=2.0))


@query("v16_resolvability")
def v16(t):
    p = profiles(t)
    r = quantiles(p.select("vol", PR.resolvability(F.col("profile"), half=2.0).alias("r")), "r", {"median_resolvability": 0.5}, BY)
    return r.select("vol", "n", F.round("median_resolvability", 4).alias("median_resolvability"))


@query("v17_label_placement")
def v17(t):
    return _rounded(PR.label_placement(profiles(t), BY, half=2.0, min_runs=5))


@query("v18_margin_relabel")
def v18(t):
    out = PR.relabel_margin(t.vox.select(*HERE, "label"), profiles(t), BY, SHAPE)
    return out.groupBy("vol", "label").agg(F.count("*").alias("n"))


@query("v19_label_thinning")
def v19(t):
    return _rounded(PR.thinning_stats(PR.thin_labels(profiles(t), BY, width=1.0), BY))


@query("v20_ridge_nms")
def v20(t):
    kept = cut_lineage(PR.suppress_non_maxima(t.vox, BY, SHAPE, side=SIDE).where("kept"), "kept")
    # a written table of voxels is a few MB of files and many rows: by its files alone it would be broadcast
    v = cut_lineage(t.vox.where("label <> 2").join(kept.hint("merge"), HERE, "left").withColumn("kept", F.coalesce("kept", F.lit(False))), "nms")
    s = F.col("label") == 1
    r = v.groupBy("vol").agg(ratio(count_if(s & F.col("kept")), count_if(s)).alias("recall"), ratio(count_if(s & F.col("kept")), count_if(F.col("kept"))).alias("precision"))
    best = PR.precision_at_recall(v, BY, r.select("vol", "recall"))
    return _rounded(r.join(best, "vol").withColumn("gain", F.col("precision") - F.col("best_precision")))


@query("a50_margin_classes")
def a50(t):
    m = PR.margin_classes(profiles(t), BY, min_margins=10)
    bim = F.col("frac_background").between(0.2, 0.8)
    return _rounded(m.withColumn("mixed", bim))


@query("v22_localisation_error")
def v22(t):
    p = cut_lineage(PR.sample_profiles(t.vox, BY, SHAPE, "pred", half=2.0, smooth=False, side=SIDE), "profiles")
    return _rounded(PR.localisation_error(p, BY, half=2.0, min_points=20))


SHEETGRID = GRID + ", dl AS (SELECT gr.vol, gr.z, gr.y, gr.x, coalesce(ct, 0) AS ct, coalesce(label = 1, false) AS s FROM gr LEFT JOIN vox USING (vol, z, y, x)), sh AS (SELECT * FROM dl WHERE s), bg AS (SELECT * FROM dl WHERE NOT s)"


@query(
    "v23_volume_descriptors",
    SHEETGRID + ", " + nearest("di", "sh", "bg") + ", " + nearest("dx", "bg", "sh") + ", " + comp_sql("cc", "sh") + ", dn AS (SELECT vol, z, y, x, s::INT::DOUBLE AS v FROM dl), " + smooth_sql("g", "dn", V.gaussian_weights(0.5))
    + ", " + GRAD[GRAD.index("gd AS"):].replace("FROM dn", "FROM g3")
    + """, th AS (SELECT vol, 2 * avg(d) AS thickness_mean, 2 * quantile_cont(d, 0.9) AS thickness_p90 FROM di GROUP BY 1), sg AS (SELECT vol, 2 * median(d) AS spacing_median, 2 * quantile_cont(d, 0.1) AS spacing_p10 FROM dx GROUP BY 1),
 ctr AS (SELECT vol, count(*) FILTER (WHERE s) AS n_sheet, avg(ct) FILTER (WHERE s) AS ms, avg(ct) FILTER (WHERE NOT s) AS mb, stddev_pop(ct) FILTER (WHERE NOT s) AS sb FROM dl GROUP BY 1),
 sz AS (SELECT vol, component, count(*) AS size FROM cc GROUP BY 1, 2), fr AS (SELECT vol, count(*) AS components, max(size) / CAST(sum(size) AS DOUBLE) AS lf, count(*) FILTER (WHERE size > 1000) AS o1k FROM sz GROUP BY 1),
 nm AS (SELECT vol, gz / l AS nz, gy / l AS ny, gx / l AS nx FROM (SELECT gd.*, sqrt(gz * gz + gy * gy + gx * gx) AS l FROM gd JOIN sh USING (vol, z, y, x)) WHERE l > 1e-3),
 tn AS (SELECT vol, count(*) AS n, avg(nz * nz) AS a, avg(ny * ny) AS b, avg(nx * nx) AS c, avg(nz * ny) AS d, avg(nz * nx) AS e, avg(ny * nx) AS f FROM nm GROUP BY 1 HAVING count(*) > 50),
 q AS (SELECT *, (a + b + c) / 3 AS q FROM tn), pp AS (SELECT *, sqrt((power(a - q, 2) + power(b - q, 2) + power(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
 rr AS (SELECT *, acos(least(greatest((((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (p * p * p)) / 2, -1), 1)) / 3 AS phi FROM pp)
 SELECT c.vol, round(n_sheet / 448.0::DOUBLE, 5) AS sheet_fraction, round(thickness_mean, 5) AS thickness_mean, round(thickness_p90, 5) AS thickness_p90, round(spacing_median, 5) AS spacing_median, round(spacing_p10, 5) AS spacing_p10,
  round(ms, 5) AS ct_sheet_mean, round(mb, 5) AS ct_bg_mean, round(sb, 5) AS ct_bg_std, round(coalesce((ms - mb) / nullif(sb, 0), 0), 5) AS contrast_sigma, components, round(lf, 5) AS largest_component_frac, o1k AS components_over_1k,
  round(q + 2 * p * cos(phi), 5) AS normal_anisotropy, round(((q + 2 * p * cos(phi)) - (3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2.0943951023931953)))) / (3 * q), 5) AS flatness, 'ok' AS status
 FROM ctr c JOIN th USING (vol) JOIN sg USING (vol) JOIN fr USING (vol) LEFT JOIN rr USING (vol) WHERE n_sheet >= 20""",
)
def v23(t):
    d = C.describe_volumes(t.vox, BY, SHAPE, sigma=0.5, min_sheet=20, block=SIDE)
    return d.select(*[F.round(c, 5).alias(c) if k == "double" else F.col(c) for c, k in d.dtypes])


@query("v24_half_max_width")
def v24(t):
    w = profiles(t).select("vol", PR.half_max_width(F.col("profile")).alias("w")).where("w IS NOT NULL")
    return _rounded(quantiles(w, "w", {"fwhm_median": 0.5}, BY).withColumn("unreliable", F.lit(True)))


@query(
    "v26_attenuated_sheet",
    GRID + ", dn AS (SELECT gr.vol, gr.z, gr.y, gr.x, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0 END AS v FROM gr LEFT JOIN vox USING (vol, z, y, x)), " + smooth_sql("g", "dn", V.gaussian_weights(1.0))
    + """, pk AS (SELECT vol, max(v) AS pk FROM g3 GROUP BY 1)
 SELECT vol, round(avg(least(greatest(ct / 255.0::DOUBLE * (1 - 0.3 * coalesce(g3.v / nullif(pk, 0), 0)), 0), 1)), 5) AS mean_after, count(*) AS n FROM vox JOIN g3 USING (vol, z, y, x) JOIN pk USING (vol) GROUP BY 1""",
)
def v26(t):
    v = t.vox.withColumn("ct", F.col("ct") / 255.0).select(*HERE, "ct", "label")
    a = PR.attenuate_sheet(v, BY, SHAPE, strength=0.3, sigma=1.0, side=SIDE)
    return a.groupBy("vol").agg(F.round(F.avg("ct"), 5).alias("mean_after"), F.count("*").alias("n"))


@query(
    "j5_voxel_aligned",
    "SELECT a.vol, count(*) AS n, count(*) FILTER (WHERE a.pred AND b.label = 1) AS both_n FROM vox a JOIN vox b USING (vol, z, y, x) GROUP BY 1",
)
def j5(t):
    """Two fields as packed blocks, joined block by block; stored voxels are one or more, so that absent ones don't count."""
    pred = B.pack_field(t.vox.select(*HERE, (F.col("pred").cast("int") + 1).alias("v")), BY, SHAPE, "v", BLOCK)
    lab = B.pack_field(t.vox.select(*HERE, (F.col("label") + 1).alias("v")), BY, SHAPE, "v", BLOCK)

    def counted(a, b):
        if a is None or b is None:
            return {"n": 0, "both_n": 0}
        return {"n": int(((a > 0) & (b > 0)).sum()), "both_n": int(((a == 2) & (b == 2)).sum())}

    blocks = B.per_block(B.join_fields(cut_lineage(pred, "pred"), cut_lineage(lab, "label"), BY), BY, "n BIGINT, both_n BIGINT", counted)
    return blocks.groupBy("vol").agg(F.sum("n").alias("n"), F.sum("both_n").alias("both_n"))


@query(
    "j5_prediction_over_empty",
    "SELECT vol, count(*) FILTER (WHERE pred) AS n_pred, count(*) FILTER (WHERE pred AND coalesce(ct, 0) = 0) AS n_pred_on_empty, 448 AS n_cells, 448 - count(*) FILTER (WHERE ct <> 0) AS n_empty FROM vox GROUP BY 1",
)
def j5c(t):
    pred = B.pack_field(t.vox.select(*HERE, F.col("pred").cast("int").alias("v")), BY, SHAPE, "v", 8)
    scan = B.pack_field(t.vox.select(*HERE, F.col("ct").alias("v")), BY, SHAPE, "v", 8)
    names = ["n_pred", "n_pred_on_empty", "n_cells", "n_empty"]

    def counted(p, c):
        return dict(zip(names, (int((p > 0).sum()), int(((p > 0) & (c == 0)).sum()), len(p), int((c == 0).sum()))))

    blocks = B.per_block(B.join_fields(cut_lineage(pred, "pred"), cut_lineage(scan, "scan"), BY), BY, ", ".join(f"{c} BIGINT" for c in names), counted)
    return blocks.groupBy("vol").agg(*[F.sum(c).alias(c) for c in names]).withColumn("n_cells", F.col("n_cells").cast("int"))


@query("p16_pyramid_join", "SELECT vol, z // 2 AS cz, count(*) AS n, CAST(sum(CASE WHEN coarse THEN ct ELSE 0 END) AS BIGINT) AS ct_on FROM (SELECT v.*, c.vol IS NOT NULL AS coarse FROM vox v LEFT JOIN (SELECT DISTINCT vol, z // 2 AS z, y // 2 AS y, x // 2 AS x FROM vox WHERE label = 1 AND z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0) c ON c.vol = v.vol AND c.z = v.z // 2 AND c.y = v.y // 2 AND c.x = v.x // 2) GROUP BY 1, 2")
def p16(t):
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    coarse = t.vox.where("label = 1 AND z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0").select("vol", *[half(a).alias(f"c{a}") for a in "zyx"], F.lit(True).alias("coarse"))
    fine = t.vox.withColumns({f"c{a}": half(a) for a in "zyx"}).join(coarse, ["vol", "cz", "cy", "cx"], "left")
    return fine.groupBy("vol", "cz").agg(F.count("*").alias("n"), F.sum(F.when(F.col("coarse"), F.col("ct")).otherwise(0)).alias("ct_on"))


@query(
    "v25_shift_contrast",
    """o AS (SELECT unnest(range(-2, 3)) AS s), m AS (SELECT vol, z, y, x FROM vox WHERE label = 1)
 SELECT CAST(s AS INT) AS shift, round(avg(ct) FILTER (WHERE mk) - avg(ct) FILTER (WHERE NOT mk), 6) AS contrast FROM (SELECT s, v.ct, m.vol IS NOT NULL AS mk FROM vox v CROSS JOIN o LEFT JOIN m ON m.vol = v.vol AND m.z = v.z AND m.y = v.y AND m.x = v.x + s) GROUP BY 1""",
)
def v25(t):
    from voxelmetry.operators.alignment import shift_contrasts

    return _rounded(shift_contrasts(t.vox, sheet(t), BY, {"z": 0, "y": 0, "x": 0}, "x", [-2, -1, 0, 1, 2]))


@query(
    "j19_alignment_search",
    """o AS (SELECT unnest(range(-2, 3)) AS d), dd AS (SELECT a.d AS dz, b.d AS dy, c.d AS dx FROM o a, o b, o c), m AS (SELECT vol, z, y, x FROM vox WHERE label = 1),
 dp AS (SELECT dz, dy, dx, count(*) AS n_on, sum(v.ct)::DOUBLE AS s_on FROM m, dd JOIN vox v ON v.vol = m.vol AND v.z = m.z - dz AND v.y = m.y - dy AND v.x = m.x - dx GROUP BY 1, 2, 3),
 tb AS (SELECT dz, dy, dx, s_on / n_on - ((SELECT sum(ct) FROM vox)::DOUBLE - s_on) / ((SELECT count(*) FROM vox) - n_on) AS c FROM dp),
 k1 AS (SELECT dz AS v, round(c, 9) AS c FROM tb WHERE dy = 0 AND dx = 0 ORDER BY round(c, 9) DESC, abs(dz), dz LIMIT 1), k2 AS (SELECT dy AS v, round(c, 9) AS c FROM tb WHERE dz = (SELECT v FROM k1) AND dx = 0 ORDER BY round(c, 9) DESC, abs(dy), dy LIMIT 1),
 k3 AS (SELECT dx AS v, round(c, 9) AS c FROM tb WHERE dz = (SELECT v FROM k1) AND dy = (SELECT v FROM k2) ORDER BY round(c, 9) DESC, abs(dx), dx LIMIT 1),
 k4 AS (SELECT dz AS v, round(c, 9) AS c FROM tb WHERE dy = (SELECT v FROM k2) AND dx = (SELECT v FROM k3) ORDER BY round(c, 9) DESC, abs(dz), dz LIMIT 1), k5 AS (SELECT dy AS v, round(c, 9) AS c FROM tb WHERE dz = (SELECT v FROM k4) AND dx = (SELECT v FROM k3) ORDER BY round(c, 9) DESC, abs(dy), dy LIMIT 1),
 k6 AS (SELECT dx AS v, round(c, 9) AS c FROM tb WHERE dz = (SELECT v FROM k4) AND dy = (SELECT v FROM k5) ORDER BY round(c, 9) DESC, abs(dx), dx LIMIT 1),
 st AS (SELECT 1 AS r, 'z' AS a, * FROM k1 UNION ALL SELECT 1, 'y', * FROM k2 UNION ALL SELECT 1, 'x', * FROM k3 UNION ALL SELECT 2, 'z', * FROM k4 UNION ALL SELECT 2, 'y', * FROM k5 UNION ALL SELECT 2, 'x', * FROM k6)
 SELECT r::INT AS round, a AS axis, v::INT AS shift, round(c, 6) AS contrast FROM st WHERE r = 1 OR EXISTS (SELECT 1 FROM st WHERE r = 1 AND v <> 0)""",
)
def j19(t):
    from voxelmetry.operators.alignment import search_alignment

    v = cut_lineage(t.vox.select(*HERE, "ct", "label"), "voxels")
    return _rounded(search_alignment(v, v.where("label = 1"), BY, reach=2, rounds=2))


@query(
    "a45_window_average",
    """w AS (SELECT vol, z, y, x, l1, unnest([0, 2, 4]) AS s FROM vox), c AS (SELECT vol, z, y, x, l1 + s AS l FROM w WHERE z >= s AND z < s + 4)
 SELECT vol, z, y, x, count(*) AS n, round(sum(l) / greatest(count(*), 1), 6) AS logit FROM c GROUP BY 1, 2, 3, 4""",
)
def a45(t):
    from voxelmetry.operators.alignment import average_windows

    s = F.array(*[F.lit(v) for v in (0, 2, 4)])
    w = t.vox.select(*HERE, "l1", F.explode(s).alias("s")).where((F.col("z") >= F.col("s")) & (F.col("z") < F.col("s") + 4))
    return _rounded(average_windows(w.withColumn("l", F.col("l1") + F.col("s")), HERE, "l"))


@query("j5_logit_scores", "SELECT vol, count(*) AS n, count(*) FILTER (WHERE 1 / (1 + exp(l0 - l1)) > 0.2 AND pred) AS both_n FROM vox GROUP BY 1")
def j5b(t):
    p = sigmoid_of_logits("l0", "l1")
    return t.vox.groupBy("vol").agg(F.count("*").alias("n"), count_if((p > S.THRESHOLD) & F.col("pred")).alias("both_n"))


@query("s5_chunk_scan", GRID + " SELECT gr.vol, gr.z, gr.y, gr.x, coalesce(CAST(ct AS DOUBLE), 0) AS value FROM gr LEFT JOIN vox USING (vol, z, y, x) WHERE gr.z BETWEEN 1 AND 4 AND gr.y BETWEEN 2 AND 6 AND gr.x >= 3")
def s5(t):
    """Every volume is written as a store of its own, chunk files and metadata, and a box of all of them is read back."""
    root = f"{checkpoint_root(t.spark)}/stores-{uuid.uuid4().hex}"
    write_store(B.pack_field(t.vox, BY, SHAPE, "ct", BLOCK), "vol", root)
    box = read_store(t.spark, root).where("z >= 1 AND z <= 4 AND y >= 2 AND y < 7 AND x > 2")
    return box.select(F.col("store").cast("long").alias("vol"), "z", "y", "x", "value")


@query("s5_chunks_of_box", "SELECT vol, count(*) AS chunks, sum(stored::INT)::BIGINT AS stored FROM (SELECT vol, cz, cy, count(v.z) > 0 AS stored FROM (SELECT DISTINCT vol FROM vox), (SELECT unnest([0, 1]) AS cz), (SELECT unnest([0, 1]) AS cy) LEFT JOIN (SELECT vol AS vv, z, y, x FROM vox) v ON v.vv = vol AND v.z // 4 = cz AND v.y // 4 = cy AND v.x // 4 = 0 GROUP BY 1, 2, 3) GROUP BY 1")
def s5c(t):
    root = f"{checkpoint_root(t.spark)}/stores-{uuid.uuid4().hex}"
    write_store(B.pack_field(t.vox, BY, SHAPE, "ct", BLOCK), "vol", root)
    chunks = read_store(t.spark, root, run=3).where("x = 0").select("store", "cz", "cy", "cx", "stored").distinct()
    return chunks.groupBy(F.col("store").cast("long").alias("vol")).agg(F.count("*").alias("chunks"), count_if(F.col("stored")).alias("stored"))
