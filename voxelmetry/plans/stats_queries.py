"""Queries on ranks, tests, arms, strata and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmetry.functions.expr import count_if, r6, ratio
from voxelmetry.operators import score as S
from voxelmetry.operators import stats as T
from voxelmetry.operators import strata as ST
from voxelmetry.operators.distribution import cumulative, medians, mid_ranks, quantiles
from voxelmetry.operators.volumes import block_census, shift_torus
from voxelmetry.plans.registry import query, uniform_sql
from voxelmetry.plans.score_queries import _rounded

FEATS = ["n_chars", "dense", "vowel", "stops"]
LONG = "lng AS (" + " UNION ALL ".join(f"SELECT item, slab, y, '{f}' AS field, round({f}, 9) AS v FROM feat" for f in FEATS) + ")"


def feat(t):
    return t.feat.select("item", "slab", "y", *[F.round(f, 9).alias(f) for f in FEATS])


def mwu_sql(src: str, value: str, flag: str, keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""rk AS (SELECT {k}{value} AS v, {flag} AS f, rank() OVER ({part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {k}{value}) - 1) / 2.0::DOUBLE AS r,
   count(*) OVER (PARTITION BY {k}{value}) AS c FROM {src}),
 mw AS (SELECT {k}count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n2, coalesce(sum(r) FILTER (WHERE f), 0) AS r1, CAST(sum(CAST(c AS DOUBLE) * c - 1) AS DOUBLE) AS tie FROM rk {group}),
 mz AS (SELECT {k}n1, n2, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, r1, tie FROM mw),
 mwu AS (SELECT {k}n1, n2, u, u / nullif(n1 * n2, 0)::DOUBLE AS auc, (u - n1 * n2 / 2.0::DOUBLE) / nullif(sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - tie / nullif((n1 + n2) * (n1 + n2 - 1.0::DOUBLE), 0))), 0) AS z FROM mz)"""


@query("a33_mann_whitney", LONG + ", " + mwu_sql("lng", "v", "y = 1", "field") + " SELECT field, n1, n2, u, round(auc, 6) AS auc, round(z, 6) AS z FROM mwu")
def a33(t):
    df = T.mann_whitney_features(feat(t).withColumn("bad", F.col("y") == 1), FEATS, "bad")
    return df.select("field", "n1", "n2", "u", r6("auc").alias("auc"), r6("z").alias("z"))


# erfc(x) = 1 - 2 / sqrt(pi) * sum of (-1)^n x^(2n+1) / (n! (2n+1)); beyond six sigma it is zero to six digits
ERFC = "(1 - 1.1283791670955126 * list_sum(list_transform(range(0, 120), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln({x}) - lgamma(n + 1)) / (2 * n + 1))))"


@query(
    "f7_normal_p",
    LONG + ", " + mwu_sql("lng", "v", "y = 1", "field")
    + f" SELECT field, round(z, 6) AS z, CASE WHEN abs(z) > 6 THEN 0 WHEN z = 0 THEN 1 ELSE round({ERFC.format(x='(abs(z) / sqrt(2))')}, 6) END AS p FROM mwu",
)
def f7(t):
    df = T.mann_whitney_features(feat(t).withColumn("bad", F.col("y") == 1), FEATS, "bad", with_p=True)
    return df.select("field", r6("z").alias("z"), r6("p").alias("p"))


@query("w4_mid_ranks", "SELECT volume_id, p, rank() OVER (PARTITION BY volume_id ORDER BY p) + (count(*) OVER (PARTITION BY volume_id, p) - 1) / 2.0::DOUBLE AS mid_rank FROM scored QUALIFY row_number() OVER (PARTITION BY volume_id, p ORDER BY label) = 1")
def w4(t):
    return mid_ranks(cumulative(t.scored, "p", ["volume_id"])).select("volume_id", "p", "mid_rank")


ARMS = """m AS (SELECT volume_id, avg(CASE WHEN arm = 'A' THEN recall END) AS ra, avg(CASE WHEN arm = 'B' THEN recall END) AS rb, avg(CASE WHEN arm = 'A' THEN loc_error END) AS la,
   avg(CASE WHEN arm = 'B' THEN loc_error END) AS lb FROM arms GROUP BY 1),
 pr AS (SELECT volume_id, 'recall' AS field, round(ra, 9) AS a, round(rb, 9) AS b FROM m WHERE ra IS NOT NULL AND rb IS NOT NULL UNION ALL SELECT volume_id, 'loc_error', round(la, 9), round(lb, 9) FROM m WHERE la IS NOT NULL AND lb IS NOT NULL)"""


def pairs(t):
    p = T.paired_arms(t.arms, "volume_id", "arm", ["recall", "loc_error"], "A", "B")
    p = p.withColumns({"a": F.round("a", 9), "b": F.round("b", 9)})
    return p.withColumn("d", F.round(F.col("b") - F.col("a"), 9))


@query("j13_paired_arms", ARMS + " SELECT volume_id, field, round(a, 6) AS a, round(b, 6) AS b FROM pr")
def j13(t):
    return pairs(t).select("volume_id", "field", r6("a").alias("a"), r6("b").alias("b"))


WILCOX = ARMS + """, d AS (SELECT field, round(b - a, 9) AS d FROM pr WHERE round(b - a, 9) <> 0),
 r AS (SELECT field, d, rank() OVER (PARTITION BY field ORDER BY abs(d)) + (count(*) OVER (PARTITION BY field, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY field, abs(d)) AS c FROM d),
 w AS (SELECT field, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS w_minus, CAST(sum(CAST(c AS DOUBLE) * c - 1) AS DOUBLE) AS tie FROM r GROUP BY 1)"""


@query("a34_wilcoxon", WILCOX + " SELECT field, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic, round((w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tie / 48), 6) AS z FROM w")
def a34(t):
    return T.wilcoxon(pairs(t), "d", ["field"]).withColumn("z", r6("z"))


@query(
    "a34_arm_verdict",
    WILCOX + """, md AS (SELECT field, median(a) AS ma, median(b) AS mb FROM pr GROUP BY 1)
 SELECT field, round(ma, 6) AS median_a, round(mb, 6) AS median_b, round(mb - ma, 6) AS delta, CASE WHEN field = 'recall' AND abs(mb - ma) < 0.01 THEN 'null_below_floor'
  WHEN abs((w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tie / 48)) > 1.959963985 THEN CASE WHEN mb > ma THEN 'b_better' ELSE 'b_worse' END ELSE 'not_significant' END AS verdict FROM md JOIN w USING (field)""",
)
def a34b(t):
    return _rounded(T.compare_arms(pairs(t), {"recall": 0.01}).select("field", "median_a", "median_b", "delta", "verdict"))


@query(
    "a28_seed_spread",
    """s AS (SELECT arm, seed, avg(recall) AS recall, avg(loc_error) AS loc_error FROM arms GROUP BY 1, 2),
 l AS (SELECT arm, 'recall' AS metric, recall AS v FROM s UNION ALL SELECT arm, 'loc_error', loc_error FROM s), g AS (SELECT arm, metric, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd, count(*) AS seeds FROM l GROUP BY 1, 2),
 j AS (SELECT g.arm, g.metric, g.seeds, b.mean AS base_mean, g.mean, g.mean - b.mean AS delta, greatest(g.sd, b.sd) AS spread FROM g JOIN g b ON b.arm = 'A' AND g.metric = b.metric WHERE g.arm <> 'A')
 SELECT arm, metric, seeds, round(base_mean, 6) AS base_mean, round(mean, 6) AS mean, round(delta, 6) AS delta, round(spread, 6) AS spread, CASE WHEN abs(delta) <= spread THEN 'not_demonstrated' WHEN delta > 0 THEN 'better' ELSE 'worse' END AS verdict,
  round(CASE WHEN base_mean < 1 THEN delta / (1 - base_mean) END, 6) AS headroom_gain FROM j""",
)
def a28(t):
    return _rounded(T.seed_spread(t.arms, "arm", "seed", ["recall", "loc_error"], "A"))


@query(
    "a28_arm_warnings",
    """s AS (SELECT arm, seed, avg(recall) AS recall, avg(loc_error) AS loc_error, avg(on_empty) AS on_empty FROM arms GROUP BY 1, 2), g AS (SELECT arm, avg(recall) AS r, avg(loc_error) AS l, avg(on_empty) AS e FROM s GROUP BY 1),
 j AS (SELECT g.arm, g.r - b.r AS dr, g.l - b.l AS dl, (g.r - b.r) / (1 - b.r) AS fg, greatest((g.l - b.l) / (1 - b.l), (g.e - b.e) / (1 - b.e)) AS og FROM g JOIN g b ON b.arm = 'A' WHERE g.arm <> 'A')
 SELECT arm, round(fg, 6) AS faint_gain, round(og, 6) AS other_gain, fg <= og AS not_selective, round(dr, 6) AS recall_delta, round(dl, 6) AS dice_delta, dr > 0 AND dl < 0 AS traded_precision FROM j""",
)
def a28w(t):
    """The three endpoints at hand stand in for the recall of dark, mid and bright sheet, and one of them for Dice."""
    spread = T.seed_spread(t.arms, "arm", "seed", ["recall", "loc_error", "on_empty"], "A")
    return _rounded(T.arm_warnings(spread, "arm", "recall", ["loc_error", "on_empty"], "recall", "loc_error"))


@query(
    "a30_pearson",
    LONG.replace("'n_chars' AS field", "'n_chars' AS field") + """, c AS (SELECT field, count(*) AS n, corr(y, v) AS r FROM lng GROUP BY 1 HAVING count(*) >= 20 AND stddev_pop(v) > 0)
 SELECT field, n, round(r, 6) AS r FROM c""",
)
def a30(t):
    return _rounded(T.pearson_table(feat(t), "y", FEATS))


@query(
    "a31_spearman",
    """r AS (SELECT volume_id, rank() OVER (PARTITION BY volume_id ORDER BY p) + (count(*) OVER (PARTITION BY volume_id, p) - 1) / 2.0::DOUBLE AS a,
   rank() OVER (PARTITION BY volume_id ORDER BY ct) + (count(*) OVER (PARTITION BY volume_id, ct) - 1) / 2.0::DOUBLE AS b FROM scored)
 SELECT volume_id, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""",
)
def a31(t):
    return _rounded(T.spearman(t.scored, "p", "ct", ["volume_id"]))


@query("a11_confound_medians", "g AS (SELECT CASE WHEN y = 1 THEN 'bad' ELSE 'good' END AS grp, * FROM (" + " UNION ALL ".join(f"SELECT y, '{f}' AS field, {f} AS v FROM feat" for f in FEATS) + ")) SELECT grp, field, count(*) AS n, round(median(v), 6) AS median FROM g GROUP BY 1, 2")
def a11(t):
    g = t.feat.withColumn("grp", F.when(F.col("y") == 1, "bad").otherwise("good"))
    return _rounded(medians(g, FEATS, ["grp"]))


@query(
    "w5_quantile_strata",
    """f AS (SELECT item, y = 1 AS bad, round(n_chars, 9) AS c, round(dense, 9) AS v FROM feat), e AS (SELECT quantile_cont(c, 0.2) AS e1, quantile_cont(c, 0.4) AS e2, quantile_cont(c, 0.6) AS e3, quantile_cont(c, 0.8) AS e4 FROM f),
 st AS (SELECT f.*, 1 + (c >= e1)::INT + (c >= e2)::INT + (c >= e3)::INT + (c >= e4)::INT AS stratum FROM f, e), """
    + mwu_sql("st", "v", "bad", "stratum")
    + """, md AS (SELECT stratum, nullif(count(*) FILTER (WHERE bad), 0) AS n_in, median(v) FILTER (WHERE bad) AS median_in, nullif(count(*) FILTER (WHERE NOT bad), 0) AS n_out, median(v) FILTER (WHERE NOT bad) AS median_out FROM st GROUP BY 1)
 SELECT CAST(stratum AS INT) AS stratum, n_in, round(median_in, 6) AS median_in, n_out, round(median_out, 6) AS median_out, round(z, 6) AS z, round(median_out - median_in, 6) AS gap FROM md JOIN mwu USING (stratum)""",
)
def w5(t):
    return _rounded(ST.matched_strata(feat(t), "n_chars", "dense", F.col("y") == 1))


@query(
    "a25_paired_contrast",
    """l AS (SELECT vol, NOT pred AS missed, 'ct' AS field, CAST(ct AS DOUBLE) AS v FROM vox WHERE label = 1 UNION ALL SELECT vol, NOT pred, 'p', p FROM vox WHERE label = 1 UNION ALL SELECT vol, NOT pred, 'l1', l1 FROM vox WHERE label = 1),
 g AS (SELECT vol, field, median(v) FILTER (WHERE missed) AS m, median(v) FILTER (WHERE NOT missed) AS f, stddev_pop(v) FILTER (WHERE NOT missed) AS sd FROM l GROUP BY 1, 2)
 SELECT vol, field, round(m, 6) AS missed_median, round(f, 6) AS found_median, round((m - f) / (sd + 1e-6), 6) AS delta_z FROM g WHERE m IS NOT NULL AND f IS NOT NULL""",
)
def a25(t):
    return _rounded(ST.paired_contrast(t.vox.where("label = 1"), ["vol"], ["ct", "p", "l1"], ~F.col("pred")))


@query(
    "a27_tercile_recall",
    """s AS (SELECT vol, ct, pred FROM vox WHERE label = 1), q AS (SELECT vol, quantile_cont(ct, 0.333) AS lo, quantile_cont(ct, 0.667) AS hi FROM s GROUP BY 1 HAVING count(*) >= 30)
 SELECT CASE WHEN ct <= lo THEN 'dark' WHEN ct <= hi THEN 'mid' ELSE 'bright' END AS tercile, count(*) FILTER (WHERE pred) AS hits, count(*) AS n, round(count(*) FILTER (WHERE pred) / CAST(count(*) AS DOUBLE), 6) AS recall FROM s JOIN q USING (vol) GROUP BY 1""",
)
def a27(t):
    return _rounded(ST.tercile_recall(t.vox.where("label = 1"), ["vol"], "ct", F.col("pred")))


LIFT = """h AS (SELECT {k} AS vol, ct, {hot} AS hot FROM {src}), q AS (SELECT vol, quantile_cont(ct, 0.9) AS hi, quantile_cont(ct, 0.5) AS lo FROM h GROUP BY 1),
 g AS (SELECT vol, count(*) FILTER (WHERE ct >= hi AND hot) / CAST(nullif(count(*) FILTER (WHERE ct >= hi), 0) AS DOUBLE) AS p_dense, count(*) FILTER (WHERE ct <= lo AND hot) / CAST(nullif(count(*) FILTER (WHERE ct <= lo), 0) AS DOUBLE) AS p_sparse,
  coalesce(count(*) FILTER (WHERE ct >= hi AND hot) / CAST(nullif(count(*) FILTER (WHERE hot), 0) AS DOUBLE), 0) AS hot_in_dense FROM h JOIN q USING (vol) GROUP BY 1)
 SELECT vol, round(p_dense, 6) AS p_dense, round(p_sparse, 6) AS p_sparse, round(p_dense / nullif(p_sparse, 0), 6) AS dense_lift, round(hot_in_dense, 6) AS hot_in_dense FROM g"""


@query("a20_dense_lift", LIFT.format(k="volume_id", hot="p > 0.5", src="scored"))
def a20(t):
    return _rounded(ST.dense_lift(t.scored.withColumnRenamed("volume_id", "vol"), ["vol"], F.col("p") > 0.5))


SHIFTED = """sh AS (SELECT a.vol, a.ct, coalesce(b.p > 0.5, false) AS hot FROM vox a LEFT JOIN vox b ON a.vol = b.vol AND b.z = (a.z + 7 - 2) % 7 AND b.y = (a.y + 8 - 2) % 8 AND b.x = (a.x + 8 - 2) % 8), """


@query("p17_shifted_null", SHIFTED + LIFT.format(k="vol", hot="hot", src="sh"))
def p17(t):
    hot = shift_torus(t.vox.where("p > 0.5").select("vol", "z", "y", "x"), (7, 8, 8), (2, 2, 2)).withColumn("hot", F.lit(True))
    v = t.vox.select("vol", "z", "y", "x", "ct").join(hot, ["vol", "z", "y", "x"], "left")
    return _rounded(ST.dense_lift(v, ["vol"], F.coalesce("hot", F.lit(False))))


@query(
    "a21_decile_profile",
    "e AS (SELECT volume_id, " + ", ".join(f"quantile_cont(ct, {i / 10}) AS e{i}" for i in range(1, 10)) + """ FROM scored GROUP BY 1),
 b AS (SELECT s.*, 1 + """ + " + ".join(f"(ct >= e{i})::INT" for i in range(1, 10)) + """ AS bin FROM scored s JOIN e USING (volume_id))
 SELECT volume_id, CAST(bin AS INT) AS bin, count(*) AS n_voxels, min(ct) AS lo, max(ct) AS hi, round(avg(p) + 1e-9, 6) AS mean_p, round(count(*) FILTER (WHERE p > 0.5) / CAST(count(*) AS DOUBLE), 6) AS hot_share FROM b GROUP BY 1, 2""",
)
def a21(t):
    prof = ST.quantile_profile(t.scored, ["volume_id"], "ct", 10, "p", F.col("p") > 0.5)
    return _rounded(prof.withColumn("mean_p", F.col("mean_p") + 1e-9))  # p has two decimals: keeps halves off the rounding edge


DIS = "(p > 0.2) <> pred"


@query(
    "a23_axis_deciles",
    f"""a AS (SELECT vol, ({DIS}) AS f, 'z' AS axis, CAST(ceil(10 * (z + 1) / 7.0::DOUBLE) - 1 AS INT) AS decile FROM vox UNION ALL SELECT vol, ({DIS}), 'y', CAST(ceil(10 * (y + 1) / 8.0::DOUBLE) - 1 AS INT) FROM vox
  UNION ALL SELECT vol, ({DIS}), 'x', CAST(ceil(10 * (x + 1) / 8.0::DOUBLE) - 1 AS INT) FROM vox) SELECT vol, axis, decile, count(*) AS n, round(count(*) FILTER (WHERE f) / CAST(count(*) AS DOUBLE), 6) AS share FROM a GROUP BY 1, 2, 3""",
)
def a23(t):
    return _rounded(ST.axis_deciles(t.vox, ["vol"], (7, 8, 8), (F.col("p") > 0.2) != F.col("pred")))


@query(
    "a23_face_distance",
    f"SELECT vol, CAST((d >= 1)::INT + (d >= 2)::INT + (d >= 3)::INT AS INT) AS ring, count(*) AS n, round(count(*) FILTER (WHERE f) / CAST(count(*) AS DOUBLE), 6) AS share FROM (SELECT vol, ({DIS}) AS f, least(z, 6 - z, y, 7 - y, x, 7 - x) AS d FROM vox) GROUP BY 1, 2",
)
def a23b(t):
    return _rounded(ST.face_distance(t.vox, ["vol"], (7, 8, 8), (F.col("p") > 0.2) != F.col("pred"), [1, 2, 3]))


@query(
    "a23_stride_phase",
    f"""a AS (SELECT vol, ({DIS}) AS f, 'z' AS axis, (z + 3) % 4 AS phase FROM vox UNION ALL SELECT vol, ({DIS}), 'y', (y + 5) % 4 FROM vox UNION ALL SELECT vol, ({DIS}), 'x', (x + 7) % 4 FROM vox)
 SELECT vol, axis, CAST(phase AS INT) AS phase, count(*) AS n, round(count(*) FILTER (WHERE f) / CAST(count(*) AS DOUBLE), 6) AS share FROM a GROUP BY 1, 2, 3""",
)
def a23c(t):
    return _rounded(ST.stride_phase(t.vox, ["vol"], 4, (3, 5, 7), (F.col("p") > 0.2) != F.col("pred"), bins=4))


@query(
    "a23_intensity_quintiles",
    f"""e AS (SELECT vol, quantile_cont(ct, 0.2) AS e1, quantile_cont(ct, 0.4) AS e2, quantile_cont(ct, 0.6) AS e3, quantile_cont(ct, 0.8) AS e4 FROM vox GROUP BY 1),
 b AS (SELECT vol, p, ct, ({DIS}) AS f, 1 + (ct >= e1)::INT + (ct >= e2)::INT + (ct >= e3)::INT + (ct >= e4)::INT AS bin FROM vox JOIN e USING (vol))
 SELECT vol, CAST(bin AS INT) AS bin, count(*) AS n_voxels, min(ct) AS lo, max(ct) AS hi, round(avg(p) + 1e-9, 6) AS mean_p, round(count(*) FILTER (WHERE f) / CAST(count(*) AS DOUBLE), 6) AS hot_share FROM b GROUP BY 1, 2""",
)
def a23d(t):
    prof = ST.quantile_profile(t.vox, ["vol"], "ct", 5, "p", (F.col("p") > 0.2) != F.col("pred"))
    return _rounded(prof.withColumn("mean_p", F.col("mean_p") + 1e-9))


@query("a41_noise_sigma", "SELECT vol, round(greatest(quantile_cont(sd, 0.1), 1e-3), 6) AS sigma FROM (SELECT vol, z // 2, y // 2, x // 2, stddev_pop(ct) AS sd FROM vox WHERE z < 6 GROUP BY ALL) GROUP BY 1")
def a41(t):
    return _rounded(ST.noise_sigma(t.vox, ["vol"], (7, 8, 8), block=2))


@query(
    "a41_noise_mad",
    """d AS (SELECT a.vol, b.ct - a.ct AS d FROM vox a JOIN vox b ON a.vol = b.vol AND b.z = a.z + 1 AND a.y = b.y AND a.x = b.x), m AS (SELECT vol, median(d) AS m FROM d GROUP BY 1)
 SELECT vol, round(1.4826::DOUBLE * median(abs(d - m)) / sqrt(2.0::DOUBLE), 6) AS sigma FROM d JOIN m USING (vol) GROUP BY 1""",
)
def a41b(t):
    return _rounded(ST.noise_sigma_mad(t.vox, ["vol"]))


@query(
    "a42_otsu",
    """h AS (SELECT vol, ct, count(*) AS n FROM vox GROUP BY 1, 2), s AS (SELECT vol, ct, sum(n) OVER w AS w0, sum(n * ct) OVER w AS s0, sum(n) OVER (PARTITION BY vol) AS nn, sum(n * ct) OVER (PARTITION BY vol) AS ss FROM h WINDOW w AS (PARTITION BY vol ORDER BY ct)),
 v AS (SELECT vol, ct, round(CAST(w0 AS DOUBLE) * (nn - w0) * power(CAST(s0 AS DOUBLE) / w0 - CAST(ss - s0 AS DOUBLE) / (nn - w0), 2), 3) AS var FROM s WHERE w0 < nn)
 SELECT vol, ct AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY vol ORDER BY var DESC, ct) = 1""",
)
def a42(t):
    return ST.otsu(t.vox, ["vol"])


CENSUS = """c AS (SELECT vol, CAST(z // 4 AS INT) AS bz, CAST(y // 4 AS INT) AS by_, CAST(x // 4 AS INT) AS bx, count(*) AS n, count(*) FILTER (WHERE ct = 0) AS n_empty, count(*) FILTER (WHERE pred) AS sheet,
  count(*) FILTER (WHERE pred AND ct = 0) AS phantom FROM vox GROUP BY ALL)"""


@query("a17_block_census", CENSUS + " SELECT vol, count(*) FILTER (WHERE sheet > 0) AS blocks, CAST(sum(sheet) AS BIGINT) AS sheet, CAST(sum(phantom) AS BIGINT) AS phantom, round(CAST(sum(phantom) AS DOUBLE) / greatest(sum(sheet), 1), 6) AS p_empty, count(*) FILTER (WHERE phantom > 0) AS affected FROM c GROUP BY 1")
def a17(t):
    c = block_census(t.vox, ["vol"], 4)
    return c.groupBy("vol").agg(
        count_if(F.col("sheet") > 0).alias("blocks"), F.sum("sheet").alias("sheet"), F.sum("phantom").alias("phantom"),
        r6(F.sum("phantom") / F.greatest(F.sum("sheet"), F.lit(1)).cast("double")).alias("p_empty"), count_if(F.col("phantom") > 0).alias("affected"),
    )


@query("a18_phantom_blocks", CENSUS + " SELECT vol, bz, by_, bx, n, round(1 - CAST(n_empty AS DOUBLE) / n, 6) AS coverage, sheet, phantom, round(phantom / greatest(CAST(sheet AS DOUBLE), 1), 6) AS phantom_fraction, n_empty > 0 AND n_empty < n AS mixed FROM c WHERE phantom > 0")
def a18(t):
    c = block_census(t.vox, ["vol"], 4).where("phantom > 0").withColumnRenamed("by", "by_")
    return _rounded(c.select("vol", "bz", "by_", "bx", "n", "coverage", "sheet", "phantom", "phantom_fraction", "mixed"))


@query("p15_phantom_masks", "SELECT vol, count(*) FILTER (WHERE ct = 0) AS empty, count(*) FILTER (WHERE pred AND ct = 0) AS phantom, count(*) FILTER (WHERE pred AND ct <> 0) AS real_n FROM vox GROUP BY 1")
def p15(t):
    empty = F.col("ct") == 0
    return t.vox.groupBy("vol").agg(count_if(empty).alias("empty"), count_if(F.col("pred") & empty).alias("phantom"), count_if(F.col("pred") & ~empty).alias("real_n"))


PHANTOM_CUTS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7]
A19 = f"""x AS (SELECT volume_id % 3 AS arm, p, ct FROM scored), c AS (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in PHANTOM_CUTS)}]) AS cut),
 g AS (SELECT arm, cut, count(*) AS n, count(*) FILTER (WHERE ct = 0) AS n_empty, count(*) FILTER (WHERE p > cut) AS sheet, count(*) FILTER (WHERE p > cut AND ct = 0) AS phantom FROM x, c GROUP BY 1, 2)"""


@query(
    "a19_phantom_thresholds",
    A19 + """ SELECT g.arm, g.cut, g.sheet, g.phantom, g.sheet - g.phantom AS real, round(g.phantom / CAST(g.n AS DOUBLE), 6) AS frac_of_region, round(coalesce(g.phantom / CAST(nullif(g.sheet, 0) AS DOUBLE), 0), 6) AS frac_of_sheet,
  round(coalesce((g.sheet - g.phantom) / CAST(nullif(g.n - g.n_empty, 0) AS DOUBLE), 0), 6) AS frac_of_scanned, round(g.phantom / CAST(nullif(b.phantom, 0) AS DOUBLE), 6) AS vs_base FROM g JOIN g b ON b.arm = 0 AND b.cut = g.cut""",
)
def a19(t):
    rows = S.by_thresholds(t.scored.withColumn("arm", F.col("volume_id") % 3), ["arm"], PHANTOM_CUTS, F.col("p"))
    base = rows.where("arm = 0").select("cut", F.col("phantom").alias("_base"))
    return _rounded(rows.join(base, "cut").withColumn("vs_base", ratio("phantom", "_base")).drop("n", "n_empty", "_base"))


RANK = """sc AS (SELECT item, slab, y, round(dense, 9) AS score FROM feat),
 rk AS (SELECT *, row_number() OVER (PARTITION BY slab ORDER BY score DESC, item) AS rank, count(*) OVER (PARTITION BY slab) AS n_in_group FROM sc)"""


def ranked(t):
    sc = t.feat.select("item", "slab", "y", F.round("dense", 9).alias("score"))
    return T.rank_rows(sc, ["slab"], [F.desc("score"), F.asc("item")])


@query("w1_rank_in_slab", RANK + " SELECT item, slab, rank, n_in_group FROM rk")
def w1(t):
    return ranked(t).select("item", "slab", "rank", "n_in_group")


@query("w2_budget_flag", RANK + " SELECT item, slab, rank <= greatest(1, round_even(0.1::DOUBLE * n_in_group, 0)) AS selected FROM rk")
def w2(t):
    return ranked(t).select("item", "slab", T.selected_within(0.1).alias("selected"))


def lift_sql(budgets: str) -> str:
    return RANK + f""", bd AS (SELECT unnest({budgets}) AS budget), k AS (SELECT DISTINCT slab, n_in_group AS n, budget, CAST(greatest(1, round_even(budget * n_in_group, 0)) AS BIGINT) AS k FROM rk, bd),
 lf AS (SELECT k.slab, k.budget, k.n, k.k, CAST(sum(y) AS BIGINT) AS n_bad, CAST(sum(CASE WHEN rank <= k.k THEN y ELSE 0 END) AS BIGINT) AS found, avg(score) AS mean_score FROM rk JOIN k ON rk.slab = k.slab GROUP BY ALL),
 lift AS (SELECT *, found / CAST(k AS DOUBLE) / greatest(n_bad / CAST(n AS DOUBLE), 1e-9) AS lift FROM lf)"""


@query("w3_lift_at_k", lift_sql("[0.1::DOUBLE, 0.2::DOUBLE]") + " SELECT slab, budget, n, k, n_bad, found, round(lift, 6) AS lift FROM lift")
def w3(t):
    return _rounded(T.lift_at(ranked(t), ["slab"], "y", [0.1, 0.2]))


@query(
    "a35_slab_summary",
    lift_sql("[0.1::DOUBLE]") + """ SELECT count(*) AS n_slabs, round(avg(lift), 6) AS mean, round(sum(lift * n) / sum(n), 6) AS weighted, round(min(lift), 6) AS min, round(max(lift), 6) AS max, round(stddev_samp(lift) / sqrt(count(*)), 6) AS sem,
  count(*) FILTER (WHERE lift >= 2) AS n_at_floor, round(corr(mean_score, n_bad / CAST(n AS DOUBLE)), 6) AS corr_score_rate, round(median(lift), 6) AS median,
  round(avg(lift) - 1.96::DOUBLE * stddev_samp(lift) / sqrt(count(*)), 6) AS ci_lo, round(avg(lift) + 1.96::DOUBLE * stddev_samp(lift) / sqrt(count(*)), 6) AS ci_hi FROM lift WHERE n_bad > 0""",
)
def a35(t):
    r = ranked(t)
    lifts = T.lift_at(r, ["slab"], "y", [0.1]).join(r.groupBy("slab").agg(F.avg("score").alias("mean_score")), "slab")
    return _rounded(T.slab_lift_summary(lifts))


@query(
    "a36_lift_curve",
    lift_sql("[" + ", ".join(f"{b / 100}::DOUBLE" for b in range(1, 51)) + "]")
    + " SELECT budget, round(CAST(sum(k) AS DOUBLE) / sum(n), 6) AS selected_fraction, round(avg(lift), 6) AS mean_lift, round(sum(lift * n) / sum(n), 6) AS weighted_lift, round(CAST(sum(found) AS DOUBLE) / sum(n_bad), 6) AS bad_recall, round(median(lift), 6) AS median_lift FROM lift GROUP BY 1",
)
def a36(t):
    return _rounded(T.lift_curve(T.lift_at(ranked(t), ["slab"], "y", [b / 100 for b in range(1, 51)])))


@query("a37_pooled_ratio", "SELECT round(sum(CAST(n2 AS DOUBLE) / n * n) / sum(n), 6) AS pooled FROM (SELECT volume_id, count(*) AS n, count(*) FILTER (WHERE p > 0.5) AS n2 FROM scored WHERE label = 1 GROUP BY 1)")
def a37(t):
    per = t.scored.where("label = 1").groupBy("volume_id").agg(F.count("*").alias("n"), ratio(count_if(F.col("p") > 0.5), F.count("*")).alias("f"))
    return per.agg(r6(F.sum(F.col("f") * F.col("n")) / F.sum("n")).alias("pooled"))


@query(
    "a32_two_peaks",
    """b AS (SELECT kind, least(CAST(floor(value / 0.5) AS INT), 49) AS bin, count(*) AS n FROM records WHERE value >= 0 AND value <= 25 GROUP BY 1, 2),
 h AS (SELECT kd.kind, i AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT kind FROM b) kd CROSS JOIN (SELECT CAST(unnest(range(50)) AS INT) AS i) x LEFT JOIN b ON b.kind = kd.kind AND b.bin = x.i),
 p1 AS (SELECT kind, bin, n FROM h QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, bin) = 1),
 p2 AS (SELECT h.kind, h.bin, h.n FROM h JOIN p1 USING (kind) WHERE abs(h.bin - p1.bin) * 0.5 >= 4 QUALIFY row_number() OVER (PARTITION BY h.kind ORDER BY h.n DESC, h.bin) = 1),
 d AS (SELECT h.kind, min(h.n) AS dip, CAST(sum(h.n) AS BIGINT) AS x FROM h JOIN p1 ON h.kind = p1.kind JOIN p2 ON h.kind = p2.kind WHERE h.bin BETWEEN least(p1.bin, p2.bin) AND greatest(p1.bin, p2.bin) GROUP BY 1),
 t AS (SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1)
 SELECT p1.kind, t.n, (p1.bin + 0.5::DOUBLE) * 0.5 AS peak, (greatest(p1.bin, p2.bin) + 0.5::DOUBLE) * 0.5 AS upper_peak, d.dip, least(p1.n, p2.n) AS smaller, d.dip < 0.6 * least(p1.n, p2.n) AS bimodal, (greatest(p1.bin, p2.bin) + 0.5) * 0.5 >= 3 AS upper_ok
 FROM p1 JOIN p2 USING (kind) JOIN d USING (kind) JOIN t USING (kind)""",
)
def a32(t):
    return T.two_peaks(t.records, "value", ["kind"])


@query("w6_fold_standardised", "SELECT a.slab, round(avg(b.dense), 6) AS mu, round(stddev_pop(b.dense), 6) AS sd, count(*) AS n FROM (SELECT DISTINCT slab FROM feat) a JOIN feat b ON a.slab <> b.slab GROUP BY 1")
def w6(t):
    from voxelmetry.operators.learn import fold_moments

    m = fold_moments(t.feat, "slab", ["dense"])
    return _rounded(m.select("slab", F.col("mu.dense").alias("mu"), F.col("sd.dense").alias("sd"), "n"))


@query("f16_finite", "SELECT volume_id, count(*) AS n, count(v) AS n_finite, round(avg(v), 6) AS mean FROM (SELECT volume_id, CASE WHEN label <> 2 THEN p END AS v FROM scored) GROUP BY 1")
def f16(t):
    nan = F.lit(float("nan"))
    v = F.when(F.col("label") == 2, nan).otherwise(F.col("p"))
    finite = F.when(~F.isnan(v), v)
    return t.scored.groupBy("volume_id").agg(F.count("*").alias("n"), F.count(finite).alias("n_finite"), r6(F.avg(finite)).alias("mean"))


@query("f8_half_even", "SELECT l_linenumber, l_quantity, round_even(l_quantity / 2, 0) AS half, round_even(l_discount * 10, 1) AS tenth FROM lineitem")
def f8(t):
    return t.lineitem.select("l_linenumber", "l_quantity", F.bround(F.col("l_quantity") / 2, 0).alias("half"), F.bround(F.col("l_discount") * 10, 1).alias("tenth"))


@query("f5_elementary", "SELECT l_linenumber, round(ln(1 + l_quantity), 6) AS a, round(sqrt(l_quantity), 6) AS b, round(exp(-l_tax), 6) AS c, least(greatest(l_quantity, 10), 40) AS d, CAST(ceil(l_quantity / 7) AS BIGINT) AS e, (l_linenumber - 5 + 14) % 7 AS f, power(2, l_linenumber) AS g FROM lineitem")
def f5(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_linenumber", r6(F.log1p(q)).alias("a"), r6(F.sqrt(q)).alias("b"), r6(F.exp(-F.col("l_tax"))).alias("c"), F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("d"),
        F.ceil(q / 7).alias("e"), F.pmod(F.col("l_linenumber") - 5, F.lit(7)).alias("f"), F.pow(F.lit(2.0), F.col("l_linenumber")).alias("g"),
    )


@query(
    "p14_fixed_normalisation",
    "c AS (SELECT quantile_cont(ct, 0.005) AS lo, quantile_cont(ct, 0.995) AS hi, avg(ct) AS m, stddev_pop(ct) AS s FROM scored) SELECT volume_id, count(*) AS n, round(sum((least(greatest(ct, lo), hi) - m) / s), 4) AS total FROM scored, c GROUP BY 1",
)
def p14(t):
    q = quantiles(t.scored, "ct", {"lo": 0.005, "hi": 0.995})
    m = t.scored.agg(F.avg("ct").alias("m"), F.stddev_pop("ct").alias("s"))
    cut, mom = q.select(F.struct("lo", "hi")).scalar(), m.select(F.struct("m", "s")).scalar()
    v = (F.least(F.greatest(F.col("ct"), cut["lo"]), cut["hi"]) - mom["m"]) / mom["s"]
    return t.scored.groupBy("volume_id").agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"))


@query("p18_seeded_control", f"SELECT vol, z, y, x, {uniform_sql(7, 'vol', 'z', 'y', 'x')} < 0.12 AS control FROM vox")
def p18(t):
    from voxelmetry.functions.expr import hash_uniform

    return t.vox.select("vol", "z", "y", "x", (hash_uniform(7, "vol", "z", "y", "x") < 0.12).alias("control"))

