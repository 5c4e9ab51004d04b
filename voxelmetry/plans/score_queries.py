"""Queries of the scoring chapter: projections and predicates on voxels, counts, ratios, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmetry.functions.expr import count_if, hash_uniform, r6, ratio, share, sigmoid_of_logits
from voxelmetry.operators import score as S
from voxelmetry.plans.registry import query, uniform_sql
from voxelmetry.session import cut_lineage

V = ["volume_id"]


@query("p1_probability", "SELECT vol, z, y, x, round(1 / (1 + exp(l0 - l1)), 6) AS p1, round(1 / (1 + exp(-l1)), 6) AS p_one FROM vox")
def p1(t):
    return t.vox.select(
        "vol", "z", "y", "x",
        r6(sigmoid_of_logits("l0", "l1")).alias("p1"),
        r6(sigmoid_of_logits(F.lit(0.0), "l1")).alias("p_one"),
    )


@query("p2_binarise", "SELECT volume_id, count(*) FILTER (WHERE p > 0.2) AS n_pred, count(*) AS n FROM scored GROUP BY 1")
def p2(t):
    return t.scored.groupBy("volume_id").agg(count_if(F.col("p") > S.THRESHOLD).alias("n_pred"), F.count("*").alias("n"))


@query("p3_class_masks", "SELECT volume_id, count(*) FILTER (WHERE label = 1) AS sheet, count(*) FILTER (WHERE label = 2) AS ignored, count(*) FILTER (WHERE label <> 2) AS scored_n FROM scored GROUP BY 1")
def p3(t):
    lab = F.col("label")
    return t.scored.groupBy("volume_id").agg(
        count_if(lab == 1).alias("sheet"), count_if(lab == 2).alias("ignored"), count_if(lab != 2).alias("scored_n")
    )


A1 = """h AS (SELECT volume_id, count(*) FILTER (WHERE p > 0.2 AND label = 1) AS tp, count(*) FILTER (WHERE p <= 0.2 AND label = 1) AS fn,
   count(*) FILTER (WHERE p > 0.2 AND label = 0) AS fp, count(*) FILTER (WHERE p > 0.2 AND label <> 2) AS n_pred,
   count(*) FILTER (WHERE p > 0.2 AND label = 2) AS fp_in_ignore, count(*) FILTER (WHERE p > 0.2 AND ct = 0) AS on_empty,
   count(*) FILTER (WHERE label <> 2) AS n_scored, count(*) FILTER (WHERE label = 1) AS n_sheet FROM scored GROUP BY 1)"""


@query("a1_confusion", A1 + " SELECT * FROM h")
def a1(t):
    return S.confusion_counts(t.scored, V)


def _endpoint_sql(prefix: str) -> str:
    c = lambda n: f"h.{n}" if not prefix else f"b.{n}"
    prec = f"{c('tp')} / greatest(CAST({c('tp')} + {c('fp')} AS DOUBLE), 1)"
    return f"""round({c('tp')} / greatest(CAST({c('tp')} + {c('fn')} AS DOUBLE), 1), 6) AS {prefix}recall,
      round({prec}, 6) AS {prefix}precision, round(CAST({c('n_pred')} AS DOUBLE) / h.n_scored, 6) AS {prefix}positive_fraction,
      round(({prec}) / greatest(CAST(h.n_sheet AS DOUBLE) / h.n_scored, 1e-9), 6) AS {prefix}precision_lift,
      round({c('on_empty')} / greatest(CAST({c('n_pred')} AS DOUBLE), 1), 6) AS {prefix}on_empty_share,
      round({c('fp_in_ignore')} / greatest(CAST({c('n_pred')} + {c('fp_in_ignore')} AS DOUBLE), 1), 6) AS {prefix}ignore_share"""


ENDPOINTS = (
    A1
    + """, cut AS (SELECT volume_id, quantile_cont(p, 0.88) AS t FROM scored WHERE label <> 2 GROUP BY 1),
 b AS (SELECT volume_id, count(*) FILTER (WHERE p > t AND label = 1) AS tp, count(*) FILTER (WHERE p <= t AND label = 1) AS fn,
   count(*) FILTER (WHERE p > t AND label = 0) AS fp, count(*) FILTER (WHERE p > t AND label <> 2) AS n_pred,
   count(*) FILTER (WHERE p > t AND label = 2) AS fp_in_ignore, count(*) FILTER (WHERE p > t AND ct = 0) AS on_empty
   FROM scored JOIN cut USING (volume_id) GROUP BY 1)"""
)
ENDPOINTS_E = ENDPOINTS + f""", e AS (SELECT h.volume_id, 'ok' AS status, h.n_scored, h.n_sheet, round(CAST(h.n_sheet AS DOUBLE) / h.n_scored, 6) AS base_rate,
   round(t, 6) AS budget_threshold, {_endpoint_sql('')}, {_endpoint_sql('budget_')}
   FROM h JOIN b USING (volume_id) JOIN cut USING (volume_id) WHERE h.n_sheet >= 50 AND h.n_scored >= 100)"""


def _endpoints(t):
    return S.endpoints(t.scored, V, min_sheet=50, min_scored=100).where("status = 'ok'")


def _records(t):
    """The endpoints as a written record table, as summaries read them."""
    return cut_lineage(_endpoints(t), "records")


def _rounded(df):
    return df.select(*[r6(c).alias(c) if dt == "double" else F.col(c) for c, dt in df.dtypes])


@query("a2_endpoints", ENDPOINTS_E + " SELECT * FROM e")
def a2(t):
    return _rounded(_endpoints(t))


@query("a7_budget_recall", ENDPOINTS_E + " SELECT volume_id, budget_threshold, budget_recall FROM e")
def a7(t):
    return _rounded(_endpoints(t).select("volume_id", "budget_threshold", "budget_recall"))


@query("a8_calibration", ENDPOINTS + " SELECT count(*) AS n, round(quantile_cont(t, 0.5), 6) AS threshold, round(quantile_cont(t, 0.1), 6) AS q10, round(quantile_cont(t, 0.9), 6) AS q90 FROM cut")
def a8(t):
    return _rounded(S.calibrate_threshold(t.scored, V))


POP = """, w AS (SELECT e.*, located FROM e JOIN (SELECT DISTINCT volume_id, located FROM scored) USING (volume_id)),
 g AS (SELECT 'all' AS population, * FROM w UNION ALL SELECT CASE WHEN located THEN 'located' ELSE 'other' END, * FROM w)"""
FIELDS = ["recall", "precision", "precision_lift", "budget_recall"]


@query(
    "a10_population_report",
    ENDPOINTS_E.replace("round(", "(").replace(", 6)", ")")
    + POP
    + ", l AS ("
    + " UNION ALL ".join(f"SELECT population, '{f}' AS field, {f} AS v FROM g" for f in FIELDS)
    + ") SELECT population, field, count(*) AS n, round(median(v), 6) AS median FROM l GROUP BY 1, 2",
)
def a10(t):
    located = t.scored.select("volume_id", "located").distinct()
    rep = S.population_report(
        _records(t).join(located, "volume_id"),
        FIELDS,
        [("all", F.lit(True)), ("located", F.col("located")), ("other", ~F.col("located"))],
    )
    return _rounded(rep)


AGREE = """a AS (SELECT vol, count(*) AS n, count(*) FILTER (WHERE p > 0.2) AS n_a, count(*) FILTER (WHERE pred) AS n_b,
  count(*) FILTER (WHERE p > 0.2 AND pred) AS n_both, count(*) FILTER (WHERE (p > 0.2) <> pred) AS disagreeing FROM vox GROUP BY 1)"""


@query(
    "a3_dice_iou",
    AGREE + """ SELECT vol, n, n_a, n_b, disagreeing, round(CASE WHEN n_a + n_b = 0 THEN 1 ELSE 2.0::DOUBLE * n_both / (n_a + n_b) END, 6) AS dice,
  round(CASE WHEN n_a + n_b = 0 THEN 1 ELSE CAST(n_both AS DOUBLE) / (n_a + n_b - n_both) END, 6) AS iou,
  round(1 - CAST(disagreeing AS DOUBLE) / n, 6) AS agreement FROM a""",
)
def a3(t):
    return _rounded(S.mask_agreement(t.vox, ["vol"], F.col("p") > 0.2, F.col("pred")))


CUTS = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in S.SWEEP_CUTS) + "]"
SWEEP = f"""c AS (SELECT unnest({CUTS}) AS cut, unnest(range(39)) AS ordinal),
 s AS (SELECT vol, CAST(ordinal AS INT) AS ordinal, cut, count(*) FILTER (WHERE p > cut) AS n_pred, count(*) FILTER (WHERE p > cut AND pred) AS n_both,
   count(*) FILTER (WHERE pred) AS n_mask FROM vox, c GROUP BY 1, 2, 3),
 d AS (SELECT *, CASE WHEN n_pred + n_mask = 0 THEN 1 ELSE CAST(2 * n_both AS DOUBLE) / (n_pred + n_mask) END AS dice FROM s)"""


@query("a4_threshold_sweep", SWEEP + " SELECT vol, ordinal, cut, n_pred, n_both, n_mask, round(dice, 6) AS dice FROM d")
def a4(t):
    return _rounded(S.threshold_sweep(t.vox, ["vol"], F.col("pred")))


BEST = (
    AGREE
    + ", "
    + SWEEP
    + """, base AS (SELECT vol, CASE WHEN n_a + n_b = 0 THEN 1 ELSE CAST(2 * n_both AS DOUBLE) / (n_a + n_b) END AS dice FROM a),
 top AS (SELECT vol, cut, dice AS best, row_number() OVER (PARTITION BY vol ORDER BY dice DESC, ordinal) AS r FROM d),
 v AS (SELECT vol, base.dice, greatest(best, base.dice) AS best_dice, CASE WHEN best > base.dice THEN cut ELSE CAST(0.2 AS DOUBLE) END AS best_threshold,
   greatest(best - base.dice, 0) AS headroom FROM base JOIN top USING (vol) WHERE r = 1)"""
)


def _best(t):
    base = S.mask_agreement(t.vox, ["vol"], F.col("p") > 0.2, F.col("pred"))
    return S.best_threshold(S.threshold_sweep(t.vox, ["vol"], F.col("pred")), base, ["vol"], 0.2)


@query("a4_best_threshold", BEST + " SELECT vol, round(dice, 6) AS dice, round(best_dice, 6) AS best_dice, best_threshold, round(headroom, 6) AS headroom FROM v")
def a4b(t):
    return _rounded(_best(t))


@query(
    "p19_verdict",
    BEST + """ SELECT vol, CASE WHEN dice > 0.99 THEN 'reproduced' WHEN best_dice - dice < 0.02 THEN 'structural_difference' ELSE 'calibration_difference' END AS verdict FROM v""",
)
def p19(t):
    return _best(t).select("vol", S.verdict(F.col("dice"), F.col("best_dice")).alias("verdict"))


@query(
    "a5_recall_by_threshold",
    "SELECT volume_id, "
    + ", ".join(f"round(count(*) FILTER (WHERE p > {c}) / CAST(count(*) AS DOUBLE), 6) AS recall_{i}" for i, c in enumerate((0.1, 0.2, 0.3, 0.5)))
    + " FROM scored WHERE label = 1 GROUP BY 1",
)
def a5(t):
    m = S.recall_by_threshold(t.scored, V, [0.1, 0.2, 0.3, 0.5])
    return m.select("volume_id", *[r6(F.element_at("recall_by_threshold", str(c))).alias(f"recall_{i}") for i, c in enumerate((0.1, 0.2, 0.3, 0.5))])


@query(
    "a6_near_threshold",
    """SELECT vol, count(*) AS n, round(count(*) FILTER (WHERE abs(p - 0.2::DOUBLE) < 0.01) / CAST(count(*) AS DOUBLE), 6) AS within_0_01,
  round(count(*) FILTER (WHERE abs(p - 0.2::DOUBLE) < 0.05) / CAST(count(*) AS DOUBLE), 6) AS within_0_05,
  round(count(*) FILTER (WHERE abs(p - 0.2::DOUBLE) < 0.15) / CAST(count(*) AS DOUBLE), 6) AS within_0_15 FROM vox WHERE (p > 0.2) <> pred GROUP BY 1""",
)
def a6(t):
    return _rounded(S.near_threshold_share(t.vox, ["vol"], F.col("pred"), 0.2))


SUMMARY = """count({v}) AS n, round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.05), 6) AS p5, round(quantile_cont({v}, 0.25), 6) AS q1,
  round(quantile_cont({v}, 0.5), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS q3, round(quantile_cont({v}, 0.9), 6) AS p90,
  round(count(*) FILTER (WHERE {v} < 0.8) / CAST(count(*) AS DOUBLE), 6) AS below_0_8, round(count(*) FILTER (WHERE {v} < 0.7) / CAST(count(*) AS DOUBLE), 6) AS below_0_7,
  round(count(*) FILTER (WHERE {v} < 0.5) / CAST(count(*) AS DOUBLE), 6) AS below_0_5"""


@query("a9_summary", ENDPOINTS_E.replace("round(", "(").replace(", 6)", ")") + " SELECT " + SUMMARY.format(v="recall") + " FROM e")
def a9(t):
    return _rounded(S.summary(_records(t), "recall"))


@query("p8_status_filter", "SELECT kind, count(*) AS n, round(avg(value), 6) AS mean FROM records WHERE status = 'ok' GROUP BY 1")
def p8(t):
    return t.records.where("status = 'ok'").groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(
    "a43_regime",
    """s AS (SELECT vol, min(l1) AS lo, max(l1) AS hi, max(l1) - min(l1) AS span, 1 / (1 + exp(min(l0 - l1))) AS pmax,
   count(*) FILTER (WHERE 1 / (1 + exp(l0 - l1)) > 0.2) / CAST(count(*) AS DOUBLE) AS pos,
   avg(abs(1 / (1 + exp(l0 - l1)) - 0.5)) * 2 AS conf, count(*) FILTER (WHERE 1 / (1 + exp(l0 - l1)) > 0.9) / CAST(count(*) AS DOUBLE) AS hot FROM vox GROUP BY 1)
 SELECT vol, lo AS logit_min, hi AS logit_max, span AS logit_span, round(pos, 6) AS positive_fraction, round(conf, 6) AS mean_confidence, round(hot, 6) AS share_over_09,
   CASE WHEN conf >= 0.2 AND pos BETWEEN 0.005 AND 0.6 THEN 'normal' ELSE 'degenerate' END AS regime FROM s""",
)
def a43(t):
    p = sigmoid_of_logits("l0", "l1")
    s = t.vox.groupBy("vol").agg(
        F.min("l1").alias("logit_min"),
        F.max("l1").alias("logit_max"),
        (F.max("l1") - F.min("l1")).alias("logit_span"),
        ratio(count_if(p > 0.2), F.count("*")).alias("positive_fraction"),
        (F.avg(F.abs(p - 0.5)) * 2).alias("mean_confidence"),
        ratio(count_if(p > 0.9), F.count("*")).alias("share_over_09"),
    )
    healthy = (F.col("mean_confidence") >= 0.2) & F.col("positive_fraction").between(0.005, 0.6)
    return _rounded(s.withColumn("regime", F.when(healthy, "normal").otherwise("degenerate")))


@query(
    "p20_range_verdict",
    """s AS (SELECT volume_id, max(p) AS mx, stddev_pop(p) AS sd, count(*) FILTER (WHERE p > 0.5) / CAST(count(*) AS DOUBLE) AS hot FROM scored GROUP BY 1),
 c AS (SELECT quantile_cont(hot, 0.9) AS top FROM s)
 SELECT volume_id, CASE WHEN sd < 1e-6 THEN 'degenerate_constant_output' WHEN mx < 0.5 THEN 'no_signal' WHEN hot > top THEN 'above_range' ELSE 'within_range' END AS verdict FROM s, c""",
)
def p20(t):
    from voxelmetry.operators.distribution import quantiles

    s = t.scored.groupBy("volume_id").agg(
        F.max("p").alias("mx"), F.stddev_pop("p").alias("sd"), ratio(count_if(F.col("p") > 0.5), F.count("*")).alias("hot")
    )
    top = quantiles(s, "hot", {"top": 0.9}).select("top").scalar()  # calibration: one number
    return s.select(
        "volume_id",
        F.when(F.col("sd") < 1e-6, "degenerate_constant_output")
        .when(F.col("mx") < 0.5, "no_signal")
        .when(F.col("hot") > top, "above_range")
        .otherwise("within_range")
        .alias("verdict"),
    )


@query(
    "a47_reference_range",
    """s AS (SELECT volume_id, count(*) FILTER (WHERE p > 0.5) / CAST(count(*) AS DOUBLE) AS hot FROM scored GROUP BY 1)
 SELECT count(*) AS n, round(min(hot), 6) AS lo, round(max(hot), 6) AS hi, round(avg(hot), 6) AS mean, round(median(hot), 6) AS median, round(quantile_cont(hot, 0.9), 6) AS p90 FROM s""",
)
def a47(t):
    from voxelmetry.operators.distribution import cumulative, quantiles_from

    s = t.scored.groupBy("volume_id").agg(ratio(count_if(F.col("p") > 0.5), F.count("*")).alias("hot"))
    cum = cumulative(s, "hot")
    q = quantiles_from(cum, "hot", {"lo": 0.0, "hi": 1.0, "median": 0.5, "p90": 0.9})
    mean = cum.agg(F.sum(F.col("hot") * F.col("n")) / F.sum("n")).scalar()
    return _rounded(q.withColumn("mean", mean))


@query(
    "a46_class_weights",
    """c AS (SELECT volume_id, label, count(*) AS n FROM scored GROUP BY 1, 2), t AS (SELECT label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1),
 w AS (SELECT label, n, 1 / (CAST(n AS DOUBLE) / sum(n) OVER ()) AS inv FROM t)
 SELECT label, n, round(inv / avg(inv) OVER (), 6) AS inverse, round(sqrt(inv) / avg(sqrt(inv)) OVER (), 6) AS inverse_sqrt FROM w""",
)
def a46(t):
    counts = t.scored.groupBy("label").agg(F.count("*").alias("n"))
    # three classes: the totals are one row of three known numbers
    totals = counts.agg(F.struct(F.avg(1 / F.col("n")).alias("m"), F.avg(1 / F.sqrt("n")).alias("ms"))).scalar()
    return counts.select(
        "label", "n",
        r6(1 / F.col("n") / totals["m"]).alias("inverse"),
        r6(1 / F.sqrt("n") / totals["ms"]).alias("inverse_sqrt"),
    )


@query(
    "s7_scaled_probability",
    """m AS (SELECT *, max(p) OVER (PARTITION BY vol) AS mx FROM (SELECT vol, z, y, x, CASE WHEN vol % 2 = 0 THEN p ELSE p * 255 END AS p FROM vox))
 SELECT vol, z, y, x, round(CASE WHEN mx > 1.5 THEN p / 255 ELSE p END, 6) AS p FROM m""",
)
def s7(t):
    from voxelmetry.sources.records import rescale_probability

    raw = t.vox.select("vol", "z", "y", "x", F.when(F.col("vol") % 2 == 0, F.col("p")).otherwise(F.col("p") * 255).alias("p"))
    return rescale_probability(raw, ["vol"]).select("vol", "z", "y", "x", r6("p").alias("p"))


@query(
    "p7_adaptive_size",
    """SELECT run_no, least(CAST(floor(least(pz, py, px) / 64.0) AS INT) * 64, 256) AS size,
  CASE WHEN least(CAST(floor(least(pz, py, px) / 64.0) AS INT) * 64, 256) <= 2 * 64 THEN 'too_small' ELSE 'ok' END AS status FROM runs""",
)
def p7(t):
    size = F.least((F.floor(F.least("pz", "py", "px") / 64) * 64).cast("int"), F.lit(256))
    return t.runs.select("run_no", size.alias("size"), F.when(size <= 128, "too_small").otherwise("ok").alias("status"))


@query(
    "a49_null_controls",
    f"""SELECT 'random' AS control, count(*) AS n_volumes, round(avg(hit / greatest(CAST(hit + fp AS DOUBLE), 1) / (n_sheet / CAST(n_scored AS DOUBLE))), 6) AS mean_lift FROM
 (SELECT vol, count(*) FILTER (WHERE label <> 2) AS n_scored, count(*) FILTER (WHERE label = 1) AS n_sheet, count(*) FILTER (WHERE u > 0.2 AND label = 1) AS hit, count(*) FILTER (WHERE u > 0.2 AND label = 0) AS fp
  FROM (SELECT vol, label, {uniform_sql(11, 'vol', 'z', 'y', 'x')} AS u FROM vox) GROUP BY 1) UNION ALL
 SELECT 'perfect' AS control, count(*) AS n_volumes, round(avg(n_scored / CAST(n_sheet AS DOUBLE)), 6) AS mean_lift FROM
 (SELECT volume_id, count(*) FILTER (WHERE label <> 2) AS n_scored, count(*) FILTER (WHERE label = 1) AS n_sheet FROM scored GROUP BY 1)""",
)
def a49(t):
    perfect = t.scored.withColumn("p", (F.col("label") == 1).cast("double"))
    random = t.vox.withColumn("p", hash_uniform(11, "vol", "z", "y", "x")).withColumnRenamed("vol", "volume_id")

    def lift(control, arm):
        e = S.endpoints(arm, V, min_sheet=1, min_scored=1)
        return e.agg(F.lit(control).alias("control"), F.count("*").alias("n_volumes"), r6(F.avg("precision_lift")).alias("mean_lift")).select("control", "n_volumes", "mean_lift")

    return lift("random", random).unionByName(lift("perfect", perfect))
