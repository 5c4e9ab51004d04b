"""Queries on names, catalogues, sources and artifact lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxelmetry.functions import names as N
from voxelmetry.functions.expr import count_if, r6
from voxelmetry.operators import catalog as C
from voxelmetry.operators import sampling as P
from voxelmetry.operators.blocks import pack_field
from voxelmetry.operators.stats import rank_rows
from voxelmetry.plans.registry import query
from voxelmetry.session import checkpoint_root
from voxelmetry.sources import records as R
from voxelmetry.sources.chunks import parse_array_metadata
from voxelmetry.sources.store import read_array_metadata, write_store

RE = r"^(\d+)-surface-(\d+)-(.+?)-L(\d+)-th([0-9.]+)\.zarr$"
PARSED = f"""parsed AS (SELECT run_no, cust, scroll, name AS prediction, pz, py, px, dice, regexp_extract(name, '{RE}', 1) AS ct, regexp_extract(name, '{RE}', 2) AS run_id,
   regexp_extract(name, '{RE}', 3) AS model, CAST(regexp_extract(name, '{RE}', 4) AS INT) AS declared_level, CAST(regexp_extract(name, '{RE}', 5) AS DOUBLE) AS threshold
   FROM runs WHERE regexp_matches(name, '{RE}'))"""
CAT = PARSED + """, scan AS (SELECT p.*, (SELECT min(ct_volume) FROM cts v WHERE v.scroll = p.scroll AND v.ct_volume LIKE p.ct || '-%') AS ct_volume FROM parsed p),
 lev AS (SELECT s.*, (SELECT min(level) FROM cts r WHERE r.scroll = s.scroll AND r.ct_volume = s.ct_volume AND r.cz = s.pz AND r.cy = s.py AND r.cx = s.px
   AND (SELECT count(*) FROM cts q WHERE q.scroll = r.scroll AND q.ct_volume = r.ct_volume AND q.level < r.level) = r.level) AS actual_level FROM scan s),
 cat AS (SELECT scroll, prediction, run_id, model, threshold, ct_volume, declared_level, actual_level, dice, CASE WHEN ct_volume IS NULL THEN 'ct_missing' WHEN actual_level IS NULL THEN 'no_matching_level'
   WHEN actual_level = declared_level THEN 'verifiable' ELSE 'level_mismatch' END AS status FROM lev)"""
CATCOLS = "scroll, prediction, run_id, model, threshold, ct_volume, declared_level, actual_level, status"


def shaped(t):
    runs = t.runs.withColumn("shape", F.array("pz", "py", "px"))
    cts = t.cts.withColumn("shape", F.array("cz", "cy", "cx"))
    return runs, cts


# rows of a JSON file; a reader holds one file's array in a task
PER_FILE = 10_000


def written_arrays(rows, number: str, name: str) -> str:
    """Writes JSON files under the shared folder, each one array of the rows whose ``number`` lies in one stretch of PER_FILE,
    and returns the folder. The number itself, which no two rows should share, is not written."""
    path = f"{checkpoint_root(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    part = F.floor(F.col(number) / PER_FILE).alias("part")
    record = F.struct(*[c for c in rows.columns if c != number])
    text = rows.select(part, record.alias("r")).groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value"))
    text.repartition("part").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def catalogue(t):
    return C.build_catalogue(*shaped(t))


@query(
    "f1_parse_names",
    PARSED + """ SELECT r.run_no, ct, run_id AS run, model, declared_level AS level, threshold, r.name LIKE 'notes%' AS odd FROM runs r LEFT JOIN parsed p ON r.run_no = p.run_no""",
)
def f1(t):
    return t.runs.withColumn("a", N.parse_prediction("name")).select("run_no", "a.*", F.col("name").startswith("notes").alias("odd"))


@query("f1_resolution", "SELECT DISTINCT ct_volume, CAST(nullif(regexp_extract(ct_volume, '-([0-9.]+)um-', 1), '') AS DOUBLE) AS um FROM cts")
def f1b(t):
    return t.cts.select("ct_volume", N.resolution_um("ct_volume").alias("um")).distinct()


@query(
    "f2_paths",
    """SELECT page_id, replace(url, '/', chr(92)) AS windows_path, url AS normal, regexp_extract(rtrim(url, '/'), '[^/]*$') AS base, regexp_replace(regexp_extract(rtrim(url, '/'), '[^/]*$'), '\\.[^.]*$', '') AS stem,
   CASE WHEN contains(url, '/') THEN regexp_replace(url, '^[^/]*/', '') ELSE url END AS below_top, contains(url, 'page') AS has_page, starts_with(url, 'http') AS is_http FROM pages""",
)
def f2(t):
    w = F.replace("url", F.lit("/"), F.lit("\\"))
    return t.pages.select(
        "page_id",
        w.alias("windows_path"),
        N.normalise_path(w).alias("normal"),
        N.base_name("url").alias("base"),
        N.stem("url").alias("stem"),
        N.without_top_folder("url").alias("below_top"),
        F.contains("url", F.lit("page")).alias("has_page"),
        F.startswith("url", F.lit("http")).alias("is_http"),
    )


@query(
    "f4_stamp_time",
    PARSED + " SELECT run_no, CAST(epoch(strptime(run_id, '%Y%m%d%H%M%S')) AS BIGINT) AS seconds FROM parsed",
)
def f4(t):
    a = t.runs.withColumn("a", N.parse_prediction("name")).where("a IS NOT NULL")
    return a.select("run_no", F.unix_timestamp(N.stamp_time("a.run")).alias("seconds"))


@query("s2_catalogue_scan", CAT + " SELECT scroll, prediction, run_id, model, threshold, ct_volume, declared_level, actual_level, status, pz * 1::BIGINT * py * px AS voxels FROM cat JOIN runs USING (scroll) WHERE runs.name = prediction")
def s2b(t):
    rows = catalogue(t).join(t.runs.select("run_no", "scroll", F.col("name").alias("prediction"), F.array("pz", "py", "px").alias("pred_shape")), ["scroll", "prediction"])
    back = R.read_catalogue(t.spark, written_arrays(rows, "run_no", "catalogue"))
    return back.select(*CATCOLS.split(", "), N.shape_product("pred_shape").alias("voxels"))


@query("s2_catalogue_shape", "SELECT run_no, CAST(pz AS BIGINT) * py * px AS voxels, greatest(pz, py, px) AS longest, pz = py AS cubic FROM runs")
def f9(t):
    s = F.array("pz", "py", "px")
    return t.runs.select("run_no", N.shape_product(s).alias("voxels"), F.array_max(s).alias("longest"), (F.col("pz") == F.col("py")).alias("cubic"))


@query("f9_shape_helpers", "SELECT run_no, CAST(pz AS BIGINT) * py * px AS voxels, greatest(pz, py, px) AS longest, (pz = cz AND py = cy AND px = cx) AS same FROM runs JOIN cts ON runs.cust = cts.cust WHERE level = 0")
def f9b(t):
    runs, cts = shaped(t)
    j = runs.join(cts.where("level = 0").select("cust", F.col("shape").alias("ct_shape")), "cust")
    return j.select("run_no", N.shape_product("shape").alias("voxels"), F.array_max("shape").alias("longest"), (F.col("shape") == F.col("ct_shape")).alias("same"))


@query("s3_child_prefixes", "SELECT DISTINCT 'surfaces/' AS parent, scroll AS child FROM runs")
def s3(t):
    keys = t.runs.select(F.concat(F.lit("surfaces/"), "scroll", F.lit("/"), "name", F.lit("/0/.zarray")).alias("key"))
    return keys.select(F.lit("surfaces/").alias("parent"), N.child_prefix("key", "surfaces/").alias("child")).distinct().where("child IS NOT NULL")


@query("s4_array_metadata", "SELECT scroll, level, CAST(cz AS BIGINT) * cy * cx AS voxels, 128 AS chunk, '|u1' AS dtype, CAST(ceil(cz / 128.0) * ceil(cy / 128.0) * ceil(cx / 128.0) AS BIGINT) AS n_chunks FROM cts")
def s4(t):
    text = F.format_string('{"shape":[%d,%d,%d],"chunks":[128,128,128],"dtype":"|u1","compressor":null,"zarr_format":2}', "cz", "cy", "cx")
    m = parse_array_metadata(t.cts.select("scroll", "level", text.alias("value")), "value")
    return m.select("scroll", "level", N.shape_product("shape").alias("voxels"), F.get("chunks", 0).alias("chunk"), "dtype", n_chunks())


@query("s4_store_metadata", "SELECT DISTINCT vol, 448::BIGINT AS voxels, 4 AS chunk, '|u1' AS dtype, 8::BIGINT AS n_chunks FROM vox")
def s4s(t):
    """Metadata files of stores that are written first, one for each volume."""
    root = f"{checkpoint_root(t.spark)}/stores-{uuid.uuid4().hex}"
    write_store(pack_field(t.vox, ["vol"], (7, 8, 8), "ct", 4), "vol", root)
    m = read_array_metadata(t.spark, root)
    return m.select(F.col("store").cast("long").alias("vol"), N.shape_product("shape").alias("voxels"), F.get("chunks", 0).alias("chunk"), "dtype", n_chunks())


def n_chunks():
    n = F.lit(1)
    for i in range(3):
        n = n * F.ceil(F.get("shape", i) / F.get("chunks", i))
    return n.cast("long").alias("n_chunks")


@query("j6_level_resolution", CAT + " SELECT prediction, scroll, declared_level, actual_level FROM cat")
def j6(t):
    return catalogue(t).select("prediction", "scroll", "declared_level", "actual_level")


@query("j7_stamp_prefix", CAT + " SELECT prediction, scroll, ct_volume FROM cat")
def j7(t):
    return catalogue(t).select("prediction", "scroll", "ct_volume")


@query("p21_catalogue_status", CAT + f" SELECT {CATCOLS} FROM cat")
def p21(t):
    return catalogue(t)


@query(
    "p21_uncovered_status",
    f"""SELECT scroll, n_ct, CASE WHEN n_ct > 0 THEN 'no_prediction' ELSE 'no_ct' END AS status FROM
  (SELECT concat('Scroll', CAST(c_custkey AS VARCHAR)) AS scroll FROM customer) s
  LEFT JOIN LATERAL (SELECT count(DISTINCT ct_volume) AS n_ct FROM cts WHERE cts.scroll = s.scroll) ON true
  WHERE scroll NOT IN (SELECT scroll FROM runs WHERE contains(name, 'wide'))""",
)
def p21b(t):
    scrolls = t.customer.select(F.concat(F.lit("Scroll"), F.col("c_custkey").cast("string")).alias("scroll"))
    return C.uncovered(scrolls, t.runs.where(F.contains("name", F.lit("wide"))), t.cts)


@query("p9_resolve_artifact", CAT + " SELECT scroll, count(*) AS n, CASE WHEN count(*) = 1 THEN min(prediction) END AS prediction FROM cat WHERE contains(model, 'base') AND declared_level = 2 GROUP BY 1")
def p9(t):
    return C.unambiguous(catalogue(t), "base", 2)


@query("p10_eligible", CAT + " SELECT scroll, prediction FROM cat WHERE status = 'verifiable' AND contains(model, 'base') AND declared_level = 1")
def p10(t):
    return C.eligible(catalogue(t), "base", 1).select("scroll", "prediction")


NEAR = """v AS (SELECT DISTINCT cust, scroll, ct_volume, CAST(regexp_extract(ct_volume, '-([0-9.]+)um-', 1) AS DOUBLE) AS um0 FROM cts),
 near AS (SELECT scroll, ct_volume, CAST(k AS INT) AS at_level, um0 * power(2, k) AS um, (1024 + 64 * (cust % 5)) AS grid FROM v, (SELECT unnest(range(5)) AS k) WHERE abs(um0 * power(2, k) - 9.6) / 9.6 <= 0.25)"""


def near(t):
    v = t.cts.select("cust", "scroll", "ct_volume").distinct()
    n = C.near_resolution(v)
    return n.withColumn("grid", 1024 + 64 * (F.col("cust") % 5))


@query("p11_near_resolution", NEAR + " SELECT scroll, ct_volume, at_level, round(um, 6) AS um FROM near")
def p11(t):
    return near(t).select("scroll", "ct_volume", "at_level", r6("um").alias("um"))


@query("t3_nearest_resolution", NEAR + " SELECT scroll, ct_volume, at_level, round(um, 6) AS um FROM (SELECT *, row_number() OVER (PARTITION BY scroll ORDER BY round(abs(um - 9.6), 9), grid DESC) AS r FROM near) WHERE r = 1")
def t3(t):
    return C.nearest_resolution(near(t), ["scroll"], "grid").select("scroll", "ct_volume", "at_level", r6("um").alias("um"))


@query("a12_status_counts", CAT + " SELECT status, declared_level, model, count(*) AS n FROM cat GROUP BY ALL")
def a12(t):
    return catalogue(t).groupBy("status", "declared_level", "model").agg(F.count("*").alias("n"))


@query("a13_distinct_counts", CAT + " SELECT count(DISTINCT scroll) AS scrolls, count(DISTINCT run_id) AS runs_n, count(DISTINCT model) AS models, count(*) AS n FROM cat")
def a13(t):
    return catalogue(t).agg(
        F.countDistinct("scroll").alias("scrolls"), F.countDistinct("run_id").alias("runs_n"), F.countDistinct("model").alias("models"), F.count("*").alias("n")
    )


@query("a16_best_per_scroll", "SELECT scroll, run_no, round(dice, 6) AS dice FROM (SELECT *, row_number() OVER (PARTITION BY scroll ORDER BY dice DESC, run_no) AS r FROM runs) WHERE r = 1")
def a16(t):
    return C.best_per_group(t.runs, ["scroll"], "dice", "run_no").select("scroll", "run_no", r6("dice").alias("dice"))


@query(
    "a48_coverage_report",
    CAT
    + """ SELECT count(*) AS n_artifacts, count(d) AS n_matched, count(DISTINCT scroll) AS n_scrolls, count(DISTINCT declared_level) AS n_levels,
   count(*) FILTER (WHERE d >= 0.5) AS n_near, round(min(d), 6) AS min_dice, bool_and(coalesce(d >= 0.5, false)) AS all_near
   FROM (SELECT *, CASE WHEN status = 'verifiable' THEN dice END AS d FROM cat)""",
)
def a48(t):
    cat = catalogue(t)
    results = t.runs.select("scroll", F.col("name").alias("prediction"), "dice").join(cat.where("status = 'verifiable'"), ["scroll", "prediction"], "left_semi")
    rep = C.coverage_report(cat, results, near=0.5)
    return rep.withColumn("min_dice", r6("min_dice"))


@query(
    "j18_best_variant",
    """SELECT c.scroll, b.run_no, round(b.dice, 6) AS best_dice FROM (SELECT DISTINCT scroll FROM cts) c LEFT JOIN
   (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scroll ORDER BY dice DESC, run_no) AS r FROM runs WHERE contains(name, 'tta')) WHERE r = 1) b ON c.scroll = b.scroll""",
)
def j18(t):
    best = C.best_per_group(t.runs.where(F.contains("name", F.lit("tta"))), ["scroll"], "dice", "run_no")
    return t.cts.select("scroll").distinct().join(best, "scroll", "left").select("scroll", "run_no", r6("dice").alias("best_dice"))


@query(
    "f15_result_table",
    """SELECT printf('| %s | %.4f | %s |', scroll, dice + 1e-9, format('{:,}', CAST(run_no AS BIGINT))) AS line FROM
   (SELECT *, row_number() OVER (PARTITION BY scroll ORDER BY dice DESC, run_no) AS r FROM runs) WHERE r = 1""",
)
def f15(t):
    best = C.best_per_group(t.runs, ["scroll"], "dice", "run_no")
    return best.select(F.format_string("| %s | %.4f | %s |", "scroll", F.col("dice") + 1e-9, F.format_number("run_no", 0)).alias("line"))


@query(
    "t2_results_order",
    "SELECT position, scroll, round(dice, 6) AS dice FROM (SELECT scroll, dice, row_number() OVER (ORDER BY dice DESC, scroll) AS position FROM (SELECT scroll, max(dice) AS dice FROM runs GROUP BY 1))",
)
def t2(t):
    best = t.runs.groupBy("scroll").agg(F.max("dice").alias("dice"))
    ranked = rank_rows(best, [], [F.desc("dice"), F.asc("scroll")])
    return ranked.select(F.col("rank").alias("position"), "scroll", r6("dice").alias("dice"))


@query(
    "s6_pair_check",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side FROM
   (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 9 <> 0) b ON a.k = b.k""",
)
def s6(t):
    a = t.orders.select(F.col("o_custkey").alias("k")).distinct()
    b = t.customer.where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("k"))
    return R.pair_by_name(a, b, "k").select("k", "side")


@query(
    "s12_integrity_filter",
    """SELECT CASE WHEN pz >= 512 AND py <= 1100 THEN 'good' ELSE 'quarantine' END AS verdict, count(*) AS n FROM runs GROUP BY 1""",
)
def s12(t):
    good, bad = R.split_by_integrity(t.runs, (F.col("pz") >= 512) & (F.col("py") <= 1100))
    both = good.withColumn("verdict", F.lit("good")).unionByName(bad.withColumn("verdict", F.lit("quarantine")))
    return both.groupBy("verdict").agg(F.count("*").alias("n"))


@query("s13_completeness", "SELECT g AS id FROM (SELECT unnest(range((SELECT max(doc_id) + 1 FROM documents))) AS g) WHERE g NOT IN (SELECT doc_id FROM labels)")
def s13(t):
    # the expected range is itself a table here, so its size need not be known on the driver
    return t.documents.select(F.col("doc_id").alias("id")).join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("k5_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def k5(t):
    return R.pending(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query(
    "k6_failure_rows",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'error' ELSE 'ok' END AS status,
   CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS result FROM events""",
)
def k6(t):
    # every tenth record is damaged: it must give a failure row, not stop the job
    text = F.when(F.col("event_id") % 10 == 0, F.lit("{")).otherwise(F.col("props"))
    k = R.decode_properties(text, "k INT")["k"]
    return t.events.select("event_id", F.when(k.isNull(), "error").otherwise("ok").alias("status"), k.alias("result"))


@query("f13_tolerant_json", "SELECT kind, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k FROM records GROUP BY 1")
def f13(t):
    k = R.decode_properties(F.col("props"), "k INT")["k"]
    return t.records.groupBy("kind").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("f12_map_access", "SELECT entity, kind AS k, round(max(value), 6) AS v FROM records GROUP BY 1, 2")
def f12(t):
    per = t.records.groupBy("entity", "kind").agg(F.max("value").alias("v"))
    m = per.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("kind", "v"))).alias("m"))  # five kinds
    return m.select("entity", F.explode("m").alias("k", "v")).select("entity", "k", r6("v").alias("v"))


@query("s1_record_scan", "SELECT status, count(*) AS n, count(recall) AS n_recall, round(avg(recall), 6) AS mean FROM records GROUP BY 1")
def s1(t):
    # record files in the shared folder: one array of records for every stretch of ids
    rows = t.records.select("event_id", F.col("event_id").cast("string").alias("sample"), "status", "recall")
    parsed = R.read_records(t.spark, written_arrays(rows, "event_id", "records"), glob="*.txt")
    return parsed.groupBy("status").agg(F.count("*").alias("n"), F.count("recall").alias("n_recall"), r6(F.avg("recall")).alias("mean"))


@query(
    "a15_conditional_sums",
    """SELECT status, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS components,
   CAST(sum(CASE WHEN value < 20 THEN CAST(json_extract_string(props, '$.k') AS INT) ELSE 0 END) AS BIGINT) AS lost, count(*) FILTER (WHERE value < 20) AS with_loss FROM records GROUP BY 1""",
)
def a15(t):
    k = R.decode_properties(F.col("props"), "k INT")["k"]
    low = F.col("value") < 20
    return t.records.groupBy("status").agg(
        F.count("*").alias("n"), F.sum(k).alias("components"), F.sum(F.when(low, k).otherwise(0)).alias("lost"), count_if(low).alias("with_loss")
    )


@query(
    "p4_region_slice",
    "SELECT vol, count(*) AS n, round(avg(p), 6) AS mean, '1:6,2:7,0:5' AS box FROM vox WHERE z >= 1 AND z < 6 AND y >= 2 AND y < 7 AND x >= 0 AND x < 5 GROUP BY 1",
)
def p4(t):
    box = N.parse_box(F.lit("1:6,2:7,0:5"))
    return t.vox.where(N.in_box(box)).groupBy("vol").agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean"), F.first(N.format_box(box)).alias("box"))


@query("p5_interior_trim", "SELECT vol, count(*) AS n, count(*) FILTER (WHERE pred) AS n_pred FROM vox WHERE z BETWEEN 1 AND 5 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY 1")
def p5(t):
    box = N.parse_box(F.lit("0:7,0:8,0:8"))
    return t.vox.where(N.in_box(box, margin=1)).groupBy("vol").agg(F.count("*").alias("n"), count_if(F.col("pred")).alias("n_pred"))


@query("p6_centre_crop", "SELECT vol, z - 1 AS z, y - 2 AS y, x - 2 AS x, label FROM vox WHERE z >= 1 AND z < 5 AND y >= 2 AND y < 6 AND x >= 2 AND x < 6")
def p6(t):
    from voxelmetry.operators.volumes import centre_crop

    return centre_crop(t.vox, (7, 8, 8), (4, 4, 4)).select("vol", "z", "y", "x", "label")


@query("f3_box_text", "SELECT run_no, concat('0:', pz, ',0:', py, ',8:', px) AS box, pz - 0 AS dz, px - 8 AS dx FROM runs")
def f3(t):
    s = lambda c: F.col(c).cast("string")
    box = N.parse_box(F.concat(F.lit("0:"), s("pz"), F.lit(",0:"), s("py"), F.lit(",8:"), s("px")))
    return t.runs.withColumn("b", box).select(
        "run_no", N.format_box("b").alias("box"), (F.col("b.z1") - F.col("b.z0")).alias("dz"), (F.col("b.x1") - F.col("b.x0")).alias("dx")
    )


@query(
    "w11_first_best_probe",
    """SELECT scroll, run_no, round(dice, 1) AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY scroll ORDER BY round(dice, 1) DESC, run_no) AS r FROM runs)
   WHERE r = 1 AND round(dice, 1) >= 0.4""",
)
def w11(t):
    return P.first_best(t.runs, ["scroll"], F.round("dice", 1), "run_no", 0.4).select("scroll", "run_no", "best_score")


@query("t1_top_n", "SELECT scroll, rank, run_no FROM (SELECT scroll, run_no, CAST(row_number() OVER (PARTITION BY scroll ORDER BY dice DESC, pz, run_no) AS INT) AS rank FROM runs) WHERE rank <= 3")
def t1(t):
    return P.top_per_group(t.runs, ["scroll"], [F.desc("dice"), F.asc("pz")], ["run_no"], 3).select("scroll", "rank", "run_no")


@query("p23_gates", "SELECT scroll, max(dice) AS d, count(*) AS n, max(dice) >= 0.6 AS gate_1, count(*) >= 3 AS gate_2, max(dice) >= 0.6 AND count(*) >= 3 AS passed FROM runs GROUP BY 1")
def p23(t):
    from voxelmetry.operators.integrity import gate_table

    g = t.runs.groupBy("scroll").agg(F.max("dice").alias("d"), F.count("*").alias("n"))
    return gate_table(g, [("d", ">=", 0.6), ("n", ">=", 3)])


@query("p13_minimum_support", "SELECT scroll, count(*) AS n, CASE WHEN count(*) < 5 THEN 'too_few' ELSE 'ok' END AS status FROM runs GROUP BY 1")
def p13(t):
    return t.runs.groupBy("scroll").agg(F.count("*").alias("n")).withColumn("status", F.when(F.col("n") < 5, "too_few").otherwise("ok"))

