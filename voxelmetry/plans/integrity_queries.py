"""Queries on digests, duplicates, sets, samples, splits and access patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmetry.functions.expr import r6
from voxelmetry.functions.names import morton, register_table_functions, window_starts
from voxelmetry.operators import access as A
from voxelmetry.operators import integrity as I
from voxelmetry.operators import sampling as P
from voxelmetry.operators.stats import rank_rows
from voxelmetry.plans.registry import query, uniform_sql
from voxelmetry.session import cut_lineage

DIGEST = """b AS (SELECT vol, min(z) FILTER (WHERE ct <> 0) AS z0, max(z) FILTER (WHERE ct <> 0) AS z1, min(y) FILTER (WHERE ct <> 0) AS y0, max(y) FILTER (WHERE ct <> 0) AS y1,
   min(x) FILTER (WHERE ct <> 0) AS x0, max(x) FILTER (WHERE ct <> 0) AS x1, max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM vox GROUP BY 1),
 az AS (SELECT *, unnest(range(nz)) AS z FROM b), ay AS (SELECT *, unnest(range(ny)) AS y FROM az), ax AS (SELECT *, unnest(range(nx)) AS x FROM ay),
 bt AS (SELECT ax.*, lpad(hex(coalesce(ct, 0)), 2, '0') AS h FROM ax LEFT JOIN vox USING (vol, z, y, x)),
 dg AS (SELECT b.*, r.d AS raw_digest, c.d AS content_digest FROM b JOIN (SELECT vol, sha256(unhex(string_agg(h, '' ORDER BY z, y, x))) AS d FROM bt GROUP BY 1) r USING (vol)
   LEFT JOIN (SELECT vol, sha256(unhex(string_agg(h, '' ORDER BY z, y, x))) AS d FROM bt WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY 1) c USING (vol))"""


@query("a38_content_digest", DIGEST + " SELECT * FROM dg")
def a38(t):
    return I.content_digests(t.vox, ["vol"])


@query("a38_text_digest", "SELECT doc_id, sha256(text) AS raw_digest, sha256(trim(text, ' ')) AS content_digest FROM docs")
def a38b(t):
    return I.text_digests(t.docs).select("doc_id", "raw_digest", "content_digest")


@query("f14_sha256", "SELECT page_id, sha256(html) AS digest FROM pages")
def f14(t):
    return t.pages.select("page_id", F.sha2("html", 256).alias("digest"))


@query("a14_duplicates", "SELECT doc_id, n, first_member FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS first_member FROM docs) WHERE n > 1")
def a14(t):
    return I.duplicates(I.text_digests(t.docs).select("doc_id", "raw_digest"), "raw_digest", "doc_id").select("doc_id", "n", "first_member")


@query("s8_unique_names", "SELECT concat(CASE WHEN vec_id % 2 = 0 THEN 'even/' ELSE 'odd/' END, CAST(vec_id AS VARCHAR)) AS patch, label AS batch_label FROM embeddings")
def s8(t):
    from voxelmetry.sources.patches import union_batches

    e = t.embeddings.select(F.col("vec_id").cast("string").alias("patch"), F.col("label").alias("batch_label"))
    return union_batches({"even": e.where("patch % 2 = 0"), "odd": e.where("patch % 2 = 1")}, check_unique=True)


@query("s11_pinned_digest", "SELECT doc_id, n_chars FROM docs")
def s11(t):
    from voxelmetry.sources.records import require_digest

    # the digest is pinned beside the content; a differing row would fail the job
    pinned = t.docs.select("doc_id", "n_chars", F.encode("text", "UTF-8").alias("content"), F.sha2("text", 256).alias("pin"))
    return require_digest(pinned, "content", F.col("pin")).select("doc_id", "n_chars")


# published digests are those of the trimmed texts, so that texts with outer blanks are found to differ
@query("a39_reverify", f"SELECT doc_id, text = trim(text, ' ') AS verified FROM docs WHERE {uniform_sql(39, 'doc_id')} < 0.25")
def a39(t):
    pinned = cut_lineage(I.text_digests(t.docs).select("doc_id", F.col("content_digest").alias("digest")), "published")
    return I.reverify(pinned, t.docs.select("doc_id", F.sha2("text", 256).alias("digest")), "doc_id", "digest", 0.25, 39)


@query("a39_changed_volumes", DIGEST + " SELECT vol, true AS verified FROM dg WHERE " + uniform_sql(7, "vol") + " < 0.5")
def a39v(t):
    digests = lambda: I.content_digests(t.vox, ["vol"]).select("vol", "raw_digest")
    return I.reverify(cut_lineage(digests(), "published"), digests(), "vol", "raw_digest", 0.5, 7)


@query("a40_label_values", "SELECT vol, count(DISTINCT label) AS n_values, count(DISTINCT label) FILTER (WHERE label NOT IN (0, 1)) AS n_unexpected FROM vox GROUP BY 1")
def a40(t):
    return I.unexpected_values(t.vox, ["vol"], "label", [0, 1])


MULTI = """m AS (SELECT coalesce(a.n_chars, b.n_chars) AS n_chars, coalesce(na, 0) AS n_a, coalesce(nb, 0) AS n_b, coalesce(na, 0) - coalesce(nb, 0) AS surplus
  FROM (SELECT n_chars, count(*) AS na FROM docs WHERE lang = 'en' GROUP BY 1) a FULL JOIN (SELECT n_chars, count(*) AS nb FROM docs WHERE lang <> 'en' GROUP BY 1) b ON a.n_chars = b.n_chars)"""


def _sides(t):
    return t.docs.where("lang = 'en'"), t.docs.where("lang <> 'en'")


@query("j17_multiset_compare", MULTI + " SELECT * FROM m")
def j17(t):
    return I.multiset_difference(*_sides(t), ["n_chars"])


@query("u4_multiset_intersection", MULTI + " SELECT CAST(sum(least(n_a, n_b)) AS BIGINT) AS n_common FROM m")
def u4(t):
    a, b = (d.select("n_chars") for d in _sides(t))
    return a.intersectAll(b).agg(F.count("*").alias("n_common"))


@query("u5_multiset_containment", MULTI + " SELECT CAST(sum(least(n_a, n_b)) AS BIGINT) AS n_common, max(surplus) <= 0 AS contained FROM m")
def u5(t):
    return I.multiset_overlap(*_sides(t), ["n_chars"])


@query("u1_tagged_union", "SELECT tag, count(*) AS n FROM (SELECT 'bad' AS tag FROM labels WHERE quality = 0 UNION ALL SELECT 'good' FROM labels WHERE quality = 1) GROUP BY 1")
def u1(t):
    bad = t.labels.where("quality = 0").withColumn("tag", F.lit("bad"))
    good = t.labels.where("quality = 1").withColumn("tag", F.lit("good"))
    return bad.unionByName(good).groupBy("tag").agg(F.count("*").alias("n"))


@query("u2_intersect", "SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def u2(t):
    k = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("k"))
    return k("A").intersect(k("R"))


@query("u3_except", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def u3(t):
    return t.orders.select(F.col("o_custkey").alias("k")).exceptAll(t.customer.select("c_custkey"))


@query("j1_record_join", "SELECT user_id, count(*) AS n, round(avg(c_acctbal), 6) AS bal FROM events JOIN customer ON user_id = c_custkey GROUP BY 1")
def j1(t):
    return t.events.join(t.customer.withColumnRenamed("c_custkey", "user_id"), "user_id").groupBy("user_id").agg(F.count("*").alias("n"), r6(F.avg("c_acctbal")).alias("bal"))


@query("j2_membership_flag", "SELECT o_orderkey, c_custkey IS NOT NULL AS located FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def j2(t):
    located = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("located"))
    return t.orders.join(located, "o_custkey", "left").select("o_orderkey", F.coalesce("located", F.lit(False)).alias("located"))


@query("j3_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def j3(t):
    c = t.customer.where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("j4_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("j14_parameter_rows", "SELECT volume_id, cut, count(*) FILTER (WHERE p > cut) AS n_pred FROM scored, (SELECT unnest([0.1::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS cut) GROUP BY 1, 2")
def j14(t):
    # the parameters meet per-volume counts, not the voxels: one pass, then four rows per volume
    cuts = [0.1, 0.3, 0.5, 0.7]
    wide = t.scored.groupBy("volume_id").agg(*[F.count(F.when(F.col("p") > c, 1)).alias(f"c{i}") for i, c in enumerate(cuts)])
    pairs = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"c{i}").alias("n_pred")) for i, c in enumerate(cuts)])
    return wide.select("volume_id", F.inline(pairs))


WINS = """g AS (SELECT c_custkey AS v, CAST(256 + 64 * (c_custkey % 7) AS INT) AS s FROM customer),
 n AS (SELECT *, CAST(ceil((s - 192) / 96.0) AS INT) + 1 AS k FROM g), st AS (SELECT v, s, CASE WHEN s <= 192 THEN 0 ELSE CAST(round_even(i * (s - 192) / (k - 1)::DOUBLE, 0) AS INT) END AS w
   FROM n, LATERAL (SELECT unnest(range(k)) AS i))"""


def grid(t):
    s = (256 + 64 * (F.col("c_custkey") % 7)).cast("int")
    return t.customer.select(F.col("c_custkey").alias("v"), s.alias("nz"), F.lit(192).alias("ny"), s.alias("nx"))


@query("f10_window_starts", WINS + " SELECT v, w FROM st")
def f10(t):
    return grid(t).select("v", F.explode(window_starts("nz", 192, 0.5)).alias("w"))


@query("f10_window_starts_by_sql", WINS + " SELECT v, w FROM st")
def f10s(t):
    register_table_functions(t.spark)
    return t.spark.sql("SELECT v, start AS w FROM {grid}, LATERAL window_starts(CAST(nz AS INT), 192, CAST(0.5 AS DOUBLE))", grid=grid(t))


@query("j15_interval_overlap", WINS + " SELECT a.v, count(*) AS n_windows FROM st a JOIN st b ON a.v = b.v WHERE a.w < 300 AND a.w + 192 > 100 AND b.w < 200 AND b.w + 192 > 50 GROUP BY 1")
def j15(t):
    wins = A.windows(grid(t), 192, 0.5)
    lo, hi = (F.lit(100), F.lit(0), F.lit(50)), (F.lit(300), F.lit(192), F.lit(200))
    return wins.where(A.meets_region(192, lo, hi)).groupBy("v").agg(F.count("*").alias("n_windows"))


TOUCH = WINS + """, c AS (SELECT v, w, unnest(range(w // 128, (w + 191) // 128 + 1)) AS c FROM st), tch AS (SELECT a.v, a.c AS cz, y.c AS cy, b.c AS cx FROM c a JOIN c b ON a.v = b.v, (SELECT unnest(range(0, 2)) AS c) y)"""


@query("j16_window_chunks", TOUCH + " SELECT v, CAST(cz AS INT) AS cz, CAST(cy AS INT) AS cy, CAST(cx AS INT) AS cx, count(*) AS n FROM tch GROUP BY ALL")
def j16(t):
    return A.chunk_touches(grid(t), ["v"], 192, 0.5, 128)


@query("a44_grid_amplification", TOUCH + " SELECT v, CAST(sum(n) AS BIGINT) AS touches, count(*) AS distinct_chunks, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS amplification, max(n) AS max_refetch FROM (SELECT v, cz, cy, cx, count(*) AS n FROM tch GROUP BY ALL) GROUP BY 1")
def a44(t):
    touched = A.chunk_touches(grid(t), ["v"], 192, 0.5, 128)
    return A.read_amplification(touched, ["cz", "cy", "cx"], ["v"], "n").withColumn("amplification", r6("amplification"))


@query("a44_log_amplification", "SELECT CAST(sum(n) AS BIGINT) AS touches, count(*) AS distinct_chunks, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS amplification, max(n) AS max_refetch FROM (SELECT chunk, count(*) AS n FROM log WHERE part <> 7 GROUP BY 1)")
def a44b(t):
    return A.read_amplification(t.log.where("part <> 7"), ["chunk"]).withColumn("amplification", r6("amplification"))  # part 7: metadata keys


MORTON = " + ".join(f"((({{z}} >> {b}) & 1) << {3 * b + 2}) + ((({{y}} >> {b}) & 1) << {3 * b + 1}) + ((({{x}} >> {b}) & 1) << {3 * b})" for b in range(21))  # as many bits as morton() takes


@query("f11_morton", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN greatest(l_partkey, l_suppkey, l_linenumber) >= 2097152 OR least(l_partkey, l_suppkey, l_linenumber) < 0 THEN error('a Morton index must have at most 21 bits') ELSE {MORTON.format(z='l_partkey', y='l_suppkey', x='CAST(l_linenumber AS BIGINT)')} END AS key FROM lineitem")
def f11(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", morton("l_partkey", "l_suppkey", "l_linenumber").alias("key"))


# of wider indices the bits above the lowest 21 come first
T6KEYS = ", ".join(MORTON.format(z=f"(bz >> {b})", y=f"(by_ >> {b})", x=f"(bx >> {b})") for b in (21, 0))


@query("t6_morton_order", f"SELECT bz, by_ AS by, bx, row_number() OVER (ORDER BY {T6KEYS}) AS line FROM (SELECT DISTINCT CAST(z AS BIGINT) AS bz, CAST(y AS BIGINT) AS by_, vol * 8 + x AS bx FROM vox)")
def t6(t):
    blocks = t.vox.select(F.col("z").cast("long").alias("bz"), F.col("y").cast("long").alias("by"), (F.col("vol") * 8 + F.col("x")).alias("bx")).distinct()
    laid = cut_lineage(A.in_morton_order(blocks, 8), "laid")
    # the line a block was written to: files in the order of their names, rows in the order of the file
    lines = cut_lineage(laid.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")), "lines")
    return rank_rows(lines, [], [F.asc("file"), F.asc("at")]).select("bz", "by", "bx", F.col("rank").alias("line"))


@query("t4_first_qualifying", "SELECT doc_id FROM (SELECT doc_id FROM docs WHERE n_chars >= 200 ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100)")
def t4(t):
    return t.docs.where("n_chars >= 200").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").limit(100).select("doc_id")


@query("t5_largest_k", "SELECT slab, item, CAST(r AS INT) AS rank FROM (SELECT l_suppkey AS slab, l_partkey AS item, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS r FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE r <= 5")
def t5(t):
    sizes = t.lineitem.groupBy(F.col("l_suppkey").alias("slab"), F.col("l_partkey").alias("item")).agg(F.count("*").alias("size"))
    return P.top_per_group(sizes, ["slab"], [F.desc("size")], ["item"], 5).select("slab", "item", "rank")


@query("t7_sample_per_group", f"SELECT vol, z, y, x FROM vox QUALIFY row_number() OVER (PARTITION BY vol ORDER BY {uniform_sql(0, 'vol', 'z', 'y', 'x')}, z, y, x) <= 20")
def t7(t):
    return P.sample_per_group(t.vox, ["vol"], ["vol", "z", "y", "x"], 20).select("vol", "z", "y", "x")


@query(
    "t8_random_origins",
    "SELECT vol, CAST(b AS INT) AS block_index, " + ", ".join(f"CAST(floor({uniform_sql(i, 'vol', 'b')} * greatest(1, n{a} - 4)) AS INT) AS {a}0" for i, a in enumerate("zyx"))
    + " FROM (SELECT vol, max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM vox GROUP BY 1), (SELECT unnest(range(30)) AS b)",
)
def t8(t):
    shapes = t.vox.groupBy("vol").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in "zyx"])
    return P.random_origins(shapes, 4, 30, ["vol"]).select("vol", "block_index", "z0", "y0", "x0")


@query("t9_batches", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders")
def t9(t):
    ranked = rank_rows(t.orders.select("o_orderkey"), [], [F.asc("o_orderkey")])
    return ranked.select("o_orderkey", F.floor((F.col("rank") - 1) / 1000).alias("batch"))


@query(
    "w13_seeded_split",
    f"""SELECT doc_id, 'test' AS part FROM docs WHERE source = 'src3' UNION ALL
 SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {uniform_sql(0, 'doc_id')}, doc_id) <= 50 THEN 'val' ELSE 'train' END FROM docs WHERE source <> 'src3'""",
)
def w13(t):
    return P.seeded_split(t.docs.select("doc_id", "source"), "doc_id", F.col("source") == "src3", 50).select("doc_id", "part")


@query("w14_job_order", "SELECT CAST(row_number() OVER (ORDER BY seed, arm) AS BIGINT) AS position, seed, arm, n FROM (SELECT seed, arm, count(*) AS n FROM arms GROUP BY 1, 2)")
def w14(t):
    from pyspark.sql import Window

    per = t.arms.groupBy("seed", "arm").agg(F.count("*").alias("n"))  # twelve rows
    return per.select(F.row_number().over(Window.orderBy("seed", "arm")).cast("long").alias("position"), "seed", "arm", "n")


@query(
    "w12_greedy_picks",
    """c AS (SELECT vol, k, z, y, x FROM vox WHERE pred),
 p1 AS (SELECT vol, z, y, x FROM (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY k DESC, z DESC, y DESC, x DESC) AS r FROM c) WHERE r = 1),
 c2 AS (SELECT c.* FROM c JOIN p1 ON c.vol = p1.vol WHERE NOT (abs(c.z - p1.z) < 3 AND abs(c.y - p1.y) < 3 AND abs(c.x - p1.x) < 3)),
 p2 AS (SELECT vol, z, y, x FROM (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY k DESC, z DESC, y DESC, x DESC) AS r FROM c2) WHERE r = 1),
 c3 AS (SELECT c2.* FROM c2 JOIN p2 ON c2.vol = p2.vol WHERE NOT (abs(c2.z - p2.z) < 3 AND abs(c2.y - p2.y) < 3 AND abs(c2.x - p2.x) < 3)),
 p3 AS (SELECT vol, z, y, x FROM (SELECT *, row_number() OVER (PARTITION BY vol ORDER BY k DESC, z DESC, y DESC, x DESC) AS r FROM c3) WHERE r = 1)
 SELECT vol, z AS pick_z, y AS pick_y, x AS pick_x, 1 AS pick FROM p1 UNION ALL SELECT vol, z, y, x, 2 FROM p2 UNION ALL SELECT vol, z, y, x, 3 FROM p3""",
)
def w12(t):
    c = t.vox.where("pred").select("vol", "k", "z", "y", "x")
    return P.greedy_spaced(c, ["vol"], [F.col("k")], ["z", "y", "x"], gap=3, rounds=3)
