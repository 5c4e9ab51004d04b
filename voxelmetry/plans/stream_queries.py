"""Queries on incremental work and on sinks: each writes under the shared checkpoint folder and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxelmetry.functions.expr import r6
from voxelmetry.operators.stats import rank_rows, selected_within
from voxelmetry.plans.registry import query
from voxelmetry.plans.score_queries import _rounded
from voxelmetry.plans.stats_queries import RANK
from voxelmetry.session import checkpoint_root, cut_lineage
from voxelmetry.sources import records as R
from voxelmetry.streaming import incremental as N


def place(t, name):
    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


def events(t):
    # the pattern meets one file as well as a folder of part files
    s = N.file_stream(t.spark, f"{t.sf_dir}/events.parquet*", t.events.schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("r1_incremental_scoring", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def r1(t):
    sums = {"n": F.count("*"), "total": F.sum("value"), "measured": F.count("value")}
    return N.score_new_entities(events(t), "user_id", sums, {"n": F.col("n"), "mean": r6(F.col("total") / F.col("measured"))}, place(t, "scores"), place(t, "r1"))


@query("r1_running_quantiles", """c AS (SELECT event_type, value, greatest(least(floor(value / 500 * 4096), 4095), 0) AS b FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY b) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM c)
 SELECT event_type, any_value(n) AS n, round(500 / 4096.0::DOUBLE * (max(b) FILTER (WHERE k = floor(0.5::DOUBLE * (n - 1))) + 0.5::DOUBLE), 6) AS median FROM o GROUP BY 1""")
def r1q(t):
    N.state_store(t.spark)
    out = place(t, "quantiles")
    q = N.running_quantiles(events(t), "event_type", "value", 0.0, 500.0, 4096, {"median": 0.5})
    N.run_available(q, lambda df, b: N.write_batch(df, out, b), place(t, "r1q"), "update")
    return _rounded(N.latest(t.spark, out, ["event_type"]))


@query("r2_batch_manifest", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def r2(t):
    out = place(t, "manifest")

    def twice(df, batch):
        N.write_batch(df, out, batch)
        N.write_batch(df, out, batch)  # a replay of the batch must not double its rows

    N.run_available(events(t), twice, place(t, "r2"))
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("r3_progress_windows", "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, min(value) AS low, 0::BIGINT AS n_late FROM events GROUP BY 1")
def r3(t):
    out = place(t, "progress")
    late = N.run_available(N.progress(events(t), "ts", "value", "6 hours", "60 days"), lambda df, b: N.write_batch(df, out, b), place(t, "r3"), "update")
    # rows that came after their window was closed are in no window, so their number stands beside all of them
    return N.latest(t.spark, out, ["start"]).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "low", F.lit(late).cast("long").alias("n_late"))


@query("r4_running_summary", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (WHERE value < 20) AS n_below FROM events GROUP BY 1")
def r4(t):
    out = place(t, "summary")
    N.run_available(N.running_summary(events(t), ["event_type"], "value", 20.0), lambda df, b: N.write_batch(df, out, b), place(t, "r4"), "update")
    return N.latest(t.spark, out, ["event_type"]).withColumn("total", F.round("total", 4))


@query("r4_record_medians", "SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.05), 6) AS p5 FROM events GROUP BY 1")
def r4b(t):
    out = place(t, "records")
    N.run_available(events(t), lambda df, b: N.write_batch(df, out, b), place(t, "r4b"))
    return _rounded(N.record_summary(t.spark, out, ["event_type"], "value"))


@query("r5_duplicate_content", "SELECT event_type, count(DISTINCT value) AS n_first, 0::BIGINT AS n_late FROM events GROUP BY 1")
def r5(t):
    out = place(t, "first")
    digest = F.sha2(F.concat_ws("|", "event_type", F.col("value").cast("string")), 256)
    late = N.run_available(N.first_occurrences(events(t), "ts", digest, "60 days"), lambda df, b: N.write_batch(df, out, b), place(t, "r5"))
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n_first"), F.lit(late).cast("long").alias("n_late"))


@query("k1_report_sink", "SELECT status, count(*) AS n, round(sum(value), 4) AS total FROM records GROUP BY 1")
def k1(t):
    out = place(t, "reports")
    R.write_reports(t.records.select("entity", "status", "value"), out, "status")
    back = t.spark.read.schema("entity LONG, value DOUBLE, status STRING").json(out)
    return back.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("k2_ranking_sink", RANK + " SELECT item, slab, rank AS rank_within_slab, n_in_group AS n_in_slab, rank <= greatest(1, round_even(0.1::DOUBLE * n_in_group, 0)) AS selected, row_number() OVER (ORDER BY slab, rank) AS line FROM rk")
def k2(t):
    out = place(t, "ranking")
    sc = t.feat.select("item", "slab", F.round("dense", 9).alias("score"))
    ranked = rank_rows(sc, ["slab"], [F.desc("score"), F.asc("item")]).withColumn("selected", selected_within(0.1))
    ranked = ranked.withColumnRenamed("rank", "rank_within_slab").withColumnRenamed("n_in_group", "n_in_slab")
    cols = ["item", "slab", "rank_within_slab", "n_in_slab", "selected"]
    R.write_ranking(ranked, out, cols, {"budget": 0.1, "features": ["dense"]}, order=["slab", "rank_within_slab"])
    back = t.spark.read.schema("item LONG, slab INT, rank_within_slab LONG, n_in_slab LONG, selected BOOLEAN").option("header", True).csv(f"{out}/ranking")
    # the line a row stands in: files in the order of their names, rows in the order of the file
    lines = cut_lineage(back.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")), "lines")
    return rank_rows(lines, [], [F.asc("file"), F.asc("at")]).select(*cols, F.col("rank").alias("line"))


@query("k3_label_sink", "SELECT vol, CAST(label AS INT) AS label, count(*) AS n FROM vox GROUP BY 1, 2")
def k3(t):
    out = place(t, "labels")
    # folders by shard, not by volume, so that their number stays bounded
    R.write_labels(t.vox.select("vol", "z", "y", "x", "label", (F.col("vol") % 8).alias("shard")), out, "shard")
    back = t.spark.read.parquet(out)
    return back.groupBy("vol", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


@query("k4_probability_cache", "SELECT vol, count(*) AS n, round(avg(CAST(CAST(p AS FLOAT) AS DOUBLE)), 6) AS mean FROM vox GROUP BY 1")
def k4(t):
    out = place(t, "cache")
    R.write_probabilities(t.vox.select("vol", "z", "y", "x", "p"), out)
    return t.spark.read.parquet(out).groupBy("vol").agg(F.count("*").alias("n"), r6(F.avg(F.col("p").cast("double"))).alias("mean"))

