"""Artifact catalogue: which prediction belongs to which scan level, and what can be verified."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as _w

from voxelmetry.functions.names import parse_prediction, resolution_um

W = _w.Window


def contiguous_levels(levels: DataFrame, key: Sequence[str], level: str = "level") -> DataFrame:
    """Keeps levels 0, 1, 2, ... of each pyramid up to the first missing one."""
    nth = F.row_number().over(W.partitionBy(*key).orderBy(level))
    return levels.withColumn("_nth", nth).where(F.col("_nth") == F.col(level) + 1).drop("_nth")


def resolve_levels(preds: DataFrame, levels: DataFrame, key: Sequence[str], shape: str = "shape") -> DataFrame:
    """First level of the prediction's own scan (``key``) whose shape equals its own: adds ``actual_level`` (NULL if none)."""
    reachable = contiguous_levels(levels, key)
    first = reachable.groupBy(*key, shape).agg(F.min("level").alias("actual_level"))
    return preds.join(first, [*key, shape], "left")


def match_scans(preds: DataFrame, scans: DataFrame) -> DataFrame:
    """The scan whose name starts with the stamp a prediction records; the first name on a tie."""
    first = scans.groupBy("scroll", F.substring_index("ct_volume", "-", 1).alias("ct")).agg(
        F.min("ct_volume").alias("ct_volume")
    )
    return preds.join(first, ["scroll", "ct"], "left")


def artifact_status(ct_volume: Column, shape: Column, declared: Column, actual: Column) -> Column:
    return (
        F.when(ct_volume.isNull(), "ct_missing")
        .when(shape.isNull(), "pred_unreadable")
        .when(actual.isNull(), "no_matching_level")
        .when(actual == declared, "verifiable")
        .otherwise("level_mismatch")
    )


def build_catalogue(runs: DataFrame, pyramids: DataFrame) -> DataFrame:
    """One row per published prediction, with its scan, levels and status.

    ``runs``: scroll, name, shape. ``pyramids``: scroll, ct_volume, level, shape.
    """
    parsed = runs.withColumn("a", parse_prediction("name")).where(F.col("a").isNotNull())
    preds = parsed.select("scroll", F.col("name").alias("prediction"), "shape", F.col("a.*"))
    scans = pyramids.select("scroll", "ct_volume").distinct()
    matched = match_scans(preds, scans)
    levels = resolve_levels(matched.withColumnRenamed("level", "declared_level"), pyramids.select("scroll", "ct_volume", "level", "shape"), ["scroll", "ct_volume"])
    return levels.select(
        "scroll",
        "prediction",
        F.col("run").alias("run_id"),
        "model",
        "threshold",
        "ct_volume",
        "declared_level",
        "actual_level",
        artifact_status(F.col("ct_volume"), F.col("shape"), F.col("declared_level"), F.col("actual_level")).alias("status"),
    )


def uncovered(scrolls: DataFrame, runs: DataFrame, pyramids: DataFrame) -> DataFrame:
    """Scrolls without a prediction: ``no_prediction`` if there is a scan, else ``no_ct``."""
    named = runs.where(parse_prediction("name").isNotNull()).select("scroll")
    n_ct = pyramids.groupBy("scroll").agg(F.countDistinct("ct_volume").alias("n_ct"))
    left = scrolls.join(named, "scroll", "left_anti").join(n_ct, "scroll", "left")
    n = F.coalesce("n_ct", F.lit(0))
    return left.select("scroll", n.cast("long").alias("n_ct"), F.when(n > 0, "no_prediction").otherwise("no_ct").alias("status"))


def resolve_artifact(catalogue: DataFrame, scroll: str, model: str | None = None, level: int | None = None) -> DataFrame:
    """Exactly one artifact or a failing job whose message lists the alternatives."""
    hits = _matching(catalogue.where(F.col("scroll") == scroll), model, level)
    label = F.concat(F.lit("model "), F.col("model"), F.lit(" level "), F.col("declared_level").cast("string"))
    # one scroll's artifacts: the list is as long as its alternatives
    found = hits.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("prediction", label.alias("l")))).alias("hits"))
    message = F.when(F.col("n") == 0, F.lit(f"no prediction for {scroll}")).otherwise(
        F.concat(F.lit(f"several predictions for {scroll}: "), F.array_join(F.col("hits.l"), "; "))
    )
    checked = found.withColumn("_ok", F.assert_true(F.col("n") == 1, message)).where("_ok IS NULL")
    return checked.select(F.lit(scroll).alias("scroll"), F.get("hits.prediction", 0).alias("prediction"))


def unambiguous(catalogue: DataFrame, model: str | None = None, level: int | None = None) -> DataFrame:
    """The same rule for every scroll at once: how many artifacts match, and the one where it is unique."""
    hits = _matching(catalogue, model, level)
    return hits.groupBy("scroll").agg(
        F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) == 1, F.min("prediction")).alias("prediction")
    )


def _matching(df: DataFrame, model: str | None, level: int | None) -> DataFrame:
    if model:
        df = df.where(F.contains("model", F.lit(model)))
    if level is not None:
        df = df.where(F.col("declared_level") == level)
    return df


def eligible(catalogue: DataFrame, model: str, level: int) -> DataFrame:
    return _matching(catalogue.where("status = 'verifiable'"), model, level)


def near_resolution(volumes: DataFrame, target: float = 9.6, tolerance: float = 0.25, levels: int = 5) -> DataFrame:
    """Pyramid levels whose voxel size lies within the tolerance of the target."""
    sized = volumes.withColumn("um0", resolution_um("ct_volume")).where(F.col("um0").isNotNull())
    each = sized.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("at_level"))
    um = F.col("um0") * F.pow(F.lit(2.0), F.col("at_level"))
    return each.withColumn("um", um).where(F.abs(um - target) / target <= tolerance)


def nearest_resolution(near: DataFrame, by: Sequence[str], voxels: str, target: float = 9.6) -> DataFrame:
    """Per group the level nearest to the target; the larger grid wins a tie."""
    key = F.struct(F.round(F.abs(F.col("um") - target), 9), -F.col(voxels))
    return near.groupBy(*by).agg(F.min_by(F.struct(*[c for c in near.columns if c not in by]), key).alias("b")).select(*by, "b.*")


def best_per_group(df: DataFrame, by: Sequence[str], score: str, order: str) -> DataFrame:
    """Best row per group; the smallest ``order`` wins a tie. One aggregate, no sort of the group."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(order))).alias("b")).select(*by, "b.*")


def coverage_report(catalogue: DataFrame, results: DataFrame, near: float = 0.99) -> DataFrame:
    """One row: artifacts matched of total, scrolls, levels, exact matches."""
    flags = catalogue.join(results, ["scroll", "prediction"], "left")
    return flags.agg(
        F.count(F.lit(1)).alias("n_artifacts"),
        F.count("dice").alias("n_matched"),
        F.countDistinct("scroll").alias("n_scrolls"),
        F.countDistinct("declared_level").alias("n_levels"),
        F.count(F.when(F.col("dice") >= near, 1)).alias("n_near"),
        F.min("dice").alias("min_dice"),
        F.bool_and(F.coalesce(F.col("dice") >= near, F.lit(False))).alias("all_near"),
    )
