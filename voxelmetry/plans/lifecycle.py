"""The three end-to-end jobs: regional match of published masks, patch review, and recall records with summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmetry.functions.expr import count_if, ratio, sigmoid_of_logits
from voxelmetry.operators import components as C
from voxelmetry.operators import learn as L
from voxelmetry.operators import patches as G
from voxelmetry.operators import score as S
from voxelmetry.operators import volumes as V
from voxelmetry.operators.distribution import quantiles
from voxelmetry.operators.strata import paired_contrast
from voxelmetry.operators.volumes import distance
from voxelmetry.session import cut_lineage
from voxelmetry.sources.records import write_ranking


def regional_match(logits: DataFrame, by: Sequence[str], published: Column, threshold: float) -> DataFrame:
    """One verification record per region: agreement, best threshold, near-threshold shares, verdict."""
    by = list(by)
    v = cut_lineage(logits.select(*by, sigmoid_of_logits("l0", "l1").alias("p"), published.alias("pub")), "match")
    base = S.mask_agreement(v, by, F.col("p") > threshold, F.col("pub"))
    best = S.best_threshold(S.threshold_sweep(v, by, F.col("pub")), base, by, threshold).drop("dice")
    near = S.near_threshold_share(v, by, F.col("pub"), threshold).drop("n")
    out = base.join(best, by).join(near, by, "left")
    return out.withColumn("verdict", S.verdict(F.col("dice"), F.col("best_dice")))


def review_patches(nodes: DataFrame, model: dict, budget: float, digits: int = 15, **features) -> DataFrame:
    """Nodes to a ranked review list; scores are rounded to ``digits`` so that reruns give the same bytes."""
    f = G.extract_features(nodes, **features)
    return L.rank_for_review(f, model, budget, digits=digits)


def review_report(nodes: DataFrame, model: dict, budget: float, path: str, digits: int = 15, sizes: dict | None = None, **features) -> DataFrame:
    """Writes the ranking with its model, and beside it the patches that can't be ranked with the reason of each; returns those.

    ``sizes``: the least nodes, interior nodes and normals of a patch (min_nodes, min_interior, min_normals).
    """
    sizes = sizes or {}
    skipped = cut_lineage(G.skipped_patches(nodes, **sizes), "skipped")
    ranking = review_patches(nodes, model, budget, digits, **features, **sizes)
    columns = ["patch", "slab", "rank_within_slab", "n_in_slab", "selected", "score", *model["features"]]
    write_ranking(ranking, path, columns, {"budget": budget, **sizes}, ["slab", "rank_within_slab"], model, skipped)
    return skipped


def recall_records(voxels: DataFrame, by: Sequence[str], shape: Sequence[int], threshold: float = S.THRESHOLD, block: int = 16, **guards) -> DataFrame:
    """Per volume: endpoints, component outcomes, and how far missed sheet lies from anything that was predicted.

    ``missed_far_frac`` is the share of missed voxels more than 3 away, ``sheet_mean_depth`` the mean distance of sheet
    to the nearest voxel that is none; contrasts of missed against found sheet are in ``missed_contrasts``. Without any
    prediction the distance is NULL (the published records say 999), and with nothing missed it is 0.
    """
    by = list(by)
    here = [*by, "z", "y", "x"]
    ends = S.endpoints(voxels, by, threshold, **guards)
    sheet = voxels.where(F.col("label") == S.SHEET)
    parts = C.label_voxels(sheet.select(*here), by, block)
    pred = voxels.where(F.col("p") > threshold)
    found = C.outcomes(parts, pred, by)
    missed = sheet.where(F.col("p") <= threshold).select(*here)
    far = cut_lineage(distance(missed, pred.select(*here), by, shape), "orphans")
    q = quantiles(far.where("distance IS NOT NULL"), "distance", {"orphan_dist_median": 0.5, "orphan_dist_p90": 0.9}, by).drop("n")
    beyond = far.groupBy(*by).agg(F.count(F.lit(1)).alias("_n_missed"), ratio(count_if(F.coalesce(F.col("distance") > 3, F.lit(True))), F.count(F.lit(1))).alias("missed_far_frac"))
    depth = sheet_depth(sheet.select(*here), by, shape).groupBy(*by).agg(F.avg("depth").alias("sheet_mean_depth"))
    out = ends.join(found, by, "left").join(q, by, "left").join(beyond, by, "left").join(depth, by, "left")
    none = F.col("_n_missed").isNull() & F.col("recall").isNotNull()
    for c in ("orphan_dist_median", "orphan_dist_p90", "missed_far_frac"):
        out = out.withColumn(c, F.when(none, F.lit(0.0)).otherwise(F.col(c)))
    return out.drop("_n_missed")


def sheet_depth(sheet: DataFrame, by: Sequence[str], shape: Sequence[int]) -> DataFrame:
    """Adds ``depth``: the distance of each sheet voxel to the nearest cell of its volume that is not sheet."""
    cells = V.dense(sheet.withColumn("_s", F.lit(1)), by, shape, "_s").where("_s = 0")
    return distance(sheet, cells.select(*by, *V.AT), by, shape, name="depth")


def missed_contrasts(voxels: DataFrame, by: Sequence[str], shape: Sequence[int], threshold: float = S.THRESHOLD, block: int = 16) -> DataFrame:
    """by, field, missed_median, found_median, delta_z of sheet depth, scan value, its local spread and component size.

    ``voxels``: by, z, y, x, p, label, ct. Missed and found sheet are compared inside each volume.
    """
    by = list(by)
    here = [*by, "z", "y", "x"]
    sheet = cut_lineage(voxels.where(F.col("label") == S.SHEET).select(*here, "p", F.col("ct").cast("double").alias("ct")), "sheet")
    parts = C.label_voxels(sheet.select(*here), by, block)
    size = parts.join(C.sizes(parts, by), [*by, "component"]).select(*here, F.col("size").cast("double").alias("component_size"))
    local = V.box_statistics(V.dense(voxels, by, shape, "ct"), by, shape, value="ct").select(*here, F.col("local_std").alias("ct_local_std"))
    each = sheet_depth(sheet, by, shape).join(size, here).join(local, here)
    return paired_contrast(cut_lineage(each, "contrast"), by, ["depth", "ct", "ct_local_std", "component_size"], F.col("p") <= threshold)
