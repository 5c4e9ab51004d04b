"""Connected components of voxel masks, and everything measured on them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxelmetry.functions.expr import count_if, ratio, rows_of, share
from voxelmetry.operators import volumes as V
from voxelmetry.operators.blocks import Cut, gathered, joined, packed
from voxelmetry.operators.distribution import cumulative, quantiles_from
from voxelmetry.operators.graph import components
from voxelmetry.operators.spatial import bounding_boxes, near_boxes, nearest_distance
from voxelmetry.session import cut_lineage, spread

BITS = 21  # per axis in a voxel's code


def voxel_code(z: Column, y: Column, x: Column) -> Column:
    """One long per voxel, ordered like (z, y, x)."""
    return F.shiftleft(z.cast("long"), 2 * BITS).bitwiseOR(F.shiftleft(y.cast("long"), BITS)).bitwiseOR(x.cast("long"))


def _local_labels(code: np.ndarray) -> np.ndarray:
    """For sorted voxel codes of one block: the smallest code of each voxel's piece inside the block."""
    label = np.arange(len(code))
    links = []
    for step in (1 << (2 * BITS), 1 << BITS, 1):
        where = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
        hit = np.nonzero(code[where] == code + step)[0]
        links.append(np.stack([hit, where[hit]]))
    a, b = np.concatenate(links, axis=1)
    while True:
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (lo == hi).all():
            break
        np.minimum.at(label, hi, lo)
        while (label[label] != label).any():
            label = label[label]
    return code[label]


def label_voxels(mask: DataFrame, by: Sequence[str], block: int = 16) -> DataFrame:
    """by..., z, y, x, component (code of its smallest voxel), for 6-neighbour connectivity.

    Blocks of bounded size are labelled inside a task each; only voxels on block faces meet their neighbours in a
    join, and the pieces of all blocks are merged as a graph in a few rounds.
    """
    by = list(by)
    # a code holds BITS bits per axis; anything else would meet another voxel's code
    coded = F.lit(True)
    for a in V.AT:
        coded = coded & F.col(a).between(0, (1 << BITS) - 1)
    fits = F.assert_true(coded, F.lit(f"coordinates must lie in 0..{(1 << BITS) - 1}"))
    mask = mask.withColumn("_fits", fits).where("_fits IS NULL")
    cut = Cut(block, 0, None)
    rows = packed(mask, by, [], cut)
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in mask.select(*by).schema) + "z INT, y INT, x INT, piece BIGINT"
    schema, n_keys = to_arrow_schema(T.StructType.fromDDL(ddl)), len(by)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in gathered(batches, n_keys):
            at = np.unique(np.concatenate([np.frombuffer(r["_at"], np.int32) for r in held]))
            z, y, x = (i + o for i, o in zip(np.unravel_index(at, (block,) * 3), cut.core(np.array(key[n_keys:]))[0]))
            piece = _local_labels((z << (2 * BITS)) | (y << BITS) | x)
            own = [pa.array([k] * len(at), f.type) for k, f in zip(key[:n_keys], schema)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(a.astype(np.int32)) for a in (z, y, x)], pa.array(piece)], schema=schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return joined(labelled(batches))

    blocks = [*by, "_bz", "_by", "_bx"]
    local = cut_lineage(spread(rows, *blocks).sortWithinPartitions(*blocks).mapInArrow(label, ddl), "pieces")

    offsets = F.array(
        *[F.when(F.col(a) % block == block - 1, F.struct(*[F.lit(int(b == a)).alias(f"d{b}") for b in V.AT])) for a in V.AT]
    )
    faces = local.select(*by, *V.AT, "piece", F.inline(F.array_compact(offsets)))
    over = faces.select(*by, *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in V.AT], F.col("piece").alias("_from"))
    node = lambda c: F.struct(*by, F.col(c).alias("piece"))
    edges = over.join(local, [*by, *V.AT]).select(node("_from").alias("src"), node("piece").alias("dst")).distinct()
    edges = cut_lineage(edges, "piece_edges")
    # only pieces that touch another one take part in the graph
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    merged = components(nodes, edges).select(*[F.col(f"node.{b}").alias(b) for b in by], F.col("node.piece").alias("piece"), F.col("component.piece").alias("component"))
    found = local.join(merged, [*by, "piece"], "left").withColumn("component", F.coalesce("component", "piece"))
    return cut_lineage(found.drop("piece"), "components")


def sizes(labelled: DataFrame, by: Sequence[str]) -> DataFrame:
    return labelled.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("size"))


def outcomes(labelled: DataFrame, pred: DataFrame, by: Sequence[str], min_size: int = 27, lost_below: float = 0.10) -> DataFrame:
    """Per volume: components, those large enough, lost ones (found share below the limit), largest share, over 1k."""
    here = [*by, *V.AT]
    hit = labelled.join(pred.select(*here, F.lit(1).alias("_hit")), here, "left")
    per = hit.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("size"), F.count("_hit").alias("found"))
    big = F.col("size") >= min_size
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("components"),
        count_if(big).alias("scored_components"),
        count_if(big & (F.col("found") / F.col("size") < lost_below)).alias("lost"),
        ratio(F.max("size"), F.sum("size")).alias("largest_share"),
        count_if(F.col("size") > 1000).alias("over_1k"),
    )


def phantom_components(labelled: DataFrame, empty: DataFrame, by: Sequence[str], share_needed: float = 0.9) -> DataFrame:
    """Per volume: predicted components, those lying (almost) wholly on empty scan, and their voxels."""
    here = [*by, *V.AT]
    hit = labelled.join(empty.select(*here, F.lit(1).alias("_e")), here, "left")
    per = hit.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("size"), F.count("_e").alias("n_e"))
    bad = F.col("n_e") / F.col("size") >= share_needed
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("components"), count_if(bad).alias("phantom_components"), ratio(F.sum(F.when(bad, F.col("size")).otherwise(0)), F.sum("size")).alias("phantom_volume_share")
    )


def islands(labelled: DataFrame, sheet: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per volume: share of predicted voxels in components that hold no labelled sheet."""
    here = [*by, *V.AT]
    per = labelled.join(sheet.select(*here, F.lit(1).alias("_s")), here, "left").groupBy(*by, "component").agg(F.count(F.lit(1)).alias("size"), F.count("_s").alias("n_s"))
    return per.groupBy(*by).agg(ratio(F.sum(F.when(F.col("n_s") == 0, F.col("size")).otherwise(0)), F.sum("size")).alias("island_fraction"))


def fragments(sheet_parts: DataFrame, pred_parts: DataFrame, by: Sequence[str], min_size: int = 200) -> DataFrame:
    """Per volume: in how many more than one predicted components each labelled component of some size lies, on average."""
    kept = sizes(sheet_parts, by).where(F.col("size") >= min_size).select(*by, "component")
    over = sheet_parts.join(kept, [*by, "component"]).join(pred_parts.withColumnRenamed("component", "_p"), [*by, *V.AT], "left")
    n = over.groupBy(*by, "component").agg(F.countDistinct("_p").alias("pieces"))
    return n.groupBy(*by).agg(F.count(F.lit(1)).alias("measured"), F.avg(F.greatest(F.col("pieces") - 1, F.lit(0))).alias("fragments"))


def enclosed_misses(mask: DataFrame, sheet: DataFrame, by: Sequence[str], shape: Sequence[int], block: int = 16) -> DataFrame:
    """Per volume: share of the labelled sheet that the mask misses but encloses on all sides (hole_frac)."""
    here = [*by, *V.AT]
    inside = cavities(mask, sheet, by, shape, block).select(*here, F.lit(1).alias("_in"))
    return sheet.select(*here).join(inside, here, "left").groupBy(*by).agg(ratio(F.count("_in"), F.count(F.lit(1))).alias("hole_frac"))


def cavities(mask: DataFrame, volumes: DataFrame, by: Sequence[str], shape: Sequence[int], block: int = 16) -> DataFrame:
    """Background voxels that no path of background joins to the volume's border. (Degenerate for open sheets.)"""
    grid = volumes.select(*by).distinct()
    for a, n in zip(V.AT, shape):
        grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(a))
    back = label_voxels(grid.join(mask.select(*by, *V.AT), [*by, *V.AT], "left_anti"), by, block)
    border = F.lit(False)
    for a, n in zip(V.AT, shape):
        border = border | (F.col(a) == 0) | (F.col(a) == n - 1)
    open_parts = back.where(border).select(*by, "component").distinct()
    return back.join(open_parts, [*by, "component"], "left_anti").select(*by, *V.AT)


def close_and_trim(voxels: DataFrame, by: Sequence[str], shape: Sequence[int], threshold: float, offsets: Sequence[tuple], min_size: int, block: int = 16) -> DataFrame:
    """Closed prediction without small components, brought back to the budget of the unprocessed one.

    ``voxels``: by..., z, y, x, p, label. Returns the stored voxels that remain.
    """
    by = list(by)
    here = [*by, *V.AT]
    base = voxels.where(F.col("p") > threshold)
    closed = cut_lineage(V.close(base, by, shape, offsets), "closed")
    parts = label_voxels(closed, by, block)
    large = sizes(parts, by).where(F.col("size") >= min_size).select(*by, "component")
    kept = parts.join(large, [*by, "component"], "left_semi").select(*here, F.lit(True).alias("_kept"))
    score = F.when(F.col("_kept"), F.greatest(F.col("p"), F.lit(threshold + 1e-6))).otherwise(0.0)
    v = cut_lineage(voxels.join(kept, here, "left").withColumn("_score", score).withColumn("_kept", F.coalesce("_kept", F.lit(False))), "post")
    scored = F.col("label") != 2
    budget = v.groupBy(*by).agg(
        share(count_if((F.col("p") > threshold) & scored), count_if(scored)).alias("_budget"), share(count_if(F.col("_kept") & scored), count_if(scored)).alias("_extra")
    )
    # the quantile differs per volume: both neighbours of its position come from the running counts
    cum = cumulative(v.where(scored), "_score", by).join(budget, by)
    pos = (1 - F.col("_budget")) * (F.col("total") - 1)
    at = lambda f: F.min(F.when(F.col("cum") > f(pos), F.col("_score")))
    cuts = cum.groupBy(*by, "_budget", "_extra").agg(at(F.floor).alias("_lo"), at(F.ceil).alias("_hi"), F.max(pos - F.floor(pos)).alias("_w"))
    cuts = cuts.withColumn("_t2", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w"))
    out = v.join(cuts, by)
    return out.where(F.col("_kept") & ((F.col("_extra") <= F.col("_budget")) | (F.col("_score") > F.col("_t2")))).select(*voxels.columns)


def close_pairs(mask: DataFrame, by: Sequence[str], near: float = 6.0, min_size: int = 100, block: int = 16) -> DataFrame:
    """Per volume: components kept, pairs closer than ``near`` and their smallest gap.

    All boundary voxels of all components of some size take part; the join of their boxes bounds the work.
    """
    by = list(by)
    parts = label_voxels(mask, by, block)
    kept = sizes(parts, by).where(F.col("size") >= min_size)
    mine = cut_lineage(parts.join(kept.select(*by, "component"), [*by, "component"], "left_semi"), "kept")
    # components do not touch, so eroding the whole mask erodes each component
    shell = mine.join(V.erode(mine, by), [*by, *V.AT], "left_anti")
    pts = cut_lineage(shell.select(*by, F.col("component").alias("part"), *[F.col(a).cast("double").alias(a) for a in V.AT]), "shell")
    cand = near_boxes(bounding_boxes(pts, [*by, "part"]), by, "part", near)
    gaps = nearest_distance(pts, cand, by, "part", limit=near)
    n = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("components"))
    pairs = gaps.groupBy(*by).agg(F.count(F.lit(1)).alias("close_pairs"), F.min("distance").alias("smallest_gap"))
    return n.join(pairs, by, "left").withColumn("close_pairs", F.coalesce("close_pairs", F.lit(0)))


def describe_volumes(voxels: DataFrame, by: Sequence[str], shape: Sequence[int], sigma: float = 1.5, min_sheet: int = 100, block: int = 16) -> DataFrame:
    """Per volume: thickness, spacing, scan contrast, fragmentation and flatness of the labelled sheet.

    ``voxels``: by..., z, y, x, ct, label.
    """
    by = list(by)
    full = cut_lineage(V.dense(voxels.withColumn("_s", F.when(F.col("label") == 1, 1).otherwise(0)), by, shape, "_s").join(voxels.select(*by, *V.AT, "ct"), [*by, *V.AT], "left").withColumn("ct", F.coalesce("ct", F.lit(0))), "dense")
    sheet, rest = full.where("_s = 1"), full.where("_s = 0")
    ok = sheet.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sheet")).where(F.col("n_sheet") >= min_sheet)
    n = shape[0] * shape[1] * shape[2]
    inside = cumulative(V.distance(sheet, rest, by, shape), "distance", by)
    outside = cumulative(V.distance(rest, sheet, by, shape), "distance", by)
    thick = inside.groupBy(*by).agg((2 * F.sum(F.col("distance") * F.col("n")) / F.sum("n")).alias("thickness_mean"))
    thick90 = quantiles_from(inside, "distance", {"q": 0.9}, by).select(*by, (2 * F.col("q")).alias("thickness_p90"))
    spacing = quantiles_from(outside, "distance", {"m": 0.5, "q": 0.1}, by).select(*by, (2 * F.col("m")).alias("spacing_median"), (2 * F.col("q")).alias("spacing_p10"))
    contrast = full.groupBy(*by).agg(
        F.avg(F.when(F.col("_s") == 1, F.col("ct"))).alias("ct_sheet_mean"), F.avg(F.when(F.col("_s") == 0, F.col("ct"))).alias("ct_bg_mean"), F.stddev_pop(F.when(F.col("_s") == 0, F.col("ct"))).alias("ct_bg_std")
    ).withColumn("contrast_sigma", F.coalesce(ratio(F.col("ct_sheet_mean") - F.col("ct_bg_mean"), "ct_bg_std"), F.lit(0.0)))
    parts = label_voxels(sheet, by, block)
    frag = sizes(parts, by).groupBy(*by).agg(F.count(F.lit(1)).alias("components"), ratio(F.max("size"), F.sum("size")).alias("largest_component_frac"), count_if(F.col("size") > 1000).alias("components_over_1k"))
    grad = V.gradient(V.gaussian(full.select(*by, *V.AT, "_s"), by, shape, sigma, "_s"), by, shape, "_s")
    mag = F.sqrt(F.col("gz") * F.col("gz") + F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx"))
    normals = sheet.select(*by, *V.AT).join(grad, [*by, *V.AT]).withColumn("_m", mag).where("_m > 1e-3").select(*by, *[(F.col(f"g{a}") / F.col("_m")).alias(f"n{a}") for a in V.AT])
    flat = V.structure_tensor(normals, by).where(F.col("n") > 50).select(*by, F.col("anisotropy").alias("normal_anisotropy"), "flatness")
    out = ok.select(*by, (F.col("n_sheet") / F.lit(float(n))).alias("sheet_fraction"))
    for part in (thick, thick90, spacing, contrast, frag):
        out = out.join(part, by)
    return out.join(flat, by, "left").withColumn("status", F.lit("ok"))
