"""Spatial joins without all-pairs work: boxes within a distance, nearest points of two sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelmetry.functions.expr import squared_distance
from voxelmetry.session import cut_lineage

XYZ = ["x", "y", "z"]


def bounding_boxes(points: DataFrame, key: Sequence[str]) -> DataFrame:
    return points.groupBy(*key).agg(
        *[f(a).alias(f"{s}{a}") for a in XYZ for f, s in ((F.min, "lo_"), (F.max, "hi_"))], F.count(F.lit(1)).alias("n_points")
    )


def _gap(a: str, b: str) -> Column:
    """Distance between two boxes whose columns carry the given prefixes."""
    per_axis = [F.greatest(F.col(f"{a}lo_{c}") - F.col(f"{b}hi_{c}"), F.col(f"{b}lo_{c}") - F.col(f"{a}hi_{c}"), F.lit(0.0)) for c in XYZ]
    return F.sqrt(per_axis[0] * per_axis[0] + per_axis[1] * per_axis[1] + per_axis[2] * per_axis[2])


def _prefixed(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def near_boxes(boxes: DataFrame, group: Sequence[str], item: str, radius: float, cell: float | None = None) -> DataFrame:
    """Pairs a < b of one group whose boxes lie within ``radius``: group..., a, b, box_gap.

    Boxes are put into the grid cells they touch and met there by an equi-join. A pair sharing several cells is
    reported only by the cell that holds the low corner of their overlap, so no later distinct is needed. The cell
    defaults to the mean box side (at least the radius), so that a box touches few cells and a cell few strangers.
    """
    if cell:
        size = F.lit(float(cell))
    else:
        side = sum((F.avg(F.col(f"hi_{a}") - F.col(f"lo_{a}")) for a in XYZ), F.lit(0.0)) / 3
        size = F.greatest(boxes.agg(side).scalar(), F.lit(float(radius)))
    wide = boxes.select(*group, item, *[c for a in XYZ for c in (f"lo_{a}", f"hi_{a}")])
    cells = lambda df, grow: _explode_cells(df, size, grow)
    left = _prefixed(cells(wide, radius), "a_", [*group, "_cx", "_cy", "_cz"])
    right = _prefixed(cells(wide, 0.0), "b_", [*group, "_cx", "_cy", "_cz"])
    met = left.join(right, [*group, "_cx", "_cy", "_cz"]).where(F.col(f"a_{item}") < F.col(f"b_{item}"))
    corner = F.lit(True)
    for a in XYZ:
        low = F.greatest(F.col(f"a_lo_{a}") - radius, F.col(f"b_lo_{a}"))
        corner = corner & (F.floor(low / size) == F.col(f"_c{a}"))
    out = met.where(corner).withColumn("box_gap", _gap("a_", "b_")).where(F.col("box_gap") <= radius)
    return out.select(*group, F.col(f"a_{item}").alias("a"), F.col(f"b_{item}").alias("b"), "box_gap")


def _explode_cells(df: DataFrame, size: Column, grow: float) -> DataFrame:
    for a in XYZ:
        first, last = F.floor((F.col(f"lo_{a}") - grow) / size), F.floor((F.col(f"hi_{a}") + grow) / size)
        df = df.select("*", F.explode(F.sequence(first, last)).alias(f"_c{a}"))
    return df


def nearest_distance(
    points: DataFrame, pairs: DataFrame, group: Sequence[str], item: str, limit: float | None = None, splits: Sequence[int] | None = None, witness: bool = False
) -> DataFrame:
    """Exact smallest point distance of each pair (group..., a, b), optionally with the two points.

    Two items of at most WHOLE points each are compared inside a task, as packed rows: one row of a shuffle for each pair.
    Points of larger items never meet all against all. Each such item is cut into boxes, ``splits`` per axis, coarse to fine: halves, quarters
    and so on until a box of the largest item holds a few points, unless given. At each level only the boxes below
    kept box pairs meet, at most 64 for each, and of them those stay whose smallest possible distance does not exceed the
    smallest distance between one point of each box. Only the points of the remaining boxes are compared.
    """
    group = list(group)
    pts = points.select(*group, item, *XYZ).distinct()
    frame = cut_lineage(bounding_boxes(pts, [*group, item]), "frames")
    largest = frame.agg(F.max("n_points")).first()[0] or 1
    small = frame.where(F.col("n_points") <= WHOLE).select(*group, item)
    if largest <= WHOLE:
        return _nearest_whole(pts, pairs.select(*group, "a", "b"), group, item, limit, witness)
    # pairs of two small items are compared whole, the others by boxes
    for side in ("a", "b"):
        pairs = pairs.join(small.select(*group, F.col(item).alias(side), F.lit(True).alias(f"_small_{side}")), [*group, side], "left")
    whole = F.coalesce(F.col("_small_a") & F.col("_small_b"), F.lit(False))
    pairs = cut_lineage(pairs.select(*group, "a", "b", whole.alias("_whole")), "pairs")
    few = _nearest_whole(pts.join(small, [*group, item], "left_semi"), pairs.where("_whole").drop("_whole"), group, item, limit, witness)
    many = _nearest_by_boxes(pts, frame, pairs.where("NOT _whole").drop("_whole"), group, item, limit, splits or _levels(largest), witness)
    return few.unionByName(many)


# points of an item that is compared whole; two such items are a matrix of half a megabyte
WHOLE = 256


def _nearest_whole(points: DataFrame, pairs: DataFrame, group: Sequence[str], item: str, limit: float | None, witness: bool) -> DataFrame:
    """``nearest_distance`` of items of at most WHOLE points: they are packed, joined to their pairs and compared in the task."""
    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in XYZ)
    packed = points.where(known).groupBy(*group, item).agg(F.array_sort(F.collect_list(F.struct(*XYZ))).alias("p")).select(*group, item, *[F.col(f"p.{c}").alias(c) for c in XYZ])
    packed = cut_lineage(packed, "packed")
    met = pairs
    for side in ("a", "b"):
        # neither side is sorted, and the files of packed points don't choose a broadcast
        named = packed.select(*group, F.col(item).alias(side), *[F.col(c).alias(f"{side}_{c}") for c in XYZ])
        met = met.join(named.hint("shuffle_hash"), [*group, side])
    n_keys = len(group) + 2
    names = [*group, "a", "b"]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in met.select(*names).schema) + "distance DOUBLE"
    if witness:
        ddl += "".join(f", {s}_{c} DOUBLE" for s in "ab" for c in XYZ)

    def sides(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Points of a side in row order, and where each row's begin (and the end of the last)."""
        columns = batch.columns[first : first + 3]
        ends = np.concatenate([[0], np.cumsum(columns[0].value_lengths().to_numpy())])
        return np.stack([c.flatten().to_numpy().astype(np.float64) for c in columns], axis=1), ends

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(start, PAIRS)
                (p, p_at), (q, q_at) = sides(batch, n_keys), sides(batch, n_keys + 3)
                n, m = np.diff(p_at), np.diff(q_at)
                best, i, j = np.empty(len(n)), np.empty(len(n), np.int64), np.empty(len(n), np.int64)
                # pairs of equal sizes are one array, a bounded number of them at a time
                size, of = np.unique(np.stack([n, m], axis=1), axis=0, return_inverse=True)
                for k, (a, b) in enumerate(size):
                    rows = np.flatnonzero(of.ravel() == k)
                    for part in np.array_split(rows, -(-len(rows) * int(a * b) // CELLS)):
                        left, right = p[p_at[part][:, None] + np.arange(a)], q[q_at[part][:, None] + np.arange(b)]
                        d2 = sum((left[:, :, None, c] - right[:, None, :, c]) ** 2 for c in range(3)).reshape(len(part), -1)
                        # points are sorted: of equal distances the first is that of the first positions
                        at = d2.argmin(axis=1)
                        best[part] = d2[np.arange(len(part)), at]
                        i[part], j[part] = p_at[part] + at // b, q_at[part] + at % b
                distance = np.sqrt(best)
                keep = np.flatnonzero(distance <= (np.inf if limit is None else limit))
                found = [c.take(pa.array(keep)) for c in batch.columns[:n_keys]] + [pa.array(distance[keep])]
                if witness:
                    found += [pa.array(side[at[keep], c]) for side, at in ((p, i), (q, j)) for c in range(3)]
                yield pa.RecordBatch.from_arrays(found, [*names, "distance", *([f"{s}_{c}" for s in "ab" for c in XYZ] if witness else [])])

    return met.select(*names, *[f"{s}_{c}" for s in "ab" for c in XYZ]).mapInArrow(work, ddl)


# pairs, and squared distances, that a task holds at once
PAIRS, CELLS = 2_000, 1 << 16


def _nearest_by_boxes(
    pts: DataFrame, frame: DataFrame, pairs: DataFrame, group: Sequence[str], item: str, limit: float | None, splits: Sequence[int], witness: bool
) -> DataFrame:
    """``nearest_distance`` by levels of boxes."""
    pts = pts.join(frame.drop("n_points"), [*group, item])
    ids: list[str] = []
    for s in splits:
        cell = [
            F.least(F.floor(F.try_divide(F.col(a) - F.col(f"lo_{a}"), F.col(f"hi_{a}") - F.col(f"lo_{a}")) * s), F.lit(s - 1)) for a in XYZ
        ]
        pts = pts.withColumn(f"_box{s}", F.struct(*[F.coalesce(c, F.lit(0)).alias(a) for c, a in zip(cell, XYZ)]))
        ids.append(f"_box{s}")
    # read once per level and side below
    pts = cut_lineage(pts.select(*group, item, *XYZ, *ids), "points")

    keep = pairs.select(*group, "a", "b")
    pair = [*group, "a", "b"]
    for level in range(len(ids)):
        # any point of each box, the same one in every run: its distance to another box's point bounds the smallest one
        some = F.min_by(F.struct(*XYZ), F.struct(F.xxhash64(*XYZ), *XYZ)).alias("some")
        inside = [*group, item, *ids[: level + 1]]
        boxes = pts.groupBy(*inside).agg(*[f(a).alias(f"{s}{a}") for a in XYZ for f, s in ((F.min, "lo_"), (F.max, "hi_"))], some)
        parents = ids[:level]
        # of each side: the boxes of this level below the boxes kept so far
        for side in ("a", "b"):
            named = boxes.select(
                *group, F.col(item).alias(side), *[F.col(p).alias(f"{side}{p}") for p in ids[: level + 1]], *[F.col(f"{s}{c}").alias(f"{side}_{s}{c}") for c in XYZ for s in ("lo_", "hi_")], F.col("some").alias(f"{side}_some"),
            )
            keep = keep.join(named, [*group, side, *[f"{side}{p}" for p in parents]])
        keep = keep.withColumn("_low", _gap("a_", "b_")).withColumn("_high", F.sqrt(squared_distance([f"a_some.{c}" for c in XYZ], [f"b_some.{c}" for c in XYZ])))
        keep = keep.select(*pair, *[f"{side}{p}" for side in ("a", "b") for p in ids[: level + 1]], "_low", F.min("_high").over(W.partitionBy(*pair)).alias("_bound"))
        keep = keep.where(F.col("_low") <= F.col("_bound") * (1 + 1e-12))
        if limit is not None:
            keep = keep.where(F.col("_low") <= limit)
        keep = keep.select(*pair, *[f"{side}{p}" for side in ("a", "b") for p in ids[: level + 1]])
        keep = cut_lineage(keep, "levels" if level + 1 < len(ids) else "box-pairs")

    joined = keep
    for side in ("a", "b"):
        named = pts.select(*group, F.col(item).alias(side), *[F.col(p).alias(f"{side}{p}") for p in ids], *[F.col(c).alias(f"{side}{c}") for c in XYZ])
        joined = joined.join(named, [*group, side, *[f"{side}{p}" for p in ids]])
    d2 = squared_distance([f"a{c}" for c in XYZ], [f"b{c}" for c in XYZ])
    if witness:
        place = F.struct(d2.alias("d2"), *[F.col(f"{s}{c}") for s in "ab" for c in XYZ])
        best = joined.groupBy(*pair).agg(F.min(place).alias("w"))  # nearest first, then by position
        out = best.select(*pair, F.sqrt("w.d2").alias("distance"), *[F.col(f"w.{s}{c}").alias(f"{s}_{c}") for s in "ab" for c in XYZ])
    else:
        out = joined.groupBy(*pair).agg(F.sqrt(F.min(d2)).alias("distance"))
    return out if limit is None else out.where(F.col("distance") <= limit)


# points that a box of the finest level holds about, on a surface
POINTS_PER_BOX = 8


def _levels(n: int) -> list[int]:
    """Halvings for an item of n points that lie on a surface."""
    levels = [2]
    while levels[-1] ** 2 * POINTS_PER_BOX < n:
        levels.append(2 * levels[-1])
    return levels


def pair_distances(points: DataFrame, group: Sequence[str], item: str, near: float, **kw) -> DataFrame:
    """Box candidates within ``near`` with their exact distance, which may exceed ``near``."""
    boxes = cut_lineage(bounding_boxes(points, [*group, item]), "boxes")
    cand = near_boxes(boxes, group, item, near)
    return nearest_distance(points, cand, group, item, **kw)


def range_minimum(points: DataFrame, group: Sequence[str], item: str, radius: float, **kw) -> DataFrame:
    """Pairs of items with any points within ``radius``, and their smallest distance."""
    return pair_distances(points, group, item, radius, limit=radius, **kw)


def both_ways(edges: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Each undirected pair a, b as two rows src, dst."""
    one = edges.select(*keep, F.col("a").alias("src"), F.col("b").alias("dst"))
    return one.unionByName(edges.select(*keep, F.col("b").alias("src"), F.col("a").alias("dst")))
