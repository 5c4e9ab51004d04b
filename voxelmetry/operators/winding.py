"""Wrap numbers of patches: scroll axis, same-wrap and next-wrap edges, potentials over a spanning forest.

The integer result is published as unreliable; the residuals tell how much the local signs disagree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmetry.functions.expr import dot, ratio
from voxelmetry.operators.blocks import pack_columns
from voxelmetry.operators.graph import potentials
from voxelmetry.operators.spatial import range_minimum
from voxelmetry.session import cut_lineage

# fixed values: separation of one wrap, and of two neighbouring wraps, in voxels
SAME_WRAP, NEXT_WRAP = 4.5, 15.0


def axis_centres(points: DataFrame, by: Sequence[str], span: float = 300.0, steps: int = 13, bins: int = 40) -> DataFrame:
    """Every tried centre with the unevenness of its radial histogram: by..., ordinal, cy, cx, score.

    Points are packed by group once and never copied for a centre: one pass finds the bounds of all radii, one counts
    all histograms, and either passes on a few numbers for each group, task and centre.
    """
    by = list(by)
    packed = cut_lineage(pack_columns(points.where("y IS NOT NULL AND x IS NOT NULL"), by, ["y", "x"]), "packed_points")
    mid = points.groupBy(*by).agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
    offs = np.array([-span + 2 * span * i / (steps - 1) for i in range(steps)])
    dy, dx = (a.ravel() for a in np.meshgrid(offs, offs, indexing="ij"))
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in points.select(*by).schema)

    def radii(row: dict) -> Iterator[np.ndarray]:
        y, x = np.frombuffer(row["y"]), np.frombuffer(row["x"])
        for a, b in zip(dy, dx):
            yield np.sqrt((y - row["my"] - a) ** 2 + (x - row["mx"] - b) ** 2)

    def each(rows: DataFrame, names: list[str], kind: str, fn: Callable[[dict, int, np.ndarray], dict]) -> DataFrame:
        """One row of ``fn``'s lists for each packed row and centre."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    made = [fn(row, k, r) for k, r in enumerate(radii(row))]
                    own = [pa.array([row[c]] * len(made), batch.schema.field(c).type) for c in by]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(range(len(made)), pa.int32()), *[pa.array([m[n] for m in made]) for n in names]], [*by, "ordinal", *names])

        return rows.mapInArrow(work, f"{keys}ordinal INT, {kind}")

    bounds = each(packed.join(mid, by), ["lo", "hi", "n"], "lo DOUBLE, hi DOUBLE, n BIGINT", lambda row, k, r: {"lo": r.min(), "hi": r.max(), "n": len(r)})
    ends = bounds.groupBy(*by, "ordinal").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    listed = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ordinal", "lo", "hi", "n"))).alias("s"))
    listed = cut_lineage(listed.join(mid, by).select(*by, "my", "mx", *[F.col(f"s.{c}").alias(f"_{c}") for c in ("lo", "hi", "n")]), "bounds")

    def counts(row: dict, k: int, r: np.ndarray) -> dict:
        lo, hi = row["_lo"][k], row["_hi"][k]
        if hi == lo:  # one radius alone has no histogram
            return {"counts": [0] * bins}
        return {"counts": np.bincount(np.minimum(np.floor((r - lo) / (hi - lo) * bins), bins - 1).astype(int), minlength=bins).tolist()}

    hist = each(packed.join(listed, by), ["counts"], "counts ARRAY<BIGINT>", counts)
    total = hist.groupBy(*by, "ordinal").agg(*[F.sum(F.get("counts", b)).alias(f"_c{b}") for b in range(bins)])
    tried = F.array(*[F.struct(F.lit(float(a)).alias("dy"), F.lit(float(b)).alias("dx")) for a, b in zip(dy, dx)])
    placed = total.join(listed, by).withColumns({"_d": F.get(tried, "ordinal"), "n": F.get("_n", "ordinal")})
    # bins without a point take no part, as in the published measure
    shares = F.filter(F.array(*[f"_c{b}" for b in range(bins)]), lambda c: c > 0)
    each_bin = placed.select(*by, "ordinal", (F.col("my") + F.col("_d.dy")).alias("cy"), (F.col("mx") + F.col("_d.dx")).alias("cx"), "n", F.explode_outer(shares).alias("c"))
    return each_bin.groupBy(*by, "ordinal", "cy", "cx").agg(F.stddev_pop(F.col("c") / F.col("n")).alias("score"))


def estimate_axis(points: DataFrame, by: Sequence[str], **kw) -> DataFrame:
    """The centre with the flattest radial histogram; the first one tried wins a tie."""
    c = axis_centres(points.select(*by, "y", "x"), by, **kw)
    best = F.min_by(F.struct("cy", "cx", "score"), F.struct(F.round("score", 12), "ordinal"))
    return c.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.cy").alias("axis_y"), F.col("b.cx").alias("axis_x"), F.col("b.score").alias("score"))


def outward_normals(patches: DataFrame, axis: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean normals (mz, my, mx) turned away from the axis."""
    j = patches.join(axis.select(*by, "axis_y", "axis_x"), list(by))
    ry, rx = F.col("c_y") - F.col("axis_y"), F.col("c_x") - F.col("axis_x")
    flip = F.when((F.sqrt(ry * ry + rx * rx) > 1e-9) & (F.col("my") * ry + F.col("mx") * rx < 0), -1.0).otherwise(1.0)
    return j.withColumns({f"m{a}": F.col(f"m{a}") * flip for a in "zyx"}).drop("axis_y", "axis_x")


def wrap_edges(points: DataFrame, patches: DataFrame, by: Sequence[str], item: str = "patch", same: float = SAME_WRAP, near: float = NEXT_WRAP, blur: float = 1.0) -> DataFrame:
    """Edges by..., a, b, distance, delta: 0 on one wrap, +1 / -1 to the next by the side at the contact point.

    ``patches`` carry outward normals. Contacts less than ``blur`` to either side are left out.
    """
    met = range_minimum(points, by, item, near, witness=True)
    normal = patches.select(*by, F.col(item).alias("a"), *[f"m{a}" for a in "zyx"])
    j = met.join(normal, [*by, "a"])
    off = dot([F.col(f"b_{a}") - F.col(f"a_{a}") for a in "zyx"], [F.col(f"m{a}") for a in "zyx"])
    delta = F.when(F.col("distance") <= same, 0).when(F.abs(off) >= blur, F.when(off > 0, 1).otherwise(-1))
    return j.select(*by, "a", "b", "distance", off.alias("offset"), delta.alias("delta")).where("delta IS NOT NULL")


def solve_wraps(patches: DataFrame, edges: DataFrame, by: Sequence[str], item: str = "patch") -> tuple[DataFrame, DataFrame]:
    """(patch potentials, fork measures): per patch its off-forest edges and the share with a residual of at least 1.

    A patch without such an edge has a share of 0.
    """
    node = lambda c: F.struct(*by, F.col(c).alias("item"))
    nodes = patches.select(node(item).alias("node"))
    e = edges.select(F.struct(*by, "a", "b").alias("eid"), node("a").alias("src"), node("b").alias("dst"), F.col("delta").cast("double").alias("delta"))
    w, scored = potentials(nodes, e)
    off = scored.where("NOT in_forest").withColumn("fork", F.abs("residual") >= 1)
    ends = off.select(F.col("src").alias("node"), "fork").unionByName(off.select(F.col("dst").alias("node"), "fork"))
    forks = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_cycles"), F.count(F.when(F.col("fork"), 1)).alias("n_forks"))
    forks = nodes.join(forks, "node", "left").na.fill(0, ["n_cycles", "n_forks"])
    forks = forks.select(
        *[F.col(f"node.{b}").alias(b) for b in by], F.col("node.item").alias(item), "n_cycles", "n_forks", F.coalesce(ratio("n_forks", "n_cycles"), F.lit(0.0)).alias("fork_fraction")
    )
    out = w.select(*[F.col(f"node.{b}").alias(b) for b in by], F.col("node.item").alias(item), F.col("component.item").alias("component"), "w")
    return out, forks
