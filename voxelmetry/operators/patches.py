"""Patch geometry, the adjacency graph of patches, and the nine review features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmetry.functions.expr import clip, cross, dot, norm, ratio
from voxelmetry.operators.distribution import quantiles, unpivot
from voxelmetry.operators.spatial import both_ways, pair_distances
from voxelmetry.session import cut_lineage

ZYX = ["z", "y", "x"]
# fixed values: radii of adjacency, of one wrap, and of the box candidates, in voxels
ADJACENT, SAME_WRAP, NEAR = 25.0, 4.5, 25.0
FEATURES = ["degree", "clustering", "local_cut", "neigh_spread", "frac_same", "normal_spread", "nb_normal_angle", "nb_degree_med", "log_size"]


def central_differences(nodes: DataFrame, by: Sequence[str], need_centre: bool = False) -> DataFrame:
    """Tangents (u*, v*) at grid nodes with four valid neighbours.

    Every node sends its position to its four neighbours; a node that received four messages has its tangents as
    signed half sums. One combined aggregate instead of four self-joins.
    """
    half = lambda c, s: F.col(c) * (0.5 * s)
    zero = F.lit(0.0)
    sends = []
    for dr, dc, s in ((-1, 0, 1), (1, 0, -1), (0, -1, 1), (0, 1, -1)):
        along_u = dr != 0
        sends.append(
            F.struct(
                (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(1).alias("_k"), F.lit(0).alias("_here"),
                *[(half(a, s) if along_u else zero).alias(f"u{a}") for a in ZYX],
                *[(zero if along_u else half(a, s)).alias(f"v{a}") for a in ZYX],
            )
        )
    sends.append(
        F.struct(F.col("row"), F.col("col"), F.lit(0).alias("_k"), F.lit(1).alias("_here"), *[zero.alias(f"{t}{a}") for t in "uv" for a in ZYX])
    )
    got = nodes.select(*by, F.inline(F.array(*sends))).groupBy(*by, "row", "col").agg(
        F.sum("_k").alias("_k"), F.sum("_here").alias("_here"), *[F.sum(f"{t}{a}").alias(f"{t}{a}") for t in "uv" for a in ZYX]
    )
    ok = F.col("_k") == 4
    return got.where(ok & (F.col("_here") == 1) if need_centre else ok).drop("_k", "_here")


def geometry(nodes: DataFrame, by: Sequence[str], min_nodes: int = 400, min_interior: int = 100, min_normals: int = 50) -> DataFrame:
    """Per patch: box, centroid, size, mean normal, normal spread, and a status naming what is too small."""
    by = list(by)
    basic = nodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_nodes"),
        *[f(a).alias(f"{s}_{a}") for a in ZYX for f, s in ((F.min, "lo"), (F.max, "hi"), (F.avg, "c"))],
        F.sqrt(sum((F.var_pop(a) for a in ZYX[1:]), F.var_pop(ZYX[0]))).alias("size"),
    )
    tang = central_differences(nodes, by)
    n = cross([F.col(f"u{a}") for a in ZYX], [F.col(f"v{a}") for a in ZYX])
    raw = tang.select(*by, "row", "col", *[c.alias(f"n{a}") for c, a in zip(n, ZYX)]).withColumn("len", norm([F.col(f"n{a}") for a in ZYX]))
    unit = raw.where("len > 1e-9").select(*by, "row", "col", *[(F.col(f"n{a}") / F.col("len")).alias(f"n{a}") for a in ZYX])
    counts = tang.groupBy(*by).agg(F.count(F.lit(1)).alias("n_interior"))
    # all normals are turned to the side of the patch's first one
    first = unit.groupBy(*by).agg(F.min_by(F.struct(*[f"n{a}" for a in ZYX]), F.struct("row", "col")).alias("f"))
    side = F.signum(dot([F.col(f"n{a}") for a in ZYX], [F.col(f"f.n{a}") for a in ZYX]))
    turned = unit.join(first, by).select(*by, *[(F.col(f"n{a}") * side).alias(f"n{a}") for a in ZYX])
    mean = turned.groupBy(*by).agg(F.count(F.lit(1)).alias("n_normals"), *[F.avg(f"n{a}").alias(f"m{a}") for a in ZYX])
    length = F.greatest(norm([F.col(f"m{a}") for a in ZYX]), F.lit(1e-9))
    mean = mean.select(*by, "n_normals", *[(F.col(f"m{a}") / length).alias(f"m{a}") for a in ZYX])
    angle = F.acos(clip(dot([F.col(f"n{a}") for a in ZYX], [F.col(f"m{a}") for a in ZYX]), -1, 1))
    spread = turned.join(mean, by).groupBy(*by).agg(F.sqrt(F.avg(angle * angle)).alias("normal_spread"))
    out = basic.join(counts, by, "left").join(mean, by, "left").join(spread, by, "left")
    few = lambda c, k: F.coalesce(F.col(c), F.lit(0)) < k
    status = (
        F.when(few("n_nodes", min_nodes), "too_few_nodes").when(few("n_interior", min_interior), "too_few_interior").when(few("n_normals", min_normals), "too_few_normals").otherwise("ok")
    )
    return out.withColumn("status", status)


def distortion(nodes: DataFrame, by: Sequence[str], min_nodes: int = 200) -> DataFrame:
    """Stretch and shear (median, q90) and the variation of area, from the first fundamental form."""
    t = central_differences(nodes, by, need_centre=True)
    u, v = [F.col(f"u{a}") for a in ZYX], [F.col(f"v{a}") for a in ZYX]
    form = t.select(*by, dot(u, u).alias("E"), dot(u, v).alias("F"), dot(v, v).alias("G")).where("E > 1e-9 AND G > 1e-9")
    tr, det = F.col("E") + F.col("G"), F.col("E") * F.col("G") - F.col("F") * F.col("F")
    root = F.sqrt(F.greatest(tr * tr / 4 - det, F.lit(0.0)))
    stretch = F.sqrt((tr / 2 + root) / F.greatest(tr / 2 - root, F.lit(1e-12)))
    per = form.select(*by, stretch.alias("stretch"), (F.abs("F") / F.sqrt(F.col("E") * F.col("G"))).alias("shear"), F.sqrt(F.greatest(det, F.lit(0.0))).alias("area"))
    q = quantiles(unpivot(per, ["stretch", "shear"], by), "value", {"med": 0.5, "q90": 0.9}, [*by, "field"])
    wide = q.groupBy(*by).agg(
        *[F.max(F.when(F.col("field") == f, F.col(c))).alias(f"{f}_{c}") for f in ("stretch", "shear") for c in ("med", "q90")], F.max("n").alias("n_nodes")
    )
    area = per.groupBy(*by).agg((F.stddev_pop("area") / F.greatest(F.avg("area"), F.lit(1e-9))).alias("area_cv"))
    return wide.join(area, list(by)).where(F.col("n_nodes") >= min_nodes)


def neighbour_pairs(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per patch: pairs of neighbours, how many are linked, how many share no neighbour but the patch.

    ``edges``: group..., a, b. A pair's common neighbours are counted once over the whole graph, so "no common
    neighbour but i" is a pair counted once, met at i; nothing is tested pair by pair. Degrees are bounded by how
    many patches fit around one patch.
    """
    group = list(group)
    adj = both_ways(edges, group)
    left, right = adj.withColumnRenamed("dst", "p"), adj.withColumnRenamed("dst", "q")
    wedges = left.join(right, [*group, "src"]).where("p < q")
    linked = edges.select(*group, F.col("a").alias("p"), F.col("b").alias("q"), F.lit(1).alias("linked"))
    shared = wedges.groupBy(*group, "p", "q").agg(F.count(F.lit(1)).alias("common"))
    kinds = shared.join(linked, [*group, "p", "q"], "left")
    met = wedges.join(kinds, [*group, "p", "q"])
    return met.groupBy(*group, "src").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count(F.when(F.col("linked") == 1, 1)).alias("linked"),
        F.count(F.when(F.col("linked").isNull() & (F.col("common") == 1), 1)).alias("no_common"),
    )


def graph_features(
    patches: DataFrame, distances: DataFrame, group: Sequence[str], item: str = "patch", adjacent: float = ADJACENT, same: float = SAME_WRAP, near: float = NEAR, compat: bool = False
) -> DataFrame:
    """The nine features of every patch; an isolated patch keeps zeros.

    ``patches``: group..., item, c_z/c_y/c_x, m_z.. mean normal (mz, my, mx), normal_spread, size.
    ``distances``: group..., a, b, distance over the box candidates. By default the share of same-wrap pairs is taken
    over pairs within ``near``; compat takes all box candidates, also those that turned out farther.
    """
    group = list(group)
    base = distances if compat else distances.where(F.col("distance") <= near)
    close = both_ways(base.select(*group, "a", "b", (F.col("distance") < same).alias("s")), [*group, "s"])
    same_share = close.groupBy(*group, "src").agg(ratio(F.count(F.when(F.col("s"), 1)), F.count(F.lit(1))).alias("frac_same"))

    edges = distances.where(F.col("distance") <= adjacent).select(*group, "a", "b")
    adj = both_ways(edges, group)
    degree = adj.groupBy(*group, "src").agg(F.count(F.lit(1)).alias("degree"))
    fields = ["c_z", "c_y", "c_x", "mz", "my", "mx", "size"]
    side = lambda k, p: patches.select(*group, F.col(item).alias(k), *[F.col(f).alias(p + f) for f in fields])
    nb = adj.join(side("src", "i_"), [*group, "src"]).join(side("dst", "j_"), [*group, "dst"])
    nb = nb.join(degree.withColumnRenamed("src", "dst").withColumnRenamed("degree", "j_degree"), [*group, "dst"])
    gap2 = dot(*[[F.col(f"i_{c}") - F.col(f"j_{c}") for c in ("c_z", "c_y", "c_x")]] * 2)
    cos = F.abs(dot([F.col(f"i_{c}") for c in ("mz", "my", "mx")], [F.col(f"j_{c}") for c in ("mz", "my", "mx")]))
    around = nb.groupBy(*group, "src").agg(
        (F.sqrt(F.avg(gap2)) / F.greatest(F.max("i_size"), F.lit(1e-6))).alias("neigh_spread"),
        # one value per neighbour of one patch
        F.percentile(F.acos(clip(cos, -1, 1)), F.lit(0.5)).alias("nb_normal_angle"),
        F.percentile("j_degree", F.lit(0.5)).alias("nb_degree_med"),
    )
    pairs = neighbour_pairs(edges, group)
    out = patches.withColumn("src", F.col(item))
    for part in (degree, around, pairs, same_share):
        out = out.join(part, [*group, "src"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        *group,
        item,
        zero(F.col("degree").cast("double")).alias("degree"),
        zero(ratio("linked", "pairs")).alias("clustering"),
        zero(ratio("no_common", "pairs")).alias("local_cut"),
        zero(F.col("neigh_spread")).alias("neigh_spread"),
        zero(F.col("frac_same")).alias("frac_same"),
        F.col("normal_spread"),
        zero(F.col("nb_normal_angle")).alias("nb_normal_angle"),
        zero(F.col("nb_degree_med")).alias("nb_degree_med"),
        F.log1p("size").alias("log_size"),
    )


def skipped_patches(nodes: DataFrame, group: Sequence[str] = ("slab",), item: str = "patch", **sizes) -> DataFrame:
    """group..., item, n_nodes, reason of the patches that are too small to have features."""
    small = geometry(nodes, [*group, item], **sizes).where("status <> 'ok'")
    return small.select(*group, item, "n_nodes", F.col("status").alias("reason"))


def extract_features(nodes: DataFrame, group: Sequence[str] = ("slab",), item: str = "patch", adjacent: float = ADJACENT, same: float = SAME_WRAP, near: float = NEAR, **kw) -> DataFrame:
    """Nodes to features: geometry, box candidates, exact distances, graph; each step is written once."""
    geo = cut_lineage(geometry(nodes, [*group, item], **kw).where("status = 'ok'"), "geometry")
    kept = nodes.join(geo.select(*group, item), [*group, item], "left_semi")
    distances = cut_lineage(pair_distances(kept, group, item, near), "distances")
    return cut_lineage(graph_features(geo, distances, group, item, adjacent, same, near), "features")

