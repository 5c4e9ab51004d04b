"""Connected components and potentials on an edge table, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmetry.session import cut_lineage

# how often chains of hooks are halved before asking whether any is left; each halving doubles the lazy plan
JUMPS = 2


def spanning_forest(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts a graph to its components.

    ``nodes``: node. ``edges``: eid, src, dst, delta (potential of dst minus that of src along the edge).
    Returns (node, rep, off): off is the potential of node minus that of its representative along the forest, and
    the forest's edge ids (eid).

    Each round every representative hooks onto its neighbour of smallest hashed priority if that is smaller than its
    own, chains of hooks are shortened by pointer jumping, and the edges are contracted. Hashed priorities keep the
    chains short on any graph, and at least one end of every edge is absorbed, so edges and nodes shrink
    geometrically. Every table that outlives a round is written, so lost executors cost no earlier round.
    """
    assign = cut_lineage(nodes.select("node", F.col("node").alias("rep"), F.lit(0.0).alias("off")), "assign")
    left = cut_lineage(_contracted(edges.select("eid", "src", "dst", F.col("delta").cast("double").alias("delta"))), "edges")
    forest = None
    while not left.isEmpty():
        both = left.unionByName(left.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("delta")).alias("delta")))
        rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
        down = both.where(rank("dst") < rank("src"))
        best = F.min_by(F.struct("dst", "delta", "eid"), F.struct(rank("dst"), "eid"))
        hooks = cut_lineage(
            down.groupBy("src").agg(best.alias("b")).select("src", F.col("b.dst").alias("parent"), (-F.col("b.delta")).alias("po"), F.col("b.eid").alias("eid")),
            "hooks",
        )
        chosen = hooks.select("eid")
        forest = chosen if forest is None else forest.unionByName(chosen)
        links = hooks.drop("eid")
        while True:
            for _ in range(JUMPS):
                up = links.select(F.col("src").alias("parent"), F.col("parent").alias("_gp"), F.col("po").alias("_gpo"))
                links = links.join(up, "parent", "left").select(
                    "src", F.coalesce("_gp", "parent").alias("parent"), (F.col("po") + F.coalesce("_gpo", F.lit(0.0))).alias("po")
                )
            links = cut_lineage(links, "links")
            if links.join(links.select(F.col("src").alias("parent")), "parent", "left_semi").isEmpty():
                break
        up = links.select(F.col("src").alias("rep"), "parent", "po")
        assign = cut_lineage(
            assign.join(up, "rep", "left").select("node", F.coalesce("parent", "rep").alias("rep"), (F.col("off") + F.coalesce("po", F.lit(0.0))).alias("off")),
            "assign",
        )
        end = lambda c: up.select(F.col("rep").alias(c), F.col("parent").alias(f"_{c}"), F.col("po").alias(f"_{c}_po"))
        moved = left.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
        # w(dst) = w(src) + delta, both rewritten in terms of their new representatives
        delta = F.col("delta") + F.coalesce("_src_po", F.lit(0.0)) - F.coalesce("_dst_po", F.lit(0.0))
        left = cut_lineage(
            _contracted(moved.select("eid", F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), delta.alias("delta"))), "edges"
        )
    if forest is None:
        forest = left.select("eid")
    return assign, forest


def _contracted(edges: DataFrame) -> DataFrame:
    """No loops, and of parallel edges the one with the smallest id."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    signed = F.when(F.col("src") == a, F.col("delta")).otherwise(-F.col("delta"))
    e = edges.where(F.col("src") != F.col("dst")).select(a.alias("src"), b.alias("dst"), F.struct("eid", signed.alias("delta")).alias("e"))
    return e.groupBy("src", "dst").agg(F.min("e").alias("e")).select("e.eid", "src", "dst", "e.delta")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of its connected component. ``edges``: src, dst."""
    e = edges.select(F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).alias("eid"), "src", "dst", F.lit(0.0).alias("delta"))
    assign, _ = spanning_forest(nodes, e)
    smallest = assign.groupBy("rep").agg(F.min("node").alias("component"))
    return assign.join(smallest, "rep").select("node", "component")


def potentials(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Potential of every node along a spanning forest, zero at each component's smallest node; and all edges with
    their residual and whether they belong to the forest. ``edges``: eid, src, dst, delta."""
    assign, forest = spanning_forest(nodes, edges)
    first = assign.groupBy("rep").agg(F.min(F.struct("node", "off")).alias("f"))
    w = cut_lineage(assign.join(first, "rep").select("node", F.col("f.node").alias("component"), (F.col("off") - F.col("f.off")).alias("w")), "potential")
    at = lambda c: w.select(F.col("node").alias(c), F.col("w").alias(f"w_{c}"))
    tree = forest.distinct().withColumn("in_forest", F.lit(True))
    scored = edges.join(at("src"), "src").join(at("dst"), "dst").join(tree, "eid", "left")
    residual = F.col("w_dst") - F.col("w_src") - F.col("delta")
    return w, scored.select("eid", "src", "dst", "delta", residual.alias("residual"), F.coalesce("in_forest", F.lit(False)).alias("in_forest"))
