"""Seeded choices that do not depend on partitioning: samples, splits, origins, greedy picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as _w

from voxelmetry.functions.expr import hash_uniform
from voxelmetry.session import cut_lineage

W = _w.Window


def sample_per_group(df: DataFrame, by: Sequence[str], keys: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """k rows per group without replacement, in hash order.

    Groups may be huge, so each is first cut into hash ranges that keep their own k smallest; only those candidates
    meet in the final ranking.
    """
    u = df.withColumn("_u", hash_uniform(seed, *keys)).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(64)))
    local = F.row_number().over(W.partitionBy(*by, "_part").orderBy("_u", *keys))
    few = u.withColumn("_r", local).where(F.col("_r") <= k)
    final = F.row_number().over(W.partitionBy(*by).orderBy("_u", *keys))
    return few.withColumn("_r", final).where(F.col("_r") <= k).drop("_u", "_part", "_r")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], tie: Sequence[str], k: int) -> DataFrame:
    """k best rows per group with their rank, found in two steps like ``sample_per_group``."""
    keys = [*order, *[F.col(c) for c in tie]]
    part = df.withColumn("_part", F.pmod(F.xxhash64(*tie), F.lit(64)))
    few = part.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*keys))).where(F.col("_r") <= k)
    return few.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*keys))).where(F.col("rank") <= k).drop("_part", "_r")


def seeded_split(ids: DataFrame, key: str, is_test: Column, n_val: int, seed: int = 0) -> DataFrame:
    """test = the flagged ids; of the others the first ``n_val`` in hash order are val, the rest train."""
    rest = ids.where(~is_test)
    val = rest.withColumn("_u", hash_uniform(seed, key)).orderBy("_u", key).limit(n_val).select(key, F.lit(True).alias("_val"))
    named = ids.join(val, key, "left")
    return named.withColumn("part", F.when(is_test, "test").when(F.col("_val"), "val").otherwise("train")).drop("_val")


def random_origins(shapes: DataFrame, block: int, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """n block origins per volume, uniform over the positions where the block fits."""
    each = shapes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block_index"))
    origin = {
        f"{a}0": F.floor(hash_uniform(seed + i, *keys, "block_index") * F.greatest(F.lit(1), F.col(f"n{a}") - block)).cast("int")
        for i, a in enumerate("zyx")
    }
    return each.withColumns(origin)


def greedy_spaced(candidates: DataFrame, by: Sequence[str], order: Sequence[Column], axes: Sequence[str], gap: int, rounds: int) -> DataFrame:
    """Up to ``rounds`` picks per group, best first, each at least ``gap`` away from the others on some axis.

    One aggregate and one join per round. Picks and survivors are written each round, so every round reads the last one's
    survivors and the plan does not grow.
    """
    best = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(a) for a in axes])
    left = candidates
    picks: DataFrame | None = None
    for r in range(rounds):
        pick = left.groupBy(*by).agg(F.max(best).alias("b")).select(
            *by, *[F.col(f"b.{a}").alias(f"pick_{a}") for a in axes], F.lit(r + 1).alias("pick")
        )
        pick = cut_lineage(pick, "picks")
        picks = pick if picks is None else picks.unionByName(pick)
        close = F.lit(True)
        for a in axes:
            close = close & (F.abs(F.col(a) - F.col(f"pick_{a}")) < gap)
        if r + 1 < rounds:
            left = cut_lineage(left.join(pick.drop("pick"), list(by)).where(~close).select(*candidates.columns), "survivors")
    return picks


def first_best(df: DataFrame, by: Sequence[str], score: Column, ordinal: str, floor: float) -> DataFrame:
    """The first strictly best candidate per group, if it reaches the floor."""
    rest = F.struct(*[c for c in df.columns if c not in by])
    top = df.groupBy(*by).agg(F.max_by(rest, F.struct(score, -F.col(ordinal))).alias("b"), F.max(score).alias("best_score"))
    return top.where(F.col("best_score") >= floor).select(*by, "best_score", "b.*")
