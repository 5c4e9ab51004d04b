"""Window grids, chunks they touch, and read amplification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmetry.functions.expr import ratio
from voxelmetry.functions.names import morton, window_starts


def windows(volumes: DataFrame, patch: int, step: float, sizes: tuple[str, str, str] = ("nz", "ny", "nx")) -> DataFrame:
    """Every window origin (wz, wy, wx) of each volume's evenly spread grid."""
    out = volumes
    for axis, size in zip("zyx", sizes):
        out = out.select("*", F.explode(window_starts(size, patch, step)).alias(f"w{axis}"))
    return out


def meets_region(patch: int, lo: tuple[Column, ...], hi: tuple[Column, ...]) -> Column:
    """The window overlaps the region [lo, hi) on every axis."""
    ok = F.lit(True)
    for axis, a, b in zip("zyx", lo, hi):
        ok = ok & (F.col(f"w{axis}") < b) & (F.col(f"w{axis}") + patch > a)
    return ok


def touched_chunks(wins: DataFrame, patch: int, chunk: int) -> DataFrame:
    """One row per (window, chunk) that the window reads."""
    out = wins
    for axis in "zyx":
        first = F.floor(F.col(f"w{axis}") / chunk).cast("int")
        last = F.floor((F.col(f"w{axis}") + (patch - 1)) / chunk).cast("int")
        out = out.select("*", F.explode(F.sequence(first, last)).alias(f"c{axis}"))
    return out


# chunks that a task counts at once
PER_TASK = 200_000


def chunk_touches(volumes: DataFrame, by: list[str], patch: int, step: float, chunk: int, sizes: tuple[str, str, str] = ("nz", "ny", "nx")) -> DataFrame:
    """by..., cz, cy, cx, n: how many windows of the volume's grid read each chunk. Rows of one volume are added up.

    A window reads a box of chunks, so n is the product of what the axes give alone, and neither windows nor what they
    read are rows. The volumes are dealt out by the number of their chunks, about PER_TASK to a task.
    """

    def touched(size: str) -> Column:
        starts = window_starts(size, patch, step)
        first, last = (lambda w: F.floor(w / chunk).cast("int")), (lambda w: F.floor((w + (patch - 1)) / chunk).cast("int"))
        met = F.array_distinct(F.flatten(F.transform(starts, lambda w: F.sequence(first(w), last(w)))))
        reads = lambda c: F.size(F.filter(starts, lambda w: (first(w) <= c) & (last(w) >= c)))
        return F.transform(met, lambda c: F.struct(c.alias("c"), reads(c).cast("long").alias("n")))

    volumes = volumes.select(*by, *sizes).dropna(subset=list(sizes))  # a volume without a size has no windows
    held = F.lit(1).cast("long")
    for size in sizes:
        held = held * F.ceil(F.greatest(F.col(size), F.lit(patch)) / chunk)
    total = volumes.agg(F.sum(held)).first()[0] or 0
    tasks = max(int(volumes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_TASK))
    # an axis is worked out once for each volume, not for each row that the axes before it make, nor (as a plain explode
    # asks for filled arrays before the shuffle) a second time; every array is filled
    out = volumes.repartition(tasks, *by).select(*by, *[touched(size).alias(f"_{a}") for a, size in zip("zyx", sizes)])
    for axis in "zyx":
        out = out.withColumn(f"_{axis}", F.explode_outer(f"_{axis}"))
    n = F.col("_z.n") * F.col("_y.n") * F.col("_x.n")
    return out.groupBy(*by, *[F.col(f"_{a}.c").alias(f"c{a}") for a in "zyx"]).agg(F.sum(n).alias("n"))


def read_amplification(access: DataFrame, key: list[str], by: list[str] | None = None, touches: str | None = None) -> DataFrame:
    """Touches per distinct chunk and the most refetched chunk; counts per key come first. ``touches``: a column with their
    number, where a row stands for several."""
    by = by or []
    per = access.groupBy(*by, *key).agg((F.sum(touches) if touches else F.count(F.lit(1))).alias("_n"))
    return per.groupBy(*by).agg(
        F.sum("_n").alias("touches"),
        F.count(F.lit(1)).alias("distinct_chunks"),
        ratio(F.sum("_n"), F.count(F.lit(1))).alias("amplification"),
        F.max("_n").alias("max_refetch"),
    )


def in_morton_order(blocks: DataFrame, partitions: int, z: str = "bz", y: str = "by", x: str = "bx") -> DataFrame:
    """Blocks laid out along the Z-order curve, for locality of later reads; indices of up to 42 bits."""
    low = morton(*[F.col(c).bitwiseAND(F.lit(0x1FFFFF)) for c in (z, y, x)])
    # a key holds 21 bits of each index: the bits above them are a key of their own, zero for smaller indices
    high = morton(*[F.shiftright(F.col(c).cast("long"), 21) for c in (z, y, x)])
    keyed = blocks.withColumns({"_high": high, "morton": low})
    return keyed.repartitionByRange(partitions, "_high", "morton").sortWithinPartitions("_high", "morton").drop("_high")
