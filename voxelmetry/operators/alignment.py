"""Does a mask sit where the scan is bright? Contrast at a shift, ordered search of shifts, window averages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmetry.operators.blocks import HALOS, SIDE, Cut, gathered, packed
from voxelmetry.operators.volumes import AT
from voxelmetry.session import spread


def shift_contrasts(voxels: DataFrame, mask: DataFrame, by: Sequence[str], base: dict[str, int], axis: str, shifts: Sequence[int]) -> DataFrame:
    """Mean scan on the mask minus off it, with the mask moved by ``base`` and each shift along one axis.

    The mask voxel at c + shift answers for scan voxel c. Only the mask is copied per shift; the voxels off the mask follow
    from the totals.
    """
    moved = mask.select(*by, *[(F.col(a) - base[a]).alias(a) for a in AT], F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift"))
    moved = moved.withColumn(axis, F.col(axis) - F.col("shift"))
    on = voxels.select(*by, *AT, "ct").join(moved, [*by, *AT]).groupBy("shift").agg(F.count(F.lit(1)).alias("n_on"), F.sum("ct").alias("s_on"))
    total = voxels.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("ct").alias("s"))).scalar()
    t = on.withColumn("t", total)
    off = (F.col("t.s") - F.col("s_on")) / (F.col("t.n") - F.col("n_on"))
    return t.select("shift", (F.col("s_on") / F.col("n_on") - off).alias("contrast"))


def displacements(voxels: DataFrame, mask: DataFrame, by: Sequence[str], reach: int, side: int | None = None) -> DataFrame:
    """dz, dy, dx, n_on, s_on: how many scan voxels c have a mask voxel at c + d, and the sum of their scan values.

    All offset vectors within ``reach`` on each axis, from one pass over packed blocks: a block's core meets the mask in
    its halo by fast correlation, whose sums of whole numbers are rounded back to them. Rows of one voxel are added up. A
    task passes on one number for each offset.
    """
    return _displacements(voxels, mask, by, reach, side).drop("n", "s")


def _displacements(voxels: DataFrame, mask: DataFrame, by: Sequence[str], reach: int, side: int | None = None) -> DataFrame:
    """``displacements`` with n and s, the number of all scan voxels and the sum of their values, in every row."""
    by = list(by)
    side = side or max(SIDE, HALOS * reach)
    cut = Cut(side, reach, None)
    both = voxels.select(*by, *AT, F.col("ct").alias("_ct"), F.lit(1).alias("_c"), F.lit(0).alias("_m"))
    both = both.unionByName(mask.select(*by, *AT, F.lit(0).alias("_ct"), F.lit(0).alias("_c"), F.lit(1).alias("_m")))
    rows, n_keys, wide = packed(both, by, ["_ct", "_c", "_m"], cut), len(by), 2 * reach + 1
    grid = np.indices((wide,) * 3).reshape(3, -1) - reach

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, totals = np.zeros((2, wide**3)), np.zeros(2)
        for key, held in gathered(batches, n_keys):
            at = np.concatenate([np.frombuffer(row["_at"], np.int32) for row in held])
            ct, stored, on = (np.concatenate([np.frombuffer(row[f"_v{k}"], np.float64) for row in held]) for k in range(3))
            # positions in the padded region, whose core begins and ends a reach inside it
            place = np.stack(np.unravel_index(at, (side + 2 * reach,) * 3))
            own = np.flatnonzero(((place >= reach) & (place < reach + side)).all(axis=0) & (stored > 0))
            totals += stored[own].sum(), ct[own].sum()
            there = np.flatnonzero(on > 0)
            if not len(own) or not len(there):
                continue
            # only where something is stored, with as much empty space around it that no offset wraps
            used = np.concatenate([own, there])
            low = place[:, used].min(axis=1)
            size = tuple(place[:, used].max(axis=1) - low + 1 + 2 * reach)
            spot = lambda which: np.ravel_multi_index(tuple(place[:, which] - low[:, None] + reach), size)
            dense = lambda which, v: np.bincount(spot(which), v[which], int(np.prod(size))).reshape(size)
            far = np.fft.rfftn(dense(there, on))
            for k, v in enumerate((stored, ct)):
                met = np.fft.irfftn(np.conj(np.fft.rfftn(dense(own, v))) * far, s=size, axes=(0, 1, 2))
                sums[k] += np.rint(met[tuple(grid % np.array(size)[:, None])])
        counted = [pa.array(sums[0].astype(np.int64)), pa.array(sums[1])]
        every = [pa.array(np.full(wide**3, int(totals[0]))), pa.array(np.full(wide**3, totals[1]))]
        yield pa.RecordBatch.from_arrays([*[pa.array(g.astype(np.int32)) for g in grid], *counted, *every], ["dz", "dy", "dx", "n_on", "s_on", "n", "s"])

    blocks = [*by, "_bz", "_by", "_bx"]
    dealt = spread(rows, *blocks).sortWithinPartitions(*blocks).mapInArrow(work, "dz INT, dy INT, dx INT, n_on BIGINT, s_on DOUBLE, n BIGINT, s DOUBLE")
    return dealt.groupBy("dz", "dy", "dx").agg(*[F.sum(c).alias(c) for c in ("n_on", "s_on", "n", "s")])


def contrast_of(table: DataFrame) -> DataFrame:
    """Adds ``contrast`` to a table of displacements with n and s: mean scan on the moved mask minus off it."""
    off = F.try_divide(F.col("s") - F.col("s_on"), F.col("n") - F.col("n_on"))
    return table.withColumn("contrast", F.try_divide(F.col("s_on"), F.col("n_on")) - off).drop("n", "s")


def search_alignment(voxels: DataFrame, mask: DataFrame, by: Sequence[str], reach: int = 16, rounds: int = 3) -> DataFrame:
    """Coordinate descent over the three axes: best shift per axis, until a round changes nothing.

    The voxels are read once, for the table of displacements; its (2 reach + 1)^3 numbers are what the steps look at.
    """
    table = contrast_of(_displacements(voxels, mask, by, reach))
    known = {(r.dz, r.dy, r.dx): r.contrast for r in table.collect() if r.contrast is not None}
    at, steps = dict.fromkeys(AT, 0), []
    for r in range(rounds):
        before = dict(at)
        for axis in AT:
            tried = {s: known.get(tuple({**at, axis: s}.values())) for s in range(-reach, reach + 1)}
            best = max((s for s, c in tried.items() if c is not None), key=lambda s: (round(tried[s], 9), -abs(s), -s), default=None)
            if best is None:
                continue
            at[axis] = best
            steps.append((r + 1, axis, best, float(round(tried[best], 9))))
        if at == before:
            break
    return voxels.sparkSession.createDataFrame(steps, "round INT, axis STRING, shift INT, contrast DOUBLE")


def average_windows(logits: DataFrame, at: Sequence[str], value: str) -> DataFrame:
    """Mean over the overlapping windows that predicted each voxel, and how many did."""
    return logits.groupBy(*at).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(value) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("logit")
    )
