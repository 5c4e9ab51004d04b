"""Neighbourhood operators on sparse voxel tables (vol, z, y, x, ...).

Morphology, smoothing and differences run as kernels over packed blocks, distances over packed lines; voxels are rows
only outside the shuffles. A voxel belongs to a volume; a missing voxel reads as False or 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmetry.functions.expr import count_if, ratio, rows_of
from voxelmetry.session import spread

AT = ["z", "y", "x"]
# fixed values: the six face neighbours
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def centre_crop(df: DataFrame, full: Sequence[int], want: Sequence[int]) -> DataFrame:
    """Central sub-volume, shifted to start at zero."""
    out = df
    for a, f, w in zip(AT, full, want):
        off = (f - w) // 2
        out = out.where((F.col(a) >= off) & (F.col(a) < off + w)).withColumn(a, F.col(a) - off)
    return out


def shifted(df: DataFrame, offsets: Sequence[tuple[int, int, int]], keep: Sequence[str], sign: int = 1) -> DataFrame:
    """Every voxel once per offset, moved by it: columns keep..., z, y, x, and the offset dz, dy, dx."""
    each = df.select(*keep, *AT, F.inline(rows_of([tuple(o) for o in offsets], ("dz", "dy", "dx"))))
    moved = [(F.col(a) + sign * F.col(f"d{a}")).alias(a) for a in AT]
    return each.select(*keep, *moved, "dz", "dy", "dx")


def inside(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    ok = F.lit(True)
    for a, n in zip(AT, shape):
        ok = ok & F.col(a).between(0, n - 1)
    return df.where(ok)


def ball(radius: int) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [(z, y, x) for z in r for y in r for x in r if z * z + y * y + x * x <= radius * radius]


def _moved(mask: np.ndarray, offset: Sequence[int]) -> np.ndarray:
    """The mask shifted by an offset; what leaves the array is lost, what enters it is false."""
    out = np.zeros_like(mask)
    to = tuple(slice(max(o, 0), n + min(o, 0)) for o, n in zip(offset, mask.shape))
    off = tuple(slice(max(-o, 0), n + min(-o, 0)) for o, n in zip(offset, mask.shape))
    out[to] = mask[off]
    return out


def _mask_kernel(voxels: DataFrame, by: Sequence[str], shape: Sequence[int] | None, offsets: Sequence[tuple], steps: Sequence[Callable], at_voxels: bool = False) -> DataFrame:
    """Packed blocks of the mask through ``steps`` (each combines moved masks); a block's halo is all they reach."""
    from voxelmetry.operators.blocks import Block, KernelSpec, nothing, run_kernel

    offs = sorted(set(offsets) | {(0, 0, 0)})

    def fn(block: Block) -> pd.DataFrame:
        mask = block.arrays["_m"] > 0
        for step in steps:
            mask = step(mask, offs)
        at = block.core_points(mask)
        return pd.DataFrame({**dict(zip(AT, at.T.astype("int32"))), "_": True}) if len(at) else nothing([*AT, "_"])

    spec = KernelSpec("mask", len(steps) * max(abs(v) for o in offs for v in o), "_ BOOLEAN", fn, at_voxels)
    return run_kernel(voxels.select(*by, *AT, F.lit(1.0).alias("_m")), by, shape, ["_m"], spec).drop("_")


def _grown(mask: np.ndarray, offsets: Sequence[tuple]) -> np.ndarray:
    return np.logical_or.reduce([_moved(mask, o) for o in offsets])


def _shrunk(mask: np.ndarray, offsets: Sequence[tuple]) -> np.ndarray:
    return np.logical_and.reduce([_moved(mask, [-v for v in o]) for o in offsets])


def dilate(mask: DataFrame, by: Sequence[str], shape: Sequence[int], offsets: Sequence[tuple] = FACES, times: int = 1) -> DataFrame:
    """Set of voxels reached from the mask by an offset; outside the volume is cut off. All steps in one pass over blocks."""
    return _mask_kernel(mask, by, shape, offsets, [_grown] * times)


def erode(mask: DataFrame, by: Sequence[str], offsets: Sequence[tuple] = FACES, times: int = 1) -> DataFrame:
    """Voxels whose every offset neighbour is in the mask; outside the volume counts as not in it."""
    return _mask_kernel(mask, by, None, offsets, [_shrunk] * times, at_voxels=True)


def close(mask: DataFrame, by: Sequence[str], shape: Sequence[int], offsets: Sequence[tuple] = FACES, times: int = 1) -> DataFrame:
    """Dilation, then erosion, on the same blocks."""
    return _mask_kernel(mask, by, shape, offsets, [_grown] * times + [_shrunk] * times)


# fixed values: the published sweep
CONTACT_RADII = (1, 2, 3, 5, 8, 12)


def contact(mask: DataFrame, by: Sequence[str], shape: Sequence[int], radii: Sequence[int] = CONTACT_RADII, side: int | None = None) -> DataFrame:
    """by..., z, y, x, radius: mask voxels beside a thin gap, for all radii in one pass over padded blocks."""
    from voxelmetry.operators.blocks import contact_kernel, run_kernel

    return run_kernel(mask.select(*by, *AT, F.lit(1.0).alias("_m")), by, shape, ["_m"], contact_kernel(radii), side)


def contact_shares(mask: DataFrame, by: Sequence[str], shape: Sequence[int], radii: Sequence[int] = CONTACT_RADII, side: int | None = None) -> DataFrame:
    """by..., radius, n_contact, share of the mask's voxels; zero where a radius finds none."""
    by = list(by)
    found = contact(mask, by, shape, radii, side).groupBy(*by, "radius").agg(F.count(F.lit(1)).alias("n_contact"))
    total = mask.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select("*", F.explode(F.array(*[F.lit(r) for r in radii])).alias("radius"))
    n = F.coalesce("n_contact", F.lit(0).cast("long"))
    return total.join(found, [*by, "radius"], "left").select(*by, "radius", n.alias("n_contact"), ratio(n, "_n").alias("share"))


def interface(voxels: DataFrame, by: Sequence[str], shape: Sequence[int], empty: Column) -> DataFrame:
    """Scanned voxels that touch an empty one."""
    void = voxels.where(empty)
    grown = dilate(void, by, shape)
    return voxels.where(~empty).join(grown, [*by, *AT], "left_semi")


# lines of a plane that are looked at together
LINES = 1024
# sites and asked positions after which the planes of a task so far are answered, and the same times the length of their lines
CELLS, SPAN = 1 << 15, 1 << 28


def lower_envelope(starts: np.ndarray, counts: np.ndarray, pos: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sites of each line whose parabola val + (p - pos)^2 is lowest somewhere: their line, their index, where they begin.

    Lines are runs of sites in ascending position. All lines advance together; a site is pushed once and popped once at
    most, so that the work follows the number of sites whatever their distances.
    """
    stack, since = np.empty(len(pos), np.int64), np.full(len(pos), -np.inf)
    top = np.zeros(len(starts), np.int64)
    stack[starts] = starts
    for k in range(1, int(counts.max(initial=0))):
        lanes = np.flatnonzero(counts > k)
        new = starts[lanes] + k
        meet, left = np.empty(len(lanes)), np.arange(len(lanes))
        while len(left):
            at = starts[lanes[left]] + top[lanes[left]]
            a, b = stack[at], new[left]
            meet[left] = (val[b] + pos[b] ** 2 - val[a] - pos[a] ** 2) / (2.0 * (pos[b] - pos[a]))
            left = left[meet[left] <= since[at]]
            top[lanes[left]] -= 1
        top[lanes] += 1
        stack[starts[lanes] + top[lanes]] = new
        since[starts[lanes] + top[lanes]] = meet
    sizes = top + 1
    line = np.repeat(np.arange(len(starts)), sizes)
    at = starts[line] + np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return line, stack[at], since[at]


def nearest_on_lines(line: np.ndarray, pos: np.ndarray, val: np.ndarray, ask_line: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """min over a line's sites of val + (ask - pos)^2, infinite on lines without a site. Sites may come in any order."""
    out = np.full(len(ask), np.inf)
    if not len(line) or not len(ask):
        return out
    order = np.lexsort((val, pos, line))
    line, pos, val = line[order], pos[order], val[order]
    first = np.ones(len(line), bool)  # of equal positions the lowest
    first[1:] = (line[1:] != line[:-1]) | (pos[1:] != pos[:-1])
    line, pos, val = line[first], pos[first].astype(np.float64), val[first]
    starts = np.flatnonzero(np.diff(line, prepend=line[0] - 1))
    which, site, since = lower_envelope(starts, np.diff(starts, append=len(line)), pos, val)
    lowest = min(pos.min(), ask.min()) - 1.0
    width = max(pos.max(), ask.max()) - lowest + 2.0
    names = line[starts]
    row = np.minimum(np.searchsorted(names, ask_line), len(names) - 1)
    known = names[row] == ask_line
    begins = which * width + np.clip(since - lowest, 0.0, width - 1.0)
    found = site[np.searchsorted(begins, row[known] * width + (ask[known] - lowest), "right") - 1]
    out[known] = val[found] + (ask[known] - pos[found]) ** 2
    return out


def _packed_planes(n_keys: int, exact: int, second: int, along: int, lines: int | None = LINES):
    """Rows (keys, z, y, x, value) to packed rows (keys, plane, tile of so many lines, line numbers, positions, values)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            from voxelmetry.operators.blocks import _group_codes

            at = [batch.column(n_keys + k).to_numpy() for k in range(3)]
            group, plane, tile = _group_codes(batch.columns[:n_keys], batch.num_rows), at[exact], at[second] // lines if lines else at[second] * 0
            order = np.lexsort((tile, plane, group))
            new = np.zeros(len(order), bool)
            new[0] = True
            for c in (group, plane, tile):
                new[1:] |= np.diff(c[order]) != 0
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(order))
            first = order[starts]
            cells = [at[second].astype(np.int32), at[along].astype(np.int32), batch.column(n_keys + 3).to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[c.take(pa.array(first)) for c in batch.columns[:n_keys]], pa.array(plane[first].astype(np.int32)), pa.array(tile[first].astype(np.int32)),
                    *[pa.array([c[order[a:b]].tobytes() for a, b in zip(starts, ends)], pa.binary()) for c in cells],
                ],
                [*batch.schema.names[:n_keys], "_plane", "_tile", "_line", "_pos", "_val"],
            )

    return work


def _by_plane(voxels: DataFrame, by: Sequence[str], axis: str) -> DataFrame:
    """A plane's voxels together, so that they are packed as one and not by ones and twos."""
    return spread(voxels, *by, axis).sortWithinPartitions(*by, axis)


def _nearest_along(sites: DataFrame, asked: DataFrame, by: Sequence[str], axes: tuple[str, str, str], limit: float | None) -> DataFrame:
    """by..., z, y, x, d2: at the positions asked for, min over the line's sites of d2 + the squared distance along it.

    ``axes``: the plane, the line in it, and the axis along the line. ``asked`` has _plane, _tile, and either _ask (the
    positions wanted on every line that has a site) or _line and _pos (the positions wanted on each line).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n_keys, where = len(by), [AT.index(a) for a in axes]
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sites.select(*by).schema)
    rows = _by_plane(sites, by, axes[0]).mapInArrow(_packed_planes(n_keys, *where), keys + "_plane INT, _tile INT, _line BINARY, _pos BINARY, _val BINARY")
    rows = rows.unionByName(asked, allowMissingColumns=True)
    rows = rows if "_ask" in rows.columns else rows.withColumn("_ask", F.lit(None).cast("array<int>"))
    ddl = keys + "z INT, y INT, x INT, d2 DOUBLE"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    bound = np.inf if limit is None else limit * limit
    order = ["_plane", "_tile", "_line", "_pos", "_val", "_ask"]
    join = lambda parts, kind: np.concatenate([np.frombuffer(p, kind) for p in parts]) if parts else np.empty(0, kind)

    def answer(keys: list[tuple], held: list[tuple[int, dict]]) -> pa.RecordBatch | None:
        """The cells of many planes and tiles at once; ``held``: packed rows, each with the number of its key."""
        own, asking = [(c, r) for c, r in held if r["_val"] is not None], [(c, r) for c, r in held if r["_val"] is None]
        if not own or not asking:
            return None
        of = lambda some, size: np.repeat(np.array([c for c, _ in some], np.int64), [size(r) for _, r in some])
        cell, (line, pos, val) = of(own, lambda r: len(r["_val"]) // 8), (join([r[c] for _, r in own], k) for c, k in (("_line", np.int32), ("_pos", np.int32), ("_val", np.float64)))
        listed = asking[0][1]["_ask"] is not None
        ask_line = np.empty(0, np.int32) if listed else join([r["_line"] for _, r in asking], np.int32)
        low = min(line.min(), ask_line.min(initial=line.min())).astype(np.int64)
        wide = max(line.max(), ask_line.max(initial=line.max())) - low + 1
        name = cell * wide + (line - low)
        if listed:
            # the positions that a key asks for, on each of its lines that has a site
            places = np.unique(np.stack([of(asking, lambda r: len(r["_ask"])), np.concatenate([np.array(r["_ask"], np.int64) for _, r in asking])]), axis=1)
            n = np.bincount(places[0], minlength=len(keys))
            lines = np.unique(name)
            each = n[lines // wide]
            ask_name = np.repeat(lines, each)
            nth = np.arange(len(ask_name)) - np.repeat(np.cumsum(each) - each, each)
            ask = places[1][nth + np.repeat((np.cumsum(n) - n)[lines // wide], each)].astype(np.int32)
        else:
            ask_name, ask = of(asking, lambda r: len(r["_pos"]) // 4) * wide + (ask_line - low), join([r["_pos"] for _, r in asking], np.int32)
        d2 = nearest_on_lines(name, pos, val, ask_name, ask)
        near = np.flatnonzero(d2 <= bound) if np.isfinite(bound) else np.flatnonzero(np.isfinite(d2))
        if not len(near):
            return None
        which = pa.array(ask_name[near] // wide)
        plane = pa.array([k[-2] for k in keys], pa.int32()).take(which)
        at = dict(zip(axes, (plane, pa.array((ask_name[near] % wide + low).astype(np.int32)), pa.array(ask[near]))))
        named = [pa.array([k[i] for k in keys], f.type).take(which) for i, f in zip(range(n_keys), schema)]
        return pa.RecordBatch.from_arrays([*named, *[at[a] for a in AT], pa.array(d2[near])], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, n, lowest, highest = [], [], 0, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row.values())[: n_keys + 2]
                if not keys or key != keys[-1]:
                    # keys are answered together; the numbers that tell lines and positions apart stay small
                    if n > CELLS or n * (highest - lowest + 2) > SPAN:
                        out = answer(keys, held)
                        if out is not None:
                            yield out
                        keys, held, n, lowest, highest = [], [], 0, 0, 0
                    keys.append(key)
                held.append((len(keys) - 1, row))
                pos = np.frombuffer(row["_pos"], np.int32) if row["_ask"] is None else np.array(row["_ask"])
                if len(pos):
                    n, lowest, highest = n + len(pos), min(lowest, pos.min()), max(highest, pos.max())
        if keys:
            out = answer(keys, held)
            if out is not None:
                yield out

    cell = [*by, "_plane", "_tile"]
    return spread(rows.select(*by, *order), *cell).sortWithinPartitions(*cell).mapInArrow(work, ddl)


def distance(points: DataFrame, targets: DataFrame, by: Sequence[str], shape: Sequence[int], limit: float | None = None, name: str = "distance") -> DataFrame:
    """Exact Euclidean distance of each point to the nearest target voxel of its volume, NULL if there is none
    (or none within ``limit``).

    Separable: one pass per axis over the lines of the volume, each by the lower envelope of its sites, so that the work
    follows the stored voxels and not the distances or the length of empty lines. Voxels travel packed, a plane's stretch
    of LINES lines at a time, and block borders play no part. The first two passes answer at heights and rows where a
    point is asked for, the last at the points; with a ``limit`` only cells within it go on to the next pass.
    """
    by, here = list(by), [*by, *AT]
    nz, ny, nx = shape
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = -(-nx // LINES)
    asked = points.select(*here).distinct()
    heights = asked.groupBy(*by, "z").agg(F.collect_set("y").alias("_ask"))
    sites = targets.select(*by, *[F.col(a).cast("int").alias(a) for a in AT], F.lit(0.0).alias("d2")).distinct()
    first = heights.groupBy(*by).agg(F.collect_list(F.col("z").cast("int")).alias("_ask")).select(*by, every(ny).alias("_plane"), "_ask").select("*", every(tiles).alias("_tile"))
    d2 = _nearest_along(sites, first, by, ("y", "x", "z"), limit)
    second = heights.select(*by, F.col("z").cast("int").alias("_plane"), F.col("_ask").cast("array<int>").alias("_ask"), every(tiles).alias("_tile"))
    d2 = _nearest_along(d2, second, by, ("z", "x", "y"), limit)
    places = asked.select(*by, *[F.col(a).cast("int").alias(a) for a in AT], F.lit(0.0).alias("d2"))
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in points.select(*by).schema)
    third = _by_plane(places, by, "z").mapInArrow(_packed_planes(len(by), 0, 1, 2), keys + "_plane INT, _tile INT, _line BINARY, _pos BINARY, _val BINARY").drop("_val")
    d2 = _nearest_along(d2, third, by, ("z", "y", "x"), limit)
    found = points.join(d2.withColumnRenamed("d2", "_d2"), here, "left")
    return found.withColumn(name, F.sqrt("_d2")).drop("_d2")


# fixed values: half-open depth ranges, and the integer ranges of the published reports (kept for comparison)
DEPTH_EDGES = [(0, 2), (2, 4), (4, 8), (8, 16), (16, None)]
DEPTH_BINS_COMPAT = [(1, 1), (2, 2), (3, 4), (5, 8), (9, 16), (17, None)]


def depth_bin(d: Column, compat: bool = False) -> Column:
    """Label of the depth range; compat: closed integer ranges, so 1.41 or 2.24 fall into none."""
    out = F.lit(None).cast("string")
    if compat:
        for lo, hi in DEPTH_BINS_COMPAT:
            ok = (d >= lo) if hi is None else (d >= lo) & (d <= hi)
            out = F.when(ok, f"{lo}-{'inf' if hi is None else hi}").otherwise(out)
        return out
    for lo, hi in DEPTH_EDGES:
        ok = (d >= lo) if hi is None else (d >= lo) & (d < hi)
        out = F.when(ok, f"{lo}-{'inf' if hi is None else hi}").otherwise(out)
    return out


def dense(voxels: DataFrame, by: Sequence[str], shape: Sequence[int], value: str) -> DataFrame:
    """Every cell of each volume's grid, absent voxels as zero."""
    cells = voxels.select(*by).distinct()
    for a, n in zip(AT, shape):
        cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(a))
    return cells.join(voxels.select(*by, *AT, value), [*by, *AT], "left").withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    import math

    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [(i - r, v / sum(w)) for i, v in enumerate(w)]


def _filtered(vol: DataFrame, by: Sequence[str], shape: Sequence[int], value: str, halo: int, out: Sequence[str], fn: Callable) -> DataFrame:
    """by..., z, y, x and the columns ``out`` of ``fn`` (array to arrays) at every stored voxel, by packed blocks."""
    from voxelmetry.operators.blocks import Block, KernelSpec, nothing, run_kernel

    def kernel(block: Block) -> pd.DataFrame:
        at = block.core_points(block.arrays["_stored"] > 0)
        if not len(at):
            return nothing([*AT, *out])
        cells = tuple((at - block.origin).T)
        return pd.DataFrame({**dict(zip(AT, at.T.astype("int32"))), **dict(zip(out, (a[cells] for a in fn(block.arrays["_f"]))))})

    marked = vol.select(*by, *AT, F.col(value).alias("_f"), F.lit(1.0).alias("_stored"))
    return run_kernel(marked, by, shape, ["_f", "_stored"], KernelSpec("filter", halo, ", ".join(f"{c} DOUBLE" for c in out), kernel))


def gaussian(vol: DataFrame, by: Sequence[str], shape: Sequence[int], sigma: float, value: str, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian smoothing of a dense volume with mirrored borders; the reach must stay below each side."""
    from voxelmetry.operators.blocks import gaussian_filter

    return _filtered(vol, by, shape, value, int(truncate * sigma + 0.5), [value], lambda a: [gaussian_filter(a, sigma, truncate)])


def box_statistics(vol: DataFrame, by: Sequence[str], shape: Sequence[int], value: str, size: int = 5) -> DataFrame:
    """Local mean and standard deviation over a cube, mirrored borders."""
    from voxelmetry.operators.blocks import separable_filter

    w = [(o, 1.0 / size) for o in range(-(size // 2), size // 2 + 1)]

    def fn(a: np.ndarray) -> list[np.ndarray]:
        mean = separable_filter(a, w)
        return [mean, np.sqrt(np.maximum(separable_filter(a * a, w) - mean * mean, 0.0))]

    return _filtered(vol, by, shape, value, size // 2, ["local_mean", "local_std"], fn)


def gradient(vol: DataFrame, by: Sequence[str], shape: Sequence[int], value: str) -> DataFrame:
    """Central differences (one-sided at the border, zero across a volume one cell thick) as gz, gy, gx."""
    fn = lambda a: [np.gradient(a, axis=k) if n > 1 else np.zeros_like(a) for k, n in enumerate(a.shape)]
    return _filtered(vol, by, shape, value, 1, [f"g{a}" for a in AT], fn)


def structure_tensor(normals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean outer product of unit normals, its eigenvalues, anisotropy and flatness."""
    from voxelmetry.functions.expr import symmetric_eigenvalues

    pairs = [("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x")]
    t = normals.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"n{a}") * F.col(f"n{b}")).alias(a + b) for a, b in pairs]
    )
    lo, mid, hi = symmetric_eigenvalues({a + b: F.col(a + b) for a, b in pairs})
    return t.select(*by, "n", hi.alias("anisotropy"), ratio(hi - mid, lo + mid + hi).alias("flatness"))


def shift_torus(mask: DataFrame, shape: Sequence[int], by_how_much: Sequence[int]) -> DataFrame:
    """Voxels moved around the torus: a null that keeps every property but the alignment."""
    return mask.withColumns({a: F.pmod(F.col(a) + s, F.lit(n)) for a, n, s in zip(AT, shape, by_how_much)})


def block_census(voxels: DataFrame, by: Sequence[str], side: int) -> DataFrame:
    """Per block of side^3: voxels, scan coverage, sheet, phantom (sheet on empty scan) and real voxels."""
    block = [F.floor(F.col(a) / side).cast("int").alias(f"b{a}") for a in AT]
    empty = F.col("ct") == 0
    c = voxels.groupBy(*by, *block).agg(
        F.count(F.lit(1)).alias("n"), count_if(empty).alias("n_empty"), count_if(F.col("pred")).alias("sheet"), count_if(F.col("pred") & empty).alias("phantom")
    )
    cover = 1 - ratio("n_empty", "n")
    return c.select(
        "*",
        cover.alias("coverage"),
        (F.col("sheet") - F.col("phantom")).alias("real"),
        (F.col("phantom") / F.greatest(F.col("sheet"), F.lit(1)).cast("double")).alias("phantom_fraction"),
        ((cover > 0) & (cover < 1)).alias("mixed"),
    )
