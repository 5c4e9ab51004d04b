"""Array kernels over packed blocks of voxel volumes.

A block is a cube of a volume. Its voxels are brought together once, as narrow rows, and travel on as packed rows: one for each
block and target, with the positions and the values as bytes. Besides its own block a packed row goes to the neighbours
whose halo it reaches, and only with the slice (face, edge or corner) that lies there. A task then holds one padded block of bounded size. At the volume's border the
padding mirrors the volume, inside it comes from the neighbours, so results do not depend on how the volume is cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxelmetry.session import spread

AT = ["z", "y", "x"]
# a block's side in halos at least: a voxel is then sent to fewer than four blocks on average
HALOS, SIDE = 4, 64


@dataclass
class Block:
    """What a kernel sees: dense arrays over the padded region, where it lies, and the core it answers for."""

    arrays: dict[str, np.ndarray]
    origin: np.ndarray  # volume position of the region's first cell
    core_lo: np.ndarray
    core_hi: np.ndarray
    shape: np.ndarray  # of the volume

    def core_points(self, mask: np.ndarray) -> np.ndarray:
        """Volume positions of true cells inside the core."""
        at = np.argwhere(mask) + self.origin
        return at[((at >= self.core_lo) & (at < self.core_hi)).all(axis=1)]

    def core(self, a: np.ndarray) -> np.ndarray:
        return a[tuple(slice(lo, hi) for lo, hi in zip(self.core_lo - self.origin, self.core_hi - self.origin))]


@dataclass(frozen=True)
class KernelSpec:
    """A named kernel: how far it looks, what it returns per core point (z, y, x and these columns)."""

    name: str
    halo: int
    out_schema: str
    fn: Callable[[Block], pd.DataFrame]
    at_voxels: bool = False  # it returns stored voxels only, so that a block without voxels of its own is passed over


@dataclass(frozen=True)
class Cut:
    """How volumes of one shape are cut: the padded region of a block, and where its core begins and ends.

    Without a shape the volume has no border, and absent voxels around the stored ones are cells like any other.
    """

    side: int
    halo: int
    shape: np.ndarray | None

    def core(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = block * self.side
        return lo, lo + self.side if self.shape is None else np.minimum(lo + self.side, self.shape)

    def region(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.core(block)
        if self.shape is None:
            return lo - self.halo, hi + self.halo
        return np.maximum(lo - self.halo, 0), np.minimum(hi + self.halo, self.shape)

    def exists(self, block: np.ndarray) -> np.ndarray:
        if self.shape is None:
            return np.ones(len(block), bool)
        return ((block >= 0) & (block * self.side < self.shape)).all(axis=1)


def nothing(names: Sequence[str]) -> pd.DataFrame:
    """No rows; untyped columns, so that Arrow takes them for any declared type."""
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})


def _group_codes(columns: list[pa.Array], rows: int) -> np.ndarray:
    """A number for each row, equal for rows that agree in all columns (nulls agree)."""
    code = np.zeros(rows, np.int64)
    for c in columns:
        own = c.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        _, code = np.unique(code * (own.max() + 1) + own, return_inverse=True)
    return code


def _row_order(columns: Sequence[np.ndarray]) -> np.ndarray:
    """A stable order of rows by whole numbers, the first column foremost; one sort of one number where that fits."""
    low = [int(c.min()) for c in columns]
    wide = [int(c.max()) - lo + 1 for c, lo in zip(columns, low)]
    if math.prod(wide) >= 1 << 62:
        return np.lexsort(columns[::-1])
    code = columns[0] - low[0]
    for c, lo, n in zip(columns[1:], low[1:], wide[1:]):
        code = code * n + (c - lo)
    return np.argsort(code, kind="stable")


def _reached(inside: np.ndarray, block: np.ndarray, step: int, cut: Cut, axis: int) -> np.ndarray:
    """Voxels, ``inside`` their own block along an axis, that lie in the padded region of the block ``step`` away, if it exists."""
    ok = (inside >= step * cut.side - cut.halo) & (inside < (step + 1) * cut.side + cut.halo)
    if cut.shape is None:
        return ok
    at, end = (block - step) * cut.side + inside, cut.shape[axis]
    return ok & (block >= 0) & (block * cut.side < end) & (at >= 0) & (at < end)


def packer(n_keys: int, cut: Cut) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys, z, y, x, values) to packed rows (keys, block, positions in the padded region, values as bytes)."""
    reach = -(-cut.halo // cut.side)
    steps = range(-reach, reach + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.column(n_keys + k).to_numpy().astype(np.int64) for k in range(3)]
            values = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys + 3, batch.num_columns)]
            group = _group_codes(batch.columns[:n_keys], batch.num_rows)
            blocks = [a // cut.side for a in at]
            # by axis and step: is there such a block, and does its padded region hold the voxel?
            held = [{d: _reached(a - b * cut.side, b + d, d, cut, k) for d in steps} for k, (a, b) in enumerate(zip(at, blocks))]
            which, targets = [], []
            for d in product(steps, repeat=3):
                sent = np.flatnonzero(held[0][d[0]] & held[1][d[1]] & held[2][d[2]])
                if len(sent):  # most directions leave a small volume
                    which.append(sent)
                    targets.append(np.stack([b[sent] + o for b, o in zip(blocks, d)]))
            if not which:
                continue
            which, targets = np.concatenate(which), np.concatenate(targets, axis=1)
            order = _row_order([group[which], *targets])
            which, targets = which[order], targets[:, order]
            new = np.diff(group[which], prepend=-1) != 0
            for t in targets:
                new[1:] |= t[1:] != t[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(which))
            targets = targets[:, starts].T
            lo, hi = cut.region(targets)
            row = np.repeat(np.arange(len(starts)), ends - starts)
            size = hi - lo
            z, y, x = (a[which] - lo[row, k] for k, a in enumerate(at))
            place = ((z * size[row, 1] + y) * size[row, 2] + x).astype(np.int32)
            cells = [place, *[v[which] for v in values]]
            first = pa.array(which[starts])
            yield pa.RecordBatch.from_arrays(
                [
                    *[c.take(first) for c in batch.columns[:n_keys]],
                    *[pa.array(targets[:, k].astype(np.int32)) for k in range(3)],
                    *[pa.array([c[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for c in cells],
                ],
                [*batch.schema.names[:n_keys], "_bz", "_by", "_bx", "_at", *[f"_v{k}" for k in range(len(values))]],
            )

    return work


def packed(voxels: DataFrame, by: Sequence[str], values: Sequence[str], cut: Cut, kind: str = "double") -> DataFrame:
    """by..., _bz, _by, _bx, _at (int32 positions), _v0... (values as ``kind``) of every task, block and target."""
    by = list(by)
    cells = voxels.select(*by, *[F.col(a).cast("int").alias(a) for a in AT], *[F.col(v).cast(kind).alias(v) for v in values])
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in voxels.select(*by).schema)
    made = ", ".join(["_bz INT, _by INT, _bx INT, _at BINARY", *[f"_v{k} BINARY" for k in range(len(values))]])
    # the voxels of a region of blocks come together first: scattered over tasks they would be packed by ones and twos
    near = {f"_near{a}": F.floor(F.col(a) / max(SIDE, cut.side)) for a in AT}
    own = {f"_own{a}": F.floor(F.col(a) / cut.side) for a in AT}
    cells = spread(cells.withColumns({**near, **own}), *by, *near).sortWithinPartitions(*by, *near, *own).drop(*near, *own)
    return cells.mapInArrow(packer(len(by), cut), keys + made)


def gathered(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """The packed rows of each block, sorted by keys and block, as (keys and block, rows)."""
    held, last = [], None
    for batch in batches:
        names = batch.schema.names
        for row in batch.to_pylist():
            key = tuple(row[c] for c in names[: n_keys + 3])
            if held and key != last:
                yield last, held
                held = []
            held.append(row)
            last = key
    if held:
        yield last, held


# rows of a batch that a task passes on; the rows of small volumes are too few for batches of their own
ROWS = 8192


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ROWS at least, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def dense_arrays(rows: list[dict], size: np.ndarray, n: int, dtype: type = np.float64) -> list[np.ndarray]:
    arrays = [np.zeros(int(np.prod(size)), dtype) for _ in range(n)]
    for row in rows:
        at = np.frombuffer(row["_at"], np.int32)
        for k, a in enumerate(arrays):
            a[at] = np.frombuffer(row[f"_v{k}"], dtype)
    return [a.reshape(size) for a in arrays]


def moved(rows: list[dict], origin: np.ndarray, size: np.ndarray, to: np.ndarray, to_size: np.ndarray) -> list[dict]:
    """Packed rows whose positions in one region are those in another."""
    out = []
    for row in rows:
        at = np.stack(np.unravel_index(np.frombuffer(row["_at"], np.int32), size)) + (origin - to)[:, None]
        out.append({**row, "_at": np.ravel_multi_index(tuple(at), to_size).astype(np.int32).tobytes()})
    return out


def run_kernel(voxels: DataFrame, by: Sequence[str], shape: Sequence[int] | None, values: Sequence[str], spec: KernelSpec, side: int | None = None) -> DataFrame:
    """by..., z, y, x and the kernel's columns. ``side``: of the blocks, by default HALOS halos and SIDE at least."""
    by, values = list(by), list(values)
    cut = Cut(side or max(SIDE, HALOS * spec.halo), spec.halo, None if shape is None else np.array(shape))
    rows = packed(voxels, by, values, cut)
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in voxels.select(*by).schema)
    ddl = keys + f"z INT, y INT, x INT, {spec.out_schema}"
    schema, fn, n_keys = to_arrow_schema(T.StructType.fromDDL(ddl)), spec.fn, len(by)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in gathered(batches, n_keys):
            block = np.array(key[n_keys:])
            (start, stop), (lo, hi) = cut.region(block), cut.core(block)
            if cut.shape is None:
                # nothing lies beyond the stored voxels, so that a kernel need look no farther than its halo around them
                places = np.concatenate([np.frombuffer(row["_at"], np.int32) for row in held])
                at = np.stack(np.unravel_index(places, stop - start), axis=1) + start
                if spec.at_voxels and not ((at >= lo) & (at < hi)).all(axis=1).any():
                    continue
                first, last = np.maximum(at.min(axis=0) - spec.halo, start), np.minimum(at.max(axis=0) + spec.halo + 1, stop)
                held = moved(held, start, stop - start, first, last - first)
                start, stop = first, last
                lo, hi = np.clip(lo, start, stop), np.clip(hi, start, stop)
            arrays = dense_arrays(held, stop - start, len(values))
            out = fn(Block(dict(zip(values, arrays)), start, lo, hi, stop if cut.shape is None else cut.shape))
            if len(out):
                own = [pa.array([k] * len(out), f.type) for k, f in zip(key[:n_keys], schema)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(out[f.name], f.type) for f in list(schema)[n_keys:]]], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return joined(answers(batches))

    blocks = [*by, "_bz", "_by", "_bx"]
    return spread(rows, *blocks).sortWithinPartitions(*blocks).mapInArrow(work, ddl)


def pack_columns(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """by... and each of ``columns`` as the bytes of its doubles: one row for each group and batch of rows."""
    by = list(by)
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    n_keys = len(by)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = _group_codes(batch.columns[:n_keys], batch.num_rows)
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            ends = np.append(starts[1:], len(order))
            values = [batch.column(k).to_numpy(zero_copy_only=False)[order] for k in range(n_keys, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(order[starts])) for c in batch.columns[:n_keys]], *[pa.array([v[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for v in values]],
                batch.schema.names,
            )

    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.mapInArrow(work, keys + ", ".join(f"`{c}` BINARY" for c in columns))


# ---- tables of dense blocks ----------------------------------------------------------------------------------

PLACE = ["bz", "by", "bx"]
SHAPE = ["nz", "ny", "nx"]


def pack_field(voxels: DataFrame, by: Sequence[str], shape: Sequence[int], value: str, side: int = SIDE) -> DataFrame:
    """by..., bz, by, bx, nz, ny, nx, side, data: one row per block that holds a voxel, its float32 cells in C order."""
    by = list(by)
    cut = Cut(side, 0, np.array(shape))
    rows = packed(voxels, by, [value], cut, "float")
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in voxels.select(*by).schema)
    ddl = keys + ", ".join(f"{c} INT" for c in [*PLACE, *SHAPE, "side"]) + ", data BINARY"
    schema, n_keys = to_arrow_schema(T.StructType.fromDDL(ddl)), len(by)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in gathered(batches, n_keys):
            lo, hi = cut.core(np.array(key[n_keys:]))
            (data,) = dense_arrays(held, hi - lo, 1, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, *cut.shape.tolist(), side, data.tobytes()], schema)], schema=schema)

    blocks = [*by, "_bz", "_by", "_bx"]
    return spread(rows, *blocks).sortWithinPartitions(*blocks).mapInArrow(work, ddl)


def join_fields(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks of two fields side by side (data, other); null where one field has no voxel in a block.

    Volumes of which the fields differ in shape, or in the way they are cut, fail the job; so does a volume that only one of them has.
    """
    by = list(by)
    cuts = lambda df, to: df.groupBy(*by).agg(F.max(F.struct(*SHAPE, "side")).alias(to), F.min(F.struct(*SHAPE, "side")).alias(f"{to}_least"))
    met = cuts(left, "_l").join(cuts(right, "_r"), by, "full")
    agree = (F.col("_l") == F.col("_r")) & (F.col("_l") == F.col("_l_least")) & (F.col("_r") == F.col("_r_least"))
    words = F.concat(F.lit("fields differ in shape: "), F.to_json(F.struct(*by)), F.lit(" "), *[F.coalesce(F.to_json(c), F.lit("none")) for c in ("_l", "_r")])
    met = met.select(*by, F.assert_true(F.coalesce(agree, F.lit(False)), words).alias("_ok"))
    both = left.join(right.drop(*SHAPE, "side").withColumnRenamed("data", "other"), [*by, *PLACE], "full")
    # the assertion is a column of the join's other side, so that it is computed for every volume
    checked = both.drop(*SHAPE, "side").join(met, by, "full").where("_ok IS NULL").drop("_ok")
    return checked.join(left.groupBy(*by).agg(*[F.first(c).alias(c) for c in (*SHAPE, "side")]), by)


def per_block(blocks: DataFrame, by: Sequence[str], out_schema: str, fn: Callable[[np.ndarray | None, np.ndarray | None], dict]) -> DataFrame:
    """by..., bz, by, bx and what ``fn(data, other)`` returns for the cells of each block of ``join_fields``."""
    by = list(by)
    keep = [*by, *PLACE]
    rows = blocks.select(*keep, "data", "other")
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema) + out_schema
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(*[None if v is None else np.frombuffer(v, np.float32) for v in (row["data"], row["other"])]) for row in batch.select(["data", "other"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array([m[f.name] for m in made], f.type) for f in list(schema)[len(keep) :]]], schema=schema)

    return rows.mapInArrow(work, ddl)


# ---- array functions and kernels -------------------------------------------------------------------------------------


def separable_filter(a: np.ndarray, weights: Sequence[tuple[int, float]]) -> np.ndarray:
    """Weighted sums along each axis in turn, with mirrored borders."""
    r = max(o for o, _ in weights)
    for axis in range(3):
        pad = [(r, r) if k == axis else (0, 0) for k in range(3)]
        p = np.moveaxis(np.pad(a, pad, mode="symmetric"), axis, 0)
        n = a.shape[axis]
        a = np.moveaxis(sum(c * p[r + o : r + o + n] for o, c in weights), 0, axis)
    return a


def gaussian_filter(a: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Separable smoothing with mirrored borders."""
    from voxelmetry.operators.volumes import gaussian_weights

    return separable_filter(a, gaussian_weights(sigma, truncate))


def grow(mask: np.ndarray, times: int) -> np.ndarray:
    """Cells within ``times`` face steps of the mask, inside the array."""
    for _ in range(times):
        out = mask.copy()
        for axis in range(mask.ndim):
            a, b = np.moveaxis(out, axis, 0), np.moveaxis(mask, axis, 0)
            a[1:] |= b[:-1]
            a[:-1] |= b[1:]
        mask = out
    return mask


def shrink(mask: np.ndarray, times: int) -> np.ndarray:
    """Cells whose surroundings within ``times`` face steps lie in the mask; beyond the array nothing does."""
    return ~grow(np.pad(~mask, times, constant_values=True), times)[tuple(slice(times, -times or None) for _ in mask.shape)]


def contact_kernel(radii: Sequence[int]) -> KernelSpec:
    """Per radius the mask's voxels beside a thin gap: what closing adds, grown back and met with the mask."""

    def fn(block: Block) -> pd.DataFrame:
        mask = block.arrays["_m"] > 0
        found = []
        for r in radii:
            gap = shrink(grow(mask, r), r) & ~mask
            at = block.core_points(grow(gap, r) & mask)
            found.append(pd.DataFrame({**dict(zip(AT, at.T.astype("int32"))), "radius": np.int32(r)}))
        out = pd.concat(found)
        return out if len(out) else nothing([*AT, "radius"])

    return KernelSpec("contact", 3 * max(radii), "radius INT", fn)


def across_sheet_normals(field: np.ndarray, at: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Unit eigenvectors of the most negative curvature of the smoothed field at region cells ``at``.

    The sign is fixed: the first clearly nonzero component is positive.
    """
    g = [np.gradient(c) if min(field.shape) > 1 else [c * 0] * 3 for c in np.gradient(gaussian_filter(field, sigma))]
    i, j, k = at.T
    hess = np.empty((len(at), 3, 3))
    for a in range(3):
        for b in range(3):
            hess[:, a, b] = g[a][b][i, j, k]
    _, vec = np.linalg.eigh(0.5 * (hess + hess.transpose(0, 2, 1)))
    n = vec[:, :, 0]
    lead = np.argmax(np.abs(n) > 1e-6, axis=1)
    return n * np.where(n[np.arange(len(n)), lead] < 0, -1.0, 1.0)[:, None]


def sample_lines(field: np.ndarray, block: Block, pts: np.ndarray, dirs: np.ndarray, ts: np.ndarray, nearest: bool = False) -> np.ndarray:
    """Field values at pts + t * dirs (points x ts); positions are clamped to the volume."""
    at = pts[:, None, :] + ts[None, :, None] * dirs[:, None, :]
    at = np.clip(at, 0, block.shape - 1) - block.origin
    if nearest:
        i = np.floor(at + 0.5).astype(int)
        i = np.minimum(i, np.array(field.shape) - 1)
        return field[i[..., 0], i[..., 1], i[..., 2]]
    lo = np.minimum(np.floor(at).astype(int), np.maximum(np.array(field.shape) - 2, 0))
    w = at - lo
    hi = np.minimum(lo + 1, np.array(field.shape) - 1)
    out = 0.0
    for corner in range(8):
        up = [(corner >> k) & 1 for k in range(3)]
        idx = [np.where(u, hi[..., k], lo[..., k]) for k, u in enumerate(up)]
        weight = np.prod([w[..., k] if u else 1 - w[..., k] for k, u in enumerate(up)], axis=0)
        out = out + weight * field[idx[0], idx[1], idx[2]]
    return out
