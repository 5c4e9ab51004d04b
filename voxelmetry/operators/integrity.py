"""Content digests, duplicates and multiset comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxelmetry.functions.expr import count_if, hash_uniform
from voxelmetry.operators.volumes import _packed_planes
from voxelmetry.session import cut_lineage, spread


def content_digests(voxels: DataFrame, by: Sequence[str], value: str = "ct", shape: Sequence[int] | None = None) -> DataFrame:
    """SHA-256 of a volume's bytes in C order (raw_digest) and of its nonzero-cropped content (content_digest), the crop
    box (z0..x1, both ends inside) and the volume's size.

    Values are bytes; absent voxels are zero. Without ``shape`` a volume ends at its last stored voxel. Voxels are packed
    by plane where they are; a task then takes the planes of a volume in order and feeds them to the digests one by one,
    so that it holds a single plane. A volume without content has no content_digest.
    """
    by = list(by)
    nz = F.when(F.col(value) != 0, 1)
    end = lambda a, k: (F.max(a) + 1 if shape is None else F.max(F.lit(shape[k]))).cast("int").alias(f"n{a}")
    box = voxels.groupBy(*by).agg(
        *[f(F.when(nz == 1, F.col(a))).alias(f"{a}{s}") for a in "zyx" for f, s in ((F.min, "0"), (F.max, "1"))],
        *[end(a, k) for k, a in enumerate("zyx")],
    )
    box = cut_lineage(box, "boxes")
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in voxels.select(*by).schema)
    cells = voxels.select(*by, *[F.col(a).cast("int").alias(a) for a in "zyx"], F.col(value).cast("double").alias("_value"))
    planes = cells.mapInArrow(_packed_planes(len(by), 0, 1, 2, None), keys + "_plane INT, _tile INT, _line BINARY, _pos BINARY, _val BINARY")
    ends = [*[f"{a}{k}" for a in "zyx" for k in "01"], "nz", "ny", "nx"]
    rows = spread(planes.join(box.select(*by, *ends), by).select(*by, "_plane", "_line", "_pos", "_val", *ends), *by).sortWithinPartitions(*by, "_plane")
    n_keys = len(by)

    def digested(key: tuple, rows: Iterator[dict]) -> tuple:
        raw, crop, z, ends = hashlib.sha256(), None, 0, None
        for plane, parts in groupby(rows, lambda r: r["_plane"]):
            parts = list(parts)
            ends = ends or parts[0]
            ny, nx = ends["ny"], ends["nx"]
            if crop is None and ends["z0"] is not None:
                crop, inside = hashlib.sha256(), (slice(ends["y0"], ends["y1"] + 1), slice(ends["x0"], ends["x1"] + 1))
            cells = np.zeros((ny, nx), np.uint8)
            for r in parts:
                cells[np.frombuffer(r["_line"], np.int32), np.frombuffer(r["_pos"], np.int32)] = np.frombuffer(r["_val"]).astype(np.uint8)
            for k in range(z, plane + 1):
                now = cells if k == plane else np.zeros((ny, nx), np.uint8)
                raw.update(now.tobytes())
                if crop is not None and ends["z0"] <= k <= ends["z1"]:
                    crop.update(np.ascontiguousarray(now[inside]).tobytes())
            z = plane + 1
        for _ in range(z, ends["nz"]):
            raw.update(bytes(ends["ny"] * ends["nx"]))
        return (*key, raw.hexdigest(), None if crop is None else crop.hexdigest())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in batch.to_pylist())
        for key, rows in groupby(each, lambda r: tuple(r.values())[:n_keys]):
            yield pa.RecordBatch.from_pylist([dict(zip([*by, "raw_digest", "content_digest"], digested(key, rows)))], schema=schema)

    ddl = keys + "raw_digest STRING, content_digest STRING"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    return box.join(rows.mapInArrow(work, ddl), by)


def text_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("raw_digest", F.sha2(F.col(text), 256)).withColumn("content_digest", F.sha2(F.trim(F.col(text)), 256))


def duplicates(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys that occur more than once, one row per member, with the size of the group.

    The members stay rows: a digest shared by a large part of the data is never collected into one list.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("first_member")).where("n > 1")
    return df.select(key, member).join(sizes, key)


def reverify(published: DataFrame, recomputed: DataFrame, key: str, digest: str, share: float = 1.0, seed: int = 0) -> DataFrame:
    """key, verified of a seeded ``share`` of the published digests: whether the recomputed one agrees.

    A key without a recomputed digest is not verified. Which keys are drawn depends on seed and key alone.
    """
    again = recomputed.select(key, F.col(digest).alias("_again"))
    drawn = published.where(hash_uniform(seed, key) < share)
    return drawn.join(again, key, "left").select(key, F.col(digest).eqNullSafe(F.col("_again")).alias("verified"))


def digest_mismatches(published: DataFrame, recomputed: DataFrame, key: str, digest: str) -> DataFrame:
    """Entities whose recomputed digest differs from the published one."""
    again = recomputed.select(key, F.col(digest).alias("_again"))
    return published.join(again, key).where(~F.col(digest).eqNullSafe(F.col("_again")))


def unexpected_values(df: DataFrame, by: Sequence[str], value: str, expected: Sequence) -> DataFrame:
    """Distinct label values per group, and how many of them were not expected."""
    d = df.select(*by, value).distinct()
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_values"), count_if(~F.col(value).isin(list(expected))).alias("n_unexpected")
    )


def multiset_difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts per key on both sides with the surplus of ``a`` over ``b`` (negative: deficit)."""
    ca = a.groupBy(*key).agg(F.count(F.lit(1)).alias("n_a"))
    cb = b.groupBy(*key).agg(F.count(F.lit(1)).alias("n_b"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ca.join(cb, list(key), "full_outer").select(*key, n("n_a").alias("n_a"), n("n_b").alias("n_b"), (n("n_a") - n("n_b")).alias("surplus"))


def multiset_overlap(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: size of the multiset intersection, and whether ``a`` is contained in ``b``."""
    d = multiset_difference(a, b, key)
    return d.agg(F.sum(F.least("n_a", "n_b")).alias("n_common"), (F.max("surplus") <= 0).alias("contained"))


def gate_table(values: DataFrame, gates: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Named thresholds against a one-row or per-group table: pass/fail columns and their AND."""
    checks = {f"gate_{i + 1}": _check(F.col(c), op, lim) for i, (c, op, lim) in enumerate(gates)}
    out = values.withColumns(checks)
    passed = F.lit(True)
    for k in checks:
        passed = passed & F.col(k)
    return out.withColumn("passed", passed)


def _check(c: Column, op: str, limit: float) -> Column:
    ops = {">=": c >= limit, "<=": c <= limit, "<": c < limit, ">": c > limit}
    return F.coalesce(ops[op], F.lit(False))
