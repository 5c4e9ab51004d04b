"""Raw chunked array stores: metadata text and uncompressed chunk files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAY_METADATA = "shape ARRAY<INT>, chunks ARRAY<INT>, dtype STRING, compressor STRING, fill_value DOUBLE"


def parse_array_metadata(df: DataFrame, text: str) -> DataFrame:
    """Adds shape, chunks, dtype, compressor of a store's metadata text; bad text gives NULLs."""
    return df.withColumn("_m", F.from_json(text, ARRAY_METADATA, {"mode": "PERMISSIVE"})).select("*", "_m.*").drop("_m")


def decode_chunks(
    chunks: DataFrame,
    keep: Sequence[str],
    shape: tuple[int, int, int],
    chunk: tuple[int, int, int],
    dtype: str = "|u1",
    box: tuple[int, int, int, int, int, int] | None = None,
) -> DataFrame:
    """keep..., z, y, x, value of uncompressed chunks (cz, cy, cx, content).

    The box prunes chunks by their index before any content is decoded. Absent chunks are not stored: they read as zero.
    """
    z0, z1, y0, y1, x0, x1 = box or (0, shape[0], 0, shape[1], 0, shape[2])
    hit = F.lit(True)
    for name, size, lo, hi in zip(("cz", "cy", "cx"), chunk, (z0, y0, x0), (z1, y1, x1)):
        hit = hit & (F.col(name) * size < hi) & ((F.col(name) + 1) * size > lo)
    chosen = chunks.where(hit).select(*keep, "cz", "cy", "cx", "content")
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.select(*keep).schema)
    low = np.array([z0, y0, x0])
    high = np.minimum([z1, y1, x1], shape)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = np.frombuffer(row["content"], dtype=np.dtype(dtype)).reshape(chunk)
                at = np.indices(chunk).reshape(3, -1).T + np.array([row["cz"], row["cy"], row["cx"]]) * np.array(chunk)
                ok = ((at >= low) & (at < high)).all(axis=1)
                voxels = dict(zip("zyx", at[ok].T.astype("int32")))
                yield pd.DataFrame({**{k: row[k] for k in keep}, **voxels, "value": block.reshape(-1)[ok].astype("float64")})

    return chosen.mapInPandas(decode, keys + "z INT, y INT, x INT, value DOUBLE")


def read_chunks(spark: SparkSession, root: str, shape: tuple[int, int, int], chunk: tuple[int, int, int], dtype: str = "|u1", box=None) -> DataFrame:
    """path, z, y, x, value of a store whose uncompressed chunk files are named ``i.j.k``.

    Chunk indices come from the names of the listed files, so files outside the box are left out before they are opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*.*").load(root)
    parts = F.split(F.col("_metadata.file_name"), r"\.")
    idx = [F.get(parts, i).try_cast("int").alias(n) for i, n in enumerate(("cz", "cy", "cx"))]
    return decode_chunks(files.select("path", *idx, "content"), ["path"], shape, chunk, dtype, box)


def encode_chunks(voxels: DataFrame, by: Sequence[str], value: str, side: int) -> DataFrame:
    """by..., cz, cy, cx, content: dense byte chunks of side^3 from stored voxels, the rest zero. Bounded per chunk."""
    corner = [F.floor(F.col(a) / side).cast("int").alias(f"c{a}") for a in "zyx"]
    place = (F.pmod("z", F.lit(side)) * side + F.pmod("y", F.lit(side))) * side + F.pmod("x", F.lit(side))
    cells = voxels.select(*by, *corner, place.alias("i"), F.lpad(F.hex(F.col(value).cast("int")), 2, "0").alias("h"))
    packed = cells.groupBy(*by, "cz", "cy", "cx").agg(F.map_from_entries(F.collect_list(F.struct("i", "h"))).alias("m"))
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(side**3 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit("00")))
    return packed.select(*by, "cz", "cy", "cx", F.unhex(F.array_join(bytes_, "")).alias("content"))
