"""Chunked array stores as a Spark data source: a folder with ``.zarray`` and one file for each stored chunk.

``read_store`` plans runs of chunks that meet the wanted box; many small runs share a partition. Comparisons of z, y and x with
constants are pushed into the scan, so that a filter opens only the files it needs. A chunk without a file is all fill
value. Paths are opened with Arrow's filesystems, so that ``file://``, ``hdfs://`` and object stores work alike.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from voxelmetry.sources.chunks import parse_array_metadata

AXES = ("z", "y", "x")
# chunks of a run; a partition reads more only if there are many runs
RUN = 16


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a path and the path inside it; a plain path is a local one."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


@dataclass(frozen=True)
class Layout:
    """What a store's metadata says about its chunks."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill: float
    separator: str

    @staticmethod
    def read(path: str) -> Layout:
        files, root = opened(path)
        with files.open_input_stream(f"{root}/.zarray") as f:
            meta = json.loads(f.read())
        if meta.get("compressor") is not None or meta.get("filters"):
            raise ValueError(f"{path}: only uncompressed chunks can be read")
        if meta.get("order", "C") != "C" or len(meta["shape"]) != 3:
            raise ValueError(f"{path}: only three axes in C order can be read")
        return Layout(tuple(meta["shape"]), tuple(meta["chunks"]), meta["dtype"], meta.get("fill_value") or 0, meta.get("dimension_separator", "."))

    def name(self, index: Sequence[int]) -> str:
        return self.separator.join(str(i) for i in index)

    def chunk(self, files: pafs.FileSystem, root: str, index: Sequence[int]) -> tuple[np.ndarray, bool]:
        """The cells of a chunk inside the volume, and whether it is stored. A file of another size fails."""
        size = [min(c, n - i * c) for i, c, n in zip(index, self.chunks, self.shape)]
        path = f"{root}/{self.name(index)}"
        try:
            with files.open_input_stream(path) as f:
                raw = f.read()
        except FileNotFoundError:
            return np.full(size, self.fill, np.dtype(self.dtype)), False
        if len(raw) != int(np.prod(self.chunks)) * np.dtype(self.dtype).itemsize:
            raise ValueError(f"{path}: {len(raw)} bytes are not a chunk of {self.chunks} {self.dtype}")
        whole = np.frombuffer(raw, np.dtype(self.dtype)).reshape(self.chunks)
        return whole[tuple(slice(0, n) for n in size)], True


def stores_in(path: str) -> list[tuple[str, str]]:
    """Names and paths of the stores: the folder itself (without a name), or those right below it."""
    files, root = opened(path)
    if files.get_file_info(f"{root}/.zarray").type == pafs.FileType.File:
        return [("", path)]
    inner = files.get_file_info(pafs.FileSelector(root))
    return sorted((i.base_name, f"{path}/{i.base_name}") for i in inner if i.type == pafs.FileType.Directory)


def read_array_metadata(spark: SparkSession, path: str) -> DataFrame:
    """store and the parsed metadata of every store in a folder. Tasks read the files, which Spark's readers take for hidden ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for store in batch.column(1).to_pylist():
                files, root = opened(store)
                with files.open_input_stream(f"{root}/.zarray") as f:
                    texts.append(f.read().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["store", "value"])

    found = stores_in(path.rstrip("/"))
    named = spark.createDataFrame(found, "store STRING, path STRING")
    return parse_array_metadata(named.repartition(max(1, min(len(found), 200))).mapInArrow(work, "store STRING, value STRING"), "value")


@dataclass
class ChunkRun:
    store: str
    layout: Layout
    start: int
    stop: int


@dataclass
class ChunkRuns(InputPartition):
    runs: list[ChunkRun]


# partitions of a scan at most, however many stores there are; and rows of a batch about
PARTITIONS, ROWS = 512, 1 << 16
# metadata files that are read at the same time
READERS = 32


class StoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.run = options["path"].rstrip("/"), int(options.get("run", RUN))
        self.low, self.high = [0, 0, 0], [None, None, None]
        self.stores: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the box by comparisons of z, y, x and the stores by name; both are exact, so Spark needn't repeat them."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            whole = isinstance(getattr(f, "value", None), int)
            if name in AXES and whole and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                k = AXES.index(name)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[k] = max(self.low[k], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high[k] = end if self.high[k] is None else min(self.high[k], end)
            elif name == "store" and isinstance(f, (EqualTo, In)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.stores = wanted if self.stores is None else self.stores & wanted
            else:
                yield f

    def _box(self, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        high = [n if h is None else max(min(h, n), 0) for h, n in zip(self.high, layout.shape)]
        return np.array(self.low), np.array(high)

    def _grid(self, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """First chunk and number of chunks on each axis that meet the box."""
        low, high = self._box(layout)
        first = low // layout.chunks
        return first, np.where(high > low, -(-high // layout.chunks) - first, 0)

    def partitions(self) -> list[ChunkRuns]:
        """Runs of chunks in C order, many small ones to a partition. The folder is a store itself, or holds stores."""
        wanted = [(name, path) for name, path in stores_in(self.root) if self.stores is None or name in self.stores]
        with ThreadPoolExecutor(READERS) as pool:
            layouts = list(pool.map(Layout.read, [path for _, path in wanted], chunksize=64))
        known: dict[Layout, Layout] = {}  # equal layouts are sent once
        runs = []
        for (name, _), layout in zip(wanted, layouts):
            layout = known.setdefault(layout, layout)
            n = int(np.prod(np.maximum(self._grid(layout)[1], 0)))
            runs += [ChunkRun(name, layout, k, min(k + self.run, n)) for k in range(0, n, self.run)]
        # consecutive runs share a partition by their chunks; a few stores keep a partition for each run
        each = max(self.run, -(-sum(r.stop - r.start for r in runs) // PARTITIONS))
        parts: list[ChunkRuns] = []
        held = each
        for r in runs:
            if held + r.stop - r.start > each:
                parts.append(ChunkRuns([]))
                held = 0
            parts[-1].runs.append(r)
            held += r.stop - r.start
        return parts or [ChunkRuns([])]

    def read(self, partition: ChunkRuns) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0
        for run in partition.runs:
            for chunk in self._chunks(run):
                held.append(chunk)
                rows += chunk[-1].size
                if rows >= ROWS:
                    yield self._batch(held)
                    held, rows = [], 0
        if held:
            yield self._batch(held)

    def _chunks(self, run: ChunkRun) -> Iterator[tuple]:
        """Store, index, whether stored, positions and cells of each chunk of a run, cut to the box."""
        layout = run.layout
        files, root = opened(f"{self.root}/{run.store}" if run.store else self.root)
        (low, high), (first, size) = self._box(layout), self._grid(layout)
        for k in range(run.start, run.stop):
            index = first + np.array(np.unravel_index(k, size))
            cells, stored = layout.chunk(files, root, index.tolist())
            corner = index * layout.chunks
            cut = [slice(max(lo - c, 0), hi - c) for lo, hi, c in zip(low, high, corner)]
            cells = cells[tuple(cut)]
            at = np.indices(cells.shape).reshape(3, -1) + (corner + [s.start for s in cut])[:, None]
            yield run.store, index, stored, at, cells.reshape(-1).astype(np.float64)

    @staticmethod
    def _batch(chunks: list[tuple]) -> pa.RecordBatch:
        stores, index, stored, at, cells = zip(*chunks)
        sizes = [len(c) for c in cells]
        which = pa.array(np.repeat(np.arange(len(chunks)), sizes))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(stores, pa.string()).take(which), *[pa.array(np.array([i[k] for i in index], np.int32)).take(which) for k in range(3)], pa.array(stored).take(which),
                *[pa.array(a.astype(np.int32)) for a in np.concatenate(at, axis=1)], pa.array(np.concatenate(cells)),
            ],
            ["store", "cz", "cy", "cx", "stored", *AXES, "value"],
        )


class StoreSource(DataSource):
    """Format ``chunkstore``; options ``path`` and ``run`` (chunks of a run)."""

    @classmethod
    def name(cls) -> str:
        return "chunkstore"

    def schema(self) -> str:
        return "store STRING, cz INT, cy INT, cx INT, stored BOOLEAN, z INT, y INT, x INT, value DOUBLE"

    def reader(self, schema) -> StoreReader:
        return StoreReader(dict(self.options))


def read_store(spark: SparkSession, path: str, run: int = RUN) -> DataFrame:
    """store, cz, cy, cx, stored, z, y, x, value of the store in ``path``, or of all stores right below it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)
    return spark.read.format("chunkstore").option("run", run).load(path)


def write_store(fields: DataFrame, name: str, path: str, dtype: str = "|u1", fill: float = 0) -> int:
    """Writes every volume of ``fields`` (a table of packed blocks) as the store ``path/<name>``; returns the number of chunks.

    Tasks write the chunk files, each under another name first and then moved, so that a task that runs again leaves the
    same files. Blocks without a row stay missing, and are read as ``fill``.
    """
    rows = fields.select(F.col(name).cast("string").alias("name"), "bz", "by", "bx", "nz", "ny", "nx", "side", "data")

    def put(files: pafs.FileSystem, folder: str, file: str, content: bytes) -> None:
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/.{file}.{os.getpid()}.part") as f:
            f.write(content)
        files.move(f"{folder}/.{file}.{os.getpid()}.part", f"{folder}/{file}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        n, described = 0, set()
        for batch in batches:
            for row in batch.to_pylist():
                index, shape, side = (row["bz"], row["by"], row["bx"]), (row["nz"], row["ny"], row["nx"]), row["side"]
                size = [min(side, m - i * side) for i, m in zip(index, shape)]
                whole = np.full((side,) * 3, fill, np.dtype(dtype))
                whole[tuple(slice(0, m) for m in size)] = np.frombuffer(row["data"], np.float32).reshape(size)
                folder = f"{root}/{row['name']}"
                if folder not in described:
                    meta = {"zarr_format": 2, "shape": shape, "chunks": (side,) * 3, "dtype": dtype, "compressor": None, "filters": None, "order": "C", "fill_value": fill}
                    put(files, folder, ".zarray", json.dumps(meta).encode())
                    described.add(folder)
                put(files, folder, ".".join(map(str, index)), whole.tobytes())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return rows.mapInArrow(work, "n BIGINT").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
