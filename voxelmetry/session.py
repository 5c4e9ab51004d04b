"""Session helpers: the recommended settings and the shared place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_RUN: ContextVar[str | None] = ContextVar("run_folder", default=None)


def build_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(master)
        .appName("voxelmetry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Where written tables go: the folder of the run, or else the cluster's shared checkpoint folder.

    A temporary folder serves only a local master.
    """
    if _RUN.get():
        return _RUN.get()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.conf.get("voxelmetry.local.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-voxelmetry-", dir="/tmp")
    spark.conf.set("voxelmetry.local.checkpoint.dir", root)
    return root


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """One folder for all tables that are written inside, removed on leaving.

    Queries are lazy and read such tables when their result is computed, so store or collect the result inside.
    """
    path = f"{checkpoint_root(spark)}/run-{uuid.uuid4().hex}"
    before = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(before)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions by ``keys`` into the session's full number of partitions.

    For stages whose work is array code: the adaptive planner sizes partitions by bytes and would put many small but
    costly groups into one task. The grouping that follows on the same keys needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut_lineage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` under the checkpoint folder (or another shared ``folder``) and read it back.

    A written table survives the loss of executors, gives the next round real sizes to plan with, and is
    computed once, which the iterative operators need.
    """
    spark = df.sparkSession
    path = f"{folder or checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
