"""Parametric patches: node grids from several batches, their slab, feature tables by slab."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLAB_HEIGHT = 250

NODES_SCHEMA = T.StructType(
    [T.StructField("patch", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())]
    + [T.StructField(a, T.DoubleType()) for a in "xyz"]
)


def union_batches(batches: Mapping[str, DataFrame], check_unique: bool = True, key: Sequence[str] = ("patch",)) -> DataFrame:
    """Patches of several batches under prefixed names. A name (or another ``key``, such as patch, row and col of node
    tables) that a batch has twice fails the job."""
    named = [df.withColumn("patch", F.concat(F.lit(name + "/"), "patch")) for name, df in batches.items()]
    out = reduce(DataFrame.unionByName, named)
    if not check_unique:
        return out
    from voxelmetry.sources.records import require_unique

    return require_unique(out, list(key), "patch")


def valid_node() -> Column:
    """A grid node carries a position: all three coordinates are positive."""
    return (F.col("x") > 0) & (F.col("y") > 0) & (F.col("z") > 0)


def slab_of(z_low: Column, z_high: Column, z_mean: Column, height: int = SLAB_HEIGHT) -> Column:
    """Slab of a patch: that of its box's middle, else of its mean height."""
    return F.floor(F.coalesce((z_low + z_high) / 2, z_mean) / height).cast("int")


def read_features(spark: SparkSession, path: str, features: Sequence[str], slabs: Sequence[int] | None = None) -> DataFrame:
    """Feature table partitioned by slab; the stored columns must be the expected ones."""
    df = spark.read.parquet(path)
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"feature table lacks {missing}")
    return df if slabs is None else df.where(F.col("slab").isin(list(slabs)))


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("slab").parquet(path)


def enough_slabs(features: DataFrame, at_least: int = 5) -> DataFrame:
    """Passes the table through, failing the job when it holds too few slabs to hold one out."""
    n = features.agg(F.countDistinct("slab")).scalar()
    ok = F.assert_true(n >= at_least, F.lit(f"fewer than {at_least} slabs"))
    return features.withColumn("_ok", ok).where("_ok IS NULL").drop("_ok")
