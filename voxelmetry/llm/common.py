"""Column helpers and the running totals that several corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelmetry.session import cut_lineage

# the bytes between words: space, tab, line feed, vertical tab, form feed, carriage return
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"


def pick(docs: DataFrame, **names: str) -> DataFrame:
    """Columns of ``docs`` under new names (new=old), whatever its other columns are called."""
    columns = list(docs.columns)
    flat = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    return flat.select([F.col(f"c{columns.index(old)}").alias(new) for new, old in names.items()])


def words(text: Column) -> Column:
    """The runs of other characters than SEPARATORS, in order; an empty array for null and for separators alone."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{SEPARATOR_CLASS}+"))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds ``start`` (sum of ``value`` over the earlier rows of the group) and ``place`` (their number).

    Rows are range-partitioned by (group, order), so that a group of a third of all rows is cut into as many pieces as
    any other third; the totals of the pieces, one row for each piece and group, are what is added up across pieces.
    ``df`` must be a written table, as its ranges are drawn in a pass of their own. Rows that are equal in ``order``
    are exchangeable.
    """
    by = list(by)
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(pieces, *by, *order).withColumn("_piece", F.spark_partition_id()), "runs")
    totals = placed.groupBy(*by, "_piece").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = totals.select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("_piece").alias("_p"),
        F.coalesce(F.sum("_sum").over(earlier), zero).alias("_start"), F.coalesce(F.sum("_n").over(earlier), zero).alias("_place"),
    )
    here = W.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("_s", F.coalesce(F.sum(value).over(here), zero)).withColumn("_r", F.coalesce(F.count(F.lit(1)).over(here), zero))
    same = (F.col("_piece") == F.col("_p"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return inside.join(before, same).select(
        *df.columns, (F.col("_s") + F.col("_start")).alias("start"), (F.col("_r") + F.col("_place")).alias("place")
    )
