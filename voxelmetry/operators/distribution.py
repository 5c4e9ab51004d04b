"""Exact order statistics that survive one group holding a large share of all rows.

The usual ``percentile`` and ``rank() OVER (PARTITION BY group)`` put a whole group into one task. Here rows
are first counted per distinct value (map-side combined) and written, so that the source is read once. Where there are
more than a task should hold, (group, value) is cut into ranges of about PER_RANGE distinct values, and running counts
are taken inside the ranges and shifted by the counts of the ranges below.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as _w

from voxelmetry.session import cut_lineage

W = _w.Window
# distinct values that a task takes running counts of; more are cut into ranges of about that many
PER_RANGE = 200_000


def cumulative(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """One row per (by, value): ``n``, running ``cum`` (inclusive), group ``total`` and the extra ``sums``.

    For every extra sum ``s`` the running ``cum_s`` and group ``total_s`` are given too. Rows with a NULL or NaN
    value are left out. ``weight`` counts a row more than once.
    """
    by = list(by)
    sums = dict(sums or {})
    names = ["n", *sums]
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = ok.groupBy(*by, value).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"),
        *[F.sum(c).alias(k) for k, c in sums.items()],
    )
    counts = cut_lineage(counts, "value_counts")
    pieces = -(-counts.count() // PER_RANGE)
    if pieces <= 1:
        group = W.partitionBy(*by)
        upto = group.orderBy(value)
        return counts.select(
            *by, value, *names, *[F.sum(c).over(upto).alias(_cum(c)) for c in names], *[F.sum(c).over(group).alias(_total(c)) for c in names]
        )

    # ranges of (group, value) hold about as many values each, however large a group is
    pieces = max(pieces, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(counts.repartitionByRange(pieces, *by, value).withColumn("_range", F.spark_partition_id()), "value_ranges")
    # one row for each range and group from here on
    per_range = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_in_{c}") for c in names])
    group = W.partitionBy(*by)
    below = per_range.select(
        *[F.col(b).alias(f"_{b}") for b in by],
        F.col("_range").alias("_r"),
        *[
            (F.sum(f"_in_{c}").over(group.orderBy("_range")) - F.col(f"_in_{c}")).alias(f"_below_{c}")
            for c in names
        ],
        *[F.sum(f"_in_{c}").over(group).alias(_total(c)) for c in names],
    )
    same = F.col("_range") == F.col("_r")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    inside = W.partitionBy(*by, "_range").orderBy(value)
    return ranged.join(below, same).select(
        *by,
        value,
        *names,
        *[(F.sum(c).over(inside) + F.col(f"_below_{c}")).alias(_cum(c)) for c in names],
        *[_total(c) for c in names],
    )


def _cum(name: str) -> str:
    return "cum" if name == "n" else f"cum_{name}"


def _total(name: str) -> str:
    return "total" if name == "n" else f"total_{name}"


def quantiles_from(cum: DataFrame, value: str, qs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles (the numpy default) out of a ``cumulative`` table, plus ``n``."""
    at = []
    for i, q in enumerate(qs.values()):
        pos = F.lit(float(q)) * (F.col("total") - 1)
        at += [
            F.min(F.when(F.col("cum") > F.floor(pos), F.col(value))).cast("double").alias(f"_lo{i}"),
            F.min(F.when(F.col("cum") > F.ceil(pos), F.col(value))).cast("double").alias(f"_hi{i}"),
        ]
    picked = cum.groupBy(*by).agg(F.max("total").alias("n"), *at)
    out = []
    for i, (name, q) in enumerate(qs.items()):
        pos = F.lit(float(q)) * (F.col("n") - 1)
        out.append(
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos))).alias(name)
        )
    return picked.select(*by, "n", *out)


def quantiles(df: DataFrame, value: str, qs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles per group: columns ``by``, ``n`` and one per name in ``qs``."""
    return quantiles_from(cumulative(df, value, by), value, qs, by)


def medians(df: DataFrame, values: Sequence[str], by: Sequence[str] = (), name: str = "field") -> DataFrame:
    """Median of several columns at once, in long form: ``by``, ``name``, ``n``, ``median``."""
    return quantiles(unpivot(df, values, by, name), "value", {"median": 0.5}, [*by, name])


def unpivot(df: DataFrame, values: Sequence[str], by: Sequence[str] = (), name: str = "field") -> DataFrame:
    """Wide to long with a double ``value`` column."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in values])
    return wide.unpivot(list(by), list(values), name, "value")


def mid_ranks(cum: DataFrame) -> DataFrame:
    """Adds ``mid_rank``, the average rank of the ties at each value of a ``cumulative`` table."""
    return cum.withColumn("mid_rank", F.col("cum") - (F.col("n") - 1) / F.lit(2.0))


def interval_of(df: DataFrame, value: str, edges: DataFrame, by: Sequence[str], cuts: Sequence[str]) -> DataFrame:
    """Joins per-group cut points and adds ``stratum``: how many of the cuts are <= value."""
    joined = df.join(edges, list(by))
    stratum = sum((F.when(F.col(value) >= F.col(c), 1).otherwise(0) for c in cuts), F.lit(0))
    return joined.withColumn("stratum", stratum)
