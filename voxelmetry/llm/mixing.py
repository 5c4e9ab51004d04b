"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

The points frac(t * golden ratio) are mapped through the cumulative shares of the sources: slot t of the mix belongs to
the source whose interval holds its point, so every stretch of the mix has nearly the target proportions. Slots are
ranked within their source, and the r-th slot takes the r-th block of the source's shuffled words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelmetry.llm.common import pick, running, words
from voxelmetry.llm.exact_dedup import content_hash
from voxelmetry.session import cut_lineage

WEIGHTS, SHARE, CEILING = (3, 1, 2), 1.5, 2
# words in a block, and the cells in which points meet the intervals of the sources
BLOCK, CELLS = 1024, 4096
GOLDEN = "0.618033988749894848"
# slots that are ranked together in one task
STRETCH = 1 << 16


@dataclass
class Mix:
    """rows: row, doc_id, text_hash, source, size. sources: source, source_size, target, quota (whole words).
    schedule: slot, source, block. pieces: slot, row, begin, end (words of the row that the slot takes)."""

    rows: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def source_targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target, quota: targets follow the weights, and none is above ``ceiling`` times its source.

    Sources stand in code-point order, null last, and get the weights in turn. What a source cannot take is shared among
    the others by weight, until none is above its ceiling; each round is one small aggregation, of which the driver sees
    three sums.
    """
    sizes = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size")).select(F.col("source").isNull().alias("_none"), "source", "source_size", F.lit(0).cast("long").alias("_zero")), "sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int"))
    weighed = cut_lineage(running(sizes, [], ["_none", "source"], "_zero").select("source", "source_size", weight.alias("weight")), "weights")
    level, closed = 0.0, -1
    while True:
        full = ceiling * F.col("source_size") < F.lit(level) * F.col("weight")
        r = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(full, ceiling * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight"))), F.lit(0.0)), F.count_if(full),
        ).first()
        if r[3] == closed or not r[2]:
            break
        level, closed = (share * r[0] - r[1]) / r[2], r[3]
    target = F.least(F.lit(float(ceiling)) * F.col("source_size"), F.lit(level) * F.col("weight"))
    return cut_lineage(weighed.select("source", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("quota")), "targets")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source, block: which block of which source stands in each slot of the mix.

    There are as many points as blocks in all quotas. The points give a source its number of blocks up to a few; slots
    beyond it are left out, and blocks that no point has reached follow after the last slot, so quotas are met exactly.
    """
    spark = sources.sparkSession
    blocks = sources.where("quota > 0").select("source", F.ceil(F.col("quota") / block).cast("long").alias("blocks"))
    places = cut_lineage(running(cut_lineage(blocks, "blocks"), [], ["source"], "blocks").select("source", "blocks", "start"), "places")
    total = places.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    # exact decimal arithmetic: points are whole multiples of 1e-18
    point = F.pmod(F.col("slot").cast("decimal(19,0)") * F.expr(f"cast('{GOLDEN}' as decimal(18,18))"), F.expr("cast(1 as decimal(1,0))"))
    at = F.floor(point.cast("double") * total).cast("long")
    cell = lambda c: F.floor(c * (CELLS / max(total, 1))).cast("int")
    points = spark.range(total).withColumnRenamed("id", "slot").withColumn("at", at).withColumn("cell", cell(F.col("at")))
    spans = places.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("blocks") - 1))))
    hits = points.join(spans, "cell").where("at >= start and at < start + blocks").select("slot", "source", "blocks", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    hits = cut_lineage(hits, "hits")
    counts = hits.groupBy("source", "stretch").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("source").orderBy("stretch")
    before = counts.select(F.col("source").alias("_source"), F.col("stretch").alias("_stretch"), (F.sum("n").over(order) - F.col("n")).alias("before"))
    here = F.row_number().over(W.partitionBy("source", "stretch").orderBy("slot")) - 1
    ranked = hits.withColumn("here", here).join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("stretch") == F.col("_stretch")))
    ranked = ranked.withColumn("block", (F.col("here") + F.col("before")).cast("long")).where("block < blocks").select("slot", "source", "block")
    reached = counts.groupBy(F.col("source").alias("_source")).agg(F.sum("n").alias("reached"))
    short = places.join(reached, F.col("source").eqNullSafe(F.col("_source")), "left").where(F.coalesce("reached", F.lit(0)) < F.col("blocks"))
    late = short.withColumn("block", F.explode(F.sequence(F.coalesce("reached", F.lit(0)).cast("long"), F.col("blocks") - 1)))
    return ranked.unionByName(late.select((F.lit(total) + F.col("start") + F.col("block")).alias("slot"), "source", "block"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, block: int = BLOCK, seed: str = "mix",
) -> Mix:
    """The mix of all rows; see ``Mix``.

    A row's size is its number of words. Each source's rows are shuffled by a hash of the seed and their id, laid end to
    end, at most ``ceiling`` times over, and cut into blocks of ``block`` words; its quota ends within a block. Rows are
    placed by range-partitioned running sums, so a source of a third of all rows is spread like any other third.
    Null text has size 0 and is never taken. A null source is a source of its own, the last one. Null ids share one
    place in the shuffle. Repeated rows are separate rows. An empty table gives an empty mix; other columns are
    never read.
    """
    docs = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", content_hash(F.coalesce("text", F.lit(""))).alias("text_hash"), "source",
        F.size(words(F.col("text"))).cast("long").alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_dice"),
    )
    rows = cut_lineage(narrow, "sizes")
    sources = source_targets(rows, weights, share, ceiling)
    slots = schedule(sources, block)
    placed = running(rows.where("size > 0"), ["source"], ["_dice", "doc_id", "size", "text_hash", "row"], "size")
    own = sources.select(F.col("source").alias("_source"), "source_size", "quota")
    laid = placed.join(own, F.col("source").eqNullSafe(F.col("_source"))).withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(ceiling - 1))))
    laid = laid.withColumn("from", F.col("lap") * F.col("source_size") + F.col("start")).where("from < quota")
    upto = F.least(F.col("from") + F.col("size"), F.col("quota"))
    cut = laid.withColumn("upto", upto).withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("upto") - 1) / block))))
    edge = lambda c: c - F.col("from")
    cut = cut.select(
        F.col("source").alias("_source"), F.col("block").alias("_block"), "row",
        edge(F.greatest("from", F.col("block") * block)).alias("begin"), edge(F.least("upto", (F.col("block") + 1) * block)).alias("end"),
    )
    pieces = slots.join(cut, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).select("slot", "row", "begin", "end")
    return Mix(rows, sources, slots, pieces)


def taken_words(m: Mix) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, taken (words that the mix takes, repeats counted) of every row."""
    taken = m.pieces.groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    own = m.sources.select(F.col("source").alias("_source"), "source_size", "target")
    return m.rows.join(own, F.col("source").eqNullSafe(F.col("_source"))).join(taken, "row", "left").select(
        "doc_id", "text_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in whole: taken / size, rounded to the nearest number.

    Rows are found by id and content; those that repeat an id, a text and a source share what the mix takes of them evenly.
    """
    taken = taken_words(mix(docs, id_col, text_col, source_col, **parameters)).where("size > 0")
    times: Column = F.bround(F.sum("taken") / F.sum("size")).cast("int")
    times = taken.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(times.alias("_times"))
    times = cut_lineage(times.where("_times > 0"), "times")
    names = list(docs.columns)
    flat = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own_id, own_text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    found = flat.withColumn("_own", content_hash(F.coalesce(own_text, F.lit("")))).join(times, own_id.eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))
    return found.withColumn("_lap", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(flat.columns).toDF(*names)
