"""Shards along a Hilbert curve through the metadata of documents, so that a filter on any dimension skips most shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmetry.llm.common import pick, running
from voxelmetry.llm.exact_dedup import content_hash
from voxelmetry.session import cut_lineage

SHARDS, BITS = 16, 8
# a group of equal texts stays in one shard up to this part of a shard's bytes
TOGETHER = 0.01


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of points [n, dimensions] of ``bits`` bits each along the Hilbert curve through their grid.

    Published transposition: from the highest bit down, a set bit of a coordinate inverts the lower bits of the first
    one and an unset bit exchanges them; what results is Gray-coded, and its bits are interleaved.
    """
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(len(x)):
            inverted = (x[k] >> bit & 1).astype(bool)
            moved = np.where(inverted, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ moved)
            x[k] = x[k] ^ moved
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | (c ^ flip) >> bit & 1
    return out


def _category_codes(groups: DataFrame, column: str, bits: int) -> DataFrame:
    """column, code: categories in order of their names, at equal depth: as many rows below a code as its share says."""
    counts = groups.groupBy(column).agg(F.sum("rows").cast("long").alias("n")).withColumn("_some", F.col(column).isNotNull())
    placed = running(cut_lineage(counts, "categories"), [], ["_some", column], "n")
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    code = F.floor((F.col("start") + F.col("n") / 2) / total * (1 << bits)).cast("int")
    return cut_lineage(placed.select(F.col(column).alias(f"_{column}"), code.alias(f"{column}_code")), "codes")


def hilbert_shards(
    docs: DataFrame, shards: int = SHARDS, bits: int = BITS, together: float = TOGETHER,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve and the dimensions of every row.

    Dimensions: language and source, each quantised to ``bits`` bits at equal depth, and the logarithm of the size in
    eighths (linear between powers of two). Equal texts are one group and lie together, at the place of their smallest id. Rows in curve order are cut
    into runs of nearly equal bytes (law ``bytes``): a row goes where its middle byte falls, and a group of up to
    ``together`` of a shard goes where its own middle byte falls, so that it is never cut. Larger groups are cut like
    any rows. Positions are range-partitioned running sums over narrow rows; texts are read once and never shuffled.

    size is the UTF-8 bytes of the text plus 1, slots are gapless from 0 in each shard, grown_shard is null.
    Null text has no bytes, size 1 and the crc of no bytes, and forms a group with empty texts. Null language or source
    is a category before all others. Null ids come before others, and repeated rows are separate rows. Shards may be
    empty where there are fewer rows than shards; an empty table gives an empty result; other columns are never read.
    """
    docs = pick(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col)
    text = F.coalesce("text", F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), content_hash(text).alias("text_hash"),
        ),
        "narrow",
    )
    first = F.min_by(F.struct("lang", "source", "size"), F.struct("doc_id", "row"))
    groups = rows.groupBy("text_hash").agg(first.alias("f"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("group_size"))
    groups = cut_lineage(groups.select("text_hash", F.col("f.lang").alias("lang"), F.col("f.source").alias("source"), F.col("f.size").alias("one"), "rows", "group_size"), "groups")
    # the place of the highest bit and the three bits below it: whole numbers, so that no rounding is involved
    high = F.length(F.bin("one")) - 1
    size_code = F.least(high * 8 + F.call_function("shiftright", F.col("one") * 8, high).bitwiseAND(7), F.lit((1 << bits) - 1)).cast("int")
    coded = groups.withColumn("size_code", size_code)
    for c in ("lang", "source"):
        codes = _category_codes(groups, c, bits)
        coded = coded.join(codes, F.col(c).eqNullSafe(F.col(f"_{c}"))).drop(f"_{c}", c)

    def curve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(curve=hilbert_index(b[["lang_code", "source_code", "size_code"]].to_numpy(), bits))

    kinds = "text_hash binary, group_size bigint, lang_code int, source_code int, size_code int"
    coded = cut_lineage(coded.select("text_hash", "group_size", "lang_code", "source_code", "size_code").mapInPandas(curve, f"{kinds}, curve bigint"), "curve")
    ordered = running(cut_lineage(rows.drop("lang", "source").join(coded, "text_hash"), "keyed"), [], ["curve", "text_hash", "doc_id", "row"], "size")
    ordered = cut_lineage(ordered, "ordered")
    total = ordered.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    # a written table, so that the join below is one that may be split where a group is large
    starts = cut_lineage(ordered.groupBy("text_hash").agg(F.min("start").alias("group_start")), "starts")
    run: Column = F.when(F.col("group_size") <= together * total / shards, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("start") + F.col("size") / 2)
    cut = ordered.join(starts, "text_hash").withColumn("shard", F.least(F.floor(run * shards / total), F.lit(shards - 1)).cast("int"))
    cut = cut_lineage(cut, "cut")
    begins = cut.groupBy(F.col("shard").alias("_shard")).agg(F.min("place").alias("_begin"))
    return cut.join(begins, F.col("shard") == F.col("_shard")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("_begin")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve", "lang_code", "source_code", "size_code", "text_hash",
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the rows of ``docs`` under ``path``/shard=N in the order of their slots, and returns the manifest.

    The manifest has a row per shard: shard, rows, bytes and the smallest and largest code of each dimension, by which
    a reader picks the shards that a filter can meet. Rows are found by id and content; rows that repeat both are written
    once for each place.
    """
    flat = docs.withColumn("_hash", content_hash(F.coalesce(F.col(text_col), F.lit(""))))
    repeats = flat.groupBy(F.col(id_col).alias("_id"), "_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    once = flat.join(repeats.select("_id", F.col("_hash").alias("_h")), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left_anti")
    again = flat.join(repeats.select("_id", F.col("_hash").alias("_h")), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left_semi")
    unique = once.unionByName(again.dropDuplicates([id_col, "_hash"]))
    spots = placed.select(F.col("doc_id").alias("_pid"), F.col("text_hash").alias("_phash"), "shard", "slot")
    found = unique.join(spots, F.col(id_col).eqNullSafe(F.col("_pid")) & (F.col("_hash") == F.col("_phash"))).drop("_hash", "_pid", "_phash")
    found.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    codes = ("lang_code", "source_code", "size_code")
    return placed.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *[f(c).alias(f"{n}_{c}") for c in codes for n, f in (("min", F.min), ("max", F.max))]
    )
