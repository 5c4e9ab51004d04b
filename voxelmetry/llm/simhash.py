"""Near duplicates by 64-bit SimHash fingerprints and covering locality-sensitive hashing.

Structured masks: every bit position gets one of the nonzero (radius + 1)-bit vectors, and the table of a nonzero
vector v looks at the positions whose vector has an odd product with v. Up to ``radius`` differing positions span at
most ``radius`` dimensions, so some v is orthogonal to all of them, and in its table the two fingerprints have the same
key. With radius 3 that is 15 tables of 34 key bits each: no link is missed, and keys are long enough for few chance
collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmetry.llm.common import pick, words
from voxelmetry.llm.exact_dedup import content_hash, staying_rows
from voxelmetry.session import cut_lineage

BITS = 64
# distinct fingerprints that are compared with one another in one task; larger buckets are split by more masks
BUCKET = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """One mask over ``positions`` for each nonzero vector of radius + 1 bits, as signed 64-bit numbers."""
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << p for k, p in enumerate(positions) if bin((1 + k % vectors) & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def shingle_hashes(tokens: Column, width: int) -> Column:
    """XXH64 (seed 42) of every run of ``width`` words joined by a space; of all words if there are fewer.

    ``tokens`` must be a plain column, as it is looked up for every shingle.
    """
    n = F.size(tokens)
    several = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(width)])))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, F.array(F.xxhash64(F.array_join(tokens, " ")))).otherwise(several)


def _majorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the list of hashes in the last column by the number whose bits are set in over half of them."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        prints = np.zeros(len(lists), np.uint64)
        lengths = np.diff(offsets)
        filled = np.flatnonzero(lengths)
        # a few ten thousand hashes at a time stay in the processor's cache
        groups = np.searchsorted(np.cumsum(lengths[filled]), np.arange(32768, lengths.sum() + 32768, 32768)) if len(filled) else []
        begin = 0
        for end in groups:
            end = min(int(end) + 1, len(filled))
            if end <= begin:
                continue
            docs = filled[begin:end]
            part = values[offsets[docs[0]] : offsets[docs[-1] + 1]]
            starts = offsets[docs] - offsets[docs[0]]
            half = lengths[docs]
            for bit in range(BITS):
                ones = np.add.reduceat(((part >> np.uint64(bit)) & np.uint64(1)).view(np.int64), starts)
                prints[docs] |= (2 * ones > half).astype(np.uint64) << np.uint64(bit)
            begin = end
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*batch.schema.names[:-1], "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, text_hash and print (the fingerprint as a signed number) of every row; zero for texts without a word."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tokens = docs.select("doc_id", content_hash(text).alias("text_hash"), words(F.translate(text, UPPER, LOWER)).alias("tokens"))
    hashes = tokens.select("doc_id", "text_hash", shingle_hashes(F.col("tokens"), width).alias("hashes"))
    return hashes.mapInArrow(_majorities, f"doc_id {id_type}, text_hash binary, print bigint")


def _forest(buckets: pd.Series, radius: int) -> pd.DataFrame:
    """Links inside buckets: enough of them to connect all that are connected by links of at most ``radius`` bits."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    arrays = [np.asarray(b, np.int64) for b in buckets]
    pairs = [a for a in arrays if len(a) == 2]
    if pairs:
        two = np.stack(pairs)
        near = np.bitwise_count((two[:, 0] ^ two[:, 1]).view(np.uint64)) <= radius
        found.append((two[near, 0], two[near, 1]))
    for a in arrays:
        if len(a) == 2:
            continue
        rest, front = a.view(np.uint64), np.empty(0, np.uint64)
        while len(rest):
            if not len(front):
                front, rest = rest[:1], rest[1:]
                continue
            near = np.bitwise_count(rest ^ front[0]) <= radius
            if near.any():
                reached = rest[near]
                found.append((np.full(len(reached), front[0]).view(np.int64), reached.view(np.int64)))
                front, rest = np.concatenate([front[1:], reached]), rest[~near]
            else:
                front = front[1:]
    if not found:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})


def links(prints: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, each at most ``radius`` bits apart, that connect all such pairs.

    ``prints``: a written table of distinct numbers in column ``print``. A bucket (table, key) of up to ``bucket``
    fingerprints is compared inside one task and yields a spanning forest, never all its pairs. A larger bucket, whose
    members agree on the bits of its mask, is covered again over the remaining bits; this ends at the third level, as
    few bits are left then. No bucket is cut.
    """
    if bucket < 1 << (2 * radius + 6):
        raise ValueError("buckets must be large enough that a larger one has bits left to split it by")
    masks = covering_masks(radius, list(range(BITS)))
    level = prints.select("print", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("_v", "mask")).select(
        "print", F.lit("").alias("_path"), F.col("_v"), "mask"
    )
    found = None
    while True:
        level = level.select("print", F.concat_ws("/", "_path", "_v").alias("path"), "mask", F.col("print").bitwiseAND(F.col("mask")).alias("key"))
        sizes = level.groupBy("path", "key").agg(F.count(F.lit(1)).alias("size"))
        small = level.join(sizes.where(F.col("size").between(2, bucket)), ["path", "key"])
        members = small.groupBy("path", "key").agg(F.collect_list("print").alias("members")).select("members")

        def connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield _forest(batch["members"], radius)

        part = cut_lineage(members.mapInPandas(connect, "a bigint, b bigint").distinct(), "links")
        found = part if found is None else found.unionByName(part)
        large = cut_lineage(level.join(sizes.where(F.col("size") > bucket), ["path", "key"]).select("print", "path", "mask"), "large_buckets")
        if large.isEmpty():
            return found

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for (path, mask), rows in batch.groupby(["path", "mask"]):
                    left = [p for p in range(BITS) if not int(mask) >> p & 1]
                    for v, more in enumerate(covering_masks(radius, left)):
                        yield pd.DataFrame({"print": rows["print"], "_path": path, "_v": v, "mask": int(mask) | more})

        level = cut_lineage(large.mapInPandas(split, "print bigint, _path string, _v int, mask bigint"), "split_buckets")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """node, root: of every node that edges (a, b) connect with a smaller one, the smallest such node.

    Alternates two star steps until nothing moves: every node's larger neighbours, then its smaller ones, are hooked
    onto its smallest neighbour. Minima are combined before the shuffle, and the joins may be split where a star is
    large. Every round is a written table.
    """
    now, before = cut_lineage(edges.select("a", "b").distinct(), "stars"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        down = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        hooked = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut_lineage(hooked.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id, text_hash.

    Words are the runs of other characters than space and control spaces, A-Z in lower case; shingles are ``width``
    words. Equal fingerprints are one node of the graph, so copies are never paired. component_id is the smallest id
    of all rows that links of at most ``radius`` bits connect.
    Null text counts as empty; a text without words has fingerprint zero and is linked like any other. Null ids are
    passed over by the minimum: component_id is null only if all ids of a component are. Repeated rows share their
    component. An empty table gives an empty result; other columns are never read.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = cut_lineage(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    roots = smallest_reachable(links(nodes.select("print"), radius, bucket))
    placed = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("root", "print"))
    placed = cut_lineage(placed.select("print", "component", "least"), "placed")
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of = placed.join(named, "component").select("print", "component_id")
    return rows.join(of, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Of every component the row with the smallest id stays, with all its columns.

    Of several texts under the smallest id, the one with the smallest hash stays; components without any id keep the
    row with the smallest hash. Rows that repeat the staying id and text count as one.
    """
    found = near_duplicates(docs, id_col, text_col, width, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    # components are named by their smallest id, or by nothing at all; the fingerprint tells the latter apart
    name = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    stay = found.groupBy("component_id", name.alias("_name")).agg(first.alias("b"))
    stay = stay.select(F.col("b.id").alias("_id"), F.col("b.hash").alias("_hash"))
    return staying_rows(docs, stay, id_col, text_col)
