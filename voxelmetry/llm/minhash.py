"""Near duplicates by b-bit MinHash signatures, joined by Hamming distance through several indexes.

A signature has POSITIONS symbols of 16 bits, each a hash of the smallest of a set's shingle hashes under another
order. Two sets of similarity s differ in a symbol with probability 1 - s, so ``allowed_errors`` gives the number of
differing symbols that a pair of the wanted similarity exceeds with a stated small probability. All pairs of
signatures within that distance are found: the symbols are cut into so many chunks that one of them has at most one
error, and a chunk's keys leave out one symbol each, which enumerates the errors it may have.

What the index joins is a graph on signatures; its connected parts hold every wanted link. Inside a part the whole
sets are compared, and a link is one that they confirm.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelmetry.llm.common import pick
from voxelmetry.llm.exact_dedup import content_hash
from voxelmetry.llm.simhash import smallest_reachable
from voxelmetry.session import checkpoint_root, cut_lineage, run_folder, spread

POSITIONS = 128
# probability with which a pair of exactly the wanted similarity has more errors than are allowed
MISS = 1e-5
# signatures of a bucket, and hashes of a part, that one task compares; larger groups are compared in pieces
BUCKET, PART = 2048, 1_000_000
# members of a large group that all its pieces are compared with first
PIVOTS = 32
# bits of the filter that texts pass before they are dealt out: 16 MB whatever the input
FILTER = 1 << 27
# word hashes that a worker holds, shingle hashes that are looked at together, and texts that are
HELD, CHUNK, TEXTS = 100_000, 32_768, 1024
# odd factor of the mixing steps
MIX = np.uint64(0x9E3779B97F4A7C15)

LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """64-bit hashes of words, computed once for each word that the table holds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``width`` words, A-Z in lower case; of all words if there are fewer.

    Words are the runs of other bytes than the space and the control spaces, at which ``bytes.split`` cuts.
    """
    words = (text or b"").translate(LOWERED).split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    taken = min(width, len(words))
    n = len(words) - taken + 1
    mixed = np.full(n, taken, np.uint64)
    for k in range(taken):
        mixed = (mixed ^ each[k : k + n]) * MIX
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """POSITIONS 16-bit symbols of every set, none of which may be empty."""
    draw = np.random.default_rng(11)
    factors = draw.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
    out = np.empty((len(sets), POSITIONS), np.uint16)
    upto = np.cumsum([len(s) for s in sets])
    begin = 0
    while begin < len(sets):
        past = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, past + CHUNK, "right")))
        part = np.concatenate(sets[begin:end])
        starts = np.concatenate([[0], upto[begin : end - 1] - past]).astype(np.int64)
        for k in range(POSITIONS):
            low = np.minimum.reduceat(part * factors[k] + shifts[k], starts)
            low ^= low >> np.uint64(29)
            out[begin:end, k] = (low * MIX) >> np.uint64(48)
        begin = end
    return out


def allowed_errors(percent: int, positions: int = POSITIONS, miss: float = MISS) -> int:
    """Fewest errors that a pair of similarity ``percent`` exceeds with probability ``miss`` at most."""
    p, tail = 1 - percent / 100, 1.0
    for k in range(positions + 1):
        tail -= math.comb(positions, k) * p**k * (1 - p) ** (positions - k)
        if tail <= miss:
            return k
    return positions


def index_keys(symbols: np.ndarray, errors: int) -> np.ndarray:
    """64-bit keys of every signature (rows), of which two signatures within ``errors`` share one at least."""
    chunks = errors // 2 + 1
    edges = np.linspace(0, symbols.shape[1], chunks + 1).astype(int)
    keys = np.empty((len(symbols), symbols.shape[1]), np.uint64)
    at = 0
    for lo, hi in zip(edges[:-1], edges[1:]):
        for left_out in range(lo, hi):
            key = np.full(len(symbols), left_out + 1, np.uint64)
            for k in range(lo, hi):
                if k != left_out:
                    key = (key ^ symbols[:, k]) * MIX
                    key ^= key >> np.uint64(31)
            keys[:, at] = key
            at += 1
    return keys


def _summarised(width: int):
    """Replaces the text in the last column by set_hash, n_shingles and signature; the last is null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (whole.slice(k, TEXTS) for whole in batches for k in range(0, whole.num_rows, TEXTS)):
            sets = [shingle_set(t, width, hashes) for t in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            signed = iter(signatures([s for s in sets if len(s)]))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array(sizes),
                    pa.array([next(signed).tobytes() if n else None for n in sizes], pa.binary()),
                ],
                [*batch.schema.names[:-1], "set_hash", "n_shingles", "signature"],
            )

    return work


def _loads(column: pa.Array, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype) for v in column.to_pylist()]


class SignatureBlock:
    """Compares signatures: near are those with at most ``errors`` different symbols (of 8 bits, so never too few)."""

    def __init__(self, column: pa.Array, errors: int):
        self.symbols, self.errors = np.stack(_loads(column, np.uint8)), errors

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        return (self.symbols[others] != self.symbols[i]).sum(axis=1) <= self.errors


class SetBlock:
    """Compares whole sets: near are those with 100 * intersection >= percent * union."""

    def __init__(self, column: pa.Array, percent: int):
        sets = _loads(column, np.uint64)
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        distinct, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        own, other = self.sizes[i], self.sizes[others]
        fit = (100 * np.minimum(own, other) >= self.percent * np.maximum(own, other)).nonzero()[0]
        out = np.zeros(len(others), bool)
        if not len(fit):
            return out
        sizes, starts = other[fit], self.starts[others[fit]]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        places = np.repeat(starts - begins, sizes) + np.arange(sizes.sum())
        mine = self.ids[self.starts[i] : self.starts[i] + own]
        self.mark[mine] = True
        shared = np.add.reduceat(self.mark[self.ids[places]].astype(np.int64), begins)
        self.mark[mine] = False
        out[fit] = 100 * shared >= self.percent * (own + sizes - shared)
        return out


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of every run of equal values in the first ``n_keys`` columns, whole numbers all, as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(n_keys)], axis=1)
        bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if held and (keys[lo] != last).any():
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _forests(block: Callable):
    """Links inside every run of (cell, node, load): enough to connect what its links connect, at most one a member."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = [], 0
        for run in _runs(batches):
            nodes, held = run.column(1).to_numpy(), block(run.column(2))
            rest, front = np.arange(len(nodes)), []
            while len(rest):
                if not front:
                    front, rest = [int(rest[0])], rest[1:]
                    continue
                i = front.pop()
                near = held.near(i, rest)
                if near.any():
                    reached = rest[near]
                    pairs.append((np.full(len(reached), nodes[i]), nodes[reached]))
                    front.extend(reached.tolist())
                    rest, n = rest[~near], n + len(reached)
            if n > CHUNK:
                yield from _edges(pairs)
                pairs, n = [], 0
        yield from _edges(pairs)

    return work


def _bridges(block: Callable):
    """Links between the asking and the other rows of (cell, node, load, asks, root) that join different roots."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            nodes, held = run.column(1).to_numpy(), block(run.column(2))
            asks = run.column(3).to_numpy(zero_copy_only=False)
            roots, pairs = run.column(4).to_numpy().copy(), []
            answers = np.flatnonzero(~asks)
            for i in np.flatnonzero(asks).tolist():
                other = answers[roots[answers] != roots[i]]
                if not len(other):
                    continue
                near = other[held.near(i, other)]
                for root in np.unique(roots[near]):
                    pairs.append((nodes[[i]], nodes[near[roots[near] == root]][:1]))
                    roots[roots == root] = roots[i]
            yield from _edges(pairs)

    return work


def connect(members: DataFrame, loads: DataFrame, block: Callable, limit: int) -> DataFrame:
    """Links (a, b) that connect, inside every group of ``members`` (cell, node), what ``block`` calls near.

    ``loads``: node, load, weight. A group of at most ``limit`` weight is compared in one task and yields a spanning
    forest. A larger one is dealt into pieces of about that weight. Each piece is compared inside itself and with
    PIVOTS members of its group; then the members that this left outside the group's largest component are compared
    with all pieces, piece by piece. Tasks hold two pieces at most, pairs of members are never rows, and no link
    between different components is lost.
    """
    edge = "a bigint, b bigint"
    weighed = members.join(loads.select("node", "weight"), "node")
    sizes = cut_lineage(weighed.groupBy("cell").agg(F.ceil(F.sum("weight") / limit).alias("pieces"), F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    sized = lambda which: members.join(sizes.where(which).select("cell", "pieces"), "cell")
    run = lambda rows, work: spread(rows, "cell").sortWithinPartitions("cell").mapInArrow(work, edge).distinct()
    small = sized("pieces = 1").join(loads, "node").select("cell", "node", "load")
    found = cut_lineage(run(small, _forests(block)), "links")
    if sizes.where("pieces > 1").isEmpty():
        return found

    dice = F.xxhash64("node")
    large = cut_lineage(sized("pieces > 1").select("cell", "node", "pieces", F.pmod(dice, "pieces").alias("piece")), "pieces")
    cell = F.xxhash64("cell", "piece").alias("cell")
    first = large.withColumn("_r", F.row_number().over(W.partitionBy("cell").orderBy(dice, "node"))).where(F.col("_r") <= PIVOTS)
    everywhere = first.select("cell", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    dealt = large.select(cell, "node").unionByName(everywhere.select(cell, "node")).distinct()
    found = cut_lineage(found.unionByName(run(dealt.join(loads, "node").select("cell", "node", "load"), _forests(block))), "links")

    roots = smallest_reachable(found)
    placed = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = cut_lineage(placed.join(loads.select("node", "weight"), "node"), "placed")
    parts = placed.groupBy("cell", "root").agg(F.sum("weight").alias("w"))
    main = parts.groupBy("cell").agg(F.max(F.struct("w", "root")).alias("m")).select("cell", F.col("m.root").alias("_main"))
    asking = cut_lineage(placed.join(main, "cell").where("root <> _main").drop("_main"), "asking")
    blocks = asking.groupBy("cell").agg(F.ceil(F.sum("weight") / limit).alias("blocks"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = asking.join(blocks, "cell").select("cell", "node", "root", F.pmod(dice, "blocks").alias("block"), upto("pieces").alias("piece"), F.lit(True).alias("asks"))
    answer = placed.join(blocks, "cell").select("cell", "node", "root", upto("blocks").alias("block"), "piece", F.lit(False).alias("asks"))
    both = asked.unionByName(answer).withColumn("cell", F.xxhash64("cell", "block", "piece")).join(loads, "node")
    bridges = run(both.select("cell", "node", "load", "asks", "root"), _bridges(block))
    return cut_lineage(found.unionByName(bridges), "links")


def _possible(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` (text_hash, text) whose hash may be in ``wanted``: all that are, and few others.

    A bit table of fixed size goes to every task, so that other texts are not shuffled to the join that follows. With
    more hashes than bits it passes more and more of the others, and nothing else changes.
    """
    slot = F.pmod(F.xxhash64("text_hash"), F.lit(FILTER)).alias("slot")
    words = F.shiftright("slot", 6).alias("word")
    found = wanted.select(slot).groupBy(words).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER // 64, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(0).to_numpy()
            hit = (shared.value[slots >> 6] >> (slots & 63)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select(["text_hash", "text"])

    return texts.select(slot, "text_hash", "text").mapInArrow(work, "text_hash binary, text binary")


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to the workers TEXTS at a time, as several copies of a batch are in memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), TEXTS) if int(before) > 0 else TEXTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_sets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 80, bucket: int = BUCKET, part: int = PART
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component (null for a text without words).

    Texts with equal sets of shingles are one node; their copies are never paired. A link is a pair of sets with
    100 * intersection >= percent * union, counted on 64-bit hashes of all shingles; rows whose sets links connect have
    the same component. A pair of exactly ``percent`` similarity is no candidate with probability MISS at most, a more
    similar one with less.
    Null text counts as empty. Null ids and repeated rows pass through. An empty table gives an empty result; other
    columns are never read. A whole text and its set are in a task's memory at once.
    """
    spark = docs.sparkSession
    keep = checkpoint_root(spark)
    with run_folder(spark), _short_batches(spark):  # all tables but the two that the result reads go when it is planned
        return _near_sets(pick(docs, doc_id=id_col, text=text_col), width, percent, bucket, part, keep)


def _near_sets(docs: DataFrame, width: int, percent: int, bucket: int, part: int, keep: str) -> DataFrame:
    errors = allowed_errors(percent)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", content_hash(text).alias("text_hash"), text.cast("binary").alias("text"))
    shape = f"doc_id {id_type}, text_hash binary, set_hash binary, n_shingles bigint, signature binary"
    rows = cut_lineage(plain.mapInArrow(_summarised(width), shape), "signatures", keep)
    sets = rows.where("n_shingles > 0").groupBy("set_hash").agg(F.min("text_hash").alias("text_hash"), F.any_value("n_shingles").alias("weight"), F.any_value("signature").alias("signature"))
    nodes = cut_lineage(sets.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                keys = index_keys(np.stack(_loads(batch.column(1), np.uint16)), errors)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], ["key", "node"]
                )

    dealt = spread(nodes.select("node", "signature").mapInArrow(keyed, "key bigint, node bigint"), "key")
    repeated = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut_lineage(dealt.join(repeated, "key"), "buckets")
    # the same few nodes meet in many buckets
    lists = buckets.where(F.col("n") <= bucket).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    small = lists.select(F.xxhash64("nodes").alias("cell"), F.explode("nodes").alias("node"))
    members = cut_lineage(small.unionByName(buckets.where(F.col("n") > bucket).select(F.col("key").alias("cell"), "node")), "members")
    low = F.col("signature")

    def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [np.frombuffer(v, np.uint16).astype(np.uint8).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary()), pa.array(np.ones(len(short), np.int64))], ["node", "load", "weight"])

    prints = cut_lineage(nodes.select("node", low).join(members.select("node").distinct(), "node", "left_semi").mapInArrow(lowered, "node bigint, load binary, weight bigint"), "prints")
    candidates = connect(members, prints, lambda column: SignatureBlock(column, errors), bucket)

    roots = smallest_reachable(candidates)
    parts = cut_lineage(roots.select(F.col("root").alias("cell"), "node").unionByName(roots.select(F.col("root").alias("cell"), F.col("root").alias("node")).distinct()), "parts")
    wanted = cut_lineage(nodes.join(parts, "node").select("node", "weight", "text_hash"), "wanted")
    texts = _possible(plain, wanted).join(wanted, "text_hash").groupBy("node").agg(F.any_value("weight").alias("weight"), F.any_value("text").alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (rows.slice(k, TEXTS) for rows in batches for k in range(0, rows.num_rows, TEXTS)):
            found = [shingle_set(t, width, hashes).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(1)], ["node", "load", "weight"])

    loads = cut_lineage(texts.select("node", "weight", "text").mapInArrow(whole, "node bigint, load binary, weight bigint"), "sets")
    links = connect(parts, loads, lambda column: SetBlock(column, percent), part)
    roots = smallest_reachable(links)
    placed = nodes.join(roots, "node", "left").select("set_hash", F.coalesce("root", "node").alias("component"))
    return rows.join(cut_lineage(placed, "components", keep), "set_hash", "left").select("doc_id", "text_hash", "n_shingles", "component")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id of all rows that links connect, the row's own included; a text without words has
    no link and keeps its own id. Null ids are passed over by the minimum: component_id is null only if a component
    has no other id. kept says that the two are the same (both may be null), so repeated rows are kept together.
    """
    found = cut_lineage(near_sets(docs, id_col, text_col, width, percent), "found")
    least = found.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = found.where("component IS NOT NULL").join(least, "component").select("doc_id", "n_shingles", "component_id")
    alone = found.where("component IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
