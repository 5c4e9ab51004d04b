"""Spelling variants: words one edit apart, found by scanning sorted word lists with a banded edit matrix.

A task holds cells of the vocabulary: words of two adjacent lengths that agree on a prefix and a suffix, sorted by
code point. It scans a cell's list once for all its words of the shorter length. The longest common prefixes of
neighbours in the list cut it into ranges of a common prefix; a row of the edit matrix, of which the three cells beside
the diagonal are kept, is computed once for such a range and reused by all its words. Where the prefix already exceeds
one edit, the whole range is skipped.

Two words one edit apart first differ at one position p. For every length the positions are cut into two halves, and
the half with p in it is a cell: the words agree before it and behind it. Cells with too many words are cut in halves
again, down to a single position, where the alphabet bounds them. So every pair meets in exactly one cell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmetry.llm.common import pick
from voxelmetry.llm.minhash import LOWERED, _runs
from voxelmetry.session import cut_lineage, spread

LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
# one of so many (document, word) pairs loses a letter
DAMAGE = 31
# words of a cell that are scanned in one task, and words that a task counts before it passes them on
CELL, HELD = 1024, 400_000
# pairs of words that the cells which are scanned together may have at most
PAIRS = 2_000_000
LETTERS = re.compile("[a-zÀ-ÿ]+")


def words_of(doc_id: str, text: bytes, least: int = LEAST_LENGTH) -> Iterator[tuple[str, int]]:
    """The words of a text with their counts: runs of letters, A-Z in lower case, those that are chosen without a letter."""
    runs = Counter(LETTERS.findall(text.translate(LOWERED).decode("utf-8", "replace")))
    begin = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        if len(run) < least:
            continue
        h = zlib.crc32(run.encode(), begin)
        if h % DAMAGE == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < least:
                continue
        yield run, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counts: dict[str, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in words_of(doc_id, text):
                counts[word] = counts.get(word, 0) + n
            if len(counts) > HELD:
                yield out(counts)
                counts = {}
    yield out(counts)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words that occur at least LEAST_COUNT times. Counts are combined in the tasks that read the texts."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = plain.mapInArrow(_counted, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def scan(cells: np.ndarray, words: list[str], counts: np.ndarray, shorter: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Near words of each word of sorted cells: how many, and the index of the best one (-1: none).

    ``cells`` numbers the runs of rows that are a cell each. Only pairs of which one word at least has ``shorter``
    letters, and whose first difference lies in [lo, hi), count. All cells advance together, a letter of the scanned
    words at a time: a row of the edit matrix is that of a range of words with a common prefix and of one asking word.
    """
    near, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    codes = np.zeros((len(words), shorter + 4), np.uint32)  # two columns on either side; no letter has code 0
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    long = np.fromiter(map(len, words), np.int64, len(words))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(long) - long, long)
    codes[np.repeat(np.arange(len(words)), long), at + 2] = flat
    # the longest common prefix with the word before; less than any prefix where a cell begins
    same = np.cumprod(codes[1:, 2:] == codes[:-1, 2:], axis=1).sum(axis=1)
    shared = np.concatenate([[-1], np.minimum(same, np.minimum(long[1:], long[:-1]))])
    shared[1:][cells[1:] != cells[:-1]] = -1
    heads = np.flatnonzero(shared < 0)
    ends = np.append(heads[1:], len(words))
    asks = np.flatnonzero(long == shorter)
    who, own = asks, np.searchsorted(heads, asks, "right") - 1
    begin, end = heads[own], ends[own]
    band = np.tile(np.array([1, 0, 1], np.int8), (len(who), 1))
    found = []
    for i in range(lo, shorter + 1):
        # the ranges below each range: where a word differs from the one before within its first i + 1 letters
        starts = np.flatnonzero((shared <= i) & (long > i))
        stops = np.append(np.flatnonzero(shared <= i), len(words))
        first, past = np.searchsorted(starts, begin), np.searchsorted(starts, end)
        row = np.repeat(np.arange(len(who)), past - first)
        if not len(row):
            break
        child = starts[np.repeat(first - np.cumsum(past - first) + (past - first), past - first) + np.arange(len(row))]
        before = band[row]
        who = who[row]
        # cell c of row i + 1 stands for the first i + c letters of the word that asks
        new = before + (codes[who[:, None], np.arange(i + 1, i + 4)] != codes[child, i + 2][:, None])
        np.minimum(new[:, :2], before[:, 1:] + 1, out=new[:, :2])
        np.minimum(new[:, 1], new[:, 0] + 1, out=new[:, 1])
        np.minimum(new[:, 2], new[:, 1] + 1, out=new[:, 2])
        alive = new.min(axis=1) <= 1
        who, begin, band = who[alive], child[alive], new[alive].astype(np.int8)
        end = stops[np.searchsorted(stops, begin, "right")]
        if i + 1 >= shorter:
            done = (long[begin] == i + 1) & (band[:, shorter - i] == 1)
            found.append((who[done], begin[done]))
    if not found:
        return near, best
    asking, other = (np.concatenate(x) for x in zip(*found))
    differ = codes[asking, 2:-2] != codes[other, 2 : shorter + 2]
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), shorter)
    owned = (at >= lo) & (at < hi)
    asking, other = asking[owned], other[owned]
    back = long[other] > shorter  # the longer word asks nobody, so it gets its pairs here
    to, of = np.concatenate([asking, other[back]]), np.concatenate([other, asking[back]])
    near += np.bincount(to, minlength=len(words))
    order = np.lexsort((of, -counts[of], to))
    to, of = to[order], of[order]
    first = np.flatnonzero(np.diff(to, prepend=-1))
    best[to[first]] = of[first]
    return near, best


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, cell, shorter, lo, hi, word, n), sorted, to (word, n_near, best_n, best)."""

    def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        words, n = rows.column(5).to_pylist(), rows.column(6).to_numpy()
        near, best = scan(rows.column(1).to_numpy(), words, n, *(rows.column(k)[0].as_py() for k in (2, 3, 4)))
        hit = np.flatnonzero(near)
        if len(hit):
            chosen = pa.array(best[hit])
            yield pa.RecordBatch.from_arrays(
                [rows.column(5).take(pa.array(hit)), pa.array(near[hit]), rows.column(6).take(chosen), rows.column(5).take(chosen)], ["word", "n_near", "best_n", "best"]
            )

    held, kind, cost = [], None, 0
    for run in _runs(batches, 2):
        now = run.column(0)[0].as_py()
        if held and (now != kind or cost > PAIRS):
            yield from out(held)
            held, cost = [], 0
        kind = now
        if run.num_rows > 1:
            held.append(run)
            cost += run.num_rows**2
    if held:
        yield from out(held)


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """word, n_near, best_n, best of every word of ``words`` (word, n; a written table) that has a near word.

    best is the near word of the largest n, the smallest in code-point order of several. Cells of more than ``cell``
    words are halved until each is small or has a single position left.
    """
    long = F.length("word")
    ranges = F.explode(F.array(*[F.struct((long - d).cast("long").alias("shorter"), F.lit(s).alias("_second")) for d in (0, 1) for s in (False, True)]))
    level = words.select("word", "n", ranges.alias("r")).select("word", "n", "r.*").where(F.col("shorter") >= LEAST_LENGTH)
    half = F.floor(F.col("shorter") / 2)
    lo, hi = F.when(F.col("_second"), half).otherwise(0).cast("long"), F.when(F.col("_second"), F.col("shorter") + 1).otherwise(half).cast("long")
    level = level.select("word", "n", "shorter", lo.alias("lo"), hi.alias("hi"))
    found = None
    while True:
        # the part of the word outside [lo, hi); a suffix is counted from the end, as lengths differ
        behind = F.greatest(F.col("shorter") - F.col("hi"), F.lit(0)).cast("int")
        parts = [F.expr("left(word, cast(lo as int))"), F.when(behind > 0, F.right("word", behind)).otherwise("")]
        celled = level.withColumn("cell", F.xxhash64("shorter", "lo", "hi", *parts))
        sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("hi") - F.col("lo")).alias("wide")).where("size > 1")
        sized = cut_lineage(celled.join(sizes, "cell"), "cells")
        large = (F.col("size") > cell) & (F.col("wide") > 1)
        # kind: cells of one length and range are scanned together
        kind = (F.col("shorter") * (1 << 42) + F.col("lo") * (1 << 21) + F.col("hi")).alias("kind")
        rows = spread(sized.where(~large).select(kind, "cell", "shorter", "lo", "hi", "word", "n"), "cell").sortWithinPartitions("kind", "cell", "word")
        part = rows.mapInArrow(_scanned, "word string, n_near bigint, best_n bigint, best string")
        found = part if found is None else found.unionByName(part)
        if sized.where(large).isEmpty():
            break
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        halves = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi")))
        level = sized.where(large).select("word", "n", "shorter", halves.alias("r")).select("word", "n", "shorter", "r.*").where("lo < hi")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, cell: int = CELL) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary.

    form is the best near word if it occurs at least ``times`` as often; root is the last word that following forms
    leads to. Counts grow along forms, so that there is no circle.
    Null texts have no words; a null id counts as an empty text in the choice of damaged words. Repeated rows count
    again. An empty table gives an empty result; other columns are never read. Words of any length are compared whole.
    """
    words = cut_lineage(vocabulary(docs, id_col, text_col), "words")
    near = near_words(words, cell)
    formed = F.col("best_n") >= times * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")
    )
    found = cut_lineage(found, "formed")
    steps = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = cut_lineage(steps.join(on, "root", "left"), "roots")
        steps = joined.select("word", F.coalesce("_next", "root").alias("root"))
        if joined.where("_next IS NOT NULL").isEmpty():
            break
    return found.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
