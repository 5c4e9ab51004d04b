"""How the sources of each language differ in their terms, with the strings left behind until the end.

Terms are counted inside the tasks that read the texts. What is shuffled from then on are digests of eight bytes; the
strings stay in the written counts. A dictionary with the smallest and the largest string of every digest shows which
digests stand for several terms: these are told apart by their strings, all others by the digest alone. Strings are
joined back for the few rows of the result that show a term. All numbers are whole and exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelmetry.llm.common import pick
from voxelmetry.llm.minhash import _runs
from voxelmetry.session import checkpoint_root, cut_lineage, run_folder, spread

LEAST_DOCUMENTS, TOP = 10, 10
# (group, term) counts that a task holds before it passes them on
HELD = 400_000
# parts that the terms of a language are dealt into, whatever its size
SLICES = 64
# sources whose distances to all others are added up together, and numbers that are computed together
BLOCK, AT_ONCE = 64, 1 << 20
# letters in lower case and bytes of other characters stay, everything else is a gap
GAPS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), combined within a task."""
    names = ["lang", "source", "term", "n", "docs"]

    def out(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), of in counts.items():
            terms, rows = [t.decode("utf-8", "replace") for t in of], len(of)
            seen = docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), pa.array(terms, pa.string()), pa.array(of.values(), pa.int64()), pa.array([seen[t] for t in of], pa.int64())],
                names,
            )

    counts, docs, n = {}, {}, 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            own, key = Counter(text.translate(GAPS).split()), (lang, source)
            if key not in counts:
                counts[key], docs[key] = Counter(), Counter()
            n -= len(counts[key])
            counts[key].update(own)
            docs[key].update(own.keys())
            n += len(counts[key])
            if n > HELD:
                yield from out(counts, docs)
                counts, docs, n = {}, {}, 0
    yield from out(counts, docs)


def share_of(count: str, total: str, kept: str) -> str:
    """SQL of 1 + floor(10^9 (count + 2) / (total + 2 kept)) as a long division in three steps, so that nothing overflows."""
    rest, over, digits = f"({count} + 2)", f"({total} + 2 * {kept})", []
    for _ in range(3):
        digits.append(f"({rest} * 1000L div {over})")
        rest = f"({rest} * 1000L % {over})"
    return f"(1L + {digits[0]} * 1000000L + {digits[1]} * 1000L + {digits[2]})"


def _distances(block: int):
    """Sums of (p - q)^2 div (p + q) over the terms of a cell, for its block of sources against all sources.

    Rows (cell, lang_no, block, slice, at, p), sorted; the first row of a cell lists all sources with the shares of
    absent terms, the other rows are terms with the sources that have them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            lang, first, piece = (run.column(k)[0].as_py() for k in (1, 2, 3))
            at, p = run.column(4), run.column(5)
            ends = at.offsets.to_numpy()[: run.num_rows + 1] - at.offsets[0].as_py()
            at, p = at.flatten().to_numpy(), p.flatten().to_numpy()
            absent = np.empty(ends[1], np.int64)
            absent[at[: ends[1]]] = p[: ends[1]]
            own = slice(first * block, (first + 1) * block)
            sums = np.zeros((len(absent[own]), len(absent)), np.int64)
            step = max(1, AT_ONCE // sums.size)
            for begin in range(1, run.num_rows, step):
                stop = min(begin + step, run.num_rows)
                shares = np.tile(absent, (stop - begin, 1))
                lengths = np.diff(ends[begin : stop + 1])
                shares[np.repeat(np.arange(stop - begin), lengths), at[ends[begin] : ends[stop]]] = p[ends[begin] : ends[stop]]
                a, b = shares[:, own, None], shares[:, None, :]
                apart = a - b
                sums += (apart * apart // (a + b)).sum(axis=0)
            i, j = np.nonzero(sums if piece else np.ones_like(sums))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), lang)), pa.array(i + own.start), pa.array(j), pa.array(sums[i, j])], ["lang_no", "i", "j", "value"]
            )

    return work


def _numbered(groups: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The groups (lang, source) with 64-bit numbers of language and group that no two of them share, and those numbers
    as expressions of lang and source. Should numbers clash, another seed is taken."""
    for seed in range(100):
        lid, gid = F.xxhash64(F.lit(seed), "lang").alias("lid"), F.xxhash64(F.lit(seed), "lang", "source").alias("gid")
        n, *found = groups.agg(F.count(F.lit(1)), F.countDistinct("lang"), F.countDistinct(lid), F.countDistinct(gid)).first()
        if found[0] == found[1] and found[2] == n:
            return groups.select("lang", "source", lid, gid), lid, gid
    raise RuntimeError("no seed gives the groups different numbers")


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    least: int = LEAST_DOCUMENTS, top: int = TOP, digest: Callable[[Column], Column] = F.xxhash64, block: int = BLOCK,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms.

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case; those in at least ``least`` rows of a
    language are kept. A term's share in a group is smoothed by two and counted in units of 10^-9. Part ``pair`` has
    the sum of (p - q)^2 div (p + q) over all kept terms for each other source; part ``term`` the ``top`` terms that
    are more frequent in the source than in its language.
    Null text, language and source count as empty; a group without terms still has its pairs. Repeated rows count
    again; ties in value are ranked by the bytes of the item. An empty table gives an empty result; other columns are
    never read. The sources of one language, not their texts, must fit into a row.
    """
    docs = pick(docs, lang=lang_col, source=source_col, text=text_col)
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    named, lid, gid = _numbered(cut_lineage(docs.select("lang", "source").distinct(), "named_groups"))
    keep = checkpoint_root(docs.sparkSession)
    with run_folder(docs.sparkSession):  # the counts of the tasks go when they are added up
        terms = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
        terms = cut_lineage(terms.select(lid, gid, digest(F.col("term")).cast("bigint").alias("digest"), "term", "n", "docs"), "terms")
        words = terms.select("digest", "term").distinct().groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("_last"))
        words = cut_lineage(words, "dictionary", keep)
        several = words.where("term <> _last").select("digest", F.lit(True).alias("_several"))
        if several.isEmpty():
            told, name = terms, ["digest"]
        else:
            told, name = terms.join(several, "digest", "left").withColumn("variant", F.when(F.col("_several"), F.col("term")).otherwise("")), ["digest", "variant"]
        counts = cut_lineage(told.groupBy("lid", "gid", *name).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts", keep)
    kept = cut_lineage(counts.groupBy("lid", *name).agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least).drop("docs"), "kept")
    here = cut_lineage(counts.drop("docs").join(kept, ["lid", *name]), "group_terms")

    sizes = here.groupBy("gid").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lid").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("lang_total"))
    zero = F.lit(0).cast("long")
    numbers = named.select("lang").distinct().withColumn("lang_no", F.row_number().over(W.orderBy("lang")).cast("long"))
    groups = named.join(numbers, "lang").join(sizes, "gid", "left").join(langs, "lid", "left").select(
        "lid", "gid", "lang", "source", "lang_no", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("at"),
        *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")],
    )
    groups = cut_lineage(groups, "groups")

    # a cell is a block of sources and a slice of the terms of a language
    cell = (F.col("lang_no") * (1 << 40) + F.col("block") * (1 << 20) + F.col("slice")).alias("cell")
    n_blocks = F.ceil(F.count(F.lit(1)) / block).alias("blocks")
    absent = F.expr(f"CASE WHEN kept > 0 THEN {share_of('0L', 'total', 'kept')} ELSE 1L END")
    listed = groups.groupBy("lid", "lang_no").agg(n_blocks, F.array_sort(F.collect_list(F.struct("at", absent.alias("p")))).alias("s"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    heads = listed.withColumn("block", upto(F.col("blocks"))).withColumn("slice", upto(F.lit(SLICES).cast("long")))
    shared = here.join(groups.drop("lid"), "gid")
    present = shared.select("lid", *name, F.struct("at", F.expr(share_of("n", "total", "kept")).alias("p")).alias("e"))
    lists = present.groupBy("lid", *name).agg(F.collect_list("e").alias("s")).join(listed.select("lid", "lang_no", "blocks"), "lid")
    lists = lists.withColumn("block", upto(F.col("blocks"))).withColumn("slice", F.pmod(F.xxhash64(*name), F.lit(SLICES)).cast("long"))
    columns = [cell, "lang_no", "block", "slice", F.col("s.at").alias("at"), F.col("s.p").alias("p")]
    rows = heads.select(*columns, F.lit(0).alias("_o")).unionByName(lists.select(*columns, F.lit(1).alias("_o")))
    rows = spread(rows, "cell").sortWithinPartitions("cell", "_o").drop("_o")
    sums = rows.mapInArrow(_distances(block), "lang_no bigint, i bigint, j bigint, value bigint").groupBy("lang_no", "i", "j").agg(F.sum("value").alias("value"))
    side = lambda at, to: groups.select("lang_no", F.col("at").alias(at), F.col("source").alias(to), *(["lang"] if at == "i" else []))
    pairs = sums.where("i <> j").join(side("i", "source"), ["lang_no", "i"]).join(side("j", "item"), ["lang_no", "j"])
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked)

    shares = shared.select("lang", "source", *name, F.expr(share_of("n", "total", "kept")).alias("p"), F.expr(share_of("n_lang", "lang_total", "kept")).alias("q"))
    more = shares.where("p > q").select("lang", "source", *name, F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    # ties are told apart by the strings, which only rows that may be shown get
    best = more.withColumn("_r", F.rank().over(W.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("_r") <= top).drop("_r")
    item = (F.col("term") if len(name) == 1 else F.when(F.col("variant") != "", F.col("variant")).otherwise(F.col("term"))).alias("item")
    shown = cut_lineage(best, "best").join(words.select("digest", "term"), "digest").select("lang", "source", F.lit("term").alias("part"), item, "value")
    shown = shown.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    return pairs.unionByName(shown)
