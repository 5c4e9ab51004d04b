"""Token counts by a two-tier lookup of pre-tokens: a broadcast table of the frequent ones, a cache for the rest.

A text is one sum of pre-token lengths. The frequent pre-tokens of the whole corpus are found from bounded summaries,
one per task; their lengths are a table of bounded size that every task gets. What is not in it is encoded once by the
worker that meets it and kept in a bounded cache. No pre-token is ever shuffled.

Arrow cuts the texts and tells the distinct pre-tokens of some texts at a time, so only these become Python strings.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmetry.llm.common import pick

# pre-tokens in the broadcast table, and the longest of them: a few MB at most
TABLE, LONGEST = 65_536, 32
# pre-tokens that a task reports, and that it or a worker holds; bytes of text that are looked at together
SUMMARY, HELD, BYTES = 4_096, 200_000, 4 << 20

# letters and digits below this code point are the same in every Unicode version and stay as they are under NFC
PLAIN = 0x300


def _class(wanted: Callable[[str], bool]) -> str:
    """The wanted ones of the characters below PLAIN, for a class in a pattern of Arrow."""
    return "".join(f"\\x{{{c:x}}}" for c in range(PLAIN) if wanted(chr(c)))


def _lowers(c: str) -> bool:
    """Whether the lower case of a character is one character below PLAIN."""
    return len(c.lower()) == 1 and ord(c.lower()) < PLAIN


DIGIT = _class(lambda c: unicodedata.category(c)[0] == "N")
SYMBOL = _class(lambda c: unicodedata.category(c)[0] not in "LN" and not c.isspace())
# the pre-tokens that can touch another one; runs of letters are the others
TOUCHING = f"'(?:s|t|re|ve|m|ll|d)|[{DIGIT}]|[{SYMBOL}]+"
# whitespace that is not ASCII
WIDE = "[" + _class(lambda c: c.isspace() and not c.isascii()) + "]"
# four separators are symbols for the library
RARE = "[^" + _class(lambda c: _lowers(c) and not "\x1c" <= c <= "\x1f") + "]"


@lru_cache(maxsize=1)
def _library(vocabulary: str):
    """The tokenizer of a vocabulary, which a worker loads once for all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(vocabulary)
    library.no_truncation()
    library.no_padding()
    return library


def odd_texts(vocabulary: str) -> str:
    """A pattern of Arrow that is found in texts which can't be cut here: rare characters and special strings."""
    special = [re.escape(t.content) for t in _library(vocabulary).get_added_tokens_decoder().values()]
    return "|".join([RARE, *special])


def pre_tokens(texts: pa.Array, odd: pa.Array) -> pa.ListArray:
    """The pre-tokens of every text that is not odd, in order; the first and the last string may be empty."""
    lowered = pc.utf8_lower(pc.if_else(odd, "", texts))
    apart = pc.replace_substring_regex(pc.replace_substring_regex(lowered, WIDE, " "), TOUCHING, r" \0 ")
    # utf8_split_whitespace reads beyond the last text and may leave the whitespace at its end in
    return pc.ascii_split_whitespace(apart)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about BYTES bytes of column ``text``, at least one row each."""
    part = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64) // BYTES
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    return (batch.slice(lo, hi - lo) for lo, hi in zip(bounds[:-1], bounds[1:]))


class WordCounter:
    """Counts tokens of whole texts exactly as the library does.

    Texts of plain characters are cut into pre-tokens here, by the vocabulary's own pattern, and looked up; what is in
    no table goes to the library's model. Other texts (rarer scripts, combining marks, special strings, odd separators,
    the dotted capital I and letters whose lower case is rarer) go to the library whole.
    """

    def __init__(self, vocabulary: str, frequent: dict[str, int] | None = None):
        self.library, self.odd = _library(vocabulary), odd_texts(vocabulary)
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # how the model spells the bytes of a character
        self.spelled = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(PLAIN)}
        self.frequent, self.cache = frequent or {}, {}

    def lengths(self, tokens: list[str]) -> list[int]:
        model = self.library.model
        return [len(model.tokenize(w.translate(self.spelled))) for w in tokens]

    def counts(self, texts: list[str] | pa.Array) -> list[int]:
        texts = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, self.odd)
        split = pre_tokens(texts, odd)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        known, cache = self.frequent, self.cache
        if len(cache) > HELD:
            cache.clear()
        missing = [w for w in distinct if w not in known and w not in cache]
        cache.update(zip(missing, self.lengths(missing)))
        each = np.array([known[w] if w in known else cache[w] for w in distinct], np.int64)
        upto = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])
        counts = np.diff(upto[split.offsets.to_numpy()])
        whole = self.library.encode_batch_fast(texts.filter(odd).to_pylist(), add_special_tokens=False)
        counts[odd.to_numpy(zero_copy_only=False)] = [len(e.ids) for e in whole]
        return counts.tolist()


def frequent_lengths(docs: DataFrame, vocabulary: str, size: int = TABLE) -> dict[str, int]:
    """Lengths of about the ``size`` most frequent pre-tokens of column ``text``, counted over every text.

    A task counts in a table of bounded size, dropping the rarer half when it is full, and reports its ``SUMMARY`` most
    frequent ones; only these summaries are added up. Which pre-tokens are in the table changes the speed of a lookup,
    never a count.
    """
    odd = odd_texts(vocabulary)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        most = lambda k: seen.sort_by([("n", "descending")]).slice(0, k)
        for texts in (part.column("text") for batch in batches for part in _parts(batch)):
            met = pre_tokens(texts, pc.match_substring_regex(texts, odd)).flatten().value_counts()
            both = pa.concat_tables([seen, pa.table([met.field("values"), met.field("counts")], seen.schema.names)])
            seen = both.group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
            if len(seen) > HELD:
                seen = most(HELD // 2)
        size = pc.utf8_length(seen["word"])
        seen = seen.filter(pc.and_(pc.greater(size, 0), pc.less_equal(size, LONGEST)))
        yield from most(SUMMARY).to_batches()

    sums = docs.select("text").mapInArrow(summarise, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = [r.word for r in sums.orderBy(F.desc("n"), "word").limit(size).collect()]
    return dict(zip(chosen, WordCounter(vocabulary).lengths(chosen)))


def count_tokens(
    docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, without added special tokens, truncation or padding.

    ``vocabulary_path``: a tokenizers file that lower-cases, cuts words and spells bytes as the public lower-case word BPE does. It
    is read where this is called, and travels with the tasks. ``table`` bounds the broadcast table.
    Null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text count as the library counts them. Null
    ids and repeated rows pass through; one row comes out per row. An empty table gives an empty result; other columns
    are never read.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    docs = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, frequent_lengths(docs, vocabulary, table)))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or WordCounter(*shared.value)
            for part in _parts(batch):
                counts = words.counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
