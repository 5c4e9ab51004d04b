"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of such a vocabulary reaches from a word over the next whitespace marker, nor over a line feed, so a text falls
into chunks (a run of markers with the word after it, or a line feed) that are segmented independently of each other.
Every task keeps a table of the distinct chunks it has met, segments each of them once with the library, and joins the
ids back by position. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmetry.llm.common import pick

MARKER = "▁"
CHUNK = re.compile(" +[^ \n]*|\n|[^ \n]+")
# chunks in the table of a task before it starts afresh, and the longest chunk that is kept in it
TABLE, LONGEST = 400_000, 64


class ChunkCoder:
    """Encodes and decodes whole texts as the library does, each distinct chunk once."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        if any(re.search(f"[^{MARKER}]{MARKER}", p) or "\n" in p for p in pieces):
            raise ValueError("a piece of this vocabulary crosses a whitespace marker or a line feed")
        self.guard = self.library.encode("\n")
        probe = "\n  a\n\tB ﬁ é "
        if self.library.encode(f"\n{probe}")[: len(self.guard)] != self.guard or self.library.decode(self.library.encode(probe)) != probe:
            raise ValueError("this vocabulary normalises its input, so chunks can't be cut before that")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id()))
        self.table: dict[str, bytes] = {}

    def _segment(self, chunks: list[str]) -> dict[str, bytes]:
        # a line feed in front keeps the library from adding a marker to the chunk itself
        skip = len(self.guard)
        return {c: np.array(ids[skip:], "<u4").tobytes() for c, ids in zip(chunks, self.library.encode([f"\n{c}" for c in chunks], num_threads=1))}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with begin and end, as little-endian unsigned 32-bit numbers."""
        split = [CHUNK.findall(" " + t.replace(MARKER, " ")) if t else [] for t in texts]
        if len(self.table) > TABLE:
            self.table.clear()
        found = self.table
        for chunks in split:
            new = [c for c in dict.fromkeys(chunks) if c not in found]
            if new:
                found.update(self._segment(new))
        out = [b"".join([self.begin, *[found[c] for c in chunks], self.end]) for chunks in split]
        for c in [c for c in found if len(c) > LONGEST]:
            del found[c]
        return out

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (array<int>) of every row, with begin and end ids.

    ``model_path``: a SentencePiece model without normalisation, whose pieces don't cross markers (else ValueError). It
    is read where this is called, and its bytes travel with the tasks.
    Null text counts as empty and gives the two border ids. Null ids and repeated rows pass through; one row comes out
    per row. An empty table gives an empty result; other columns are never read.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    ChunkCoder(model)
    docs = pick(docs, doc_id=id_col, text=text_col)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or ChunkCoder(model)
            # some texts at a time: what is held follows their length, not the number of rows of a batch
            for part in _slices(batch.column("text")):
                texts = batch.column("text")[part].to_pylist()
                coded = coder.encode(texts)
                sizes = np.array([len(b) // 4 for b in coded], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[part], pa.array(sizes), pa.array([hashlib.sha256(b).hexdigest() for b in coded]),
                        pa.array([hashlib.sha256(coder.decode(b).encode()).hexdigest() for b in coded]),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<i4"))),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
                )

    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def _slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[slice]:
    """Runs of rows of about ``most`` bytes of text, at least one row each."""
    lengths = np.cumsum(np.array([len(x.as_buffer()) for x in texts], np.int64))
    begin = 0
    while begin < len(lengths):
        end = max(begin + 1, int(np.searchsorted(lengths, (lengths[begin - 1] if begin else 0) + most)))
        yield slice(begin, end)
        begin = end
