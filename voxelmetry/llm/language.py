"""Language identification by a convolutional network over bytes, trained in NumPy on labelled rows.

Every text is cut into windows of a fixed number of bytes. A window's bytes are embedded, filters of several widths
slide over them, each filter's largest response is kept, and a softmax layer turns those into language probabilities;
a text gets the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelmetry.llm.common import pick
from voxelmetry.llm.exact_dedup import content_hash

WINDOW, EMBEDDING, WIDTHS, FILTERS = 256, 8, (2, 3, 5), 16
# bounds of the training sample: labelled rows and windows of each row for every language, and languages
ROWS, WINDOWS, LANGUAGES = 600, 6, 256
UNDETERMINED = "und"


@dataclass
class ByteNet:
    """The weights, float32; ``kernel`` holds all filters, padded with fixed zeros to the widest one."""

    languages: list[str]
    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """[windows, positions, widest * EMBEDDING]: the embedded bytes under the filters at every position."""
        wide = max(WIDTHS)
        x = self.embedding[np.pad(windows, ((0, 0), (0, wide - 1)))].reshape(len(windows), -1)
        return np.lib.stride_tricks.sliding_window_view(x, wide * EMBEDDING, axis=1)[:, ::EMBEDDING]

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), self.kernel.shape[1]), np.float32)
        for i in range(0, len(windows), 16):  # so few that a block stays in the processor's cache
            part = self._patches(windows[i : i + 16])
            responses = part.reshape(-1, part.shape[2]) @ self.kernel
            out[i : i + 16] = responses.reshape(part.shape[0], part.shape[1], -1).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(self.pooled(windows) @ self.out + self.out_bias)

    @classmethod
    def fit(cls, windows: np.ndarray, target: np.ndarray, languages: list[str], passes: int = 4, batch: int = 32, rate: float = 2e-3, seed: int = 7) -> ByteNet:
        """Adam steps on the cross entropy; the same rows in the same order give the same weights."""
        rng = np.random.default_rng(seed)
        n_filters = FILTERS * len(WIDTHS)
        mask = np.zeros((max(WIDTHS) * EMBEDDING, n_filters), np.float32)
        for k, w in enumerate(WIDTHS):
            mask[: w * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1 / np.sqrt(w * EMBEDDING)
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        net = cls(languages, normal(256, EMBEDDING), normal(*mask.shape) * mask, np.zeros(n_filters, np.float32), normal(n_filters, len(languages)) * 0.1, np.zeros(len(languages), np.float32))
        net.embedding[0] = 0  # zero bytes are padding
        names = ("embedding", "kernel", "bias", "out", "out_bias")
        first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
        step = 0
        for _ in range(passes):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                x, y = windows[chosen], target[chosen]
                patches = net._patches(x)
                responses = (patches.reshape(-1, patches.shape[2]) @ net.kernel).reshape(len(x), -1, n_filters)
                where = responses.argmax(axis=1)
                hidden = np.maximum(np.take_along_axis(responses, where[:, None], 1)[:, 0] + net.bias, 0)
                wrong = _softmax(hidden @ net.out + net.out_bias)
                wrong[np.arange(len(x)), y] -= 1
                wrong /= len(x)
                back = (wrong @ net.out.T) * (hidden > 0)
                seen = patches[np.arange(len(x))[:, None], where]  # the patch that each filter kept
                to_bytes = (back[:, :, None] * net.kernel.T[None]).reshape(-1, EMBEDDING)
                spots = where[:, :, None] + np.arange(max(WIDTHS))
                under = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))[np.arange(len(x))[:, None, None], spots].ravel()
                grads = {
                    "embedding": np.zeros_like(net.embedding), "kernel": np.einsum("nf,nfk->kf", back, seen) * (mask > 0),
                    "bias": back.sum(0), "out": hidden.T @ wrong, "out_bias": wrong.sum(0),
                }
                np.add.at(grads["embedding"], under, to_bytes)
                grads["embedding"][0] = 0
                step += 1
                for n in names:
                    first[n] += 0.1 * (grads[n] - first[n])
                    second[n] += 0.001 * (grads[n] ** 2 - second[n])
                    value = getattr(net, n)
                    value -= (rate / (1 - 0.9**step)) * first[n] / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
        return net


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def cut_windows(data: np.ndarray) -> np.ndarray:
    """[windows, WINDOW] bytes of a text; the last window is filled up with zeros."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


def train(docs: DataFrame, rows: int = ROWS, windows: int = WINDOWS, languages: int = LANGUAGES, seed: int = 7) -> ByteNet | None:
    """A network fitted on a bounded sample of ``docs`` (doc_id, text, lang); None if there is nothing to learn from.

    Rows are counted per language; a share of each language, chosen by a hash of id and text so that about twice as
    many as needed come through, is ranked by that hash, and the first ``rows`` stay. Of each, ``windows`` windows at
    even distances over the whole text reach the driver: at most languages * rows * windows * WINDOW bytes.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = docs.where(F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * rows / r["count"]))])
    dice = F.xxhash64("doc_id", "text")
    drawn = usable.withColumn("_dice", dice).where(F.pmod(F.col("_dice"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    data = F.col("text").cast("binary")
    size = F.octet_length("text")
    # from the first byte to the last window that is full
    at = lambda k: (F.greatest(size - WINDOW, F.lit(0)) * k / max(windows - 1, 1)).cast("int") + 1
    pieces = drawn.select("lang", "_dice", "doc_id", F.array_distinct(F.array(*[F.substring(data, at(k), F.lit(WINDOW)) for k in range(windows)])).alias("pieces"))
    ranked = pieces.withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy("_dice", "doc_id"))).where(F.col("_rank") <= rows)
    sample = sorted(ranked.select("lang", "_rank", "pieces").collect(), key=lambda r: (r["lang"], r["_rank"]))
    names = sorted({r["lang"] for r in sample})
    if not names:
        return None
    cut = [(cut_windows(np.frombuffer(p, np.uint8)), names.index(r["lang"])) for r in sample for p in r["pieces"]]
    return ByteNet.fit(np.concatenate([w for w, _ in cut]), np.repeat([k for _, k in cut], [len(w) for w, _ in cut]), names, seed=seed)


def _vote(net: ByteNet | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; a text of any length is taken a few thousand windows at a time."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if net is None:
        return names, scores
    sums = np.zeros((len(texts), len(net.languages)))
    sizes = np.zeros(len(texts), np.int64)
    pending: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if pending:
            p = net.probabilities(np.concatenate([w for _, w, _ in pending]))
            owner = np.repeat([k for k, _, _ in pending], [len(w) for _, w, _ in pending])
            np.add.at(sums, owner, p * np.concatenate([n for _, _, n in pending])[:, None])
            pending.clear()

    held = 0
    for k, text in enumerate(texts):
        if not text.is_valid:
            continue
        data = np.frombuffer(text.as_buffer(), np.uint8)
        sizes[k] = len(data)
        for begin in range(0, len(data), 4096 * WINDOW):
            part = data[begin : begin + 4096 * WINDOW]
            cut = cut_windows(part)
            pending.append((k, cut, np.minimum(len(part) - WINDOW * np.arange(len(cut)), WINDOW)))
            held += len(cut)
            if held >= 4096:
                flush()
                held = 0
    flush()
    filled = np.flatnonzero(sizes)
    best = sums[filled].argmax(axis=1)
    scores[filled] = np.clip(sums[filled].max(axis=1) / sizes[filled], 0, 1)
    for k, b in zip(filled, best):
        names[k] = net.languages[b]
    return names, scores


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """Adds lang_pred and score to ``docs`` (column text; null where a text has no letter) by whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _vote(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and text_hash of every row.

    Rows whose crc32 of the id as text leaves 2 when divided by 4 are held out; the network learns from the texts of the
    others that have an id and a label, and predictions see the text alone. ``und`` with score 0 is given to null texts, to
    texts without a letter, and to all if nothing is labelled. Rows without an id are neither held out nor learned from.
    Repeated rows pass through; an empty table gives an empty result; other columns are never read.
    """
    docs = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    net = train(docs.where(fold != 2), rows)
    letters = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    inputs = docs.select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), content_hash(F.coalesce("text", F.lit(""))).alias("text_hash"), letters.alias("text")
    )
    return predict(inputs, net).select("doc_id", "held_out", "lang_pred", "score", "text_hash")


def least_score(languages: int, confidence: float) -> float:
    """The score that lies ``confidence`` of the way from a guess among so many languages to certainty."""
    return 1 / languages + confidence * (1 - 1 / languages)


def keep_recognised(docs: DataFrame, confidence: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` whose language is determined with ``confidence`` (see ``least_score``), with all their columns.

    The network is fitted as in ``identify``. Rows pass through the tasks that score them, so nothing is shuffled. Null
    texts and those without a letter go. Where nothing is labelled, rows with a letter are kept, as there is nothing to
    judge them by. Rows with a null id are judged like others, repeated rows share their fate, and an empty table gives
    an empty result.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    net = train(pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(fold != 2), rows)
    names = list(docs.columns)
    flat = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index(text_col)}"
    flat = flat.where(F.col(text).rlike(r"\p{L}"))
    if net is None:
        return flat.toDF(*names)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    least = least_score(len(net.languages), confidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, scores = _vote(shared.value, batch.column(text))
            yield batch.filter(pa.array(scores >= least))

    return flat.mapInArrow(run, flat.schema).toDF(*names)
