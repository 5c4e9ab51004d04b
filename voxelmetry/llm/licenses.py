"""License scans by patience alignment of texts with license templates.

Words that occur once in both the passage and the template are anchors; the longest increasing run of them is kept, and the
gaps between its anchors are aligned in the same way. What is matched, as a share of the template, is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmetry.llm.common import pick
from voxelmetry.llm.license_texts import MARKS, TEMPLATES

WORD = re.compile(r"\w+")
# share of a template's words that a passage must hold
LEAST = 0.8
# templates of up to so many words are single sentences, which are looked for within so many words of text
LINE, LINE_REACH = 20, 100


def longest_rise(values: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by piles of cards."""
    tops: list[int] = []
    cards: list[int] = []
    below = [-1] * len(values)
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        below[k] = cards[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            cards.append(k)
        else:
            tops[pile], cards[pile] = v, k
    out = []
    k = cards[-1] if cards else -1
    while k >= 0:
        out.append(k)
        k = below[k]
    return out[::-1]


def align(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of the two sequences, both rising.

    A gap is aligned after its equal ends are matched, which is what is left of it when no word in it is unique.
    """
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i0, i1, j0, j1 = gaps.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            pairs.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            pairs.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        here, there = _once(a, i0, i1), _once(b, j0, j1)
        common = sorted((i, there[w]) for w, i in here.items() if w in there)
        anchors = [common[k] for k in longest_rise([j for _, j in common])]
        pairs += anchors
        if anchors:
            edges = [(i0 - 1, j0 - 1), *anchors, (i1, j1)]
            gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(pairs)


def _once(words: Sequence[int], begin: int, end: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for k in range(begin, end):
        seen[words[k]] = -1 if words[k] in seen else k
    return {w: k for w, k in seen.items() if k >= 0 and w >= 0}


class Scanner:
    """Finds templates in texts. A text's words are numbers of the templates' words, -1 for all others.

    ``marks``: for a template's name the phrases (name, version) that a passage must hold unbroken, or one of
    several, parted by |.
    """

    def __init__(self, templates: Mapping[str, str], least: float, marks: Mapping[str, Sequence[str]] = MARKS):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall(text.lower())]
        self.templates = [(name, number(text), [[number(x) for x in m.split("|")] for m in marks.get(name, ())]) for name, text in templates.items()]
        size = len(self.vocabulary)
        self.counts = [np.bincount(w, minlength=size) for _, w, _ in self.templates]
        # the last place stands for -1
        self.member = [np.append(c > 0, False) for c in self.counts]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """name, coverage, first and last word of every passage that covers at least ``least`` of a template.

        Passages of a template don't overlap. Of two templates' passages that overlap, the one with fewer matched words
        goes, as a line inside a notice does; of equally many, the one that covers less of its template.
        """
        get = self.vocabulary.get
        codes = np.array([get(w, -1) for w in WORD.findall(text.lower())], np.int64)
        have = np.bincount(codes[codes >= 0], minlength=len(self.vocabulary))
        found = []
        for k, (name, words, _) in enumerate(self.templates):
            if np.minimum(have, self.counts[k]).sum() >= int(np.ceil(self.least * len(words))):
                found += [(name, n, len(words), first, last) for n, first, last in self._passages(codes, k)]
        return [
            (name, n / size, first, last) for name, n, size, first, last in found
            if not any((m, -z) > (n, -size) and f <= last and first <= t for _, m, z, f, t in found)
        ]

    def _passages(self, codes: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """Matched words, first and last word of the template's passages, in the order of the text: whole copies first,
        then the best one of what is left, until none is."""
        _, words, _ = self.templates[k]
        n, left, out = len(words), codes.copy(), []
        whole = np.flatnonzero(codes[: max(0, len(codes) - n + 1)] == words[0])
        for begin in whole.tolist():
            if codes[begin : begin + n].tolist() == words and (not out or begin > out[-1][2]):
                out.append((n, begin, begin + n - 1))
                left[begin : begin + n] = -1
        while best := self._best(left, k):
            out.append(best)
            left[best[1] : best[2] + 1] = -1
        return sorted(out, key=lambda x: x[1])

    def _best(self, codes: np.ndarray, k: int) -> tuple[int, int, int] | None:
        """The passage with most matched words, the narrower of equals.

        Windows are one and a half template lengths wide, then twice that and so on, for notices until one holds the whole
        text and for lines up to LINE_REACH words; they start every third of their width. Windows with too few of the
        template's words can't reach ``least`` and are passed over.
        """
        (_, words, marks), counts, member = self.templates[k], self.counts[k], self.member[k]
        n = len(words)
        need = int(np.ceil(self.least * n))
        before = np.concatenate([[0], np.cumsum(member[codes])])
        if before[-1] < need:
            return None
        wide, best = n + (n + 1) // 2, None
        reach = len(codes) if n > LINE else min(len(codes), LINE_REACH)
        while True:
            starts = np.arange(0, max(1, len(codes) - wide + max(1, wide // 3)), max(1, wide // 3))
            ends = np.minimum(starts + wide, len(codes))
            for begin, end in zip(*(x[before[ends] - before[starts] >= need] for x in (starts, ends))):
                passage = codes[begin:end]
                inside = np.bincount(passage[passage >= 0], minlength=len(counts))
                if np.minimum(inside, counts).sum() < need:
                    continue
                pairs = align(passage.tolist(), words)
                if len(pairs) < need or (best and len(pairs) <= best[0]):
                    continue
                first, last = int(begin) + pairs[0][0], int(begin) + pairs[-1][0]
                if all(any(_holds(codes[first : last + 1], x) for x in m) for m in marks):
                    best = len(pairs), first, last
            if wide >= reach:
                return best
            wide *= 2


def _holds(codes: np.ndarray, phrase: Sequence[int]) -> bool:
    n = len(phrase)
    return any(codes[i : i + n].tolist() == phrase for i in np.flatnonzero(codes == phrase[0]))


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, first_word, last_word and licenses (every passage that is found, with its span) of every row.

    Words are runs of letters, digits and underscores in lower case, counted from 0. ``license`` is the best-covered
    template, the first of ``templates`` among equals; null, with coverage 0, where none reaches ``least``.
    Whole texts are scanned; a null text has no words. Null ids and repeated rows pass through, one row comes out per
    row, and nothing is shuffled. An empty table gives an empty result; other columns are never read.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    one = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column("text")]
            entries = [[dict(zip(("license", "coverage", "first_word", "last_word"), x)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(entries, pa.list_(one))], ["doc_id", "licenses"])

    entry = "license string, coverage double, first_word bigint, last_word bigint"
    scanned = docs.mapInArrow(run, f"doc_id {id_type}, licenses array<struct<{', '.join(f.replace(' ', ':') for f in entry.split(', '))}>>")
    best = F.reduce("licenses", F.lit(None).cast(f"struct<{', '.join(f.replace(' ', ':') for f in entry.split(', '))}>"), lambda a, x: F.when(a.isNull() | (x["coverage"] > a["coverage"]), x).otherwise(a))
    return scanned.withColumn("b", best).select(
        "doc_id", F.col("b.license").alias("license"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"),
        F.col("b.first_word").alias("first_word"), F.col("b.last_word").alias("last_word"), "licenses",
    )
