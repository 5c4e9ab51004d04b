import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SEPARATED
from voxelmetry.llm import minhash as M


def shingles(text, width):
    w = SEPARATED.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(docs, width=2, percent=80):
    """(id, set size, smallest id of the component) of every row: every pair of distinct sets is compared."""
    sets = [shingles(t, width) for _, t in docs]
    distinct = sorted(set(sets) - {frozenset()}, key=len)
    root = {s: s for s in distinct}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    for k, x in enumerate(distinct):
        for y in distinct[k + 1 :]:
            if percent * len(y) > 100 * len(x):
                break
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                root[top(x)] = top(y)
    ids = {}
    for (i, _), s in zip(docs, sets):
        if s and i is not None:
            ids[top(s)] = min(i, ids.get(top(s), i))
    return Counter((i, len(s), ids.get(top(s)) if s else i) for (i, _), s in zip(docs, sets))


def rows(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for width in (2, 5):
        got = M.near_duplicate_classes(docs, width=width).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()], width)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_awkward_rows(awkward, none):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert rows(M.near_duplicate_classes(awkward)) == brute(docs)
    assert M.near_duplicate_classes(none).count() == 0


def family(n, seed, length=60):
    """A base text, copies with a few changed words, and copies of copies, among them pairs just at and below 80 %."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(length)]
    texts = [base]
    for _ in range(n):
        w = list(rng.choice(texts[-20:]))
        for at in rng.sample(range(length), rng.choice([1, 2, 3, 4, 5])):
            w[at] = word()
        texts.append(w)
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("bucket, part", [(2048, 4_000_000), (8, 500)])
def test_chains_and_large_groups_in_pieces(spark, bucket, part):
    docs = list(enumerate(family(150, 1) + family(150, 2) + ["one two three four five six"] * 40))
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(5)
    found = M.near_sets(df, bucket=bucket, part=part).collect()
    least = {}
    for r in found:
        least[r.component] = min(r.doc_id, least.get(r.component, r.doc_id))
    assert Counter((r.doc_id, r.n_shingles, least[r.component]) for r in found) == brute(docs)
    assert len(least) < len(docs) - 40


def test_index_finds_every_pair_within_the_distance():
    rng = np.random.default_rng(3)
    for errors in (1, 6, 47):
        a = rng.integers(0, 1 << 16, (200, M.POSITIONS)).astype(np.uint16)
        b = a.copy()
        for row in b:
            at = rng.choice(M.POSITIONS, errors, replace=False)
            row[at] ^= 1
        assert (M.index_keys(a, errors) == M.index_keys(b, errors)).any(axis=1).all()


def test_allowed_errors_bound_the_misses():
    k = M.allowed_errors(80)
    rng = np.random.default_rng(0)
    assert 40 < k < 60 and (rng.binomial(M.POSITIONS, 0.2, 1_000_000) > k).mean() < 1e-4
    assert M.allowed_errors(100) == 0
    sets = [np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64)) for _ in range(2)]
    shared = np.unique(rng.integers(0, 1 << 63, 7200, dtype=np.uint64))
    x, y = M.signatures([np.unique(np.concatenate([shared, s])) for s in sets])
    assert 8 < (x != y).sum() < k
