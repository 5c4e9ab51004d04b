import random
import re
import zlib
from collections import Counter

import pytest

from voxelmetry.llm import spelling as S
from voxelmetry.session import cut_lineage


def near(a, b):
    """One letter inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(docs):
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def brute(words):
    forms, out = {}, set()
    for w, n in words.items():
        other = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        forms[w] = (other[0] if other and words[other[0]] >= 10 * n else None, len(other))
    for w, (form, n_near) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.add((w, form, root, words[w], n_near, words[form] if form else None))
    return out


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_awkward_rows(awkward, none):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert rows(S.spelling_groups(awkward)) == brute(brute_words(docs))
    assert S.spelling_groups(none).count() == 0


@pytest.mark.parametrize("cell", [2048, 4])
def test_dense_words_chains_and_split_cells(spark, cell):
    rng = random.Random(4)
    made = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 8))) for _ in range(900)}
    made |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaabaaaa", "ÀÀÀÀÀÀ×", "x" * 700, "x" * 699, "x" * 350 + "y" + "x" * 349}
    docs = [(k, " ".join([w, w.upper()] * rng.choice([1, 1, 1, 12, 150]))) for k, w in enumerate(sorted(made))]
    docs += [(8000 + k, " ".join([w] * n)) for k, (w, n) in enumerate((("qqqqqqqq", 400), ("qqqqqqqr", 40), ("qqqqqqrr", 3)))]
    docs += [(None, "unnamed unnamed"), (5, None), (6, ""), (7, "short words only"), (8, "tied-words tied_words")] + [(9, "repeated repeated")] * 3
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(4)
    words = brute_words(docs)
    want = brute(words)
    assert rows(S.spelling_groups(df, cell=cell)) == want
    assert len({r[2] for r in want}) < len(want) and max(r[4] for r in want) > 3 and any(r[1] != r[2] for r in want if r[1])
    table = cut_lineage(spark.createDataFrame(list(words.items()), "word STRING, n LONG"), "words")
    assert {r.word: r.n_near for r in S.near_words(table, cell).collect()} == {r[0]: r[4] for r in want if r[4]}
