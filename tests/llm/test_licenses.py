import random
from itertools import combinations

import pytest

from tests.llm.conftest import AWKWARD
from voxelmetry.llm import licenses as N
from voxelmetry.llm.license_texts import TEMPLATES

SCANNER = N.Scanner(TEMPLATES, N.LEAST)
rng = random.Random(4)


def filler(n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_longest_rise_against_all_subsequences():
    for _ in range(100):
        values = rng.sample(range(20), rng.randrange(0, 8))
        got = [values[k] for k in N.longest_rise(values)]
        longest = max(k for k in range(len(values) + 1) if any(list(c) == sorted(c) for c in combinations(values, k)))
        assert got == sorted(got) and len(got) == longest


def test_alignment_rises_and_matches_equal_words():
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        pairs = N.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert N.align(a, a) == [(k, k) for k in range(len(a))]


@pytest.mark.parametrize("name", TEMPLATES)
def test_every_template_is_found_anywhere_with_small_changes(name):
    text = TEMPLATES[name]
    n = len(N.WORD.findall(text))
    for before, after in ((0, 0), (1, 700), (333, 5), (2000, 2000)):
        found = {x[0]: x for x in SCANNER.scan(f"{filler(before)} {text} {filler(after)}")}
        assert found[name][1:] == (1.0, before, before + n - 1)
    words = text.split()
    if len(words) > 20:
        for k in rng.sample(range(1, len(words) - 1), len(words) // 20):
            words[k] = "changed"
        found = {x[0]: x for x in SCANNER.scan(filler(50) + " " + " ".join(words) + " " + filler(50))}
        assert found[name][1] >= 0.85


@pytest.mark.parametrize("name", TEMPLATES)
@pytest.mark.parametrize("times", [2, 3, 6])
def test_repeated_templates_are_found(name, times):
    for before in range(0, 12, 3):
        text = filler(before) + " " + "\n".join([TEMPLATES[name]] * times) + filler(30)
        assert {x[0]: x[1] for x in SCANNER.scan(text)}[name] == 1.0


def test_plain_text_has_no_license():
    assert SCANNER.scan(filler(3000)) == [] and SCANNER.scan("") == []
    assert SCANNER.scan("the of and to in " * 500) == []


def test_rows(awkward, none, spark):
    got = N.scan_licenses(awkward).collect()
    assert len(got) == len(AWKWARD) and all(r.license is None and r.coverage == 0 and r.licenses == [] for r in got)
    assert N.scan_licenses(none).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: SCANNER.scan(r.text) for r in docs.collect()}
    for r in N.scan_licenses(docs).collect():
        assert [tuple(x) for x in r.licenses] == want[r.doc_id]
        if want[r.doc_id]:
            assert r.coverage == max(x[1] for x in want[r.doc_id]) and r.license is not None
    lines = {k: v for k, v in TEMPLATES.items() if "(line)" in k}
    for r in docs.collect():
        for name, text in lines.items():
            if text in r.text:
                assert (name, 1.0) in [x[:2] for x in want[r.doc_id]]
