import hashlib
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import AWKWARD, SEPARATED
from voxelmetry.llm import mixing as M


def brute(docs):
    """doc_id, size, source_size, target, taken by filling the sources one word at a time."""
    rows = [(i, len(SEPARATED.findall(t or "")), so) for i, t, so in docs]
    names = sorted({so for *_, so in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, so in rows if so == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        target = {s: 2.0 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        above = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not above:
            break
        full |= above
    taken = Counter()
    for s in names:
        order = sorted(
            ((hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, n, hashlib.md5((t or "").encode()).digest(), k)
             for k, ((i, n, so), (_, t, _)) in enumerate(zip(rows, docs)) if so == s and n)
        )
        left = int(target[s] + 0.5)
        for _ in range(2):
            for *_, n, _, k in order:
                taken[k] += min(n, left)
                left -= min(n, left)
    return sorted(((i, n, size[so], pytest.approx(target[so], rel=1e-12), taken[k]) for k, (i, n, so) in enumerate(rows)), key=lambda r: (str(r[0]), r[1], r[2], r[4]))


def rows_of(df):
    got = M.taken_words(M.mix(df)).drop("text_hash").collect()
    return sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[1], r[2], r[4]))


def test_taken_words_match_brute_force(awkward, sample, none):
    assert rows_of(awkward) == brute([(i, t, so) for i, t, _, so in AWKWARD])
    assert rows_of(sample) == brute([(r.doc_id, r.text, r.source) for r in sample.collect()])
    assert M.taken_words(M.mix(none)).count() == 0 and M.mixed_rows(none).count() == 0


def test_schedule_keeps_proportions_in_every_prefix_and_uses_every_block_once(sample):
    m = M.mix(sample, block=64)
    quota = {r.source: r.quota for r in m.sources.collect()}
    slots = sorted(tuple(r) for r in m.schedule.collect())
    used = defaultdict(list)
    total = sum(-(-q // 64) for q in quota.values())
    assert len(slots) == total and len({s for s, *_ in slots}) == total
    for k, (_, source, block) in enumerate(slots, 1):
        used[source].append(block)
        if k <= total - 4 * len(quota):
            assert abs(len(used[source]) - k * -(-quota[source] // 64) / total) < 4
    assert {s: sorted(b) for s, b in used.items()} == {s: list(range(-(-q // 64))) for s, q in quota.items() if q}


def test_blocks_hold_equal_words_and_no_word_more_often_than_the_ceiling(sample):
    m = M.mix(sample, block=50)
    words, seen = Counter(), defaultdict(Counter)
    for r in m.pieces.collect():
        words[r.slot] += r.end - r.begin
        for w in range(r.begin, r.end):
            seen[r.row][w] += 1
    last = {r.source: -(-r.quota // 50) - 1 for r in m.sources.collect()}
    assert all(words[r.slot] == 50 or r.block == last[r.source] for r in m.schedule.collect())
    assert max(n for c in seen.values() for n in c.values()) <= 2


def test_mixed_rows_repeat_whole_rows(awkward):
    left = M.mixed_rows(awkward)
    assert left.columns == awkward.columns
    times = Counter((r[0], r[1]) for r in left.collect())
    assert set(times) <= {(i, t) for i, t, *_ in AWKWARD} and all(SEPARATED.search(t) for _, t in times)
