import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD, SEPARATED
from voxelmetry.llm import exact_dedup as E
from voxelmetry.llm import simhash as S


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def brute_copies(docs, largest):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(docs):
        groups[t or ""].append((i, k))
    out = []
    for text, members in groups.items():
        ids = [i for i, _ in members if i is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        stays = next(k for i, k in members if i == keep)
        out += [(i, keep, len(members), k == stays, hashlib.sha256(text.encode()).hexdigest()) for i, k in members]
    return sorted(out, key=repr)


def test_copies_match_brute_force_on_awkward_rows(awkward):
    docs = [(i, t) for i, t, *_ in AWKWARD]
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(E.exact_copies(awkward, keep="largest"), *names) == brute_copies(docs, True)
    assert rows_of(E.exact_copies(awkward), *names) == brute_copies(docs, False)


def test_colliding_hashes_never_join_texts(awkward):
    weak = lambda text: F.unhex(F.lpad(F.conv(F.crc32(text) % 2, 10, 16), 2, "0"))
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(E.exact_copies(awkward, keep="largest", hasher=weak), *names) == brute_copies([(i, t) for i, t, *_ in AWKWARD], True)


def test_drop_copies_keeps_columns_and_one_row_of_each_text(awkward, none):
    left = E.drop_copies(awkward)
    assert left.columns == awkward.columns
    kept = [r[1] or "" for r in left.collect()]
    assert sorted(kept) == sorted({t or "" for _, t, *_ in AWKWARD})
    assert E.drop_copies(none).count() == 0 and E.exact_copies(none).count() == 0


def brute_print(text, width=3):
    table = str.maketrans(S.UPPER, S.LOWER)
    w = SEPARATED.findall((text or "").translate(table))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(docs, radius=3):
    prints = [brute_print(t) for _, t in docs]
    arr = np.array(prints, np.uint64)
    seen, comp = set(), [None] * len(docs)
    for k in range(len(docs)):
        if k in seen:
            continue
        group, todo = [], [k]
        seen.add(k)
        while todo:
            x = todo.pop()
            group.append(x)
            for y in np.flatnonzero(np.bitwise_count(arr ^ arr[x]) <= radius):
                if int(y) not in seen:
                    seen.add(int(y))
                    todo.append(int(y))
        least = min((docs[g][0] for g in group if docs[g][0] is not None), default=None)
        for g in group:
            comp[g] = least
    return sorted(((docs[k][0], f"{prints[k]:016x}", comp[k]) for k in range(len(docs))), key=repr)


def test_near_duplicates_match_brute_force(awkward, sample, none):
    names = ("doc_id", "fingerprint", "component_id")
    assert rows_of(S.near_duplicates(awkward), *names) == brute_components([(i, t) for i, t, *_ in AWKWARD])
    docs = [(r.doc_id, r.text) for r in sample.collect()]
    assert rows_of(S.near_duplicates(sample), *names) == brute_components(docs)
    assert S.near_duplicates(none).count() == 0 and S.drop_near_duplicates(none).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for radius in (1, 2, 3):
        for positions in (list(range(64)), [p for p in range(64) if p % 3]):
            masks = [m & (2**64 - 1) for m in S.covering_masks(radius, positions)]
            for _ in range(2000):
                flips = sum(1 << p for p in rng.sample(positions, radius))
                assert any(not m & flips for m in masks)


def test_large_buckets_are_split_and_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**63))
    near = {centre ^ int(sum(1 << int(p) for p in rng.choice(40, size=k, replace=False))) for k in (1, 2, 5, 6, 7, 8) for _ in range(3000)}
    values = sorted(near)
    df = spark.createDataFrame([(v,) for v in values], "print BIGINT")
    from voxelmetry.session import cut_lineage

    labels = {r.node: r.root for r in S.smallest_reachable(S.links(cut_lineage(df, "t"), 3, 4096)).collect()}
    arr = np.array(values, np.int64).view(np.uint64)
    want, unseen = {}, np.ones(len(arr), bool)
    for k in range(len(arr)):
        if unseen[k]:
            unseen[k], todo, group = False, [k], [k]
            while todo:
                hit = np.flatnonzero(unseen & (np.bitwise_count(arr ^ arr[todo.pop()]) <= 3))
                unseen[hit] = False
                todo += hit.tolist()
                group += hit.tolist()
            if len(group) > 1:
                want |= {values[g]: values[k] for g in group}
    assert {n: labels.get(n, n) for n in want} == want
    assert set(labels) <= set(want)


def test_drop_near_duplicates_keeps_one_of_each_component(awkward):
    left = [(r[0], r[1]) for r in S.drop_near_duplicates(awkward).collect()]
    comps = {c for _, _, c in brute_components([(i, t) for i, t, *_ in AWKWARD])}
    assert len(left) == len({(i, t) for i, t in left}) and len(left) >= len(comps)
