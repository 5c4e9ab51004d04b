import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import AWKWARD, SEPARATED
from voxelmetry.llm import quality as Q


def brute_counts(text):
    text = text or ""
    w = SEPARATED.findall(text)
    lines = [x for x in text.split("\n") if SEPARATED.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def brute_verdicts(docs, smallest, tail=Q.TAIL, steps=5):
    """Verdict and distance of each (text, lang, source), group by group in plain matrices."""
    counts = [brute_counts(t) for t, _, _ in docs]
    failed = [n < 50 or 100 * r > 50 * n for n, _, _, _, _, r in counts]
    x = np.array([
        [math.log(1 + n), math.log((1 + c) / (1 + n)), math.log(1 + 100 * s / (1 + c)), math.log(1 + 100 * d / max(1, k)), math.log(1 + 100 * r / max(1, n))]
        for n, c, s, k, d, r in counts
    ])
    x = np.floor(x * Q.SCALE + 0.5) / Q.SCALE
    sizes = Counter((la, so) for (_, la, so), f in zip(docs, failed) if not f)
    pool = Counter()
    for (la, _), n in sizes.items():
        pool[la] += n if n < smallest else 0
    tier = {k: 0 if n >= smallest else 1 if pool[k[0]] >= smallest else 2 for k, n in sizes.items()}
    rest = sum(n for k, n in sizes.items() if tier[k] == 2)
    groups = defaultdict(list)
    for k, ((_, la, so), f) in enumerate(zip(docs, failed)):
        if not f:
            t = tier[la, so]
            groups[(la, so) if t == 0 else (la,) if t == 1 else ()].append(k)
    floors = np.array([f for _, f in Q.STATISTICS])
    out = [(not f, None) for f in failed]
    for name, members in groups.items():
        if name == () and rest < smallest:
            continue
        v = x[members]
        step = 8 / floors
        rounded = np.floor(v * step + 0.5)
        low, mid, high = (np.percentile(rounded, p, axis=0) / step for p in (25, 50, 75))
        centre, cov = mid, np.diag(((high - low) / 1.349) ** 2 + floors**2)

        def distance(centre=None, cov=None, v=v):
            return np.einsum("ij,jk,ik->i", v - centre, np.linalg.inv(cov), v - centre)

        for _ in range(steps):
            bins = np.floor(np.log2(distance(centre, cov) + 1) * Q.BINS)
            upto = np.sort(bins)[(len(v) + Q.DIMENSIONS + 1 + 1) // 2 - 1]
            inner = v[bins <= upto]
            centre, cov = inner.mean(0), Q.consistency(0.5, 5) * np.cov(inner.T, bias=True) + np.diag(floors**2)
        inner = v[distance(centre, cov) <= Q.chi_square_point(0.975, 5)]
        centre, cov = inner.mean(0), Q.consistency(0.975, 5) * np.cov(inner.T, bias=True) + np.diag(floors**2)
        for k, d in zip(members, distance(centre, cov)):
            out[k] = (bool(d <= Q.chi_square_point(1 - tail, 5)), d)
    return counts, failed, out


def check(df, smallest):
    rows = [(r[0], r[1], r[2], r[3]) for r in df.collect()]
    counts, failed, verdicts = brute_verdicts([r[1:] for r in rows], smallest)
    got = sorted(([*r[:8], r[8]] for r in Q.robust_outliers(df, smallest=smallest).collect()), key=repr)
    want = sorted(([r[0], n, c, s, d, rep, f, kept, dist] for r, (n, c, s, _, d, rep), f, (kept, dist) in zip(rows, counts, failed, verdicts)), key=repr)
    assert [g[:8] for g in got] == [w[:8] for w in want]
    assert all((g[8] is None) == (w[8] is None) and (g[8] is None or g[8] == pytest.approx(w[8], rel=1e-6)) for g, w in zip(got, want))
    return got


def test_matches_brute_force(sample):
    got = check(sample, 10)
    assert any(not g[6] and not g[7] for g in got) and any(g[7] for g in got)


def test_awkward_rows(awkward, none):
    check(awkward, 40)
    assert Q.robust_outliers(none).count() == 0
    assert len(AWKWARD) == Q.robust_outliers(awkward).count()


def test_a_large_cluster_of_junk_does_not_hide_itself(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8)))
    clean = [" ".join(word() for _ in range(int(n))) for n in np.exp(rng.normal(5, 0.5, 200)).clip(60)]
    junk = [" ".join(word() + "###" for _ in range(int(n))) for n in np.exp(rng.normal(5, 0.5, 100)).clip(60)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    kept = {r.doc_id: r.kept for r in Q.robust_outliers(df).collect()}
    assert sum(kept[i] for i in range(200)) >= 199 and not any(kept[i] for i in range(200, 300))


def test_chi_square_constants():
    # published table values
    assert Q.chi_square_point(0.975, 5) == pytest.approx(12.8325, abs=1e-3)
    assert Q.chi_square_point(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
