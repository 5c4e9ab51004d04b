import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voxelmetry.llm import divergence as D


def brute(docs, least=10, top=10):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
        counts[lang or "", source or ""].update(found)
        seen[lang or ""].update(found.keys())
    kept = {lang: {t for t, n in of.items() if n >= least} for lang, of in seen.items()}
    out = set()

    def shares(groups, lang):
        n = {t: sum(counts[g][t] for g in groups) for t in kept[lang]}
        return {t: 1 + 10**9 * (c + 2) // (sum(n.values()) + 2 * len(n)) for t, c in n.items()}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in counts:
        mine, of = shares([(lang, source)], lang), shares([g for g in counts if g[0] == lang], lang)
        pairs = []
        for x, other in counts:
            if x == lang and other != source:
                theirs = shares([(lang, other)], lang)
                pairs.append((other, sum(f(mine[t], theirs[t]) for t in kept[lang])))
        terms = [(t, f(mine[t], of[t])) for t in kept[lang] if counts[lang, source][t] and mine[t] > of[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)}
    return out


def rows(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


def made(n=400):
    rng = random.Random(6)
    words = ["été", "日本", "Alpha", "beta", "γάμμα", *[f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]]
    docs = [("en" if k % 3 else "fr", f"s{rng.randrange(5)}", " ".join(rng.choices(words[: 10 + k % 40], k=20)) + " a1b2_c") for k in range(n)]
    return docs + [(None, None, "beta beta"), ("xx", "one", "few words"), ("xx", None, None), ("xx", "two", ""), ("en", "bare", "123 456"), ("en", "bare", "!")]


@pytest.mark.parametrize("digest, block", [(F.xxhash64, 64), (F.length, 2), (lambda t: F.length(t) * 0, 64)])
def test_counts_ties_and_colliding_digests(spark, digest, block):
    docs = made()
    df = spark.createDataFrame(docs, "lang STRING, source STRING, text STRING").repartition(5)
    assert rows(D.source_divergence(df, digest=digest, block=block)) == brute(docs)


def test_awkward_rows(awkward, none):
    docs = [(r.lang, r.source, r.text) for r in awkward.collect()]
    assert rows(D.source_divergence(awkward, least=2)) == brute(docs, 2)
    assert D.source_divergence(none).count() == 0


def test_long_division_is_exact(spark):
    cases = [(0, 0, 1), (5, 5, 1), (10**12, 7 * 10**12 + 1, 10**6), (123456789, 987654321987, 54321), (2 * 10**15, 3 * 10**15, 10**9)]
    df = spark.createDataFrame(cases, "c LONG, n LONG, v LONG").select(F.expr(D.share_of("c", "n", "v")).alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]
