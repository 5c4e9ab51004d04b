from collections import Counter

import corpus_pipeline as C
from tests.llm.conftest import SEPARATED
from tests.llm.test_mixing import brute
from tests.llm.test_near_texts import brute_rows
from tests.llm.test_tokens import direct
from voxelmetry.llm.common import pick
from voxelmetry.llm.language import identify, least_score, train
from voxelmetry.session import cut_lineage


def pairs(df):
    return Counter((r[0], r[1]) for r in df.collect())


def run_and_check(spark, docs):
    """Every stage against brute force on its own input."""
    stages = dict(C.STAGES)
    assert len(stages) == 5
    before, columns = pairs(docs), docs.columns
    scores = {(r.doc_id, bytes(r.text_hash)): r for r in identify(docs).collect()}
    learned = train(pick(docs, doc_id="doc_id", text="text", lang="lang").where("pmod(crc32(cast(cast(doc_id AS STRING) AS BINARY)), 4) <> 2"))
    n_languages = len(learned.languages)
    docs = cut_lineage(stages["language"](spark, docs, ""), "t1")
    after = pairs(docs)
    assert docs.columns == columns and not after - before
    for (i, t), n in (before - after).items():
        assert not t or not any(c.isalpha() for c in t) or any(r.score < least_score(n_languages, C.CONFIDENCE) for (j, _), r in scores.items() if j == i), (i, n)
    before = after

    docs = cut_lineage(stages["exact_dedup"](spark, docs, ""), "t2")
    least = {}
    for i, t in before:
        least[t] = i if t not in least or least[t] is None or (i is not None and i < least[t]) else least[t]
    before = pairs(docs)
    assert docs.columns == columns and before == Counter((i, t) for t, i in least.items())

    docs = cut_lineage(stages["near_dedup"](spark, docs, ""), "t3")
    after = pairs(docs)
    assert docs.columns == columns and not after - before
    assert Counter((i, t or "") for i, t in after.elements()) == brute_rows(list(before))
    rows = [(r[0], r[1], r["source"]) for r in docs.collect()]

    docs = cut_lineage(stages["mixing"](spark, docs, ""), "t4")
    expected = Counter()
    texts = {i: t for i, t, _ in rows}
    for i, size, _, _, taken in brute(rows):
        if size and round(taken / size):
            expected[i, texts[i]] = round(taken / size)
    before = pairs(docs)
    assert docs.columns == columns and before == expected and all(SEPARATED.search(t) for _, t in before)

    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages["encoding"](spark, docs, "").collect())
    want = Counter()
    for (i, t), n in before.items():
        want[(i, *direct(t))] += n
    assert got == want and sum(got.values()) > 0
    return sum(got.values())


def test_stages_on_given_documents(spark, sample):
    n = run_and_check(spark, sample)
    assert C.run(spark, "/root/testdata/sf0.001").count() == n


def test_stages_on_awkward_rows(spark, awkward, none):
    # Parquet, which every stage is written as, has no column names that differ in case alone
    names = ["text2" if c == "TEXT" else c for c in awkward.columns]
    run_and_check(spark, awkward.toDF(*names))
    docs = none.toDF(*names)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
