import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD
from voxelmetry.llm import language as L


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, L.identify(docs)


def test_held_out_rows_are_recognised(found):
    docs, out = found
    held = out.where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.count() > 100
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    fold = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2)
    assert fold.count() == held.count()


def test_reruns_and_partitions_agree(found):
    docs, out = found
    again = L.identify(docs.repartition(7).withColumn("source", F.lit("x")))
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 5)) for r in x.collect()} for x in (out, again))
    assert a == b


def test_held_out_labels_are_never_seen(found):
    docs, out = found
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    changed = docs.withColumn("lang", F.when(fold, F.lit("zz")).otherwise(F.col("lang")))
    assert L.identify(changed).where("lang_pred = 'zz'").count() == 0


def test_awkward_rows(awkward, none):
    got = L.identify(awkward).collect()
    assert len(got) == len(AWKWARD)
    labels = {la for _, _, la, _ in AWKWARD if la}
    texts = {(i, t) for i, t, *_ in AWKWARD}
    for r in got:
        letters = [any(c.isalpha() for c in t or "") for i, t in texts if i == r.doc_id]
        assert 0 <= r.score <= 1
        assert r.lang_pred in labels | {"und"}
        if not any(letters):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert L.identify(none).count() == 0
    assert {r.lang_pred for r in L.identify(awkward.drop("lang").withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_votes_are_the_weighted_mean_over_all_windows():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.integers(60, 90, (64, L.WINDOW)).astype(np.uint8)
    y = np.arange(64) % 2
    x[y == 1, ::2] = 97
    net = L.ByteNet.fit(x, y, ["a", "b"], passes=3)
    texts = [bytes(x.ravel()[: n]).decode() for n in (1, 255, 256, 257, 5000, 16000)]
    names, scores = L._vote(net, pa.array([*texts, None, ""]))
    for t, n, s in zip(texts, names, scores):
        w = L.cut_windows(np.frombuffer(t.encode(), np.uint8))
        size = np.minimum(len(t) - L.WINDOW * np.arange(len(w)), L.WINDOW)
        p = (net.probabilities(w) * size[:, None]).sum(0) / len(t)
        assert n == net.languages[p.argmax()] and s == pytest.approx(p.max(), abs=1e-5)
    assert names[-2:] == ["und", "und"]


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(2)
    x = rng.integers(97, 123, (200, L.WINDOW)).astype(np.uint8)
    y = rng.integers(0, 3, 200)
    for k in range(3):
        x[y == k, 5:200:7] = 65 + k
    net = L.ByteNet.fit(x, y, ["a", "b", "c"], passes=60)
    assert (net.probabilities(x).argmax(1) == y).mean() > 0.95
    assert not net.kernel[L.WIDTHS[0] * L.EMBEDDING :, : L.FILTERS].any() and not net.embedding[0].any()
