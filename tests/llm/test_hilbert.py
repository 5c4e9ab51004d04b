import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD
from voxelmetry.llm import hilbert as H


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_once_by_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    order = H.hilbert_index(cells, bits)
    assert sorted(order) == list(range(len(cells)))
    path = cells[np.argsort(order)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check(df, shards=16):
    rows = [(r[0], r[1] or "") for r in df.collect()]
    got = H.hilbert_shards(df, shards).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows), key=repr)
    total = sum(r.size for r in got)
    ordered = sorted(got, key=lambda r: (r.curve, r.text_hash))
    group = {h: [r.size for r in m] for h, m in itertools.groupby(ordered, key=lambda r: bytes(r.text_hash))}
    place = 0
    for h, members in itertools.groupby(ordered, key=lambda r: bytes(r.text_hash)):
        members = sorted(members, key=lambda r: (r.shard, r.slot))
        size = sum(group[h])
        for r in members:
            if size > H.TOGETHER * total / shards:
                assert r.shard == min(shards - 1, int((place + r.size / 2) * shards // total))
            place += r.size
        if size <= H.TOGETHER * total / shards:
            assert len({r.shard for r in members}) == 1
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        curve = [r.curve for r in sorted(members, key=lambda r: r.slot)]
        assert curve == sorted(curve)
    edges = [(min(r.curve for r in m), max(r.curve for r in m)) for _, m in sorted(by.items())]
    assert all(a[1] <= b[0] for a, b in zip(edges, edges[1:]))
    largest = max(r.size for r in got)
    assert all(abs(sum(r.size for r in m) - total / shards) <= largest + 2 * H.TOGETHER * total / shards for m in by.values())


def test_shards_are_runs_of_equal_bytes(sample):
    check(sample)


def test_awkward_rows(awkward, none):
    got = H.hilbert_shards(awkward).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 1) for i, t, *_ in AWKWARD), key=repr)
    assert all(0 <= r.shard < 16 and r.grown_shard is None and r.law == "bytes" for r in got)
    assert H.hilbert_shards(none).count() == 0


def test_reruns_and_partitions_agree(sample):
    a = H.hilbert_shards(sample).select("doc_id", "shard", "slot")
    b = H.hilbert_shards(sample.repartition(5)).select("doc_id", "shard", "slot")
    assert a.exceptAll(b).isEmpty()


def test_manifest_prunes_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = H.hilbert_shards(docs)
    manifest = {r.shard: r for r in H.write_shards(docs, placed, str(tmp_path / "out")).collect()}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard", "slot").exceptAll(docs).isEmpty() and back.count() == docs.count()
    code = placed.join(docs.where("lang = 'es'").select("doc_id"), "doc_id").agg(F.min("lang_code")).first()[0]
    met = {k for k, r in manifest.items() if r.min_lang_code <= code <= r.max_lang_code}
    holds = {r.shard for r in back.where("lang = 'es'").select("shard").distinct().collect()}
    assert holds <= met and len(met) <= 10
