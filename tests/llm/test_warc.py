import base64
import hashlib
import random

import pytest

from voxelmetry.llm import warc as K

PAGES = [
    (1, "http://Www.B.com/x?q=1#f", "<p>ä</p>"), (2, "http://a.com/", "<p>ä</p>"), (2, "http://a.com/", "<p>ä</p>"), (3, None, None), (4, "http://a.com/", ""),
    (None, "http://a.com/", "<p>ä</p>"), (None, "no url\r\nX: y", "only here"), (None, "q", "only here"), (5, "http://a.com/", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n"),
    (6, "http://a.com/", "long " * 60000), (-7, "http://a.com/", "minus"),
]


@pytest.fixture(scope="module")
def pages(spark):
    schema = "page_id BIGINT, url STRING, html STRING, `HTML` INT, first INT, `_sha` INT, position INT"
    return spark.createDataFrame([(*p, 1, 2, 3, 4) for p in PAGES], schema).repartition(3)


def brute(pages, smallest=0):
    rows = []
    for i, _, h in pages:
        payload = (h or "").encode()
        ids = [j for j, _, g in pages if (g or "").encode() == payload and j is not None]
        again = len(payload) >= smallest and ids and i != min(ids)
        rows.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(rows, key=repr)


def test_awkward_pages(pages):
    for smallest in (0, 9):
        got = K.archive_and_index(pages, smallest=smallest).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(PAGES, smallest)
        got.sort(key=lambda r: r.position)
        assert [r.position for r in got] == list(range(len(PAGES)))
        keys = [(r.url_key, r.time, r.page_id is not None, r.page_id or 0) for r in got]
        assert keys == sorted(keys)
    assert K.archive_and_index(pages.where("false")).count() == 0


def test_given_pages_and_order_across_ranges(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in df.collect()]
    got = sorted(K.archive_and_index(df.repartition(6)).collect(), key=lambda r: r.position)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows)
    keys = [(r.url_key, r.time, r.page_id) for r in got]
    assert keys == sorted(keys) and len({r.run for r in got}) > 1


def test_records_can_be_fetched_by_offset_and_length(spark, pages, tmp_path):
    index = K.archive_and_index(pages, str(tmp_path / "w")).collect()
    for r in index:
        data = (tmp_path / "w" / r.run).read_bytes()[r.offset : r.offset + r.length]
        ((offset, length, headers, block),) = K.parse_records(data)
        assert (offset, length) == (0, len(data)) and headers["WARC-Payload-Digest"] == f"sha1:{r.payload_digest}"
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(block.partition(b"\r\n\r\n")[2]).digest()).decode() == r.payload_digest


def test_damage_is_noticed():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for *_, b in K.parse_records(good * 2)] == [b"abc"] * 2
    for bad in (good.replace(b"3", b"2"), b"x" + good):
        with pytest.raises(ValueError):
            list(K.parse_records(bad))


def test_loser_tree_merges_any_runs():
    rng = random.Random(5)
    for k in [0, 1, 2, 3, 5, 8, 13]:
        for _ in range(20):
            runs = [sorted((rng.randrange(9), r, i) for i in range(rng.randrange(0, 12))) for r in range(k)]
            assert list(K.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert K.url_key("HTTP://Www.B.com/X?Q#f") == "com,b,www)/x?q"
    assert K.url_key(None) == "" and K.url_key("Plain") == "plain"
