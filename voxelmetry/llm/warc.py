"""WARC archives of web pages, and the merged index of their captures.

Archives are written by Spark's text sink: a record is its headers and payload, and the blank lines that end a record are
the line separator. They are read back as whole files. Every file gives one run of captures, sorted by URL key and time
where it is read; runs are dealt into key ranges, and each range is merged by a loser tree over the runs in it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelmetry.llm.common import pick
from voxelmetry.session import checkpoint_root, cut_lineage

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
# records of a file; a file is read whole
RECORDS_PER_FILE = 10_000
# pages carry no time: a page is captured as many seconds after this day as its id says, within ten years
FIRST_DAY, SPAN = "2020-01-01", 3650 * 86_400
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of the bytes in base 32, as WARC files write it."""
    digest = F.sha1(payload.cast("binary"))
    chars = []
    for k in range(8):  # five hexadecimal digits are four base-32 digits
        twenty = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(BASE32), F.shiftright(twenty, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def capture_time(page_id: Column) -> Column:
    """14 digits, whatever the session's time zone."""
    t = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(SPAN))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(t / 86_400).cast("int"))
    return F.concat(F.date_format(day, "yyyyMMdd"), two(t % 86_400 / 3600), two(t % 3600 / 60), two(t % 60))


def write_archive(pages: DataFrame, path: str, smallest: int = 0, records: int = RECORDS_PER_FILE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a WARC record for every row under ``path``.

    Of rows with equal payloads of at least ``smallest`` bytes, those with the smallest id are responses and the others
    revisit it without their payload; smaller payloads are always written. Digests are counted on a narrow table first,
    so only payloads that occur more than once are looked up.
    Null html is an empty payload. A null id comes after all others; if all ids of a payload are null, all are responses.
    A null url leaves its header out. Line breaks in urls are written as %0D and %0A.
    """
    pages = pick(pages, page_id=id_col, url=url_col, html=html_col)
    payload = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", F.octet_length(payload).alias("bytes"), F.sha1(payload.cast("binary")).alias("_sha")).where(F.col("bytes") >= smallest)
    repeated = narrow.groupBy("_sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    repeated = cut_lineage(repeated.select(F.col("_sha").alias("_again"), "first"), "payloads")
    joined = pages.withColumn("_sha", F.sha1(payload.cast("binary"))).join(repeated, F.col("_sha") == F.col("_again"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    size = F.octet_length(payload)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    time = capture_time(F.col("page_id"))
    at = lambda begin, n: F.substring(time, begin, n)
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    page = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.when(revisit, F.lit("")).otherwise(payload)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        line("WARC-Record-ID", page(F.col("page_id"))), F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.concat(at(1, 4), F.lit("-"), at(5, 2), F.lit("-"), at(7, 2), F.lit("T"), at(9, 2), F.lit(":"), at(11, 2), F.lit(":"), at(13, 2), F.lit("Z"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(payload))),
        F.when(revisit, F.concat(line("WARC-Refers-To", page(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")), F.lit(END),
    )
    record = F.concat(head, http, body).alias("value")
    joined.select(record).write.option("lineSep", END).option("maxRecordsPerFile", records).text(path)


def url_key(url: str | None) -> str:
    """The url in lower case with the parts of its host reversed, so that a site's pages stand together."""
    url = (url or "").lower()
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)([^#]*)", url, re.S)
    return ",".join(reversed(m[1].split("."))) + ")" + m[2] if m else url


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, headers and block of every record of a file."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:head].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        end = head + 4 + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, end + 4 - at, headers, data[head + 4 : end]
        at = end + 4


RUN = "run string, seq bigint, url_key string, time string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, offset bigint, length bigint"
RUN_FIELDS = [f.split()[0] for f in RUN.split(", ")]
RUN_SCHEMA = pa.schema([(f.split()[0], pa.int64() if f.endswith("bigint") else pa.string()) for f in RUN.split(", ")])


def _page(uri: str | None) -> int | None:
    number = (uri or "")[len("<urn:x-page:") : -1]
    return int(number) if number not in ("", "-") else None


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive file under ``path`` as one run, sorted by URL key, time and id; see RUN.

    Payloads of responses are hashed again and must have the digest their record states.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for offset, length, h, block in parse_records(content.as_buffer().to_pybytes()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"the payload at byte {offset} of {name} is not what its record states")
                    url = h.get("WARC-Target-URI")
                    time = re.sub(r"\D", "", h["WARC-Date"])
                    rows.append((url_key(url), time, _page(h["WARC-Record-ID"]), url, h["WARC-Type"], _page(h.get("WARC-Refers-To")), size, digest, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[8]))
                run = name.as_py().rsplit("/", 1)[-1]
                columns = list(zip(*[(run, k, *r) for k, r in enumerate(rows)])) or [[]] * len(RUN_FIELDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, RUN_SCHEMA)], schema=RUN_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return cut_lineage(files.mapInArrow(read, RUN), "capture_runs")


class LoserTree:
    """Merges sorted runs: inner nodes hold the loser of each match, and replaying one path yields the next winner."""

    def __init__(self, runs: Sequence[Sequence[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.losers = [-1] * max(len(runs), 1)
        for k in range(len(runs)):
            self._play(k)

    def _beats(self, a: int, b: int) -> bool:
        """Whether the head of run a comes before that of run b; a run at its end never does."""
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or self.runs[a][self.at[a]] < self.runs[b][self.at[b]]

    def _play(self, k: int) -> None:
        """Moves run k up from its leaf; an empty node is a match whose other side has not come yet."""
        node = (k + len(self.runs)) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = k
                return
            if self._beats(self.losers[node], k):
                self.losers[node], k = k, self.losers[node]
            node //= 2
        self.losers[0] = k

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.at[k := self.losers[0]] < len(self.runs[k]):
            yield self.runs[k][self.at[k]]
            self.at[k] += 1
            self._play(k)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in the order of URL key, time and id, with ``position``, their gapless place from 0.

    Rows are dealt into ranges of (key, time, id, run, seq), so that captures of one URL that are a third of all spread
    over as many ranges as any others. A task holds the index lines of its range, without payloads, in one list for each run;
    each list is sorted already, and the lists are merged.
    """
    order = ["url_key", "time", "page_id", "run", "seq"]
    pieces = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        tables = []
        for batch in batches:
            place = len(tables)
            tables.append(batch)
            keys = zip(*[batch.column(c).to_pylist() for c in order])
            for k, (key, time, page, run, seq) in enumerate(keys):
                parts.setdefault(run, []).append(((key, time, page is not None, page or 0, run, seq), place, k))
        for part in parts.values():  # a shuffle may deliver the blocks of a run in any order
            if any(a > b for a, b in zip(part, part[1:])):
                part.sort()
        merged = [(place, k) for _, place, k in LoserTree(list(parts.values()))]
        if tables:
            starts = [0]
            for t in tables:
                starts.append(starts[-1] + t.num_rows)
            for begin in range(0, len(merged), 10_000):
                chosen = pa.array([starts[p] + k for p, k in merged[begin : begin + 10_000]], pa.int64())
                out = pa.Table.from_batches(tables).take(chosen).combine_chunks().to_batches()[0]
                n = out.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(range(begin, begin + n), pa.int64())], [*RUN_FIELDS, "_piece", "_place"]
                )

    merged = cut_lineage(runs.repartitionByRange(pieces, *order).mapInArrow(merge, f"{RUN}, _piece int, _place bigint"), "histories")
    totals = merged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = totals.select(F.col("_piece").alias("_p"), (F.sum("_n").over(W.orderBy("_piece")) - F.col("_n")).alias("_before"))
    return merged.join(before, F.col("_piece") == F.col("_p")).select(*RUN_FIELDS, (F.col("_place") + F.col("_before")).alias("position"))


def archive_and_index(pages: DataFrame, path: str | None = None, smallest: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives of ``pages`` (under the shared folder unless ``path`` is given) and returns their merged index.

    See ``write_archive`` for nulls and ties, RUN and ``merge_runs`` for the columns. Repeated rows are separate records. An
    empty table gives an empty archive and index; other columns are never read.
    """
    spark = pages.sparkSession
    path = path or f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, smallest, id_col=id_col, url_col=url_col, html_col=html_col)
    return merge_runs(capture_runs(spark, path))
