"""Archives are an exact round trip; revisits against a brute-force rule."""

import hashlib
import io
from collections import defaultdict

import pytest

from tabloom.llm import warc
from tabloom.llm.common import Scratch
from tabloom.session import scratch_path

SCHEMA = "page_id bigint, url string, html string"


def brute(rows):
    """{(page_id, digest)} -> record type and reference, by the rule."""
    keeper = defaultdict(list)
    for i, _, html in rows:
        keeper[html or ""].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [k for k in keeper[html or ""] if k is not None]
        revisit = len(data) >= 1000 and len(keeper[html or ""]) > 1 and ids and i != max(ids)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=str)


def result(df, **options):
    return sorted([tuple(r) for r in warc.page_records(df, **options).collect()], key=str)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    pages = pages.unionByName(pages.selectExpr("page_id + 1000 AS page_id", "url", "html")).repartition(3)
    assert result(pages) == brute(rows + [(i + 1000, u, h) for i, u, h in rows])


ODD = [
    (1, None, None), (2, "", ""), (3, "http://a/b c\r\nWARC-Type: x", "x" * 999), (4, "u", "x" * 999), (5, "u", "é" * 500), (6, "u", "é" * 500),
    (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (8, "u", "y" * 10**6), (9, "u", "y" * 10**6), (9, "u", "y" * 10**6), (None, "u", "z" * 2000),
    (None, None, "z" * 2000), (10, "u", "w" * 1500), (None, "u", "w" * 1500),
]


@pytest.mark.parametrize("chunk", [1 << 18, 7])
def test_odd_pages(spark, chunk):
    rows = ODD if chunk > 7 else [r for r in ODD if len(r[2] or "") < 10**5]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS payload", "'x' AS keeper", "2 AS record_type")
    assert result(df, chunk=chunk) == brute(rows)
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_payloads_round_trip(spark):
    folder, scratch = scratch_path(spark, "warc-test"), Scratch(spark)
    rows = [r for r in ODD if r[0] is not None]
    archives = warc.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, scratch, chunk=1000)
    parts = defaultdict(dict)
    for r in warc.read_payloads(spark, archives, folder).collect():
        parts[r.page_id, r.record_id][r.chunk] = bytes(r.data)
    got = {page: b"".join(chunks[k] for k in sorted(chunks)) for (page, _), chunks in parts.items()}
    want = {i: html.encode() for i, _, html in rows if html and not (i in (5, 8))}
    assert got == want
    assert archives.agg({"n_records": "sum"}).first()[0] == len(rows)


class Slow(io.BytesIO):
    """A stream that gives a few bytes at a time and remembers the largest piece asked for."""

    asked = 0

    def read(self, n=-1):
        self.asked = max(self.asked, n)
        return super().read(min(n, 13))


def test_reader_is_bounded_and_strict():
    payload = b"abc\r\n\r\nWARC/1.1" * 50000
    record = warc.record_head("i", 1, "http://x", len(payload), hashlib.sha1(payload).hexdigest(), None) + payload + b"\r\n\r\n"
    stream = Slow(record * 2)
    rows = list(warc.record_chunks(stream, 4096))
    assert stream.asked <= 1 << 16
    assert b"".join(r[8] for r in rows) == payload * 2
    ends = [r for r in rows if r[7]]
    assert [r[9] for r in ends] == [hashlib.sha1(payload).hexdigest()] * 2
    for broken in (record[:-1], record[:-5000], record[:30], b"junk\r\n\r\n" + record):
        with pytest.raises(ValueError):
            list(warc.record_chunks(io.BytesIO(broken), 4096))


def test_chunk_rows_are_bounded(spark):
    rows = [r for r in ODD if r[0] is not None]
    own, revisits = warc.planned(spark.createDataFrame(rows, SCHEMA).repartition(3), Scratch(spark))
    got = warc.chunk_rows(own, revisits, 999).collect()
    assert max(len(r.data) for r in got) == 999
    records = defaultdict(list)
    for r in got:
        records[r.record].append(r)
    for parts in records.values():
        # In the order in which the writer sees them.
        assert [r.chunk for r in parts] == list(range(len(parts)))
        assert [r.last for r in parts] == [False] * (len(parts) - 1) + [True]
    whole = sorted((p[0].page_id, b"".join(bytes(r.data) for r in p)) for p in records.values())
    assert whole == sorted((i, b"" if i in (5, 8) else (html or "").encode()) for i, _, html in rows)


def test_writer_refuses_torn_records(spark):
    rows, revisits = warc.planned(spark.createDataFrame([(1, "u", "ab" * 700)], SCHEMA), Scratch(spark))
    chunks = warc.chunk_rows(rows, revisits, 1000).coalesce(1)
    folder = scratch_path(spark, "warc-torn")
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA), folder).isEmpty()  # makes the folder
    for torn in ("chunk = 0", "chunk = 1"):
        with pytest.raises(Exception, match="chunk"):
            warc.write_archives(chunks.where(torn), folder).collect()
    with pytest.raises(Exception, match="not its payload"):
        changed = chunks.selectExpr("* except (data)", "if(last, cast('x' AS binary), data) AS data")
        warc.write_archives(changed, folder).collect()


def test_page_of_many_megabytes(spark):
    html = "<p>0123456789é</p>" * 3_000_000
    pages = spark.createDataFrame([(1, "u", "short")], SCHEMA).unionByName(spark.range(1).selectExpr("2L AS page_id", "'u' AS url", "repeat('<p>0123456789é</p>', 3000000) AS html"))
    data = html.encode()
    assert result(pages) == sorted([(1, 5, hashlib.sha1(b"short").hexdigest(), "response", None), (2, len(data), hashlib.sha1(data).hexdigest(), "response", None)], key=str)
