"""WARC archives of pages, written and read as a table of record chunks.

A record is one or more rows of identifier, chunk number and bytes. Pages are turned into
chunk rows before they leave the JVM; the writer appends them to archives, one per task,
and the reader walks an archive in pieces of bounded size and gives the chunks back.
Digests advance with each chunk on both sides, so no step needs room for a whole record,
beyond the row that a page of the table itself is.

Payloads of at least ``REVISIT_BYTES`` that are equal are stored once, with the page of the
largest id; the other pages get revisit records that name it and carry no payload.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, small_batches

CHUNK_BYTES = 1 << 18
REVISIT_BYTES = 1000
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"

CHUNKS = "record_id string, page_id bigint, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, chunk int, last boolean, data binary, digest_so_far string"


def with_digests(pages: DataFrame) -> DataFrame:
    """``pages`` with the size and SHA-1 of each payload, the page's text in UTF-8; null is empty."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
    )


def originals(digests: DataFrame) -> DataFrame:
    """``(payload_digest, payload_bytes, keeper)`` of payloads that several pages share: the largest page id of each."""
    large = digests.where(F.col("payload_bytes") >= REVISIT_BYTES)
    held = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    return held.where("n > 1 AND keeper IS NOT NULL").select("payload_digest", "payload_bytes", "keeper")


def planned(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Pages as records to write: payload, digest, type, and the page that a revisit refers to.

    Digests alone are grouped; payloads stay where they are read, since the pages that are
    revisits are found by identifier and digest. Rows that repeat a page, id and payload
    both, are one response each: a page does not revisit itself.
    """
    rows = with_digests(pages)
    digests = scratch.write(rows.select("page_id", "payload_digest", "payload_bytes"), "digests")
    kept = scratch.write(originals(digests), "originals")
    # Both sides are scans of short rows; a payload that a third of all pages share can be split.
    revisits = digests.join(kept, ["payload_digest", "payload_bytes"]).where("page_id IS NULL OR page_id != keeper")
    return rows, scratch.write(revisits.select("page_id", "payload_digest", "keeper").distinct(), "revisits")


def _header(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {length}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n"


def record_head(record_id: str, page_id: int | None, url: str | None, payload_bytes: int, digest: str, keeper: int | None) -> bytes:
    """The header of a record. A revisit has no payload and names the page that has it."""
    revisit = keeper is not None
    uri = re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{record_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To-Page", keeper),
        ("WARC-Page-ID", page_id),
        ("WARC-Payload-Length", payload_bytes),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    return _header(fields, 0 if revisit else payload_bytes)


def _filesystem(path: str):
    """The file system of a path, and the path within it, through Arrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def chunk_rows(rows: DataFrame, revisits: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``(record, page_id, url, payload_bytes, payload_digest, keeper, chunk, last, data)`` of the records to write.

    A payload is cut into rows of ``chunk`` bytes at most; an empty one, and a revisit,
    which carries none, are one row without bytes. The rows of a record lie one after the
    other in its partition, as they come from one row, whatever way the join is done.
    """
    # Revisits are told apart beside the payloads, which move once.
    marked = rows.join(revisits, (rows.page_id.eqNullSafe(revisits.page_id)) & (rows.payload_digest == revisits.payload_digest), "left")
    fixed = ["record", "page_id", "url", "payload_bytes", "payload_digest", "keeper"]
    records = marked.select(
        F.monotonically_increasing_id().alias("record"), rows.page_id, rows.url, rows.payload_bytes, rows.payload_digest, revisits.keeper,
        F.when(revisits.keeper.isNull(), rows.payload).otherwise(F.lit(b"")).alias("payload"),
    )
    # The number of the last chunk is taken from the payload itself, so that it is read once for all of its chunks.
    numbers = F.expr(f"explode(sequence(0, greatest(0, cast((octet_length(payload) - 1L) div {chunk} as int))))")
    numbered = records.select(*fixed, "payload", numbers.alias("chunk"))
    last = F.expr(f"(chunk + 1L) * {chunk} >= octet_length(payload)")
    return numbered.select(*fixed, "chunk", last.alias("last"), F.expr(f"substring(payload, chunk * {chunk} + 1, {chunk})").alias("data"))


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """``(archive, n_records, n_bytes)`` of ``chunk_rows``: a row for each archive that a finished task has written.

    A digest advances with the chunks of a record and must end at the one in its header.
    A task writes to a name of its own attempt, so a repeated or lost task leaves at most
    an archive that no row names; readers open named archives only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        name, records, size, out = f"{uuid.uuid4().hex}.warc", 0, 0, None
        now, due, running = None, 0, None  # the open record, its next chunk, its digest so far
        for batch in batches:
            for i in range(batch.num_rows):
                record, page, url, length, digest, keeper, number, last, data = (c[i] for c in batch.columns)
                record, number = record.as_py(), number.as_py()
                if (now is None and number != 0) or (now is not None and (record, number) != (now, due)):
                    raise ValueError("the chunks of a record do not follow each other")
                keeper, digest = keeper.as_py(), digest.as_py()
                if now is None:
                    if out is None:
                        out = system.open_output_stream(f"{root}/{name}")
                    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{records}")
                    head = record_head(str(own), page.as_py(), url.as_py(), length.as_py(), digest, keeper)
                    out.write(head)
                    size += len(head) + 4
                    running = hashlib.sha1()
                view = memoryview(data.as_buffer())
                out.write(view)
                running.update(view)
                size += len(view)
                now, due = record, number + 1
                if last.as_py():
                    if keeper is None and running.hexdigest() != digest:
                        raise ValueError("the chunks of a record are not its payload")
                    out.write(b"\r\n\r\n")
                    records, now = records + 1, None
        if now is not None:
            raise ValueError("the last chunk of a record is missing")
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["archive", "n_records", "n_bytes"])

    return chunks.mapInArrow(run, "archive string, n_records bigint, n_bytes bigint")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if lines[0] + b"\r\n" != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(line.decode().split(": ", 1) for line in lines[1:] if line)


def record_chunks(stream, chunk: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunk rows of an archive, read piece by piece: never more than a header or a chunk at once."""
    held = b""

    def fill(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            more = stream.read(max(n - len(held), 1 << 16))
            if not more:
                return False
            held += more
        return True

    while fill(1):
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise ValueError("an archive ends within a header")
        fields, held = _fields(held[:at]), held[at + 4 :]
        left, number, digest = int(fields["Content-Length"]), 0, hashlib.sha1()
        refers, page = fields.get("WARC-Refers-To-Page"), fields.get("WARC-Page-ID")
        fixed = (
            fields["WARC-Record-ID"][10:-1], None if page is None else int(page), fields["WARC-Type"], None if refers is None else int(refers),
            fields["WARC-Payload-Digest"].split(":", 1)[1], int(fields["WARC-Payload-Length"]),
        )
        while True:
            take = min(left, chunk)
            if not fill(take):
                raise ValueError("an archive ends within a record")
            data, held = held[:take], held[take:]
            digest.update(data)
            left -= take
            yield (*fixed, number, left == 0, data, digest.hexdigest())
            number += 1
            if not left:
                break
        if not fill(4) or held[:4] != b"\r\n\r\n":
            raise ValueError("a record is not followed by its end")
        held = held[4:]


def read_archives(archives: DataFrame, folder: str, chunk: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the named archives; ``digest_so_far`` is the SHA-1 up to and with a chunk.

    ``with_data=False`` reads and digests the bytes but does not pass them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        schema = pa.schema(
            [
                ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()),
                ("data", pa.binary()), ("digest_so_far", pa.string()),
            ]
        )
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{name}") as stream:
                    rows, size = [], 0
                    for row in record_chunks(stream, chunk):
                        size += len(row[8])
                        rows.append(row if with_data else (*row[:8], None, row[9]))
                        if size >= 16 * chunk or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select("archive").mapInArrow(run, CHUNKS)


def archive_pages(pages: DataFrame, folder: str, scratch: Scratch | None = None, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) to archives in ``folder``; the written table of archives comes back.

    Null html is an empty payload, a null url or id leaves its header out; rows that repeat
    stay, each a record. An empty table writes no archive. Other columns are not archived.
    """
    spark = pages.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark)
    rows, revisits = planned(pages, scratch)
    system_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(system_path)
    return scratch.write(write_archives(chunk_rows(rows, revisits, chunk), folder), "archives")


def page_records(pages: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every page, from archives read back.

    The digest of a response is that of the bytes read, and must be the one in its header.
    """
    scratch = Scratch(pages.sparkSession)
    folder = scratch.path("warc")
    archives = archive_pages(pages, folder, scratch, chunk)
    spread = archives.repartition(max(1, archives.count()))
    ends = read_archives(spread, folder, chunk, with_data=False).where("last")
    response = F.col("record_type") == "response"
    checked = F.when(response & (F.col("digest_so_far") != F.col("payload_digest")), F.raise_error(F.lit("a payload has changed in its archive")))
    digest = F.coalesce(checked.cast("string"), F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")))
    return ends.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def read_payloads(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """``(record_id, page_id, chunk, data)`` of all payload bytes; concatenated by chunk they are the payloads."""
    return read_archives(archives, folder).where(F.octet_length("data") > 0).select("record_id", "page_id", "chunk", "data")
