"""WARC archives as a table of chunks.

A record's bytes are rows (archive, record, chunk number, data): the writer streams a payload into chunks and the reader
streams chunks into digests, so no record is held whole beyond the row it comes from. Each chunk carries the payload's
length and checksum so far, which the reader holds against its own. The table is written and read by Spark, so a task
that is lost is simply run again.

Records with equal payloads are written once: the page with the largest id has the response, the others are revisits
that refer to it. Payloads are compared by digest and length; only digests are grouped, never payloads.
"""

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, table, with_groups, written

CHUNK = 1 << 16
#: Payloads shorter than this are always written whole.
LEAST_BYTES = 0
CHUNKS = "archive string, record long, chunk long, data binary, payload_bytes long, payload_crc32 long, last boolean"
_PAGE = "urn:page:"


def named(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int, most: int = BROADCAST) -> DataFrame:
    """page_id, url, html, response_id: the page that has the payload's response, null where this row itself is a response.

    Digests that stand once need no partner: only repeated ones are joined back, up to ``most`` of them by a broadcast."""
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = F.octet_length("html") >= least_bytes
    groups = rows.filter(long).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1 and response_id is not null").drop("n")
    both = with_groups(rows, written(groups), "digest", ["page_id", "url"], most)
    own = F.col("page_id").eqNullSafe(F.col("response_id")) | ~long
    return both.select("page_id", "url", "html", "digest", F.when(own, F.lit(None)).otherwise(F.col("response_id")).alias("response_id"))


def _record(page_id, url, digest, response_id, size: int) -> bytes:
    """Headers of a record, with the HTTP headers that its block begins with."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response_id is None else 'revisit'}",
        f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {''.join(c for c in (url or '') if c >= ' ')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {size}",
    ]
    if response_id is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_PAGE}{response_id}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if response_id is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def to_chunks(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, chunk: int = CHUNK, most: int = BROADCAST) -> DataFrame:
    """The chunk table of the archives, one archive for each task.

    A null payload is empty, a null url an empty one, a null page_id an empty name; repeated rows are records of their
    own. Of equal payloads those of the largest page_id are responses; without any page_id all are. Other columns are
    not read, and an empty table gives no chunks."""

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number = part << 33
        archive = f"part-{part:08d}.warc"
        out: list[tuple] = []
        held = 0
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page, link, digest, response = columns[0][i].as_py(), columns[1][i].as_py(), columns[3][i].as_py(), columns[4][i].as_py()
                payload = memoryview(columns[2][i].as_buffer() or b"")
                head = _record(page, link, digest, response, len(payload))
                body = payload if response is None else b""
                seen, crc, at = 0, 0, 0
                k = 0
                while True:
                    data = bytes(body[at : at + chunk])
                    at += len(data)
                    seen, crc = seen + len(data), zlib.crc32(data, crc)
                    last = at >= len(body)
                    out.append((archive, number, k, (head if k == 0 else b"") + data + (b"\r\n\r\n" if last else b""), seen, crc, last))
                    held += len(out[-1][3])
                    k += 1
                    if held > 4 << 20:
                        yield _batch(out)
                        out, held = [], 0
                    if last:
                        break
                number += 1
        if out:
            yield _batch(out)

    return named(pages, page_id, url, html, least_bytes, most).select("page_id", "url", "html", "digest", "response_id").mapInArrow(write, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["archive", "record", "chunk", "data", "payload_bytes", "payload_crc32", "last"])


class Reader:
    """One record, chunk by chunk: headers, then the payload's length and digest."""

    def __init__(self):
        self.buffer, self.headers, self.http, self.left = b"", None, False, 0
        self.sha1, self.size, self.crc = hashlib.sha1(), 0, 0

    def feed(self, data: bytes) -> None:
        if self.http:
            return self._payload(data)
        self.buffer += data
        if self.headers is None and b"\r\n\r\n" in self.buffer:
            head, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            self.headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            self.left = int(self.headers["Content-Length"])
        if self.headers is not None and b"\r\n\r\n" in self.buffer:
            head, _, rest = self.buffer.partition(b"\r\n\r\n")
            self.left -= len(head) + 4
            self.http, self.buffer = True, b""
            self._payload(rest)

    def _payload(self, data: bytes) -> None:
        data = data[: self.left]
        self.left -= len(data)
        self.sha1.update(data)
        self.size += len(data)
        self.crc = zlib.crc32(data, self.crc)

    def row(self) -> tuple:
        h = self.headers
        kind = h["WARC-Type"]
        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (digest != base64.b32encode(self.sha1.digest()).decode() or self.size != int(h["X-Payload-Length"])):
            raise ValueError(f"record {h['WARC-Record-ID']}: its payload doesn't match its digest")
        number = lambda x: int(x) if (x := x.strip("<>").removeprefix(_PAGE)) else None
        return number(h["WARC-Record-ID"]), int(h["X-Payload-Length"]), digest, kind, number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None


def from_chunks(chunks: DataFrame) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Chunks of a record meet in a task in order of their number and go through a digest one at a time. Records of a
    single chunk are read where they lie; only the chunks of longer ones are shuffled."""

    def read(batches):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        record, reader, rows, expect = None, None, [], 0
        for batch in batches:
            for r, k, data, seen, crc in zip(*(batch.column(i) for i in range(5))):
                r, k = r.as_py(), k.as_py()
                if r != record:
                    if reader is not None:
                        rows.append(reader.row())
                    record, reader, expect = r, Reader(), 0
                if k != expect:
                    raise ValueError(f"record {r}: chunk {expect} is missing")
                expect += 1
                reader.feed(data.as_py())
                if (reader.size, reader.crc) != (seen.as_py(), crc.as_py()):
                    raise ValueError(f"record {r}: chunk {k} doesn't match its running digest")
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
                rows = []
        if reader is not None:
            rows.append(reader.row())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.select("record", "chunk", "data", "payload_bytes", "payload_crc32", "last")
    alone = F.col("last") & (F.col("chunk") == 0)
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    ordered = rows.filter(~alone).drop("last").repartition(n, "record").sortWithinPartitions("record", "chunk")
    return rows.filter(alone).drop("last").mapInArrow(read, kind).unionByName(ordered.mapInArrow(read, kind))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return from_chunks(written(to_chunks(table(spark, sf_dir, "pages"))))


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {s}) & 31), 1)"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS response_id FROM p),
g AS (SELECT m.*, CAST('0x' || substr(h, 5 * i + 1, 5) AS INTEGER) AS v, i FROM m, unnest(range(8)) AS t(i)),
d AS (SELECT page_id, html, response_id, string_agg({' || '.join(_DIGIT.format(s=s) for s in (15, 10, 5, 0))}, '' ORDER BY i) AS payload_digest FROM g GROUP BY ALL)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response_id THEN NULL ELSE response_id END AS refers_to
FROM d
"""
