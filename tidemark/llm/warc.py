"""WARC archives as chunked record tables.

Writing: a record's payload leaves as HTTP chunks, each a row of its own, so the
archive is made by Spark's text writer (any file system) and no row is longer than
a chunk. Reading: lines stream through a parser that yields one row per chunk with
the SHA-1 of all bytes so far; it holds one chunk at a time, never a record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, ship, table, utf8

CHUNK = 64 * 1024
EOL = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: One row per chunk. payload_bytes and payload_digest cover the payload up to and
#: including the chunk; ``last`` marks the row that has them for the whole payload.
CHUNKS = (
    "record_id string, record_type string, target_uri string, page_id long, refers_to long, "
    "chunk_no long, data binary, payload_bytes long, payload_digest string, declared_digest string, last boolean"
)
_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()),
        ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("declared_digest", pa.string()), ("last", pa.bool_()),
    ]
)


def base32_sha1(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload, payload_bytes, sha1 (hex) and refers_to.

    Of payloads with equal SHA-1 and length that have ``min_bytes`` or more, the one
    with the smallest page_id stays a response; rows with a larger page_id refer to
    it. Shorter payloads, null page_ids and rows that repeat the smallest page_id are
    responses. The group's minimum is combined before the shuffle, and only digests
    meet in the join on the digest, so large groups of copies are split there.
    """
    p = pages.select("page_id", "url", utf8(F.col("html")).alias("payload"))
    p = p.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    keys = p.select("page_id", "sha1", "payload_bytes")
    first = keys.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1", "payload_bytes").agg(
        F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")
    )
    revisits = keys.join(first.where("_n > 1"), ["sha1", "payload_bytes"]).where("page_id > refers_to")
    revisits = revisits.groupBy("page_id", "sha1").agg(F.min("refers_to").alias("refers_to"))
    return p.join(revisits, ["page_id", "sha1"], "left")


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_rows(page_id, url, payload: bytes, digest: str, refers_to, chunk: int = CHUNK) -> Iterator[bytes]:
    """The rows of one record; a line end follows each in the archive."""
    n = len(payload)
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    head.append("Transfer-Encoding: chunked" if refers_to is None else f"Content-Length: {n}")
    http = "\r\n".join([*head, "", ""]).encode()
    full, rest = divmod(n, chunk)
    body = 5 + full * (len(f"{chunk:x}") + 4 + chunk) + (len(f"{rest:x}") + 4 + rest if rest else 0)
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else " ".join(str(url).split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Page-ID": page_id,
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else _record_id(refers_to, digest),
        "Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + (body if refers_to is None else 0),
    }
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), ""]
    yield "\r\n".join(lines).encode() + EOL + http[:-2]
    if refers_to is None:
        view = memoryview(payload)
        for at in range(0, n, chunk):
            part = view[at : at + chunk]
            yield b"%x\r\n" % len(part) + bytes(part)
        yield b"0" + EOL
    yield b""
    yield b""


def write_archives(records: DataFrame, path: str, chunk: int = CHUNK, compression: str = "gzip") -> None:
    """Write rows of :func:`mark_revisits` as WARC files, one per task, under ``path``."""
    ship(records.sparkSession)

    def lines(batches):
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            out, held = [], 0
            for i in range(b.num_rows):
                page_id, url, payload, sha1, refers_to = (c[i].as_py() for c in cols)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                for row in record_rows(page_id, url, payload, digest, refers_to, chunk):
                    out.append(row)
                    held += len(row)
                    if held > 4 << 20:
                        yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                        out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    rows = records.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(lines, "value binary")
    rows = rows.select(F.col("value").cast("string"))
    rows.write.option("lineSep", "\r\n").option("maxRecordsPerFile", 0).option("compression", compression).text(path)


class Parser:
    """Fed with the lines of an archive in order, without line ends; ``out`` gets a
    tuple of :data:`CHUNKS` per chunk, and one without data for an empty payload."""

    def __init__(self, chunk: int = CHUNK, with_data: bool = True) -> None:
        self.chunk, self.with_data, self.out = chunk, with_data, []
        self.state = self._start

    def feed(self, line: bytes) -> None:
        self.state(line)

    def end(self) -> None:
        """The archive ends here."""
        if self.state != self._start:
            raise ValueError("the archive ends within a record")

    def _start(self, line: bytes) -> None:
        if line:
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record starts with {line[:40]!r}")
            self.fields, self.http, self.sha, self.n, self.chunks = {}, {}, hashlib.sha1(), 0, 0
            self.state = self._fields

    def _fields(self, line: bytes) -> None:
        if line:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            self.fields[k.strip().lower()] = v.strip()
            return
        self.left = int(self.fields.get("content-length", 0))
        kind = self.fields.get("content-type", "")
        if self.left == 0:
            self._finish()
        elif kind.startswith("application/http"):
            self.state = self._http
        else:
            self._body()

    def _http(self, line: bytes) -> None:
        self.left -= len(line) + 2
        if line:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            self.http[k.strip().lower()] = v.strip()
            return
        if self.left <= 0:
            if self.fields.get("warc-type") == "revisit":
                self.n = int(self.http.get("content-length", 0))
            self._finish()
        elif "chunked" in self.http.get("transfer-encoding", "").lower():
            self.state = self._size
        else:
            self._body()

    def _body(self) -> None:
        self.buffer, self.need, self.state = bytearray(), self.left, self._plain

    def _plain(self, line: bytes) -> None:
        whole = len(line) >= self.need
        part = line[: self.need] if whole else line + EOL[: self.need - len(line)]
        self.need -= len(part)
        self.buffer += part
        while len(self.buffer) >= self.chunk:
            self._emit(bytes(self.buffer[: self.chunk]))
            del self.buffer[: self.chunk]
        if self.need == 0:
            if self.buffer:
                self._emit(bytes(self.buffer))
            self._finish()

    def _size(self, line: bytes) -> None:
        self.need = int(line.split(b";")[0], 16)
        self.buffer = bytearray()
        self.state = self._data if self.need else self._trailer

    def _data(self, line: bytes) -> None:
        if len(line) > self.need:
            raise ValueError("a chunk is longer than its size says")
        self.buffer += line
        self.need -= len(line)
        if self.need == 0:
            self._emit(bytes(self.buffer))
            self.state = self._size
        else:  # the line end was part of the chunk
            self.buffer += EOL[: self.need]
            self.need -= min(2, self.need)

    def _trailer(self, line: bytes) -> None:
        if not line:
            self._finish()

    def _emit(self, data: bytes, last: bool = False) -> None:
        if self.chunks:  # the chunk before was not the last
            self.out.append(self.held)
        self.sha.update(data)
        self.n += len(data)
        self.held = self._row(data)
        self.chunks += 1

    def _row(self, data: bytes) -> tuple:
        f = self.fields
        number = lambda k: int(f[k]) if f.get(k) else None
        declared = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
        return (
            f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), number("page-id"), number("refers-to-page-id"),
            self.chunks, data if self.with_data else None, self.n, base32_sha1(self.sha.copy()), declared, False,
        )

    def _finish(self) -> None:
        row = list(self.held if self.chunks else self._row(b""))
        if row[1] == "revisit":
            row[8] = row[9]
        row[10] = True
        self.out.append(tuple(row))
        self.held = None
        self.state = self._start


def read_archives(spark: SparkSession, path: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table (:data:`CHUNKS`) of the archives under ``path``. For a revisit
    there is one row without data, with the digest and length that it declares.
    Files must not be split between tasks: they are gzip files, or each is read whole."""
    ship(spark)

    def rows(batches):
        parser, file = Parser(chunk, with_data), None
        for b in batches:
            files, lines = b.column(1), b.column(0)
            names = files.dictionary_encode()
            for name, line in zip(names.indices.to_pylist(), lines, strict=True):
                name = names.dictionary[name].as_py()
                if name != file:
                    parser.end()
                    file = name
                parser.feed(line.as_py())
                if len(parser.out) >= 64:
                    yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in parser.out], _ARROW)
                    parser.out = []
        parser.end()
        if parser.out:
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in parser.out], _ARROW)

    lines = spark.read.option("lineSep", "\r\n").text(path)
    return lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path")).mapInArrow(rows, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from the chunk table; fails on a digest that doesn't hold."""
    last = chunks.where("last")
    wrong = F.raise_error(F.concat(F.lit("digest of "), F.col("record_id")))
    ok = F.col("declared_digest").isNull() | (F.col("payload_digest") == F.col("declared_digest"))
    return last.select(
        "page_id", "payload_bytes", F.when(ok, F.col("payload_digest")).otherwise(wrong).alias("payload_digest"), "record_type", "refers_to"
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back. Null html: empty payload.
    An empty table gives no rows; further columns of pages are ignored."""
    path = f"{scratch(spark)}/warc-{uuid.uuid4().hex[:8]}"
    write_archives(mark_revisits(table(spark, sf_dir, "pages", "page_id", "url", "html")), path)
    return records(read_archives(spark, path, with_data=False))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), f AS (SELECT d, n, min(page_id) AS first FROM p GROUP BY d, n)
SELECT page_id, p.n AS payload_bytes,
  translate(upper(list_aggregate([to_base(('0x' || substr(p.d, i * 5 + 1, 5))::BIGINT, 32, 4) FOR i IN range(8)], 'string_agg', '')),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p JOIN f ON p.d = f.d AND p.n = f.n
"""
