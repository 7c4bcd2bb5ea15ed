"""WARC archives by way of a chunked record table.

A page's payload becomes rows of (record, chunk number, bytes). One stream over them carries each record's digests from
chunk to chunk and writes the chunk table to the shared folder; a payload over the chunk size is never handed to Python
whole, and no payload is shuffled. Equal payloads are then found on the table's last chunks, whose digest is that of the
whole payload, without reading any bytes of payloads: one aggregation combined before the shuffle, and a join of slim
rows. Writer tasks stream one file of the chunk table each, with the list of its revisits, into gzip members, one per
record, and start a new archive at a size limit; a revisit has no payload, so of a hot payload one copy is stored.
Reader tasks stream archives back to chunk rows; the last chunk of a record holds the full payload's length and digest,
and a difference to the header is an error.

A writer task holds the revisits of one file of the chunk table, which is as large as one partition of the input, and
one chunk. Names of archives carry the attempt; only those in the committed manifest are read, so lost and repeated
tasks do no harm.

Defined cases: null html is an empty payload; a null page_id is a response of its own and reads back as null; repeated
rows of one page_id and payload are responses each; a null url gives no target header, control characters in it are
percent-encoded; other columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, functions as F

from casebook.llm.shared import arrow_batches, open_in, open_out, shared_folder, written

CHUNK_BYTES = 1 << 20
FILE_BYTES = 1 << 30
#: What a task holds of its rows at once, beside one chunk: batches and row groups are small, for payloads are large.
BATCH_BYTES, ROW_GROUP_BYTES, READ_ROWS = 4 << 20, 8 << 20, 8
GZIP_LEVEL = 3
#: Fixed value: every record's date, so that equal inputs give equal archives.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TABLE = "page_id bigint, url string, chunk_no int, last boolean, chunk binary, record bigint, size bigint, sha1 string, sha256 binary"
MANIFEST = "path string, records bigint, bytes bigint"


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """TABLE: the chunks of all records, in the shared folder. A record's chunks follow each other in one file; ``record``
    counts the records of a task; ``size``, ``sha1`` and ``sha256`` are of the payload as far as it has come, digests
    only on the last chunk."""
    payload = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    last = F.greatest(F.ceil(F.octet_length("payload") / F.lit(chunk_bytes)).cast("int") - 1, F.lit(0))
    rows = payload.select("*", last.alias("last_no")).select("*", F.explode(F.sequence(F.lit(0), F.col("last_no"))).alias("chunk_no"))
    chunks = rows.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "chunk_no", (F.col("chunk_no") == F.col("last_no")).alias("last"), F.col("payload").substr(F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))

    def run(batches):
        import pyarrow as pa

        record, sha1, sha256, size = -1, None, None, 0
        for batch in batches:
            out = []
            for no, last, chunk in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if no == 0:
                    record, sha1, sha256, size = record + 1, hashlib.sha1(), hashlib.sha256(), 0
                part = chunk.as_buffer()
                sha1.update(part), sha256.update(part)
                size += len(part)
                out.append((record, size, sha1.hexdigest() if last else None, sha256.digest() if last else None))
            cols = list(zip(*out)) or [()] * 4
            added = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "record", "size", "sha1", "sha256"])

    with arrow_batches(pages.sparkSession, BATCH_BYTES):
        return written(chunks.mapInArrow(run, TABLE), "warc-chunks", **{"parquet.block.size": str(ROW_GROUP_BYTES), "maxRecordsPerFile": "0"})


def revisits(table: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(file, revisits array<struct<record, first_id>>) of each file of a chunk table: the records whose payload another
    page_id, the least, responds with."""
    slim = table.where("last").select(F.input_file_name().alias("file"), "record", "page_id", "size", "sha256")
    long = slim.where(F.col("page_id").isNotNull() & (F.col("size") >= min_revisit_bytes))
    firsts = long.groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id")
    found = long.join(firsts, "sha256").where("page_id <> first_id").groupBy("file").agg(F.collect_list(F.struct("record", "first_id")).alias("revisits"))
    return slim.select("file").distinct().join(found, "file", "left")


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _name(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _head(kind: str, page_id, url, digest: str, first_id, block: bytes, size: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_name(first_id)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block) + size}", "", ""]
    return "\r\n".join(lines).encode() + block


class _Writer:
    """Streams records of one task into archives."""

    def __init__(self, folder: str):
        self.folder, self.out, self.done = folder, None, []

    def begin(self, page_id, url, first_id, sha1: str, total: int) -> None:
        if self.out is None:
            self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            self.out, self.records, self.bytes = open_out(self.path), 0, 0
        self.gzip = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
        digest = base64.b32encode(bytes.fromhex(sha1)).decode()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n".encode()
        revisit = first_id is not None
        self._put(self.gzip.compress(_head("revisit" if revisit else "response", page_id, url, digest, first_id, http, 0 if revisit else total)))
        self.left = 0 if revisit else total
        if revisit:
            self._end()

    def add(self, chunk: bytes) -> None:
        self.left -= len(chunk)
        self._put(self.gzip.compress(chunk))
        if self.left == 0:
            self._end()

    def _end(self) -> None:
        self._put(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
        self.records += 1
        if self.bytes >= FILE_BYTES:
            self.close()

    def _put(self, data: bytes) -> None:
        self.bytes += len(data)
        self.out.write(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.records, self.bytes))
            self.out = None


def write_warc(pages: DataFrame, min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write all pages; the committed manifest, one row per archive."""
    folder = shared_folder(pages.sparkSession, "warc")
    plan = written(revisits(chunk_table(pages, chunk_bytes), min_revisit_bytes), "warc-plan")

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        writer = _Writer(folder)
        for batch in batches:
            for file, found in zip(*(c.to_pylist() for c in batch.columns)):
                first_of = {r["record"]: r["first_id"] for r in found or []}
                with open_in(file) as heads, open_in(file) as stream:
                    ends = _ends(pq.ParquetFile(heads))
                    for rows in pq.ParquetFile(stream, buffer_size=1 << 20).iter_batches(READ_ROWS, columns=["page_id", "url", "record", "chunk_no", "chunk"]):
                        for page_id, url, record, no, chunk in zip(*(c.to_pylist() for c in rows.columns)):
                            if no == 0:
                                writer.begin(page_id, url, first_of.get(record), *next(ends))
                            if record not in first_of:
                                writer.add(chunk)
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*writer.done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return written(plan.repartition(max(1, plan.count())).mapInArrow(run, MANIFEST), "warc-manifest")


def _ends(file):
    """(sha1, size) of the records of a file of the chunk table, in order."""
    for rows in file.iter_batches(4096, columns=["last", "sha1", "size"]):
        for last, sha1, size in zip(*(c.to_pylist() for c in rows.columns)):
            if last:
                yield sha1, size


class _Members:
    """The decompressed bytes of an archive, read piece by piece."""

    def __init__(self, stream, step: int = 1 << 14):
        self.stream, self.step, self.raw, self.buffer = stream, step, b"", bytearray()
        self.gzip = zlib.decompressobj(31)

    def _fill(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(self.step)
            if not self.raw:
                return False
        self.buffer += self.gzip.decompress(self.raw)  # at most 1032 bytes for each byte of a step
        self.raw = self.gzip.unused_data
        if self.gzip.eof:
            self.gzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._fill():
                if self.buffer:
                    raise ValueError("the archive ends within a header")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        while not self.buffer:
            if not self._fill():
                raise ValueError("the archive ends within a payload")
        out = bytes(self.buffer[:most])
        del self.buffer[: len(out)]
        return out


def chunks_of(stream, chunk_bytes: int = CHUNK_BYTES, payload: bool = True):
    """Chunk rows of an archive: (page_id, record_type, refers_to, url, chunk_no, last, payload_bytes, payload_digest,
    chunk). Length and digest are of the payload as far as it has come; a revisit's are its header's."""
    members = _Members(stream)
    while (head := members.until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines)
        number = lambda name: (lambda s: int(s) if s else None)(fields[name].removeprefix("<urn:x-page:").removesuffix(">"))
        page_id, kind, want = number("WARC-Record-ID"), fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        http = members.until(b"\r\n\r\n")
        left = int(fields["Content-Length"]) - len(http) - 4
        if kind == "revisit":
            size = int(http.decode().rpartition("Content-Length: ")[2])
            yield page_id, kind, number("WARC-Refers-To"), fields.get("WARC-Target-URI"), 0, True, size, want, b""
        else:
            digest, done, no = hashlib.sha1(), 0, 0
            held = bytearray()
            while True:
                while left and len(held) < chunk_bytes:
                    got = members.take(min(left, chunk_bytes - len(held)))
                    held += got
                    left -= len(got)
                digest.update(held)
                done += len(held)
                so_far = base64.b32encode(digest.digest()).decode()
                if not left and so_far != want:
                    raise ValueError("the payload differs from its digest")
                yield page_id, kind, None, fields.get("WARC-Target-URI"), no, not left, done, so_far, bytes(held) if payload else b""
                held.clear()
                no += 1
                if not left:
                    break
        if members.until(b"\r\n\r\n") != b"":
            raise ValueError("the record is longer than its header says")


CHUNKS = "page_id bigint, record_type string, refers_to bigint, url string, chunk_no int, last boolean, payload_bytes bigint, payload_digest string, chunk binary"


def read_warc(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, payload: bool = True) -> DataFrame:
    """The chunk table (CHUNKS) of all archives of a manifest, one task per archive."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_in(path) as stream:
                    for row in chunks_of(stream, chunk_bytes, payload):
                        rows.append(row)
                        held += len(row[-1]) + 200
                        if held > 4_000_000:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, CHUNKS)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """The contract's row per page of the whole table, read back from the archives."""
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(manifest, payload=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p
)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
