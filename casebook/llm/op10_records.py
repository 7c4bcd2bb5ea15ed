"""Token ids as length-delimited binary records with an offset index.

A record file holds sequences one after the other, each framed as: length of the payload (8 bytes), masked checksum of
those 8 bytes (4), payload, masked checksum of the payload (4); all little-endian. A payload is the document's number (8)
and its ids, of 2 bytes each where the vocabulary fits and 4 otherwise. The checksum is CRC-32 (zlib), masked by a
rotation and an added constant so that checksums of checksums stay apart. Beside each file lies an index of 24 bytes a
record: doc_id, offset, framed length; with it a reader can fetch records in any order.

Documents are dealt by range of doc_id and sorted within a range, so files follow each other in ascending doc_id.
A task writes to names of its own attempt and returns them in the manifest; only names in the committed manifest are
read, so a repeated or lost task leaves nothing behind that is read. The manifest has one row per file and is one small
Parquet file itself; small record files are read several to a task.

Defined cases: a null or empty text is only the end id; null doc_ids come first and are kept; repeated rows give
records of their own, ordered by text; other columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from casebook.llm import textblock as tb
from casebook.llm.byte_bpe import SeenPieces, codec, default_path
from casebook.llm.shared import open_in, open_out, shared_folder, written

SLICE_CHARS = 500_000
CACHED_PIECES = 300_000
#: Small files share a task that reads about so much; larger ones have a task each.
READ_BYTES = 4_000_000
#: Fixed value: added to a rotated checksum.
MASK = 0xA282EAD8
NULL_ID = -(1 << 63)
MANIFEST = "part int, path string, records bigint, ids bigint, bytes bigint"
RESULT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(stream, offset: int | None = None) -> bytes | None:
    """The payload at the stream's place (or at ``offset``); None at the end; ValueError where a checksum differs."""
    if offset is not None:
        stream.seek(offset)
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(zlib.crc32(head[:8])):
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(zlib.crc32(body[:size])):
        raise ValueError("damaged record")
    return body[:size]


@lru_cache(4)
def seen_pieces(path: str) -> SeenPieces:
    """One memory of pieces per process and file, kept from task to task."""
    return SeenPieces(codec(path), CACHED_PIECES)


def encoded(texts: list, path: str, end_id: int):
    """Ids of each text (with the end id), as arrays."""
    own, seen = codec(path), seen_pieces(path)
    for part, _ in tb.batches(texts, texts, SLICE_CHARS):
        h, begin, end, first, joined = tb.byte_bpe_pieces(part, own.special_text)
        table, head, size = seen.ids(h, begin, end, joined)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.append(tb.ragged(table, head[a:b], size[a:b]), np.uint32(end_id))


def write_records(docs: DataFrame, path: str | None = None, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Write all documents' ids in ascending doc_id order; the committed manifest, one row per file."""
    path = path or default_path()
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-records")
    wide = max(len(codec(path).pieces()[1]) - 1, end_id) > 0xFFFF

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), None
        out = index = None
        records = ids_total = offset = 0
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            if ids and out is None:
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
                out, index = open_out(f"{name}.rec"), open_out(f"{name}.idx")
            for doc, seq in zip(ids, encoded(texts, path, end_id)):
                number = NULL_ID if doc is None else doc
                framed = frame(struct.pack("<q", number) + seq.astype("<u4" if wide else "<u2").tobytes())
                out.write(framed)
                index.write(struct.pack("<qQQ", number, offset, len(framed)))
                offset += len(framed)
                records += 1
                ids_total += len(seq)
        if out is not None:
            out.close(), index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "records": [records], "ids": [ids_total], "bytes": [offset]})

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    # the manifest's rows, one per file, go into one Parquet file instead of one each
    return written(dealt.mapInArrow(run, MANIFEST).repartition(1), "token-manifest")


def read_records(manifest: DataFrame, wide: bool = False) -> DataFrame:
    """(part, place, doc_id, ids binary of 4 bytes each) of every record, read through the index and checked."""
    return _read(manifest, wide, False)


def _read(manifest: DataFrame, wide: bool, digest: bool) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, start = [], 0, 0
                with open_in(f"{name}.rec") as data, open_in(f"{name}.idx") as index:
                    place = 0
                    while entries := index.read(24 * 4096):
                        for number, offset, _ in struct.iter_unpack("<qQQ", entries):
                            payload = unframe(data, offset)
                            if struct.unpack_from("<q", payload)[0] != number:
                                raise ValueError("the index names another document")
                            seq = np.frombuffer(payload, "<u4" if wide else "<u2", -1, 8).astype("<u4")
                            doc = None if number == NULL_ID else number
                            rows.append((part, place, doc, start, len(seq), zlib.crc32(seq)) if digest else (part, place, doc, seq.tobytes()))
                            place, start, held = place + 1, start + len(seq), held + (64 if digest else seq.nbytes)
                            if held > 4_000_000:
                                yield _batch(pa, rows, digest)
                                rows, held = [], 0
                if rows:
                    yield _batch(pa, rows, digest)

    def _batch(pa, rows, digest):
        cols = list(zip(*rows))
        kinds = [pa.int32(), pa.int64(), pa.int64(), *([pa.int64()] * 3 if digest else [pa.binary()])]
        names = ["part", "place", "doc_id", *(["within", "n_tokens", "ids_crc32"] if digest else ["ids"])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    schema = "part int, place bigint, doc_id bigint, " + ("within bigint, n_tokens bigint, ids_crc32 bigint" if digest else "ids binary")
    n, size = manifest.agg(F.count("*"), F.sum("bytes")).first()
    files = manifest.select("part", "path").repartition(max(1, min(n, -(-(size or 0) // READ_BYTES))))
    return files.mapInArrow(run, schema)


def records_digest(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """RESULT's columns per record, read back from the files. A file's start is the sum of ids of the files before it;
    that sum is over the manifest, which has one row per file."""
    path = path or default_path()
    manifest = write_records(docs, path, end_id)
    wide = max(len(codec(path).pieces()[1]) - 1, end_id) > 0xFFFF
    before, starts = 0, []
    for r in sorted(manifest.select("part", "ids").collect()):
        starts.append((r.part, before))
        before += r.ids
    spark = docs.sparkSession
    heads = spark.createDataFrame(starts, "part int, before bigint")
    read = _read(manifest, wide, True).join(F.broadcast(heads), "part")
    return read.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_records(spark, sf_dir: str) -> DataFrame:
    """The contract's row per document of the whole table."""
    return records_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
