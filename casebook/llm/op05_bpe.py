"""BPE encoding and decoding by a table of distinct words.

Documents are dealt into blocks of a few million characters. A block lists its distinct pieces (what the byte-level
pre-tokenizer yields) and, for every position, the number of its piece. The lists go, packed, to hash buckets of
pieces; a bucket's task encodes each distinct piece once, whatever number of blocks hold it. The ids return to the
blocks and are joined back by position. Decoding goes from ids to bytes through the id-to-piece table, whose size is
the vocabulary's (bounded by the tokenizer file).

The block table is written to the shared folder first, so a recomputed task finds the same blocks; the positions, which
are most of it, lie in one side file per writing task (named by attempt, known from the committed table only) and are
read where a block is put together, so they are not shuffled. Hot words cost one
entry per block, never one per occurrence; a long document is one block of its own.

Defined cases: a null or empty text has no ids and decodes to the empty text; null doc_ids and repeated rows are kept
as they are, one result row per input row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, functions as F

from casebook.llm import textblock as tb
from casebook.llm.byte_bpe import codec, default_path
from casebook.llm.shared import open_in, open_out, shared_folder, written

BLOCK_CHARS = 12_000_000
SLICE_CHARS = 300_000
BLOCKS = "block string, doc_ids array<bigint>, counts array<int>, parts array<struct<bucket:int,words:binary>>, path string, at bigint, size bigint"
RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=5).compress(data)


def _unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed by planes of bytes."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T
    parts = [_squeeze(p.tobytes()) for p in planes]
    return np.array([len(values), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpack_numbers(data: bytes) -> tuple[np.ndarray, int]:
    """The numbers, and how many bytes they took."""
    n, *sizes = np.frombuffer(data, "<u4", 5).tolist()
    out, at = np.empty((n, 4), np.uint8), 20
    for k, size in enumerate(sizes):
        out[:, k] = np.frombuffer(_unsqueeze(data[at : at + size]), np.uint8, n)
        at += size
    return out.view("<u4").reshape(-1), at


def pack_words(words: list[bytes]) -> bytes:
    return pack_numbers(np.fromiter(map(len, words), np.uint32, len(words))) + _squeeze(b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    size, at = unpack_numbers(data)
    raw, end = _unsqueeze(data[at:]), np.cumsum(size.astype(np.int64)).tolist()
    return [raw[a:b] for a, b in zip([0, *end], end)]


def pack_places(places: np.ndarray) -> bytes:
    """Numbers that are given in order of first occurrence: a first occurrence is 0, others are one more."""
    seen = np.zeros(len(places), np.int64)
    seen[1:] = np.maximum.accumulate(places)[:-1] + 1
    return pack_numbers(np.where(places >= seen, 0, places + 1))


def unpack_places(data: bytes) -> np.ndarray:
    coded = unpack_numbers(data)[0].astype(np.int64)
    new = coded == 0
    return np.where(new, np.cumsum(new) - 1, coded - 1)


def _block(doc_ids: list, texts: list, special: str, buckets: int) -> dict:
    """One row of BLOCKS: pieces are numbered by first occurrence and listed by bucket of their hash."""
    known: dict[str, int] = {}
    places, counts, bucket_of = [], [], []
    for part, _ in tb.batches(texts, texts, SLICE_CHARS):
        h, begin, end, first, joined = tb.byte_bpe_pieces(part, special)
        words, slot = tb.distinct_pieces(h, begin, end, joined, special)
        had = len(known)
        number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        hash_of = np.zeros(len(words), np.uint64)
        hash_of[slot] = h[0]
        bucket_of.append((hash_of[number >= had] % np.uint64(buckets)).astype(np.int64))
        places.append(number[slot])
        counts.extend(np.diff(first).tolist())
    bucket_of = np.concatenate(bucket_of)
    words = list(known)
    parts = []
    order = np.argsort(bucket_of, kind="stable")
    heads = np.searchsorted(bucket_of[order], np.arange(buckets + 1))
    for b in np.unique(bucket_of).tolist():
        parts.append({"bucket": b, "words": pack_words([words[k].encode() for k in order[heads[b] : heads[b + 1]].tolist()])})
    return {"block": uuid.uuid4().hex, "doc_ids": doc_ids, "counts": counts, "parts": parts, "side": pack_numbers(bucket_of) + pack_places(np.concatenate(places))}


def block_table(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """The block table of all documents, in the shared folder."""
    special = codec(path).special_text
    folder = shared_folder(docs.sparkSession, "bpe-places")

    def run(batches):
        import pyarrow as pa

        name, out, at = f"{folder}/{uuid.uuid4().hex}.places", None, 0
        ids, texts, total = [], [], 0

        def flush():
            nonlocal out, at
            row = _block(ids, texts, special, buckets)
            out = out or open_out(name)
            side = row.pop("side")
            out.write(side)
            row |= {"path": name, "at": at, "size": len(side)}
            at += len(side)
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW())

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i), texts.append(t)
                total += len(t or "")
                if total >= BLOCK_CHARS:
                    yield flush()
                    ids, texts, total = [], [], 0
        if ids:
            yield flush()
        if out is not None:
            out.close()

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(slim.mapInArrow(run, BLOCKS), "bpe-blocks")


def _BLOCK_ARROW():
    import pyarrow as pa

    part = pa.struct([("bucket", pa.int32()), ("words", pa.binary())])
    return pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("parts", pa.list_(part)), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def encode_words(blocks: DataFrame, path: str, buckets: int) -> DataFrame:
    """(block, bucket, ids): ids of the block's pieces of that bucket, each distinct piece of a bucket encoded once."""

    def run(batches):
        import pyarrow as pa

        own, bucket_now, known = codec(path), None, {}
        for batch in batches:
            rows = []
            for block, bucket, words in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != bucket_now:
                    bucket_now, known = bucket, {}
                found = []
                for w in unpack_words(words):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = tuple(own.ids_of(w.decode()))
                    found.append(ids)
                size = np.fromiter(map(len, found), np.uint32, len(found))
                flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
                rows.append({"block": block, "bucket": bucket, "ids": pack_numbers(size) + pack_numbers(flat)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("ids", pa.binary())]))

    rows = blocks.select("block", F.explode("parts").alias("p")).select("block", "p.bucket", "p.words")
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "block string, bucket int, ids binary")


def encode_decode(docs: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """RESULT's columns for every row of ``docs(doc_id, text)``; ``buckets`` (by default the session's shuffle
    partitions) deals the distinct pieces to tasks."""
    path = path or default_path()
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = block_table(docs, path, buckets)
    ids = encode_words(blocks, path, buckets)

    def assemble(rows):
        import pandas as pd

        own = codec(path)
        words, row = rows[rows["bucket"] >= 0], rows[rows["bucket"] < 0].iloc[0]
        with open_in(row["path"]) as stream:
            stream.seek(int(row["at"]))
            side = stream.read(int(row["size"]))
        bucket_of, used = unpack_numbers(side)
        order = np.argsort(bucket_of, kind="stable")
        sizes, tables = [], []
        for packed in words.sort_values("bucket")["ids"] if len(words) else []:
            size, at = unpack_numbers(packed)
            sizes.append(size), tables.append(unpack_numbers(packed[at:])[0])
        table = np.concatenate(tables) if tables else np.zeros(0, np.uint32)
        by_bucket = (np.concatenate(sizes) if sizes else np.zeros(0, np.uint32)).astype(np.int64)
        size, head = np.empty_like(by_bucket), np.empty_like(by_bucket)
        size[order], head[order] = by_bucket, np.cumsum(by_bucket) - by_bucket
        places = unpack_places(side[used:])
        out, at = [], 0
        for doc, count in zip(row["doc_ids"], row["counts"]):
            mine = places[at : at + count]
            at += count
            a, b, n = hashlib.sha256(), hashlib.sha256(), 0
            text, tail = _Utf8(b), b""
            for k in range(0, len(mine), 65536):
                part = mine[k : k + 65536]
                got = tb.ragged(table, head[part], size[part])
                n += len(got)
                for piece in own.spelled(got, own.numerals()):
                    a.update(tail + piece[:-1])
                    tail = b","
                for piece in own.spelled(got, own.pieces()):
                    text.add(piece)
            text.close()
            out.append((doc, n, a.hexdigest(), b.hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    heads = blocks.select("block", F.lit(-1).alias("bucket"), "doc_ids", "counts", "path", "at", "size")
    return heads.unionByName(ids, allowMissingColumns=True).groupBy("block").applyInPandas(assemble, RESULT)


class _Utf8:
    """Feeds a digest with the text that bytes decode to, part by part."""

    def __init__(self, digest):
        import codecs

        self.digest, self.decoder = digest, codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, data: bytes) -> None:
        self.digest.update(self.decoder.decode(data).encode())

    def close(self) -> None:
        self.digest.update(self.decoder.decode(b"", True).encode())


def op5_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    """The contract's row per document of the whole table."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
