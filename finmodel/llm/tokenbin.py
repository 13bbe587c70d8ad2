"""Token ids of documents in binary files: blocks of ids cut into planes, each compressed on its own, with a chunk index.

File: magic, then the compressed planes of each block of ``BLOCK_IDS`` ids (uint32; byte planes, or bit planes), then the
compressed document table (doc_id, validity, number of ids), then a JSON index (planes' offsets and lengths by block), the
index's offset as uint64, and the magic again. Small ids leave the high planes constant, which zstandard reduces to a few
bytes. A reader needs one block at a time; a document may span blocks.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import cut, filesystem, publish, shared_dir
from .bytebpe import default_path, encoder

MAGIC, BLOCK_IDS, END_ID = b"TKPLANE1", 1 << 16, 0
#: Texts that are encoded together.
ENCODE_ROWS = 8192


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """uint32 ids -> 4 byte planes or 32 bit planes, the lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], 1).reshape(-1).view("<u4")
    each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], 1)
    return np.packbits(each, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_file(out, documents: Iterator[tuple[int | None, bytes]], bits: bool = False, level: int = 3) -> tuple[int, int]:
    """Writes (doc_id, ids as uint32 bytes) in the order given; returns the numbers of documents and ids."""
    pack, blocks, table, buffer, at, total = zstandard.ZstdCompressor(level=level), [], [], bytearray(), len(MAGIC), 0
    out.write(MAGIC)

    def flush(n_bytes: int) -> None:
        nonlocal at
        ids, spans = np.frombuffer(bytes(buffer[:n_bytes]), "<u4"), []
        del buffer[:n_bytes]
        for plane in to_planes(ids, bits):
            z = pack.compress(plane)
            out.write(z)
            spans.append([at, len(z)])
            at += len(z)
        blocks.append([len(ids), spans])

    for doc_id, ids in documents:
        table.append((doc_id or 0, doc_id is not None, len(ids) // 4))
        total += len(ids) // 4
        view = memoryview(ids)
        while len(view):
            take = min(len(view), 4 * BLOCK_IDS - len(buffer))
            buffer += view[:take]
            view = view[take:]
            if len(buffer) == 4 * BLOCK_IDS:
                flush(len(buffer))
    if buffer:
        flush(len(buffer))
    cols = [np.array([t[k] for t in table], kind) for k, kind in enumerate(("<i8", "<u1", "<i8"))]
    z = pack.compress(b"".join(c.tobytes() for c in cols))
    out.write(z)
    index = json.dumps({"documents": [at, len(z), len(table)], "blocks": blocks}).encode()
    out.write(index + struct.pack("<Q", at + len(z)) + MAGIC)
    return len(table), total


class Reader:
    """Random access to a file of ``write_file``; ``handle`` is seekable."""

    def __init__(self, handle) -> None:
        self.handle, self.unpack = handle, zstandard.ZstdDecompressor()
        handle.seek(0, 2)
        size = handle.tell()
        at, magic = struct.unpack("<Q8s", self._at(size - 16, 16))
        if magic != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a token plane file")
        index = json.loads(self._at(at, size - 16 - at))
        self.blocks = index["blocks"]
        start, length, n = index["documents"]
        raw = self.unpack.decompress(self._at(start, length)) if n else b""
        self.doc_ids, self.valid, self.lengths = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u1", n, 8 * n), np.frombuffer(raw, "<i8", n, 9 * n)

    def _at(self, start: int, length: int) -> bytes:
        self.handle.seek(start)
        return self.handle.read(length)

    def block(self, k: int) -> np.ndarray:
        n, spans = self.blocks[k]
        return from_planes([self.unpack.decompress(self._at(s, length)) for s, length in spans], n)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc_id, number of ids, pieces of its ids); the pieces must be used before the next document."""
        k, ids, at = 0, np.empty(0, "<u4"), 0

        def pieces(left: int) -> Iterator[np.ndarray]:
            nonlocal k, ids, at
            while left:
                if at == len(ids):
                    ids, at, k = self.block(k), 0, k + 1
                got = ids[at : at + left]
                at += len(got)
                left -= len(got)
                yield got

        for doc_id, valid, n in zip(self.doc_ids.tolist(), self.valid.tolist(), self.lengths.tolist(), strict=True):
            yield (doc_id if valid else None), n, pieces(n)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, bits: bool) -> Iterator[pa.RecordBatch]:
    import uuid

    end, first = struct.pack("<I", END_ID), []

    def documents():
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                ids, counts = encoder(path).encode_column(part.column(1))
                ids = ids.astype("<u4", copy=False)
                for doc_id, got in zip(part.column(0).to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    if not first:
                        first.append(doc_id)
                    yield doc_id, got.tobytes() + end

    url, size = f"{folder}/{uuid.uuid4().hex}.tok", (0, 0)

    def put(out) -> None:
        nonlocal size
        size = write_file(out, documents(), bits)

    publish(url, put)
    if size[0]:  # else the empty file is not listed
        yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array(first, pa.int64()), pa.array([size[0]], pa.int64()), pa.array([size[1]], pa.int64())], ["url", "first_id", "n_docs", "n_ids"])


def write_tokens(docs: DataFrame, tokenizer_path: str | None = None, bits: bool = False) -> DataFrame:
    """Encodes every whole text, adds the end id, and writes files that together hold the documents in ascending doc_id.

    Returns the manifest (url, first_id, n_docs, n_ids, start), start being the number of ids in all files before. Null text is
    empty; null doc_ids come first; repeated doc_ids are ordered by text. An empty table gives an empty manifest. Files go to
    the shared folder under attempt-only names; only those of tasks that ended well are listed.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    work = partial(_write, folder=shared_dir(spark, "tokens"), path=tokenizer_path or default_path(), bits=bits)
    manifest = cut(placed.mapInArrow(work, "url string, first_id long, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for url, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, path = filesystem(url)
            with fs.open_input_file(path) as handle:
                rows = []
                for doc_id, n, pieces in Reader(handle).documents():
                    crc = 0
                    for ids in pieces:
                        crc = zlib.crc32(ids.tobytes(), crc)
                    rows.append((doc_id, start, n, crc))
                    start += n
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("url", "start").repartition(n, "url").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of ``docs`` (doc_id, text), read back from the files written.

    Null and empty texts are the end id alone; a text is encoded whole, however long, and may span blocks; null doc_ids come first,
    rows of one doc_id by their text, equal rows each have their place; other columns are ignored; an empty table gives an
    empty result.
    """
    return read_tokens(write_tokens(docs, tokenizer_path))
