"""WARC archives: a writer of monolithic gzip files, their normaliser, and a reader by offset index.

The writer puts the records of an archive into a single gzip stream, as many tools do; such a file can only be read from its
start. The normaliser inflates that stream once, in pieces of fixed size, writes every record as a gzip member of its own and
puts a sidecar index of offsets beside it. The reader takes the index and reads members one by one.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut, filesystem, publish, remove, shared_dir

#: Bytes read at a time, bytes of records after which a new archive begins, and the least payload that is revisited.
PIECE, ROLL_BYTES, LEAST_REVISIT = 1 << 20, 64 << 20, 100
_GZIP = 31
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, only its digest and length."""
    http = _HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join(url.split()),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": _PROFILE}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
    row = next(rows, None)
    while row is not None:
        url, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0

        def put(out) -> None:
            nonlocal row, n
            pack, size = zlib.compressobj(6, zlib.DEFLATED, _GZIP), 0
            while row is not None and size < ROLL_BYTES:
                page, link, payload, digest, refers = row
                raw = record(page, link or "", payload or b"", digest, refers)
                out.write(pack.compress(raw))
                size, n, row = size + len(raw), n + 1, next(rows, None)
            out.write(pack.flush())

        publish(url, put)
        yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([n], pa.int64())], ["url", "n_records"])


def write_archives(pages: DataFrame) -> DataFrame:
    """(url, n_records) of monolithic archives that hold a record for every row of ``pages`` (page_id, url, html).

    Equal payloads of at least LEAST_REVISIT bytes are found by their SHA-256: only (digest, least page_id) of those that occur
    more than once is joined back, so one digest with very many pages is a grouped minimum and a splittable join.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    least = (
        rows.where(F.octet_length("payload") >= LEAST_REVISIT)
        .groupBy(F.col("digest").alias("d"))
        .agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
        .where("n > 1 AND least IS NOT NULL")
        .select("d", "least")
    )
    refers = F.when(F.col("page_id").eqNullSafe(F.col("least")), F.lit(None)).otherwise(F.col("least"))
    marked = rows.join(least, F.col("digest") == F.col("d"), "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return cut(marked.mapInArrow(partial(_write, folder=shared_dir(pages.sparkSession, "warc")), "url string, n_records long"), "archives")


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(head, pieces of the rest of the record with its end) from the pieces of a WARC stream; a record need not fit in memory."""
    buffer, at = b"", 0

    def more() -> bool:
        nonlocal buffer, at
        got = next(pieces, None)
        buffer, at = buffer[at:] + (got or b""), 0
        return got is not None

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("a WARC record is cut off")
                return
        head, at = buffer[at:end], end + 4
        left = int(parse_head(head)["content-length"]) + 4

        def body() -> Iterator[bytes]:
            nonlocal at, left
            while left:
                if at == len(buffer) and not more():
                    raise ValueError("a WARC record is cut off")
                part = buffer[at : at + left]
                at, left = at + len(part), left - len(part)
                yield part

        rest = body()
        yield head, rest
        for _ in rest:  # what the caller left
            pass


def inflate(handle) -> Iterator[bytes]:
    """Pieces of a gzip file of one or several members; an error if it is cut off, if only by its checksum."""
    unpack, empty = zlib.decompressobj(_GZIP), True
    while data := handle.read(PIECE):
        empty = False
        while data:
            if unpack.eof:
                unpack = zlib.decompressobj(_GZIP)
            got = unpack.decompress(data, PIECE)
            data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if got:
                yield got
    if not unpack.eof and (rest := unpack.flush()):
        yield rest
    if not empty and not unpack.eof:
        raise ValueError("a gzip file is cut off")


def normalise(handle, out) -> list[dict]:
    """Rewrites a WARC file with a gzip member per record; returns the index: offset, length, record id and type of each."""
    index, at = [], 0
    for head, rest in split_records(inflate(handle)):
        pack, start = zlib.compressobj(6, zlib.DEFLATED, _GZIP), at
        for part in itertools.chain((head, b"\r\n\r\n"), rest):
            at += out.write(pack.compress(part)) or 0
        at += out.write(pack.flush()) or 0
        names = parse_head(head)
        index.append({"offset": start, "length": at - start, "id": names.get("warc-record-id"), "type": names.get("warc-type")})
    return index


class _Counted:
    """A stream whose write returns the number of bytes."""

    def __init__(self, out) -> None:
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)


def _normalise(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for url in batch.column(0).to_pylist():
            target, index = f"{folder}/{uuid.uuid4().hex}", []
            fs, path = filesystem(url)
            with fs.open_input_stream(path, compression=None) as handle:
                publish(f"{target}.warc.gz", lambda out, handle=handle, index=index: index.extend(normalise(handle, _Counted(out))))
            publish(f"{target}.idx", lambda out, index=index: out.write("".join(json.dumps(e) + "\n" for e in index).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([f"{target}.warc.gz"]), pa.array([f"{target}.idx"]), pa.array([len(index)], pa.int64())], ["url", "index_url", "n_records"])


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(url, index_url, n_records): each archive with a member per record, and its index beside it."""
    spark = archives.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = partial(_normalise, folder=shared_dir(spark, "warc-members"))
    return cut(archives.select("url").repartition(n, "url").mapInArrow(work, "url string, index_url string, n_records long"), "members")


def read_record(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one record; a response's digest is computed, and checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    names = parse_head(head)
    block = rest[: int(names["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    said = names["warc-payload-digest"].removeprefix("sha256:")
    number = lambda name: int(v) if (v := names.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    if names["warc-type"] == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if digest != said or len(payload) != size:
            raise ValueError(f"the payload of {names['warc-record-id']} is damaged")
    return number("warc-record-id"), size, said, names["warc-type"], number("warc-refers-to")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    for batch in batches:
        for url, index_url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (fs, path), (fs2, path2) = filesystem(url), filesystem(index_url)
            with fs2.open_input_stream(path2, compression=None) as handle:
                entries = [json.loads(line) for line in handle.read().splitlines()]
            with fs.open_input_file(path) as handle:
                for at in range(0, len(entries), 2000):
                    rows = []
                    for e in entries[at : at + 2000]:
                        handle.seek(e["offset"])
                        rows.append(read_record(zlib.decompress(handle.read(e["length"]), _GZIP)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def read_archives(members: DataFrame) -> DataFrame:
    """A row per record, read member by member through the index."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return members.select("url", "index_url").repartition(n, "url").mapInArrow(_read, schema)


def op1(pages: DataFrame) -> DataFrame:
    """Writes, normalises and reads back a record per row of ``pages``.

    Null html is an empty payload, null urls are empty. Rows that repeat the response's page_id with its payload are responses
    too. A null page_id is kept and never referred to: if a payload has no other, all its records are responses. Other columns
    are ignored; an empty table gives no archive and no rows. A payload is held whole by one task, a record of an archive is not.
    """
    archives = write_archives(pages)
    members, first = normalise_archives(archives), archives.first()
    if first is not None:  # the monolithic files are not read again
        remove(pages.sparkSession, first["url"].rpartition("/")[0])
    return read_archives(members)


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS least FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to FROM m
"""
