"""Exact top-k by term-at-a-time accumulation.

Candidates are read in blocks. A block is turned into postings per term (a component's index): the rows that have a weight for
it, and the weights. The sparse rows of the queries then scatter their weighted postings into dense score arrays, term by term;
a partition selection keeps the k best of each query, which are merged block by block and at last over all partitions.

The query set is stated, not all pairs. It is written to the shared folder in files of a bounded size; a task reads them one after
the other for every block of candidates that it holds, so neither side is ever gathered whole, and nothing of it passes the
driver. A block of candidates returns k rows per query.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import cut, cut_path, filesystem, publish, shared_dir

#: Bytes of a file of queries, and of candidates that a task holds; queries and candidates that meet in one score array.
FILE_BYTES, HELD_BYTES, QUERY_ROWS, BLOCK_ROWS = 32 << 20, 64 << 20, 128, 2048
_OUT = "file int, query int, query_id long, vec_id long, score long"


def quantise(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) in double precision; an object array where int64 could overflow later."""
    got = np.floor(256.0 * values.astype(np.float64))
    if got.size and np.abs(got).max() >= 2.0**24:
        return np.array([int(v) for v in got.ravel()], object).reshape(got.shape)
    return got.astype(np.int64)


def rows_of(column: pa.Array) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros, which have no postings."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = quantise(column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), flat.dtype)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [np.empty(0, int)]).astype(int)] = flat
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores (query x candidate), one term after the other."""
    exact = object if object in (queries.dtype, candidates.dtype) else np.int64
    scores = np.zeros((len(queries), len(candidates)), exact)
    spare = np.empty_like(scores)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        has, posting = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        if not len(has) or not len(posting):
            continue
        if len(has) == len(queries) and len(posting) == len(candidates):
            scores += np.multiply.outer(queries[:, term], candidates[:, term], out=spare)
        else:
            scores[np.ix_(has, posting)] += np.multiply.outer(queries[has, term], candidates[posting, term])
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best per row, ties to the smaller id; a candidate with the query's own id is left out.
    The ids ascend."""
    n = len(ids)
    if scores.dtype == object or (scores.size and int(np.abs(scores).max()) >= 2**62 // max(n, 1)):
        out = []
        for q in range(len(scores)):
            keep = [j for j in range(n) if ids[j] != own[q]]
            out += [(q, int(ids[j]), int(scores[q, j])) for j in sorted(keep, key=lambda j, q=q: (-scores[q, j], ids[j]))[:k]]
        return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64), np.array([x[2] for x in out], object)
    rank = scores * n + np.arange(n - 1, -1, -1)  # distinct: score first, then the smaller id
    least = np.iinfo(np.int64).min
    first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    for q in np.flatnonzero(last > first):
        rank[q, first[q] : last[q]] = least
    top = np.argpartition(rank, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), rank.shape)
    rows = np.broadcast_to(np.arange(len(scores))[:, None], top.shape)
    ok = rank[rows, top] != least
    return rows[ok], ids[top[ok]], scores[rows[ok], top[ok]]


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best per query row of several selections; scores beyond 64 bits are shown at the limit from here on."""
    rows, ids, scores = (np.concatenate([p[c] for p in parts]) for c in range(3))
    if scores.dtype == object:
        order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], ids[i])), np.int64)
        scores = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in scores.tolist()], np.int64)
    else:
        order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.empty(0, int)
    place = np.arange(len(rows)) - np.repeat(heads, np.diff(np.append(heads, len(rows))))
    return rows[place < k], ids[place < k], scores[place < k]


def _store(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes vectors into files of about FILE_BYTES."""
    held: list[pa.RecordBatch] = []

    def put() -> pa.RecordBatch:
        table, url = pa.Table.from_batches(held), f"{folder}/{uuid.uuid4().hex}.parquet"
        publish(url, lambda out: pq.write_table(table, out))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([url])], ["url"])

    for batch in batches:
        step = max(1, int(FILE_BYTES * max(1, batch.num_rows) / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            if sum(b.get_total_buffer_size() if b.num_rows == batch.num_rows else b.nbytes for b in held) >= FILE_BYTES:
                yield put()
    if held:
        yield put()


def _read(url: str) -> pa.Table:
    fs, path = filesystem(url)
    with fs.open_input_file(path) as handle:
        return pq.read_table(handle)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of candidates: ids in ascending order, and vectors."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield _sorted(held)
            held, size = [], 0
    if size:
        yield _sorted(held)


def _sorted(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks().sort_by("vec_id").combine_chunks()
    return table.column(0).chunk(0).to_numpy(), rows_of(table.column(1).chunk(0))


def _scan(batches: Iterator[pa.RecordBatch], files: list[str], k: int) -> Iterator[pa.RecordBatch]:
    urls = sorted(u for f in files for u in _read(f).column("url").to_pylist())
    for ids, rows in _held(batches):
        for file, url in enumerate(urls):
            table = _read(url).combine_chunks()
            own, matrix = table.column(0).chunk(0).to_numpy(), rows_of(table.column(1).chunk(0))
            for q in range(0, len(own), QUERY_ROWS):
                asked, theirs = matrix[q : q + QUERY_ROWS], own[q : q + QUERY_ROWS]
                parts = [best(accumulate(asked, rows[at : at + BLOCK_ROWS]), ids[at : at + BLOCK_ROWS], theirs, k) for at in range(0, len(ids), BLOCK_ROWS)]
                at, vec, score = merged(parts, k)
                cols = [pa.array(np.full(len(at), file, np.int32)), pa.array((at + q).astype(np.int32)), pa.array(theirs[at]), pa.array(vec), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, ["file", "query", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates by integer inner product.

    Queries are the rows whose vec_id is divisible by ``every``. Rows with a null vec_id, and vectors that are null or hold null
    or non-finite components, take no part. Repeated rows are candidates each; a repeated query row is answered each time;
    candidates with the query's vec_id count as the query's own. Vectors of unequal length are compared over the shorter;
    scores beyond 64 bits are computed exactly and shown at the limit. Without candidates there are no rows.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    asked = whole.where(f"vec_id % {every} = 0")
    size = asked.agg(F.sum(F.size("embedding") * 8 + 16)).first()[0] or 0
    spread = asked.repartition(max(1, math.ceil(size / FILE_BYTES)))
    _, listed = cut_path(spread.mapInArrow(partial(_store, folder=shared_dir(spark, "queries")), "url string"), "query-files")
    files = spark.read.schema("url string").parquet(listed).inputFiles()  # names of the list's own files, one per FILE_BYTES of queries
    found = whole.mapInArrow(partial(_scan, files=files, k=k), _OUT)
    place = Window.partitionBy("file", "query").orderBy(F.desc("score"), "vec_id")
    ranked = cut(found, "partial").withColumn("rank", F.row_number().over(place).cast("int")).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
