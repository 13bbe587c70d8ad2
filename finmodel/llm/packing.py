"""Best-fit packing with conflicts.

Pieces of documents go into bins of a fixed capacity, the longest first. Bins are ordered by what they have left; a search
starts at the tightest bin that could hold the piece and goes on to the next ones until one is compatible: a bin carries bitmaps
of the sources and duplicate clusters in it, and takes a piece only if it has neither. If none is compatible a bin is opened.

Bins do not cross shards. A piece's shard is a hash of its doc_id, place, source and cluster, so the bins do not depend on files or
partitions, and no source or cluster makes a shard large. Rows without a doc_id cannot be told apart; they are dealt by position.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut, row_key
from .quality import BLANKS

#: Words of a bin, and pieces of a shard.
CAPACITY, SHARD_ROWS = 2048, 4096
_OUT = "doc_id long, piece long, start long, length long, shard long, bin long, bin_start long"


def pack(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, place in the bin) of each piece. Pieces are taken by falling length, then in the order given; null keys conflict with nothing."""
    names: tuple[dict, dict] = ({}, {})
    bits = [[0 if key is None else 1 << table.setdefault(key, len(table)) for key in keys] for table, keys in zip(names, (sources, clusters), strict=True)]
    left: list[tuple[int, int]] = []  # (room, bin), sorted
    held: list[list[int]] = []  # bitmaps by bin
    out: list[tuple[int, int]] = [(-1, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size, source, cluster = lengths[i], bits[0][i], bits[1][i]
        for at in range(bisect_left(left, (size, -1)), len(left)):
            room, b = left[at]
            if not (held[b][0] & source or held[b][1] & cluster):
                del left[at]
                break
        else:
            room, b = capacity, len(held)
            held.append([0, 0])
        out[i] = (b, capacity - room)
        held[b][0] |= source
        held[b][1] |= cluster
        if room > size:
            insort(left, (room - size, b))
    return out


def _packer(capacity: int):
    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "cluster", "source", "length")])
        got = pack(*(table.column(c).to_pylist() for c in ("length", "source", "cluster")), capacity)
        cols = {c: table.column(c) for c in ("doc_id", "piece", "start", "length", "shard")}
        return pa.table(cols | {"bin": pa.array([g[0] for g in got], pa.int64()), "bin_start": pa.array([g[1] for g in got], pa.int64())})

    return one


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, length in words, source, cluster) of whole texts; equal texts are a cluster."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blanked = text
    for c in BLANKS:
        blanked = F.replace(blanked, F.lit(c), F.lit(" "))
    words = F.size(F.array_remove(F.split(blanked, " "), "")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("length"), F.col("source").cast("string").alias("source"), F.when(text != "", F.xxhash64(text)).alias("cluster"))


def best_fit(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, shard, bin, bin_start) from (doc_id, length, source, cluster).

    A document longer than a bin is cut into full pieces and a rest, one row each, none dropped. Empty documents take no room and
    are placed too. Null lengths are 0; null sources and clusters conflict with nothing; repeated rows are packed each; an
    empty table gives an empty result.
    """
    rows = items.select("doc_id", F.coalesce(F.col("length"), F.lit(0)).alias("whole"), "source", "cluster")
    last = F.expr(f"greatest(0L, (whole - 1) div {capacity})")
    pieces = rows.select("doc_id", "whole", "source", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    spans = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).cast("long").alias("length"), "source", "cluster")
    table = cut(spans, "pieces")
    shards = max(1, math.ceil(table.count() / shard_rows))
    sharded = table.withColumn("shard", F.pmod(F.xxhash64(row_key(F.col("source"), F.col("cluster")), F.col("piece"), F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(shards)))
    return sharded.groupBy("shard").applyInArrow(_packer(capacity), _OUT)


def op8(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, shard, bin, bin_start) for every row of ``docs`` (doc_id, text, source), in words of whole texts.

    Null, empty and blank texts are a piece of length 0; a very long text is cut into full bins and a rest; equal texts are a
    cluster and never share a bin, nor do documents of one source; null sources conflict with nothing; repeated rows are packed
    each; ties of length go by doc_id; other columns are ignored; an empty table gives an empty result.
    """
    return best_fit(measured(docs))
