"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

No link ever reaches the driver: each step is a grouped minimum (combined map-side) and a join on the node, and its edges are
written to the shared folder. Nodes with very many links would make one join key hot, so the minima of those nodes alone are
broadcast: a node is hot beyond ``2 * links / HOT_NODES`` links, so there are at most HOT_NODES of them however large the input is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut_path, remove

_EDGE = "a long, b long"
FOREST_NODES = 200_000
#: Most nodes whose minimum is broadcast, and links below which a node is never hot.
HOT_NODES, LEAST_HOT = 20_000, 500


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of stars (node, smallest node of its class) of the pairs."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], ["a", "b"])


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a partition, by blocks of about FOREST_NODES edges, by spanning forests of stars."""
    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(held) > FOREST_NODES:
            yield edge_batch(forest(held))
            held = []
    yield edge_batch(forest(held))


def _with_least(pairs: DataFrame, n_links: int) -> DataFrame:
    """``pairs`` with m, the smallest b of each a."""
    limit = max(LEAST_HOT, 2 * n_links // HOT_NODES)
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links"))
    hot = F.broadcast(least.where(F.col("links") > limit).select("a", F.col("m").alias("hot_m")))
    tagged = pairs.join(hot, "a", "left")
    cold = tagged.where("hot_m IS NULL").select("a", "b").join(least.where(F.col("links") <= limit).select("a", "m"), "a")
    return tagged.where("hot_m IS NOT NULL").select("a", "b", F.col("hot_m").alias("m")).union(cold.select("a", "b", "m"))


def _large_star(edges: DataFrame, n_links: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * n_links).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n_links: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _with_least(down, n_links).select("a", "b", "m")
    return moved.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links between long ids -> (node, component): the smallest id reachable, for every node that has a link.

    Self links and repeated links are ignored, nulls are dropped, an empty table gives an empty result. Ids without a link are
    not listed (they are their own component).
    """
    spark = edges.sparkSession
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now, path = cut_path(clean.distinct().mapInArrow(local_forest, _EDGE), "edges")
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(seen)
        nxt, new = cut_path(_small_star(_large_star(now, seen[0]), seen[0]), "edges")
        remove(spark, path)
        now, path = nxt, new
    raise RuntimeError("connected components did not settle")
