"""Synthetic graphs and the reuse benchmark over them."""

from __future__ import annotations

import random
import statistics
import time

from ..model import FinancialModel


# The formulas of a segment, 1.05 times the last node and less 0.01 of the segment's input in turn.
def segmented(segments: int, depth: int, tree: bool = False) -> FinancialModel:
    """``segments`` inputs, each with a chain of ``depth`` nodes, summed into ``total`` flat or by a balanced tree."""
    m = FinancialModel("segments")
    ends = []
    for i in range(segments):
        source = f"seg{i}_in"
        m.input(source, 1_000_000.0 + (i if tree else 1000 * i))
        last = source
        for d in range(depth):
            m.define(f"seg{i}_{d}", f"{last} * 1.05" if d % 2 == 0 else f"{last} - {source} * 0.01")
            last = f"seg{i}_{d}"
        ends.append(last)
    level = 0
    while tree and len(ends) > 1:
        pairs = [ends[k : k + 2] for k in range(0, len(ends), 2)]
        for k, p in enumerate(pairs):
            m.define("total" if len(pairs) == 1 else f"sum{level}_{k}", " + ".join(p))
        ends, level = (["total"] if len(pairs) == 1 else [f"sum{level}_{k}" for k in range(len(pairs))]), level + 1
    if not tree:
        m.define("total", " + ".join(ends))
    return m.output("total")


def incremental_benchmark(segments: int, depth: int, turns: int, seed: int = 7) -> dict:
    """Turns that change one input each: nodes rebuilt against all nodes, and the median seconds of a first run, of a turn that reuses
    clean nodes, of one that rebuilds all, and of a repeat without a change."""
    m, rng = segmented(segments, depth), random.Random(seed)
    nodes, rebuilt, seconds = len(m.module.of_kind("computed")), 0, {"cold": [], "turn": [], "full": [], "warm": []}

    def run(kind: str) -> int:
        began = time.perf_counter()
        r = m.evaluate()
        assert r.values["total"] == r.values["total"]
        seconds[kind].append(time.perf_counter() - began)
        return len(r.recomputed)

    run("cold")
    for t in range(turns):
        m.set(f"seg{rng.randrange(segments)}_in", 1_000_000.0 + t)
        rebuilt += run("turn")
        assert run("warm") == 0
        m.invalidate_all()
        assert run("full") == nodes
    return {"nodes": nodes, "turns": turns, "recomputed": rebuilt, "full": nodes * turns} | {f"{k}_seconds": statistics.median(v) for k, v in seconds.items() if v}


def locality_benchmark(segments: int, depth: int, shares: tuple[float, ...] = (0.01, 0.1, 0.5, 1.0), seed: int = 7) -> list[dict]:
    """Nodes rebuilt and seconds when a share of the inputs changes at once, on a balanced tree."""
    m, rng, rows = segmented(segments, depth, tree=True), random.Random(seed), []
    m.evaluate()
    nodes = len(m.module.of_kind("computed"))
    for share in shares:
        chosen = rng.sample(range(segments), max(1, round(share * segments)))
        began = time.perf_counter()
        r = m.what_if({f"seg{i}_in": "+1%" for i in chosen})
        assert r.values["total"] > 0
        rows.append({"share": share, "nodes": nodes, "recomputed": len(r.recomputed), "seconds": time.perf_counter() - began})
    return rows


def batch_benchmark(sizes: tuple[int, ...] = (1_000, 100_000, 1_000_000), segments: int = 10, depth: int = 5) -> list[dict]:
    """Seconds to evaluate a sweep of one input over a graph, by number of scenarios; the totals are summed, not collected."""
    m, rows = segmented(segments, depth), []
    for n in sizes:
        began = time.perf_counter()
        m.sweep("seg0_in", 1e6, 2e6, n).frame.groupBy().sum("total").collect()
        rows.append({"scenarios": n, "seconds": time.perf_counter() - began})
    return rows
