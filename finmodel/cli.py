"""Command line: version, run, compile, inspect, graph, benchmark, doctor."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__
from .errors import ModelError
from .functions.kernels import default_registry
from .model import FinancialModel
from .plans.passes import compile_module
from .plans.planner import Planner, WorkloadProfile
from .sources.files import read_model


def _plain(v):
    return v.tolist() if hasattr(v, "tolist") else v


def _run(a) -> None:
    model = FinancialModel.from_ir(read_model(a.file))
    for pair in a.set:
        name, eq, value = pair.partition("=")
        if not eq:
            raise ModelError(f"--set takes name=value, not {pair!r}")
        model.set(name.strip(), float(value))
    result = model.evaluate()
    values = {k: _plain(v) for k, v in result.values.items()}
    if a.json:
        print(json.dumps(values))
        return
    for k, v in values.items():
        print(f"{k:<30} {v}")
    print(f"strategy={result.stats.backend} recomputed={result.stats.nodes_evaluated} reused={result.stats.nodes_reused}")


def _compile(a) -> None:
    done = compile_module(read_model(a.file))
    print(f"{done.module.name}: compiled ({len(done.module.nodes)} nodes)")
    for p in done.report.passes if a.show_passes else ():
        print(f"{p:<34} {done.report.timings_ms[p]:8.3f} ms  {done.report.details[p]}")


def _inspect(a) -> None:
    g = read_model(a.file)
    types = g.infer_types(default_registry().result_type)
    for n in g.nodes.values():
        print(f"{n.name:<24} {n.kind:<9} {types[n.name].textual():<24} {', '.join(g.dependencies(n.name))}")
    n = len(g.of_kind("computed"))
    choice = Planner().choose(WorkloadProfile(1, n))
    print(f"outputs: {', '.join(g.outputs) or '(none)'}\ncomputed nodes: {n}\nstrategy: {choice.name} ({choice.rationale})")


def _graph(a) -> None:
    g = read_model(a.file)
    types = g.infer_types(default_registry().result_type)
    print(json.dumps(g.to_graph_json(types), indent=2) if a.format == "json" else g.to_dot(types))


def _benchmark(a) -> None:
    from .plans.synthetic import batch_benchmark, incremental_benchmark, locality_benchmark

    print(json.dumps({"turns": incremental_benchmark(a.segments, a.depth, a.turns), "locality": locality_benchmark(a.segments, a.depth), "batches": batch_benchmark()}))


def _doctor(a) -> None:
    import pyspark

    print(f"package {__version__}, pyspark {pyspark.__version__}, python {sys.version.split()[0]}, kernels {len(default_registry().names())}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="finmodel", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, fn, *files: [c := sub.add_parser(name), c.set_defaults(fn=fn), *[c.add_argument(f) for f in files]][0]
    add("version", lambda a: print(__version__))
    run = add("run", _run, "file")
    run.add_argument("--set", action="append", default=[])
    run.add_argument("--json", action="store_true")
    add("compile", _compile, "file").add_argument("--show-passes", action="store_true")
    add("inspect", _inspect, "file")
    add("graph", _graph, "file").add_argument("--format", choices=("dot", "json"), default="dot")
    bench = add("benchmark", _benchmark)
    for name, value in (("--segments", 10), ("--depth", 3), ("--turns", 5)):
        bench.add_argument(name, type=int, default=value)
    add("doctor", _doctor)
    a = p.parse_args(argv)
    try:
        a.fn(a)
    except (ModelError, OSError) as e:
        print(f"{getattr(e, 'code', 'error')}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
