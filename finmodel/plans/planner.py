"""Which way a graph is evaluated.

``columns`` is the default: generated code over all rows. ``arrow`` runs the graph over NumPy batches (``mapInPandas``); it is
for graphs that call Python kernels, or so large or deep that generated code stops paying. A model without bound rows is one row that
the driver knows: its plain numbers are computed there, without a job (``Batches.row``). Users add strategies of their own:
a subclass of ``Strategy`` decides how nodes become columns, one of ``Batches`` only how arrays are prepared, combined and handed back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import expr as X
from ..errors import BackendError
from ..functions.kernels import Registry, default_registry
from ..functions.sql import NumericPolicy
from ..graph import Graph
from ..types import FinType
from . import columns

MAX_COLUMN_NODES, MAX_COLUMN_DEPTH = 5_000, 400


@dataclass(frozen=True)
class WorkloadProfile:
    scenario_size: int = 1
    node_count: int = 0
    has_python_kernels: bool = False
    expression_depth: int = 0


@dataclass(frozen=True)
class Choice:
    name: str
    rationale: str


class Strategy:
    """A way to add computed nodes to rows; ``name`` tells strategies apart."""

    name = ""

    def add_nodes(self, df: DataFrame, g: Graph, names: Iterable[str], types: dict[str, FinType], kernels: Registry, policy: NumericPolicy) -> DataFrame:
        """``df`` with a column for each computed node of ``names``; every other node that they need is a column already."""
        raise NotImplementedError


class Columns(Strategy):
    """Generated code: one projection per level of the graph."""

    name = "columns"

    def add_nodes(self, df, g, names, types, kernels, policy):
        return columns.add_nodes(df, g, names, types, kernels, policy)


class Planner:
    """The strategies by name, and which one suits a graph."""

    def __init__(self, *strategies: Strategy) -> None:
        self._strategies: dict[str, Strategy] = {}
        for s in (Columns(), Batches(), *strategies):
            self.register(s)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self._strategies)

    def register(self, strategy: Strategy, overwrite: bool = False) -> Strategy:
        if not isinstance(strategy, Strategy) or not strategy.name:
            raise BackendError("a strategy is an instance of Strategy with a name")
        if strategy.name in self._strategies and not overwrite:
            raise BackendError(f"strategy {strategy.name!r} exists already")
        self._strategies[strategy.name] = strategy
        return strategy

    def get(self, strategy: str | Strategy) -> Strategy:
        """The strategy of a name; a strategy itself is taken as it is."""
        if isinstance(strategy, Strategy):
            return strategy
        if strategy not in self._strategies:
            raise BackendError(f"unknown strategy {strategy!r}; there are {', '.join(self.names)}")
        return self._strategies[strategy]

    def choose(self, p: WorkloadProfile) -> Choice:
        if p.has_python_kernels:
            return Choice("arrow", "a kernel is a Python function")
        if p.node_count > MAX_COLUMN_NODES:
            return Choice("arrow", f"{p.node_count} nodes are more than {MAX_COLUMN_NODES}")
        if p.expression_depth > MAX_COLUMN_DEPTH:
            return Choice("arrow", f"an expression of depth {p.expression_depth} is deeper than {MAX_COLUMN_DEPTH}")
        return Choice("columns", "generated code over rows")


def uses_python(g: Graph, names, kernels: Registry) -> bool:
    found = []
    for n in names:
        if g.nodes[n].kind == "computed":
            X.fold(g.nodes[n].expr, lambda e, _: found.append(kernels.get(e.func).python is not None) if isinstance(e, X.Call) else None)
    return any(found)


def depth(g: Graph, names) -> int:
    return max((X.fold(g.nodes[n].expr, lambda _, kids: 1 + max(kids, default=0)) for n in names if g.nodes[n].kind == "computed"), default=0)


def batchable(g: Graph, names, types: dict[str, FinType], kernels: Registry) -> bool:
    """Whether the nodes are plain numbers of plain numbers, by operators and built-in kernels that have a batch form."""
    table, built_in = _numpy_kernels(NumericPolicy()), default_registry()

    def one(e, kids) -> bool:
        if isinstance(e, X.Ref):
            return types[e.name].inner is None
        return all(kids) and (not isinstance(e, X.Call) or (e.func in table and kernels.get(e.func) is built_in.get(e.func)))

    return all(X.fold(g.nodes[n].expr, one) for n in names if g.nodes[n].kind == "computed")


#: Element-wise built-ins over NumPy, for graphs that mix them with Python kernels.
def _numpy_kernels(policy: NumericPolicy) -> dict:
    import numpy as np

    def div(a, b):
        a, b = np.asarray(a, float), np.asarray(b, float)
        if policy.on_div_zero == "raise" and np.any(b == 0):
            raise ZeroDivisionError("division by zero")
        with np.errstate(all="ignore"):
            return np.where(b == 0, np.nan if policy.on_div_zero == "nan" else 0.0, a / np.where(b == 0, 1.0, b))

    minus = lambda a, b: a - b
    table = {name: div for name in ("divide", "ratio", "gross_margin", "ebitda_margin", "operating_margin")}
    table |= {name: minus for name in ("subtract", "gross_profit", "ebitda", "working_capital_change")}
    table |= {name: (lambda a, d: a * (d / 365.0)) for name in ("receivables", "payables")}
    table |= {name: (lambda a, b, c: a + b - c) for name in ("cash_conversion_cycle", "working_capital")}
    return table | {
        "add": lambda a, b: a + b, "multiply": lambda a, b: a * b, "percentage_change": lambda a, b: div(b - a, a), "growth": lambda a, r: a * (1.0 + r),
        "compound": lambda a, r, n: a * np.power(1.0 + r, n), "discount": lambda a, r, n: div(a, np.power(1.0 + r, n)), "free_cash_flow": lambda e, c, t, w: e - c - t - w,
        "break_even": lambda f, p, v: div(f, p - v), "inventory_days": lambda i, c: div(i, c) * 365.0, "__div__": div,
    }


class Batches(Strategy):
    """Scalar nodes over Arrow batches of rows. Subclasses may change any of the four steps; instances travel to the executors."""

    name = "arrow"

    def prepare(self, values):
        """A column's array before nodes see it."""
        return values

    def finalize(self, values):
        """A node's array before it becomes a column."""
        return values

    def binary(self, op: str, a, b, table: dict):
        if op == "/":
            return table["__div__"](a, b)
        return a + b if op == "+" else a - b if op == "-" else a * b

    def call_kernel(self, name: str, args: list, table: dict):
        """``table`` has the batch form of each kernel by name."""
        if name not in table:
            raise BackendError(f"kernel {name!r} has no batch form")
        return table[name](*args)

    def add_nodes(self, df, g, names, types, kernels, policy):
        wanted = set(names)
        exprs = [(n, g.nodes[n].expr) for n in g.topo_order() if n in wanted and g.nodes[n].kind == "computed"]
        user = {k: kernels.get(k).python for k in kernels.names() if kernels.get(k).python is not None}
        read = {r for _, e in exprs for r in X.free_refs(e)}.intersection(df.columns)
        schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n, _ in exprs)])

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pandas as pd

            table = _numpy_kernels(policy) | user
            for pdf in batches:
                env, out = {c: self.prepare(pdf[c].to_numpy()) for c in read}, {}

                def one(e, kids, env=env):
                    if isinstance(e, X.Ref):
                        return env[e.name]
                    if isinstance(e, X.Lit):
                        return e.value
                    return self.call_kernel(e.func, kids, table) if isinstance(e, X.Call) else self.binary(e.op, *kids, table)

                for n, e in exprs:
                    env[n] = X.fold(e, one)
                    out[n] = np.broadcast_to(np.asarray(self.finalize(env[n]), float), (len(pdf),))
                yield pd.concat([pdf, pd.DataFrame(out, index=pdf.index)], axis=1)

        return df.mapInPandas(run, schema)

    def row(self, g: Graph, order: list[str], env: dict[str, float], policy: NumericPolicy) -> dict[str, float]:
        """The nodes of ``order``, each after those it needs, for the one row whose other values are ``env``. No job runs."""
        import numpy as np

        nothing = float("nan") if policy.on_div_zero == "nan" else 0.0
        table, out = _numpy_kernels(policy) | {"__div__": lambda a, b: a / b if b else nothing}, {}

        def one(e, kids):
            if isinstance(e, X.Ref):
                return out[e.name] if e.name in out else env[e.name]
            if isinstance(e, X.Lit):
                return e.value
            if isinstance(e, X.Call):
                return self.call_kernel(e.func, kids, table)
            return -kids[1] if e.op == "-" and e.left == X.Lit(0.0) else self.binary(e.op, *kids, table)

        with np.errstate(all="ignore"):
            for n in order:
                out[n] = float(X.fold(g.nodes[n].expr, one))
        return out
