"""Graphs as columns: one ``selectExpr`` per level, so Catalyst sees a handful of projections and generates code for them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from .. import expr as X
from ..errors import ExecutionError
from ..functions.kernels import Registry
from ..functions.sql import Arg, NumericPolicy, lift, literal, quote
from ..graph import Graph
from ..types import FinType


def to_sql(e: X.Expr, types: dict[str, FinType], kernels: Registry, policy: NumericPolicy) -> Arg:
    """An expression over columns named like nodes, as SQL."""

    def one(node: X.Expr, kids: list[Arg]) -> Arg:
        if isinstance(node, X.Ref):
            return Arg(quote(node.name), types[node.name].is_series)
        if isinstance(node, X.Lit):
            return Arg(literal(node.value))
        if isinstance(node, X.Call):
            return kernels.call(node.func, kids, policy)
        if node.op == "/":
            return lift(kids, policy.divide)
        if node.op == "-" and node.left == X.Lit(0.0):
            return lift(kids[1:], lambda a: f"(-{a})")
        return lift(kids, lambda a, b: f"({a} {node.op} {b})")

    return X.fold(e, one)


def add_nodes(df: DataFrame, g: Graph, names: Iterable[str], types: dict[str, FinType], kernels: Registry, policy: NumericPolicy) -> DataFrame:
    """``df`` with a column for each computed node of ``names``; every other node that they need is a column already."""
    for level in g.levels(names):
        taken = [n for n in level if n in df.columns]
        if taken:
            raise ExecutionError(f"columns {taken} are in the input already")
        cols = [f"{policy.result(to_sql(g.nodes[n].expr, types, kernels, policy).sql)} AS {quote(n)}" for n in level]
        df = df.selectExpr("*", *cols)
    return df


def input_sql(g: Graph, values: dict, df: DataFrame, types: dict[str, FinType], names: Iterable[str]) -> list[str]:
    """Inputs and constants of ``names`` that are not columns of ``df`` yet, as literals; missing values are 0."""
    out = []
    for n in names:
        node = g.nodes[n]
        if node.kind == "computed" or (node.kind == "input" and n in df.columns):
            continue
        value = node.value if node.kind == "const" else values.get(n, node.value)
        empty = [] if types[n].is_series else 0.0
        out.append(f"{literal(empty if value is None else value)} AS {quote(n)}")
    return out


def clean_inputs(df: DataFrame, g: Graph, types: dict[str, FinType]) -> DataFrame:
    """Input columns as doubles without nulls; other columns as they are."""
    cols = []
    for c in df.columns:
        q = quote(c)
        if c in g.nodes and g.nodes[c].kind == "input":
            cols.append(f"coalesce(CAST({q} AS ARRAY<DOUBLE>), CAST(array() AS ARRAY<DOUBLE>)) AS {q}" if types[c].is_series else f"coalesce(CAST({q} AS DOUBLE), 0.0D) AS {q}")
        else:
            cols.append(q)
    return df.selectExpr(*cols)
