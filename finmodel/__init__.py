"""Typed financial models on Spark: rows are entities and scenarios, columns are the nodes of a model."""

from .functions.kernels import Registry, default_registry, kernel
from .functions.sql import NumericPolicy
from .graph import Graph, parse
from .model import Evaluation, FinancialModel, ModelState
from .plans.passes import compile_module

__version__ = "0.1.0"


def compile_model(source: "Graph | FinancialModel | str", **options):
    """Runs the compiler passes on a graph, a model, or the text of one."""
    graph = parse(source) if isinstance(source, str) else source.module if isinstance(source, FinancialModel) else source
    return compile_module(graph, **options)


__all__ = ["Evaluation", "FinancialModel", "Graph", "ModelState", "NumericPolicy", "Registry", "compile_model", "compile_module", "default_registry", "kernel", "parse"]
