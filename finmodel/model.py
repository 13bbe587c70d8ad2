"""The front door: a typed model, evaluated for every row of a frame of entities, for scenarios and for batches.

Rows are entities x scenarios, columns are nodes. A change rebuilds only the columns that depend on it. A model of one row keeps the
values of its nodes on the driver, so clean nodes are literals in the next plan; a model bound to rows keeps them in the frame that
``cache_base`` persists, and a new input value makes only its cone stale there. ``recomputed`` lists what the plan builds, ``reused``
what it takes from there.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ExecutionError, TypeRuleError, ValidationError
from .expr import free_refs, parse_expr
from .functions.kernels import Registry, default_registry
from .functions.sql import NumericPolicy, literal, quote
from .graph import Graph, Node
from .operators.changes import linspace, parse_change, resolve_change, scenario_rows, scenario_sql
from .plans.columns import clean_inputs, input_sql
from .plans.planner import Batches, Planner, Strategy, WorkloadProfile, batchable, depth, uses_python
from .sources.files import beside, read_text, write_text
from .types import SCALAR, FinType, money, parse_type
from .types import series as series_type

SCENARIO, SCENARIO_ID = "scenario", "scenario_id"
DRIVER = "row"  #: how the one row of a model without bound rows is computed


def _literal(value: Any) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else literal(value)


@dataclass
class RunStats:
    backend: str = "columns"
    nodes_evaluated: int = 0
    nodes_reused: int = 0
    hit_ratio: float = 0.0
    scenario_size: int = 1


@dataclass
class Evaluation:
    """``frame`` has the key columns and the targets; ``recomputed`` and ``reused`` are computed nodes in topological order.

    Where the values are known already, ``source`` makes the frame when it is asked for."""

    source: DataFrame | Callable[[], DataFrame]
    targets: list[str]
    recomputed: list[str]
    reused: list[str]
    stats: RunStats
    batch: bool = False
    known: dict[str, Any] | None = None

    @property
    def frame(self) -> DataFrame:
        if callable(self.source):
            self.source = self.source()
        return self.source

    @property
    def values(self) -> dict[str, Any]:
        """The targets as Python values, for models of one row: floats, arrays for series, and arrays over a batch's scenarios."""
        if self.known is not None:
            return {t: np.array(v) if isinstance(v := self.known[t], list) else v for t in self.targets}
        df = self.frame.orderBy(SCENARIO_ID) if self.batch else self.frame.limit(2)
        table = df.select(*[quote(t) for t in self.targets]).toArrow()
        if not self.batch and table.num_rows != 1:
            raise ExecutionError("the model is evaluated on many rows; use .frame")
        out = {}
        for t in self.targets:
            cells = table.column(t).to_pylist()
            out[t] = np.array(cells) if self.batch else np.array(cells[0]) if isinstance(cells[0], list) else cells[0]
        return out

    def __getitem__(self, name: str) -> Any:
        return self.values[name]


@dataclass(frozen=True)
class ModelState:
    """Input values at one moment; changes give new states."""

    values: dict[str, Any] = field(default_factory=dict)
    changed: tuple[str, ...] = ()

    def with_change(self, name: str, *, relative: float | None = None, absolute: float | None = None, delta: float | None = None, spec: Any = None) -> ModelState:
        given = [s for s in (spec, None if relative is None else {"relative": relative}, None if absolute is None else {"absolute": absolute}, None if delta is None else {"delta": delta}) if s is not None]
        if len(given) != 1:
            raise ValueError("give exactly one of relative, absolute, delta, spec")
        return self.with_changes({name: given[0]})

    def with_changes(self, changes: dict[str, Any]) -> ModelState:
        new = {n: resolve_change(self.values.get(n), s) for n, s in changes.items()}
        return ModelState(self.values | new, tuple(changes))


class FinancialModel:
    def __init__(self, name: str = "model", *, kernels: Registry | None = None, policy: NumericPolicy | None = None, spark: SparkSession | None = None) -> None:
        self.module, self.kernels, self.policy = Graph(name), kernels or default_registry(), policy or NumericPolicy()
        self.planner, self.backend = Planner(), None
        self._spark, self._values, self._rows = spark, {}, None
        self._types: dict[str, FinType] | None = None
        self._row: dict[str, Any] = {}  # computed values of a model of one row
        self._kept: DataFrame | None = None  # computed columns of bound rows, those of _stale out of date
        self._stale: set[str] = set()
        self._hits = self._misses = 0

    # -- building
    def _typed(self, kind: FinType | str | None, currency: str | None) -> FinType:
        if kind is not None and currency is not None:
            raise TypeRuleError("give a type or a currency, not both")
        return money(currency) if currency is not None else parse_type(kind) if isinstance(kind, str) else kind or SCALAR

    def _changed(self) -> FinancialModel:
        """After a structural edit: values stay, everything derived goes."""
        self._types = None
        self._drop_base()
        return self

    def _drop_base(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
        self._kept = None
        self._row, self._stale = {}, set()

    def _valid(self) -> set[str]:
        """Computed nodes whose base values are kept and up to date."""
        return set(self._row) if self._rows is None else set() if self._kept is None else {n for n in self._kept.columns if n in self.module.nodes and n not in self._stale}

    def input(self, name: str, value: Any = None, *, currency: str | None = None, type: FinType | str | None = None) -> FinancialModel:
        self.module.add(Node(name, "input", self._typed(type, currency), float(value) if isinstance(value, (int, float)) else None))
        if value is not None:
            self._values[name] = value
        return self._changed()

    def input_series(self, name: str, values: Iterable[float], *, period: str = "month", currency: str | None = None) -> FinancialModel:
        self.module.add(Node(name, "input", series_type(self._typed(None, currency), period)))
        self._values[name] = [float(v) for v in values]
        return self._changed()

    def constant(self, name: str, value: float, *, type: FinType | str | None = None) -> FinancialModel:
        self.module.add(Node(name, "const", self._typed(type, None), float(value)))
        return self._changed()

    def define(self, name: str, expr: str, *, output: bool = False) -> FinancialModel:
        self.module.add(Node(name, "computed", None, None, parse_expr(expr)))
        if output:
            self.module.set_output(name)
        return self._changed()

    def output(self, *names: str) -> FinancialModel:
        for n in names:
            self.module.set_output(n)
        return self

    def bind(self, df: DataFrame) -> FinancialModel:
        """Evaluates on the rows of ``df`` from now on: its columns that are named like inputs are their values, the others are keys."""
        clash = [c for c in df.columns if c in self.module.nodes and self.module.nodes[c].kind != "input"]
        if clash:
            raise ValidationError(f"columns {clash} are named like nodes that are not inputs")
        self._rows, self._spark = df, df.sparkSession
        self._drop_base()
        return self

    def set(self, name: str, value: Any) -> FinancialModel:
        """A new input value; only what depends on it is rebuilt."""
        self._require_inputs([name])
        if self._rows is not None and name in self._rows.columns:
            raise ValidationError(f"{name!r} is a column of the bound rows")
        self._values[name] = value
        dirty = self.module.cone([name])
        self._row = {n: v for n, v in self._row.items() if n not in dirty}
        self._stale |= dirty
        return self

    def set_backend(self, strategy: str | Strategy | None) -> FinancialModel:
        """The strategy of later runs, by name or a strategy of the user's; None leaves it to the planner. Kept values go, since
        another strategy may compute others."""
        self.backend = None if strategy is None else self.planner.get(strategy)
        self._drop_base()
        return self

    @classmethod
    def from_ir(cls, g: Graph, **options: Any) -> FinancialModel:
        m = cls(g.name, **options)
        m.module = g
        m._values = {n.name: n.value for n in g.of_kind("input") if n.value is not None}
        return m

    def _require_inputs(self, names: Iterable[str]) -> None:
        wrong = [n for n in names if n not in self.module.nodes or self.module.nodes[n].kind != "input"]
        if wrong:
            raise ValidationError(f"{wrong} are not inputs of the model")

    # -- graph queries
    def types(self) -> dict[str, FinType]:
        if self._types is None:
            self.module.validate()
            self._types = self.module.infer_types(self.kernels.result_type)
        return self._types

    def dirty_nodes(self, *changed: str) -> list[str]:
        return sorted(self.module.cone(changed))

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.builder.getOrCreate()
        return self._spark

    # -- evaluation
    def _build(self, df: DataFrame, names: set[str], backend: str | Strategy | None) -> tuple[DataFrame, str]:
        """``df`` with the computed nodes of ``names``, by the strategy that is asked for or suits them."""
        asked = backend or self.backend
        if asked is None:
            python = uses_python(self.module, names, self.kernels)
            size, deep = len(names), depth(self.module, names)
            if not python and self.planner.choose(WorkloadProfile(1, size, False, deep)).name != "columns" and not batchable(self.module, names, self.types(), self.kernels):
                size = deep = 0  # series and folds only have columns
            asked = self.planner.choose(WorkloadProfile(1, size, python, deep)).name
        strategy = self.planner.get(asked)
        return strategy.add_nodes(df, self.module, names, self.types(), self.kernels, self.policy), strategy.name

    def _start(self, needed: set[str]) -> DataFrame:
        """The rows with the inputs and constants of ``needed``."""
        types = self.types()
        df = self.spark.range(1).select() if self._rows is None else clean_inputs(self._rows, self.module, types)
        extra = input_sql(self.module, self._values, df, types, [n for n in self.module.nodes if n in needed])
        return df.selectExpr("*", *extra) if df.columns else self.spark.range(1).selectExpr(*(extra or ["id AS __row"]))

    def _base_frame(self, needed: set[str], wanted: Iterable[str], skip: set[str] = frozenset(), backend: str | Strategy | None = None) -> tuple[DataFrame, set[str], str]:
        """The rows with ``wanted`` and all that they and nodes of ``skip`` need, the nodes built for that, and the strategy. What is kept
        is not built; computed nodes of ``skip`` are left out."""
        computed = {n for n in needed if self.module.nodes[n].kind == "computed"} - skip
        valid = self._valid() & computed
        rebuilt = computed - valid
        used = set(wanted) | {r for n in rebuilt | (skip & needed) if self.module.nodes[n].expr is not None for r in free_refs(self.module.nodes[n].expr)}
        if self._rows is None:
            plain = input_sql(self.module, self._values, self.spark.range(1), self.types(), [n for n in self.module.nodes if n in needed & used])
            held = [f"{_literal(self._row[n])} AS {quote(n)}" for n in self.module.nodes if n in valid & used]
            df = self.spark.range(1).selectExpr(*([*plain, *held] or ["id AS __row"]))
        elif self._kept is not None:
            keep = [c for c in self._kept.columns if c not in self.module.nodes or (c in needed and c not in self._stale and c not in skip) or c in self._rows.columns]
            df = self._kept.selectExpr(*map(quote, keep))
            df = df.selectExpr("*", *input_sql(self.module, self._values, df, self.types(), [n for n in self.module.nodes if n in needed and n not in keep]))
        else:
            df = self._start(needed)
        df, name = self._build(df, rebuilt, backend)
        return df, rebuilt, name

    def cache_base(self, targets: list[str] | None = None) -> FinancialModel:
        """Keeps the base values of the targets and all they need; later runs read the unaffected columns from there."""
        if self._rows is None:
            self.evaluate(targets)
            return self
        needed = self.module.closure(self.module.targets(targets))
        self._drop_base()
        df, _, _ = self._base_frame(needed, needed)
        self._kept = df.persist()
        return self

    def _keys(self) -> list[str]:
        return [] if self._rows is None else [c for c in self._rows.columns if c not in self.module.nodes]

    def _select(self, df: DataFrame, targets: list[str], keys: list[str]) -> DataFrame:
        types = self.types()
        return df.select(*[F.col(quote(k)) for k in keys], *[F.col(quote(t)).alias(t, metadata=types[t].metadata()) for t in targets])

    def _computed(self, needed: set[str]) -> list[str]:
        return [n for n in self.module.topo_order() if n in needed and self.module.nodes[n].kind == "computed"]

    def _account(self, recomputed: list[str], reused: list[str], backend: str, size: int = 1) -> RunStats:
        self._hits += len(reused)
        self._misses += len(recomputed)
        return RunStats(backend, len(recomputed), len(reused), self._hits / max(1, self._hits + self._misses), size)

    def evaluate(self, targets: list[str] | None = None, *, backend: str | Strategy | None = None) -> Evaluation:
        wanted = self.module.targets(targets)
        self.types()
        needed = self.module.closure(wanted)
        order = self._computed(needed)
        if self._rows is None:  # one row: its values are computed once and kept
            recomputed = [n for n in order if n not in self._row]
            if self._on_driver(recomputed, backend):
                self._row |= Batches().row(self.module, recomputed, self._known_row(recomputed, {}), self.policy)
                name = DRIVER
            else:
                df, _, name = self._base_frame(needed, recomputed, backend=backend)
                if recomputed:
                    row = df.select(*[F.col(quote(n)) for n in recomputed]).toArrow()
                    self._row |= {n: row.column(k)[0].as_py() for k, n in enumerate(recomputed)}
            fresh = set(recomputed)
            reused = [n for n in order if n not in fresh]
            known = {n: self._row[n] if n in self._row else self._plain(n) for n in wanted}
            return Evaluation(self._literal_frame(known), wanted, recomputed, reused, self._account(recomputed, reused, name), known=known)
        df, rebuilt, name = self._base_frame(needed, wanted, backend=backend)
        recomputed, reused = [n for n in order if n in rebuilt], [n for n in order if n not in rebuilt]
        return Evaluation(self._select(df, wanted, self._keys()), wanted, recomputed, reused, self._account(recomputed, reused, name))

    def _on_driver(self, names: Iterable[str], backend: str | Strategy | None) -> bool:
        """Whether the one row of a model without bound rows needs no job: no strategy is asked for, the nodes are plain numbers, and
        the policy raises no errors (those are Spark's)."""
        calm = self.policy.on_div_zero != "raise" and self.policy.on_nonfinite == "ignore"
        return self._rows is None and backend is None and self.backend is None and calm and batchable(self.module, names, self.types(), self.kernels)

    def _known_row(self, names: Iterable[str], override: dict[str, float]) -> dict[str, float]:
        """Base values, with overrides, of all that the nodes refer to and that is not among them."""
        own, env = set(names), {}
        for n in own:
            for r in self.module.dependencies(n):
                if r not in own and r not in env:
                    env[r] = override[r] if r in override else self._row[r] if r in self._row else self._plain(r)
        return env

    def _literal_frame(self, known: dict[str, Any]) -> Callable[[], DataFrame]:
        """The one row of known values, as a plan that is made when it is asked for."""

        def make() -> DataFrame:
            one = self.spark.range(1)
            return self._select(one.selectExpr(*[f"{_literal(v)} AS {quote(n)}" for n, v in known.items()]) if known else one, list(known), [])

        return make

    def _one_row(self, override: dict[str, float], wanted: list[str]) -> Evaluation | None:
        """The targets of a model of one row with some inputs overridden, without a job; None where that is not possible."""
        needed, dirty = self.module.closure(wanted), self.module.cone(override)
        order = self._computed(needed)
        changed = [n for n in order if n in dirty]
        missing = [n for n in order if n not in dirty and n not in self._row]
        if not all(isinstance(v, float) for v in override.values()) or not self._on_driver([*changed, *missing], None):
            return None
        self._row |= Batches().row(self.module, missing, self._known_row(missing, {}), self.policy)
        got = override | Batches().row(self.module, changed, self._known_row(changed, override), self.policy)
        known = {n: got[n] if n in got else self._row[n] if n in self._row else self._plain(n) for n in wanted}
        again = set(missing)
        recomputed, reused = [n for n in order if n in dirty or n in again], [n for n in order if n not in dirty and n not in again]
        return Evaluation(self._literal_frame(known), wanted, recomputed, reused, self._account(recomputed, reused, DRIVER), known=known)

    def _plain(self, name: str) -> Any:
        """The value of an input or constant, as plans see it."""
        node = self.module.nodes[name]
        value = node.value if node.kind == "const" else self.input_value(name)
        if self.types()[name].is_series:
            return [float(x) for x in value or []]
        return 0.0 if value is None else float(value)

    def _scenario(self, rows: DataFrame | None, override: dict[str, str], wanted: list[str], keys: list[str], backend: str | Strategy | None) -> tuple[DataFrame, list[str], list[str], str]:
        """The targets with overridden inputs: SQL over the base columns and those of ``rows``, the scenarios, if there are any.

        What no override touches is built once per entity, before scenarios multiply the rows; all overrides are one projection
        over base values; then only their cone is built.
        """
        needed, dirty = self.module.closure(wanted), self.module.cone(override)
        order = self._computed(needed)
        rebuilt = {n for n in order if n in dirty}
        base, built, _ = self._base_frame(needed | set(override), [*wanted, *override], dirty - set(override), backend)
        if rows is not None:
            # one side is the model's own single row, or the scenarios are few stated rows (marked by the caller)
            base = rows.crossJoin(F.broadcast(base)) if self._rows is None else base.crossJoin(rows)
        changed = [n for n in override if n in needed]
        stale = rebuilt | set(changed)
        keep = [quote(c) for c in base.columns if c not in stale and (c in needed or c not in self.module.nodes)]
        df = base.selectExpr(*keep, *[f"{override[n]} AS {quote(n)}" for n in changed])
        df, name = self._build(df, rebuilt, backend)
        recomputed = [n for n in order if n in rebuilt or n in built]
        reused = [n for n in order if n not in rebuilt and n not in built]
        return self._select(df, wanted, keys), recomputed, reused, name

    def _ensure_base(self) -> None:
        """Base values of the outputs of a model of one row, so that changes can be compared with them. Bound rows are not read."""
        valid = self._valid()
        if self._rows is None and any(n not in valid for n in self._computed(self.module.closure(self.module.targets()))):
            self.evaluate()

    def what_if(self, changes: dict[str, Any] | None = None, *, targets: list[str] | None = None, backend: str | Strategy | None = None, **more: Any) -> Evaluation:
        specs = {n: parse_change(s) for n, s in {**(changes or {}), **more}.items()}
        self._require_inputs(specs)
        self._ensure_base()
        if not specs:
            return self.evaluate(targets, backend=backend)
        wanted = self.module.targets(targets)
        if backend is None and self._rows is None and not any(self.types()[n].is_series for n in specs):
            if (got := self._one_row({n: float(c.apply(self._plain(n))) for n, c in specs.items()}, wanted)) is not None:
                return got
        override = {n: c.sql(quote(n)) for n, c in specs.items()}
        frame, recomputed, reused, name = self._scenario(None, override, wanted, self._keys(), backend)
        return Evaluation(frame, wanted, recomputed, reused, self._account(recomputed, reused, name))

    def scenario_frame(self, spec: dict[str, dict[str, Any]], targets: list[str] | None = None) -> DataFrame:
        """All named scenarios of all rows in one plan: (scenario, keys..., targets...). The scenarios are a few literal rows."""
        self._require_inputs({n for changes in spec.values() for n in changes})
        wanted = self.module.targets(targets)
        rows, inputs = scenario_rows(self.spark, spec)
        few = F.broadcast(rows)  # as many rows as labels were written
        return self._scenario(few, {n: scenario_sql(quote(n), k) for k, n in enumerate(inputs)}, wanted, [SCENARIO, *self._keys()], None)[0]

    def scenarios(self, spec: dict[str, dict[str, Any]]) -> dict[str, Evaluation]:
        """One result per label, each against the base, all from one frame."""
        frame = self.scenario_frame(spec)
        self._ensure_base()
        wanted, out = self.module.targets(), {}
        order = self._computed(self.module.closure(wanted))
        for label, changes in spec.items():
            dirty = self.module.cone(changes)
            recomputed, reused = [n for n in order if n in dirty], [n for n in order if n not in dirty]
            out[label] = Evaluation(frame.where(F.col(SCENARIO) == label).drop(SCENARIO), wanted, recomputed, reused, self._account(recomputed, reused, "columns"))
        return out

    def run_scenarios(self, arrays: dict[str, Any] | None = None, *, targets: list[str] | None = None, backend: str | Strategy | None = None, **more: Any) -> Evaluation:
        """A batch: the arrays are zipped by position, those of one value repeat; a row per position and entity."""
        given = {n: np.atleast_1d(np.asarray(v, float)).ravel() for n, v in {**(arrays or {}), **more}.items()}
        self._require_inputs(given)
        if not given:
            return self.evaluate(targets, backend=backend)
        size = max(len(v) for v in given.values())
        if any(len(v) not in (1, size) for v in given.values()):
            raise ExecutionError(f"arrays of unequal length: { {n: len(v) for n, v in given.items()} }")
        import pyarrow as pa

        columns = {SCENARIO_ID: pa.array(np.arange(size))} | {f"__new_{k}": pa.array(np.broadcast_to(v, (size,))) for k, v in enumerate(given.values())}
        return self.run_frame(self.spark.createDataFrame(pa.table(columns)), {n: f"__new_{k}" for k, n in enumerate(given)}, targets, backend, size)

    def run_frame(self, scenarios: DataFrame, columns: dict[str, str], targets: list[str] | None = None, backend: str | Strategy | None = None, size: int | None = None) -> Evaluation:
        """A batch whose scenarios are rows of a DataFrame (``scenario_id`` and a column per changed input), of any number."""
        self._require_inputs(columns)
        wanted = self.module.targets(targets)
        frame, recomputed, reused, name = self._scenario(scenarios, {n: quote(c) for n, c in columns.items()}, wanted, [SCENARIO_ID, *self._keys()], backend)
        return Evaluation(frame, wanted, recomputed, reused, self._account(recomputed, reused, name, size or 0), batch=True)

    def sweep(self, name: str, low: float, high: float, steps: int, targets: list[str] | None = None) -> Evaluation:
        """``steps`` values of one input from ``low`` to ``high``, made on the executors."""
        return self.run_frame(linspace(self.spark, low, high, steps, "__new_0", SCENARIO_ID), {name: "__new_0"}, targets, size=steps)

    # -- states and counters
    def input_value(self, name: str) -> Any:
        return self._values.get(name, self.module.nodes[name].value)

    def state(self) -> ModelState:
        return ModelState({n.name: self.input_value(n.name) for n in self.module.of_kind("input")})

    def evaluate_state(self, state: ModelState, targets: list[str] | None = None) -> Evaluation:
        """Overrides every input with the state's value, so everything downstream is rebuilt."""
        override = {n: literal(0.0 if v is None else v) for n, v in state.values.items()}
        self._require_inputs(override)
        self._ensure_base()
        wanted = self.module.targets(targets)
        plain = {n: 0.0 if v is None else v for n, v in state.values.items()}
        if self._rows is None and all(isinstance(v, (int, float)) for v in plain.values()) and (got := self._one_row({n: float(v) for n, v in plain.items()}, wanted)) is not None:
            return got
        frame, recomputed, reused, name = self._scenario(None, override, wanted, self._keys(), None)
        return Evaluation(frame, wanted, recomputed, reused, self._account(recomputed, reused, name))

    def cache_stats(self) -> dict[str, float]:
        n = self._hits + self._misses
        return {"hits": self._hits, "misses": self._misses, "hit_ratio": self._hits / n if n else 0.0}

    def reset_cache_stats(self) -> None:
        self._hits = self._misses = 0

    def invalidate_all(self) -> None:
        self._drop_base()

    # -- files and intents
    def save(self, path: str | os.PathLike, *, rows: bool = False) -> None:
        """The graph and the input values as JSON, on any file system that Spark reaches. With ``rows``, the bound rows as Parquet
        beside it, together with the columns that ``cache_base`` keeps and that are up to date: a loaded model reads those instead
        of building them. Each save writes rows of its own, so a model can be saved over the file that it came from.
        """
        path = os.fspath(path)
        values = {n: v if isinstance(v, (int, float)) else [float(x) for x in v] for n, v in self._values.items()}
        whole = {"module": self.module.to_json(), "values": values}
        if rows:
            if self._rows is None:
                raise ValidationError("no rows are bound")
            name = f"{os.path.basename(path)}.{uuid.uuid4().hex[:12]}.rows"
            given = self._rows.columns
            kept = self._rows if self._kept is None else self._kept.select(*[quote(c) for c in self._kept.columns if c in given or c not in self._stale])
            kept.write.parquet(beside(path, name))
            whole["rows"] = {"path": name, "columns": given}
        write_text(path, json.dumps(whole, indent=2))

    @classmethod
    def load(cls, path: str | os.PathLike, **options: Any) -> FinancialModel:
        path = os.fspath(path)
        obj = json.loads(read_text(path))
        m = cls.from_ir(Graph.from_json(obj["module"]), **options)
        m._values |= obj["values"]
        if saved := obj.get("rows"):
            df = m.spark.read.parquet(beside(path, saved["path"]))
            m.bind(df.select(*map(quote, saved["columns"])))
            if len(df.columns) > len(saved["columns"]):
                m._kept = df
        return m

    def apply_intent(self, payload: Any) -> Any:
        """Runs a validated request; a result, or a dict of results for named scenarios."""
        from .intents import execute

        return execute(self, payload)
