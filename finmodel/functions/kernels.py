"""The registry and its built-in kernels.

A kernel turns argument SQL into SQL. Element-wise kernels are written for one value and lifted over arrays; folds take a series
as one array. For long rows (entity, t, value) the same measures are grouped aggregates in ``operators.series``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..errors import KernelError
from ..types import DAYS, PERCENTAGE, RATIO, SCALAR, FinType, binary_result, money
from .sql import NAN, Arg, NumericPolicy, fresh, lift, total

ResultRule = Callable[[list[FinType]], FinType]


def always(t: FinType) -> ResultRule:
    return lambda args: t


def same_as_first(args: list[FinType]) -> FinType:
    return args[0] if args else SCALAR


def first_money(args: list[FinType]) -> FinType:
    """The first argument that is money itself (not a series of it), else scalar."""
    return next((t for t in args if t.kind == "money"), SCALAR)


@dataclass(frozen=True)
class Kernel:
    """``build(policy, *argument SQL)`` for element-wise kernels, ``build(policy, args)`` with Arg objects for folds.

    ``python`` kernels are user functions over NumPy values; they run as Arrow batches (``plans.planner``)."""

    name: str
    build: Callable | None
    result: ResultRule
    arity: int | None = None
    doc: str = ""
    fold: bool = False
    python: Callable | None = None


class Registry:
    def __init__(self, parent: Registry | None = None) -> None:
        self._kernels: dict[str, Kernel] = dict(parent._kernels) if parent else {}

    def register(self, k: Kernel, overwrite: bool = False) -> Kernel:
        if k.name in self._kernels and not overwrite:
            raise KernelError(f"kernel {k.name!r} exists already")
        self._kernels[k.name] = k
        return k

    def add(self, name: str, build: Callable, result: ResultRule, *, arity: int | None = None, doc: str = "", fold: bool = False, overwrite: bool = False) -> Kernel:
        return self.register(Kernel(name, build, result, arity, doc, fold), overwrite)

    def has(self, name: str) -> bool:
        return name in self._kernels

    def get(self, name: str) -> Kernel:
        if name.startswith("fx_convert.") and name not in self._kernels:
            # fx_convert.USD(amount, rate): the only way from one currency to another
            return Kernel(name, lambda p, a, r: f"({a} * {r})", always(money(name.partition(".")[2])), 2, "amount * rate in another currency")
        if name not in self._kernels:
            raise KernelError(f"unknown kernel {name!r}")
        return self._kernels[name]

    def names(self) -> list[str]:
        return sorted(self._kernels)

    def _checked(self, name: str, n: int) -> Kernel:
        k = self.get(name)
        if k.arity is not None and n != k.arity:
            raise KernelError(f"kernel {name!r} takes {k.arity} arguments, not {n}")
        return k

    def result_type(self, name: str, args: list[FinType]) -> FinType:
        return self._checked(name, len(args)).result(args)

    def call(self, name: str, args: list[Arg], policy: NumericPolicy) -> Arg:
        k = self._checked(name, len(args))
        if k.build is None:
            raise KernelError(f"kernel {name!r} is a Python function and has no SQL form")
        if k.fold:
            return Arg(k.build(policy, args))
        return lift(args, lambda *sql: k.build(policy, *sql))


def kernel(name: str, *, result: ResultRule | FinType = SCALAR, arity: int | None = None, doc: str = "", registry: Registry | None = None, python: bool = False):
    """Registers a function: of argument SQL to SQL, or with ``python=True`` of NumPy arrays to an array. Replaces an old one."""
    rule = always(result) if isinstance(result, FinType) else result

    def decorate(fn: Callable) -> Callable:
        build = None if python else lambda policy, *sql: fn(*sql)
        (registry or default_registry()).register(Kernel(name, build, rule, arity, doc or fn.__doc__ or "", False, fn if python else None), overwrite=True)
        return fn

    return decorate


# folds over a series
def _flow(args: list[Arg]) -> str:
    """Cash flows given as one series, or as one value each."""
    if len(args) == 1 and args[0].array:
        return args[0].sql
    if any(a.array for a in args):
        raise KernelError("cash flows are either one series or single values")
    return f"CAST(array({', '.join(a.sql for a in args)}) AS ARRAY<DOUBLE>)"


def _present_sum(flow: str, years: str | None, rate: str) -> str:
    x, i = fresh(), fresh("i")
    when = f"get({years}, {i})" if years else f"CAST({i} AS DOUBLE)"
    return total(f"transform({flow}, ({x}, {i}) -> {x} / power(1.0D + {rate}, {when}))")


def _npv(policy: NumericPolicy, args: list[Arg]) -> str:
    return _present_sum(_flow(args[1:]), None, args[0].sql)


def _root(flow: str, years: str | None) -> str:
    """Bisection on [-0.9999, 10] in at most 200 halvings, as one fold; NaN if the value does not change sign."""
    b, s, k, m, f = fresh("b"), fresh("s"), fresh("k"), fresh("m"), fresh("f")
    cf, at = f"{b}.cf", (f"{b}.yr" if years else None)
    fields = f"'cf', {flow}" + (f", 'yr', {years}" if years else "")
    low, high = _present_sum(cf, at, "-0.9999D"), _present_sum(cf, at, "10.0D")
    start = f"named_struct('lo', -0.9999D, 'hi', 10.0D, 'flo', {low}, 'root', CAST(NULL AS DOUBLE))"
    mid = f"transform(array(named_struct('m', 0.5D * ({s}.lo + {s}.hi))), {m} -> named_struct('m', {m}.m, 'f', {_present_sum(cf, at, f'{m}.m')}))"
    step = (
        f"transform({mid}, {f} -> CASE WHEN abs({f}.f) < 1e-9D THEN named_struct('lo', {s}.lo, 'hi', {s}.hi, 'flo', {s}.flo, 'root', {f}.m)"
        f" WHEN {s}.flo * {f}.f < 0.0D THEN named_struct('lo', {s}.lo, 'hi', {f}.m, 'flo', {s}.flo, 'root', CAST(NULL AS DOUBLE))"
        f" ELSE named_struct('lo', {f}.m, 'hi', {s}.hi, 'flo', {f}.f, 'root', CAST(NULL AS DOUBLE)) END)[0]"
    )
    run = f"aggregate(sequence(1, 200), {start}, ({s}, {k}) -> IF({s}.root IS NOT NULL, {s}, {step}), {s} -> coalesce({s}.root, 0.5D * ({s}.lo + {s}.hi)))"
    return f"transform(array(named_struct({fields})), {b} -> IF(({low}) * ({high}) > 0.0D, {NAN}, {run}))[0]"


def _irr(policy: NumericPolicy, args: list[Arg]) -> str:
    return _root(_flow(args), None)


def _xirr(policy: NumericPolicy, args: list[Arg]) -> str:
    return _root(args[0].sql, args[1].sql)


def _over_series(body: Callable[[str], str]):
    """A fold that binds its series to a name once."""

    def build(policy: NumericPolicy, args: list[Arg]) -> str:
        s = fresh("s")
        series = args[0].sql if args[0].array else f"array({args[0].sql})"
        return f"transform(array({series}), {s} -> {body(s, *(a.sql for a in args[1:]))})[0]"

    return build


def _variance(s: str) -> str:
    m, x = fresh("m"), fresh()
    mean = f"({total(s)} / size({s}))"
    return f"IF(size({s}) = 0, {NAN}, transform(array({mean}), {m} -> {total(f'transform({s}, {x} -> ({x} - {m}) * ({x} - {m}))')} / size({s}))[0])"


def quantile(s: str, q: str) -> str:
    """Linear interpolation between order statistics, from the nearer one, so that a position on a statistic gives it exactly."""
    o, p, g = fresh("o"), fresh("p"), fresh("g")
    low, high = f"get({o}, CAST(floor({p}) AS INT))", f"get({o}, CAST(ceil({p}) AS INT))"
    gap = f"named_struct('a', {low}, 'b', {high}, 't', {p} - floor({p}))"
    value = f"IF({g}.t >= 0.5D, {g}.b - ({g}.b - {g}.a) * (1.0D - {g}.t), {g}.a + ({g}.b - {g}.a) * {g}.t)"
    return f"transform(array(array_sort({s})), {o} -> transform(array(({q}) * (size({o}) - 1)), {p} -> transform(array({gap}), {g} -> {value})[0])[0])[0]"


def _var(s: str, level: str = "0.95D") -> str:
    return f"IF(size({s}) = 0, {NAN}, -({quantile(s, f'1.0D - {level}')}))"


def _cvar(s: str, level: str = "0.95D") -> str:
    c, x = fresh("c"), fresh()
    tail = f"filter({s}, {x} -> {x} <= {c})"
    return f"IF(size({s}) = 0, {NAN}, transform(array({quantile(s, f'1.0D - {level}')}), {c} -> IF(size({tail}) = 0, -{c}, -({total(tail)}) / size({tail})))[0])"


def _drawdown(s: str) -> str:
    a, x = fresh("a"), fresh()
    top = f"greatest({a}.top, {x})"
    fall = f"coalesce(try_divide({top} - {x}, {top}), 0.0D)"
    return f"IF(size({s}) = 0, 0.0D, aggregate({s}, named_struct('top', {s}[0], 'most', 0.0D), ({a}, {x}) -> named_struct('top', {top}, 'most', greatest({a}.most, {fall})), {a} -> {a}.most))"


def _annuity_factor(r: str, n: str) -> str:
    return f"power(1.0D + {r}, {n})"


def _future(p: NumericPolicy, r: str, n: str, pmt: str, pv: str) -> str:
    f = _annuity_factor(r, n)
    return f"IF({r} = 0.0D, -({pv} + {pmt} * {n}), -({pv} * {f} + {pmt} * ({f} - 1.0D) / IF({r} = 0.0D, 1.0D, {r})))"


def _present(p: NumericPolicy, r: str, n: str, pmt: str, fv: str) -> str:
    f = _annuity_factor(r, n)
    return f"IF({r} = 0.0D, -({fv} + {pmt} * {n}), coalesce(try_divide(-({fv} + {pmt} * ({f} - 1.0D) / IF({r} = 0.0D, 1.0D, {r})), {f}), {NAN}))"


def _payment(p: NumericPolicy, r: str, n: str, pv: str) -> str:
    f = _annuity_factor(r, n)
    return f"IF({r} = 0.0D, {p.divide(f'-{pv}', n)}, {p.divide(f'(-{pv} * {r} * {f})', f'({f} - 1.0D)')})"


_DEFAULT: Registry | None = None


def default_registry() -> Registry:
    """The session's registry, with the built-in kernels."""
    global _DEFAULT
    if _DEFAULT is not None:
        return _DEFAULT
    reg = _DEFAULT = Registry()
    money_or_scalar = lambda args: args[0] if args and args[0].kind == "money" else SCALAR
    div = lambda p, a, b: p.divide(a, b)
    each = {
        "add": (2, same_as_first, lambda p, a, b: f"({a} + {b})", "a + b"),
        "subtract": (2, same_as_first, lambda p, a, b: f"({a} - {b})", "a - b"),
        "multiply": (2, money_or_scalar, lambda p, a, b: f"({a} * {b})", "a * b"),
        "divide": (2, lambda args: binary_result("/", *args), div, "a / b under the division policy"),
        "ratio": (2, always(RATIO), div, "a / b as a ratio"),
        "percentage_change": (2, always(PERCENTAGE), lambda p, a, b: p.divide(f"({b} - {a})", a), "(new - old) / old"),
        "growth": (2, same_as_first, lambda p, a, r: f"({a} * (1.0D + {r}))", "base * (1 + rate)"),
        "compound": (3, same_as_first, lambda p, a, r, n: f"({a} * power(1.0D + {r}, {n}))", "base * (1 + rate) ^ n"),
        "discount": (3, same_as_first, lambda p, a, r, n: p.divide(a, f"power(1.0D + {r}, {n})"), "amount / (1 + rate) ^ n"),
        "gross_profit": (2, first_money, lambda p, a, b: f"({a} - {b})", "revenue - cogs"),
        "gross_margin": (2, always(RATIO), div, "gross profit / revenue"),
        "ebitda": (2, first_money, lambda p, a, b: f"({a} - {b})", "gross profit - opex"),
        "ebitda_margin": (2, always(RATIO), div, "ebitda / revenue"),
        "operating_margin": (2, always(RATIO), div, "operating income / revenue"),
        "free_cash_flow": (4, first_money, lambda p, e, c, t, w: f"({e} - {c} - {t} - {w})", "ebitda - capex - tax - change of working capital"),
        "break_even": (3, always(SCALAR), lambda p, f, a, b: p.divide(f, f"({a} - {b})"), "fixed cost / (price - variable cost)"),
        "receivables": (2, first_money, lambda p, a, d: f"({a} * ({d} / 365.0D))", "revenue * days / 365"),
        "payables": (2, first_money, lambda p, a, d: f"({a} * ({d} / 365.0D))", "cogs * days / 365"),
        "inventory_days": (2, always(DAYS), lambda p, i, c: f"({p.divide(i, c)} * 365.0D)", "inventory / cogs * 365"),
        "cash_conversion_cycle": (3, always(DAYS), lambda p, a, b, c: f"({a} + {b} - {c})", "dso + dio - dpo"),
        "working_capital": (3, first_money, lambda p, a, b, c: f"({a} + {b} - {c})", "receivables + inventory - payables"),
        "working_capital_change": (2, first_money, lambda p, a, b: f"({a} - {b})", "new - old"),
        "future_value": (4, always(SCALAR), _future, "future value of payments"),
        "present_value": (4, always(SCALAR), _present, "present value of payments"),
        "annuity": (3, always(SCALAR), _payment, "payment of an annuity"),
    }
    for name, (arity, rule, build, doc) in each.items():
        reg.add(name, build, rule, arity=arity, doc=doc)
    folds = {
        "npv": (None, _npv, "net present value, the first flow undiscounted"),
        "irr": (None, _irr, "internal rate of return"),
        "xirr": (2, _xirr, "internal rate of return at given years"),
        "variance": (1, _over_series(_variance), "population variance"),
        "volatility": (1, _over_series(lambda s: f"sqrt({_variance(s)})"), "population standard deviation"),
        "var": (None, _over_series(_var), "historical value at risk"),
        "cvar": (None, _over_series(_cvar), "expected shortfall"),
        "drawdown": (1, _over_series(_drawdown), "largest fall from a running peak"),
    }
    for name, (arity, build, doc) in folds.items():
        reg.add(name, build, always(SCALAR), arity=arity, doc=doc, fold=True)
    return reg
