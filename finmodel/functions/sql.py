"""Building blocks of SQL text: literals, division under a policy, and element-wise lifting over arrays."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

from ..errors import NumericError

NAN = "double('NaN')"
_names = itertools.count()


@dataclass(frozen=True)
class NumericPolicy:
    """``on_div_zero``: nan, zero or raise. ``on_nonfinite``: ignore or raise. ``money_scale``: digits of decimal money, if wanted."""

    on_div_zero: str = "nan"
    on_nonfinite: str = "ignore"
    money_scale: int | None = None

    def __post_init__(self) -> None:
        if self.on_div_zero not in ("nan", "zero", "raise") or self.on_nonfinite not in ("ignore", "raise"):
            raise NumericError(f"unknown numeric policy {self}")

    def divide(self, a: str, b: str) -> str:
        """Under ANSI a plain quotient raises; ``try_divide`` is null exactly for a zero divisor, since no value is null here."""
        if self.on_div_zero == "raise":
            return f"({a} / {b})"
        return f"coalesce(try_divide({a}, {b}), {NAN if self.on_div_zero == 'nan' else '0.0D'})"

    def result(self, sql: str) -> str:
        """A computed value, checked if non-finite ones must raise."""
        if self.on_nonfinite == "ignore":
            return sql
        v = fresh("v")
        # a one-element transform evaluates the value once
        return f"transform(array({sql}), {v} -> IF(isnan({v}) OR abs({v}) = double('Infinity'), CAST(raise_error('a value is not finite') AS DOUBLE), {v}))[0]"


    def decimal(self, column):
        """Decimal money, for output: computation stays in doubles."""
        return column.cast(f"decimal(38,{2 if self.money_scale is None else self.money_scale})")


def fresh(prefix: str = "x") -> str:
    return f"{prefix}_{next(_names)}"


def literal(value) -> str:
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and not isinstance(value, (int, float)) and getattr(value, "ndim", 0):
        return f"CAST(array({', '.join(literal(float(v)) for v in value)}) AS ARRAY<DOUBLE>)"
    x = float(value)
    if math.isnan(x):
        return NAN
    if math.isinf(x):
        return f"double('{'-' if x < 0 else ''}Infinity')"
    return f"({x!r}D)" if x < 0 else f"{x!r}D"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Arg:
    """SQL text of a value, and whether it is an array."""

    sql: str
    array: bool = False


def lift(args: list[Arg], scalar: Callable[..., str]) -> Arg:
    """Applies a scalar function; over arrays element by element. Arrays must be equally long; those of one element repeat."""
    arrays = [k for k, a in enumerate(args) if a.array]
    if not arrays:
        return Arg(scalar(*(a.sql for a in args)))
    if len(arrays) == 1:
        x, k = fresh(), arrays[0]
        return Arg(f"transform({args[k].sql}, {x} -> {scalar(*(x if i == k else a.sql for i, a in enumerate(args)))})", True)
    # bind the arrays once, as a struct in a one-element array
    s, i = fresh("s"), fresh("i")
    fields = ", ".join(f"'a{k}', {args[k].sql}" for k in arrays)
    size = f"IF({' OR '.join(f'size({s}.a{k}) = 0' for k in arrays)}, 0, greatest({', '.join(f'size({s}.a{k})' for k in arrays)}))"
    pick = {k: f"get({s}.a{k}, IF(size({s}.a{k}) = 1, 0, {i}))" for k in arrays}
    body = scalar(*(pick.get(k, a.sql) for k, a in enumerate(args)))
    fits = " AND ".join(f"size({s}.a{k}) IN (1, {size})" for k in arrays)
    mapped = f"IF({size} = 0, CAST(array() AS ARRAY<DOUBLE>), transform(sequence(0, greatest({size} - 1, 0)), {i} -> {body}))"
    return Arg(f"transform(array(named_struct({fields})), {s} -> IF({fits}, {mapped}, CAST(raise_error('series lengths differ') AS ARRAY<DOUBLE>)))[0]", True)


def total(array: str) -> str:
    a, x = fresh("a"), fresh()
    return f"aggregate({array}, 0.0D, ({a}, {x}) -> {a} + {x})"
