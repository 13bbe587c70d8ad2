"""Value types of models and the rules of arithmetic on them.

Rules are tables over kinds. They are checked on the driver before any column exists; at run time every value is a double or an
array of doubles, with the type in the column's metadata.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import CurrencyError, TypeRuleError


@dataclass(frozen=True)
class FinType:
    """``kind`` with its argument: a currency, unit or period; ``inner`` is the element of a series or scenario."""

    kind: str
    arg: str | None = None
    inner: FinType | None = None

    def textual(self) -> str:
        if self.kind == "series":
            return f"series[{self.inner.textual()},{self.arg}]"
        if self.kind == "scenario":
            return f"scenario[{self.inner.textual()}]"
        return self.kind if self.arg is None else f"{self.kind}[{self.arg}]"

    @property
    def is_series(self) -> bool:
        return self.kind == "series" or (self.kind == "scenario" and self.inner.is_series)

    def metadata(self) -> dict:
        """For ``StructField.metadata``."""
        return {"ft": self.textual()}


SCALAR, BOOL, PERCENTAGE, RATIO, DAYS = (FinType(k) for k in ("scalar", "bool", "percentage", "ratio", "days"))


def money(currency: str) -> FinType:
    return FinType("money", currency)


def quantity(unit: str = "units") -> FinType:
    return FinType("quantity", unit)


def rate(per: str = "year") -> FinType:
    return FinType("rate", per)


def series(element: FinType, period: str = "month") -> FinType:
    return FinType("series", period, element)


def scenario(element: FinType) -> FinType:
    return FinType("scenario", None, element)


_WORDS = {"scalar": SCALAR, "percentage": PERCENTAGE, "pct": PERCENTAGE, "ratio": RATIO, "days": DAYS, "bool": BOOL, "boolean": BOOL, "money": money("ZAR")}
_BRACKETED = re.compile(r"(money|quantity|rate|series|scenario)\[(.*)\]", re.IGNORECASE | re.DOTALL)
_DEFAULT_ARG = {"quantity": "units", "rate": "year"}


def parse_type(text: str) -> FinType:
    """``money[ZAR]``, ``series[money[ZAR],month]`` and so on; keywords in any case."""
    text = text.strip()
    if (word := _WORDS.get(text.lower())) is not None:
        return word
    m = _BRACKETED.fullmatch(text)
    if m is None:
        raise TypeRuleError(f"unknown type: {text!r}")
    kind, body = m[1].lower(), m[2].strip()
    if kind == "series":
        element, comma, period = body.rpartition(",")
        if not comma:
            raise TypeRuleError(f"a series needs an element and a period: {text!r}")
        return series(parse_type(element), period.strip() or "month")
    if kind == "scenario":
        return scenario(parse_type(body))
    return FinType(kind, body or _DEFAULT_ARG.get(kind, ""))


def is_money(t: FinType | None) -> bool:
    return t is not None and (t.kind == "money" or is_money(t.inner))


def currency_of(t: FinType | None) -> str | None:
    if t is None:
        return None
    return t.arg if t.kind == "money" else currency_of(t.inner)


# What a product or quotient of two kinds is: "left", "right", or a type. Pairs that are not listed have no meaning.
_PLAIN = ("scalar", "percentage", "ratio")
_NUMERIC = (*_PLAIN, "rate")
_TIMES: dict[tuple[str, str], str | FinType] = {(a, b): "right" if a == "scalar" else "left" for a in _NUMERIC for b in _NUMERIC}
_OVER: dict[tuple[str, str], str | FinType] = {(a, b): SCALAR if a == b == "scalar" else RATIO for a in _NUMERIC for b in _NUMERIC}
for _p in _PLAIN:
    _TIMES |= {("money", _p): "left", (_p, "money"): "right", ("days", _p): "left", (_p, "days"): "right"}
    _OVER |= {("money", _p): "left", ("days", _p): "left"}
_TIMES |= {("quantity", "money"): "right", ("money", "quantity"): "left"}
_OVER |= {("money", "money"): RATIO, ("money", "quantity"): "left", ("money", "days"): rate("day"), ("days", "days"): RATIO, ("quantity", "quantity"): SCALAR}
_ADDED = ("money", "days", "percentage", "ratio", "scalar", "quantity")


def _element_result(op: str, a: FinType, b: FinType) -> FinType:
    if a.kind == b.kind == "money" and op in "+-/" and a.arg != b.arg:
        raise CurrencyError(f"{a.textual()} {op} {b.textual()}: currencies differ; convert one with fx_convert first")
    if op in ("+", "-"):
        if a.kind == b.kind and a.kind in _ADDED:
            return a
    elif op in ("*", "/"):
        found = (_TIMES if op == "*" else _OVER).get((a.kind, b.kind))
        if found is not None:
            return a if found == "left" else b if found == "right" else found
    else:
        raise TypeRuleError(f"unknown operator {op!r}")
    raise TypeRuleError(f"{a.textual()} {op} {b.textual()} has no meaning")


def _peel(t: FinType) -> tuple[FinType, str | None, bool]:
    """(element, period of the series or None, whether it is a batch of scenarios)."""
    period, batch = None, False
    while t.inner is not None:
        period, batch = (t.arg if t.kind == "series" else period), batch or t.kind == "scenario"
        t = t.inner
    return t, period, batch


def binary_result(op: str, a: FinType, b: FinType) -> FinType:
    """The type of ``a op b``. A scenario batch dominates a series; of two series the first gives the period."""
    (x, px, bx), (y, py, by) = _peel(a), _peel(b)
    got = _element_result(op, x, y)
    if bx or by:
        return scenario(got)
    period = px if px is not None else py
    return got if period is None else series(got, period)
