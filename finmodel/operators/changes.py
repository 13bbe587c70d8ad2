"""Change specs: how an input's new value follows from its present one.

    "+8%" / "-8%"      relative           {"relative": 0.08}
    "30d->60d"         the value after the arrow
    60, "60", "60 d"   absolute           {"absolute": 60}
                                          {"delta": 5}

Of several keys in a dict relative goes before delta, delta before absolute.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelError
from ..functions.sql import literal

_RELATIVE = re.compile(r"([+-])\s*(\d+(?:\.\d+)?)\s*%")
_ARROW = re.compile(r"[\d.]+\s*[a-zA-Z]*\s*->\s*(\d+(?:\.\d+)?)\s*[a-zA-Z]*")
_PLAIN = re.compile(r"([+-]?\d+(?:\.\d+)?)\s*[a-zA-Z%]*")


@dataclass(frozen=True)
class Change:
    """``kind`` is relative, delta or absolute."""

    kind: str
    value: float

    def apply(self, current: float | None) -> float:
        now = 0.0 if current is None else float(current)
        return {"relative": now * (1.0 + self.value), "delta": now + self.value, "absolute": self.value}[self.kind]

    def sql(self, current: str) -> str:
        v = literal(self.value)
        return {"relative": f"({current} * (1.0D + {v}))", "delta": f"({current} + {v})", "absolute": v}[self.kind]


def parse_change(spec: Any) -> Change:
    if isinstance(spec, Change):
        return spec
    if isinstance(spec, (int, float)) and not isinstance(spec, bool):
        return Change("absolute", float(spec))
    if isinstance(spec, dict):
        for kind in ("relative", "delta", "absolute"):
            if kind in spec:
                return Change(kind, float(spec[kind]))
    if isinstance(spec, str):
        text = spec.strip()
        if m := _RELATIVE.fullmatch(text):
            share = float(m[2]) / 100.0
            return Change("relative", share if m[1] == "+" else -share)
        if m := _ARROW.fullmatch(text) or _PLAIN.fullmatch(text):
            return Change("absolute", float(m[1]))
    raise ModelError(f"cannot read the change {spec!r}")


def resolve_change(current: float | None, spec: Any) -> float:
    return parse_change(spec).apply(current)


def change_column(spec: Column, current: Column) -> Column:
    """The same grammar over rows: a string column of specs applied to a column of present values; null where it cannot be read."""
    text, now = F.trim(spec), F.coalesce(current.cast("double"), F.lit(0.0))
    sign = F.regexp_extract(text, r"^([+-])\s*(\d+(?:\.\d+)?)\s*%$", 1)
    share = F.regexp_extract(text, r"^([+-])\s*(\d+(?:\.\d+)?)\s*%$", 2).try_cast("double") / 100.0
    arrow = F.regexp_extract(text, r"^[\d.]+\s*[a-zA-Z]*\s*->\s*(\d+(?:\.\d+)?)\s*[a-zA-Z]*$", 1).try_cast("double")
    plain = F.regexp_extract(text, r"^([+-]?\d+(?:\.\d+)?)\s*[a-zA-Z%]*$", 1).try_cast("double")
    return F.when(sign == "+", now * (1.0 + share)).when(sign == "-", now * (1.0 - share)).otherwise(F.coalesce(arrow, plain))


def scenario_rows(spark: SparkSession, spec: dict[str, dict[str, Any]]) -> tuple[DataFrame, list[str]]:
    """Named scenarios as rows (scenario, and a kind and value per changed input), and the changed inputs."""
    inputs = sorted({name for changes in spec.values() for name in changes})
    rows = []
    for label, changes in spec.items():
        parsed = {name: parse_change(c) for name, c in changes.items()}
        rows.append((label, *(x for name in inputs for x in ((parsed[name].kind, parsed[name].value) if name in parsed else (None, None)))))
    schema = ", ".join(["scenario string", *(f"__kind_{k} string, __value_{k} double" for k in range(len(inputs)))])
    return spark.createDataFrame(rows, schema), inputs


def scenario_sql(current: str, k: int) -> str:
    """The k-th changed input's value in a row of ``scenario_rows``."""
    kind, value = f"__kind_{k}", f"__value_{k}"
    return f"CASE {kind} WHEN 'relative' THEN {current} * (1.0D + {value}) WHEN 'delta' THEN {current} + {value} WHEN 'absolute' THEN {value} ELSE {current} END"


def linspace(spark: SparkSession, low: float, high: float, steps: int, name: str, index: str = "scenario_id") -> DataFrame:
    """``steps`` values from ``low`` to ``high``, both included, without a driver-side list."""
    if steps == 1:
        return spark.range(1).select(F.col("id").alias(index), F.lit(float(low)).alias(name))
    step = literal((high - low) / (steps - 1))
    value = F.expr(f"IF(id = {steps - 1}L, {literal(high)}, {literal(low)} + id * {step})")
    return spark.range(steps).select(F.col("id").alias(index), value.alias(name))
