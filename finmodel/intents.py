"""Structured requests: an envelope of operations or named scenarios, checked and then run on a model.

Checks come in two forms with the same wording: over one payload on the driver, and as columns over a DataFrame of payloads.
"""

from __future__ import annotations

import json
from collections import Counter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import IntentError
from .types import FinType, currency_of, is_money

SCHEMA_VERSION = "1.0"
# Fixed values of the contract.
STATUSES = ("valid", "ambiguous", "unsupported", "invalid")
OPERATIONS = ("relative_change", "set", "absolute_change", "range")
UNITS = ("money", "percentage", "ratio", "days", "rate", "quantity", "scalar")
ALIASES = {"change": "relative_change", "delta": "absolute_change"}
OPERATION_FIELDS = ("value", "unit", "currency", "min", "max", "steps")

OPERATION_DDL = "STRUCT<operation: STRING, target: STRING, value: DOUBLE, unit: STRING, currency: STRING, min: DOUBLE, max: DOUBLE, steps: INT>"
ENVELOPE_DDL = f"schema_version STRING, status STRING, reason STRING, operations ARRAY<{OPERATION_DDL}>, scenarios ARRAY<STRUCT<name: STRING, operations: ARRAY<{OPERATION_DDL}>>>"


def json_schema() -> dict:
    """The contract as JSON Schema (draft 2020-12); it also forbids unknown members."""
    number, text = {"type": "number"}, {"type": "string"}
    base = {"target": {"type": "string", "minLength": 1}}
    currency = {"type": "string", "pattern": "^[A-Z]{3}$"}

    def shape(op: str, extra: dict, required: list[str]) -> dict:
        return {"type": "object", "additionalProperties": False, "properties": base | {"operation": {"const": op}} | extra, "required": ["operation", "target", *required]}

    scalar = [shape("relative_change", {"value": number}, ["value"]), *(shape(op, {"value": number, "unit": {"enum": list(UNITS)}, "currency": currency}, ["value"]) for op in ("set", "absolute_change"))]
    swept = shape("range", {"min": number, "max": number, "steps": {"type": "integer", "minimum": 2}, "unit": {"enum": list(UNITS)}, "currency": currency}, ["min", "max", "steps"])
    named = {"type": "object", "additionalProperties": False, "properties": {"name": {"type": "string", "minLength": 1}, "operations": {"type": "array", "items": {"oneOf": scalar}}}, "required": ["name", "operations"]}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "type": "object",
        "additionalProperties": False,
        "properties": {"schema_version": {"const": SCHEMA_VERSION}, "status": {"enum": list(STATUSES)}, "reason": text, "operations": {"type": "array", "items": {"oneOf": [*scalar, swept]}}, "scenarios": {"type": "array", "minItems": 1, "items": named}},
        "required": ["schema_version", "status"],
    }


def _operation(obj: Any) -> dict:
    if not isinstance(obj, dict):
        raise IntentError("an operation must be an object")
    kind = str(obj.get("operation", "relative_change"))
    kind = ALIASES.get(kind, kind)
    if kind not in OPERATIONS:
        raise IntentError(f"unknown operation {kind!r}")
    target = obj.get("target") or obj.get("metric")
    if not isinstance(target, str) or not target:
        raise IntentError("an operation needs a target")
    out = {"operation": kind, "target": target}
    found = {k: obj.get(k) for k in OPERATION_FIELDS} | {"value": obj.get("value", obj.get("relative_change"))}
    for k in ("value", "min", "max"):
        if found[k] is not None:
            found[k] = float(found[k])
    if found["steps"] is not None:
        found["steps"] = int(found["steps"])
    return out | {k: v for k, v in found.items() if v is not None}


def normalise(payload: Any) -> dict:
    """The canonical envelope of a payload: an envelope, its JSON text, or a single operation of the old form."""
    if isinstance(payload, str):
        payload = json.loads(payload)
    if not isinstance(payload, dict):
        raise IntentError("a request must be an object")
    if "operation" in payload and "operations" not in payload and "scenarios" not in payload:
        payload = {"operations": [payload]}
    status = payload.get("status", "valid")
    if status not in STATUSES:
        raise IntentError(f"unknown status {status!r}")
    named = payload.get("scenarios") or []
    return {
        "schema_version": str(payload.get("schema_version", SCHEMA_VERSION)),
        "status": status,
        "reason": payload.get("reason"),
        "operations": [_operation(o) for o in payload.get("operations") or []],
        "scenarios": [{"name": s.get("name", ""), "operations": [_operation(o) for o in s.get("operations", [])]} for s in named],
    }


def to_dict(intent: dict) -> dict:
    """For output: without empty members; scenarios go before operations."""
    out = {"schema_version": intent["schema_version"], "status": intent["status"]}
    if intent.get("reason") is not None:
        out["reason"] = intent["reason"]
    return out | ({"scenarios": intent["scenarios"]} if intent["scenarios"] else {"operations": intent["operations"]})


def _operation_errors(op: dict) -> list[str]:
    kind, errors = op["operation"], []
    if op.get("unit") is not None and op["unit"] not in UNITS:
        errors.append(f"unknown unit {op['unit']!r}")
    ccy = op.get("currency")
    if ccy is not None and not (len(ccy) == 3 and ccy.isupper()):
        errors.append(f"currency {ccy!r} is not a three-letter code")
    swept = ("min", "max", "steps")
    needs, bars = (swept, ("value",)) if kind == "range" else (("value",), swept)
    errors += [f"{kind} needs {f!r}" for f in needs if op.get(f) is None]
    errors += [f"{kind} must not carry {f!r}" for f in bars if op.get(f) is not None]
    if op.get("steps") is not None and op["steps"] < 2:
        errors.append("'steps' must be at least 2")
    if kind == "relative_change" and (op.get("unit") is not None or ccy is not None):
        errors.append("relative_change has no unit or currency")
    return errors


def _repeated(names: list[str]) -> list[str]:
    return sorted(n for n, c in Counter(names).items() if c > 1)


def structural_errors(intent: dict) -> list[str]:
    """What is wrong with a normalised envelope, whatever the model."""
    ops, named, errors = intent["operations"], intent["scenarios"], []
    if intent["schema_version"] != SCHEMA_VERSION:
        errors.append(f"schema_version {intent['schema_version']!r} is not {SCHEMA_VERSION}")
    if intent["status"] != "valid" and (ops or named):
        errors.append(f"{intent['status']} requests carry no operations")
    if ops and named:
        errors.append("operations and scenarios exclude each other")
    if any(o["operation"] == "range" for o in ops) and len(ops) > 1:
        errors.append("a range must be the only operation")
    if names := _repeated([s["name"] for s in named]):
        errors.append(f"repeated scenarios {names}")
    for where, group in [("", ops), *((f"scenario {s['name']!r}: ", s["operations"]) for s in named)]:
        if repeated := _repeated([o["target"] for o in group]):
            errors.append(f"{where}repeated targets {repeated}")
        errors += [where + e for o in group for e in _operation_errors(o)]
        if where and any(o["operation"] == "range" for o in group):
            errors.append(f"{where}range is not allowed")
    errors += ["a scenario needs a name" for s in named if not s["name"]]
    return errors


def check(payload: Any) -> dict:
    """The canonical envelope, or IntentError with all that is wrong."""
    intent = normalise(payload)
    if errors := structural_errors(intent):
        raise IntentError(errors)
    return intent


def semantic_errors(op: dict, types: dict[str, FinType], inputs: set[str]) -> list[str]:
    """What is wrong with an operation on this model."""
    name, unit, ccy = op["target"], op.get("unit"), op.get("currency")
    if name not in inputs:
        return [f"target {name!r} is not an input of the model"]
    t = types[name]
    if op["operation"] == "relative_change":
        return []
    errors = []
    if is_money(t):
        if ccy is not None and ccy != currency_of(t):
            errors.append(f"target {name!r} is {t.textual()}, not {ccy}")
        allowed = ("money",)
    else:
        if ccy is not None:
            errors.append(f"target {name!r} is {t.textual()} and has no currency")
        allowed = {"days": ("days",), "percentage": (p := ("scalar", "percentage", "ratio")), "ratio": p, "scalar": p}.get(t.kind, ("scalar",))
    if unit is not None and unit not in allowed:
        errors.append(f"unit {unit!r} does not fit target {name!r} of type {t.textual()}")
    return errors


_SPEC = {"relative_change": "relative", "set": "absolute", "absolute_change": "delta"}


def changes_of(ops: list[dict]) -> dict[str, dict]:
    """Operations, none of them a range, as change specs by input."""
    return {o["target"]: {_SPEC[o["operation"]]: o["value"]} for o in ops}


def execute(model, payload: Any) -> Any:
    """Checks a request against the model and runs it."""
    intent = check(payload)
    if intent["status"] != "valid":
        raise IntentError(f"a request with status {intent['status']} cannot run" + (f": {intent['reason']}" if intent["reason"] else ""))
    groups = {s["name"]: s["operations"] for s in intent["scenarios"]}
    if not intent["operations"] and not groups:
        raise IntentError("the request has nothing to run")
    types, inputs = model.types(), {n.name for n in model.module.of_kind("input")}
    if errors := [e for ops in (intent["operations"], *groups.values()) for o in ops for e in semantic_errors(o, types, inputs)]:
        raise IntentError(errors)
    if groups:
        return model.scenarios({name: changes_of(ops) for name, ops in groups.items()})
    first = intent["operations"][0]
    if first["operation"] == "range":
        return model.sweep(first["target"], first["min"], first["max"], first["steps"])
    return model.what_if(changes_of(intent["operations"]))


# -- over DataFrames of payloads
def parse_rows(df: DataFrame, text: str = "payload") -> DataFrame:
    """``df`` with the envelope's columns, from JSON text; unreadable text gives nulls."""
    return df.withColumn("__e", F.from_json(text, ENVELOPE_DDL)).select("*", "__e.*").drop("__e")


def _op_messages(op: Column) -> Column:
    kind, swept = F.coalesce(op["operation"], F.lit("relative_change")), op["operation"] == "range"
    kind = F.when(kind == "change", "relative_change").when(kind == "delta", "absolute_change").otherwise(kind)
    say = lambda when, *parts: F.when(F.coalesce(when, F.lit(False)), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    swept = kind == "range"
    rows = [
        say(~kind.isin(*OPERATIONS), "unknown operation '", kind, "'"),
        say(F.coalesce(op["target"], F.lit("")) == "", "an operation needs a target"),
        say(~op["unit"].isin(*UNITS), "unknown unit '", op["unit"], "'"),
        say(~op["currency"].rlike("^[A-Z]{3}$"), "currency '", op["currency"], "' is not a three-letter code"),
        *(say(swept & op[f].isNull(), f"range needs '{f}'") for f in ("min", "max", "steps")),
        say(swept & op["value"].isNotNull(), "range must not carry 'value'"),
        say(~swept & op["value"].isNull(), kind, " needs 'value'"),
        *(say(~swept & op[f].isNotNull(), kind, f" must not carry '{f}'") for f in ("min", "max", "steps")),
        say(op["steps"] < 2, "'steps' must be at least 2"),
        say((kind == "relative_change") & (op["unit"].isNotNull() | op["currency"].isNotNull()), "relative_change has no unit or currency"),
    ]
    return F.array_compact(F.array(*rows))


def structural_errors_column() -> Column:
    """The messages of ``structural_errors`` for the columns of ``parse_rows``, in no particular order."""
    ops, named = F.coalesce("operations", F.array().cast(f"array<{OPERATION_DDL}>")), F.coalesce("scenarios", F.array().cast(f"array<struct<name: string, operations: array<{OPERATION_DDL}>>>"))
    status = F.coalesce("status", F.lit("valid"))
    targets, names = F.transform(ops, lambda o: o["target"]), F.transform(named, lambda s: F.coalesce(s["name"], F.lit("")))
    envelope = F.array_compact(
        F.array(
            F.when(F.coalesce("schema_version", F.lit(SCHEMA_VERSION)) != SCHEMA_VERSION, F.lit("wrong schema_version")),
            F.when(~status.isin(*STATUSES), F.concat(F.lit("unknown status '"), status, F.lit("'"))),
            F.when((status != "valid") & ((F.size(ops) > 0) | (F.size(named) > 0)), F.concat(status, F.lit(" requests carry no operations"))),
            F.when((F.size(ops) > 0) & (F.size(named) > 0), F.lit("operations and scenarios exclude each other")),
            F.when(F.size(F.array_distinct(targets)) < F.size(targets), F.lit("repeated targets")),
            F.when((F.size(ops) > 1) & F.exists(ops, lambda o: o["operation"] == "range"), F.lit("a range must be the only operation")),
            F.when(F.size(F.array_distinct(names)) < F.size(names), F.lit("repeated scenarios")),
        )
    )
    of = lambda s: F.concat(F.lit("scenario '"), F.coalesce(s["name"], F.lit("")), F.lit("': "))
    unlike = lambda s: F.size(F.array_distinct(F.transform(s["operations"], lambda o: o["target"])))
    by_scenario = F.flatten(
        F.transform(
            named,
            lambda s: F.array_compact(
                F.array(
                    F.when(F.coalesce(s["name"], F.lit("")) == "", F.lit("a scenario needs a name")),
                    F.when(unlike(s) < F.size(s["operations"]), F.concat(of(s), F.lit("repeated targets"))),
                    F.when(F.exists(s["operations"], lambda o: o["operation"] == "range"), F.concat(of(s), F.lit("range is not allowed"))),
                )
            ),
        )
    )
    inner = F.flatten(F.transform(F.concat(ops, F.flatten(F.transform(named, lambda s: s["operations"]))), _op_messages))
    return F.concat(envelope, by_scenario, inner)


def _problem(known: Column, kind: Column, slot: Column, operation: Column, unit: Column, currency: Column) -> Column:
    """What is wrong with an operation on an input (``known``) of this kind and currency, or null."""
    cash, plain = kind == "money", F.array(F.lit("scalar"), F.lit("percentage"), F.lit("ratio"))
    allowed = F.when(cash, F.array(F.lit("money"))).when(kind == "days", F.array(F.lit("days"))).when(kind.isin("percentage", "ratio", "scalar"), plain).otherwise(F.array(F.lit("scalar")))
    return (
        F.when(~known, "not an input")
        .when(operation == "relative_change", F.lit(None))
        .when(cash & currency.isNotNull() & (currency != slot), "currency mismatch")
        .when(~cash & currency.isNotNull(), "no currency expected")
        .when(unit.isNotNull() & ~F.array_contains(allowed, unit), "unit mismatch")
    )


def semantic_rows(ops: DataFrame, inputs: DataFrame) -> DataFrame:
    """``ops`` (id, operation, target, unit, currency) with ``problem``, by a join with ``inputs`` (name, kind, currency)."""
    i = inputs.select(F.col("name").alias("__n"), F.col("kind").alias("__k"), F.col("currency").alias("__c"))
    j = ops.join(F.broadcast(i), F.col("target") == F.col("__n"), "left")  # inputs are the declared slots of one model
    c = F.col
    return j.withColumn("problem", _problem(c("__n").isNotNull(), c("__k"), c("__c"), c("operation"), c("unit"), c("currency"))).drop("__n", "__k", "__c")


def semantic_problems_column(operations: Column, types: dict[str, FinType]) -> Column:
    """The problems of an array of operations on a model whose inputs have these types; the inputs are literals of the plan."""
    slot = lambda t: F.struct(F.lit(t.kind if not is_money(t) else "money").alias("kind"), F.lit(currency_of(t)).cast("string").alias("currency"))
    slots = F.create_map(*[x for n, t in types.items() for x in (F.lit(n), slot(t))])
    found = lambda o: F.element_at(slots, o["target"])
    return F.array_compact(F.transform(operations, lambda o: _problem(found(o).isNotNull(), found(o)["kind"], found(o)["currency"], o["operation"], o["unit"], o["currency"])))
