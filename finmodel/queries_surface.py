"""Registered queries over the surface around evaluation: files, strategies, kernels of the user, counters, instructions.

Those that can read tables evaluate a model on their rows, so that what is written, read back or registered has to give right values.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import intents, nl
from .errors import ModelError
from .expr import parse_expr
from .functions.kernels import Registry, always, default_registry, first_money, kernel, same_as_first
from .functions.sql import NumericPolicy
from .graph import Graph, Node, parse
from .model import FinancialModel
from .plans.planner import Batches, Planner, WorkloadProfile
from .plans.synthetic import segmented
from .queries import _MODEL, _PL, _golden_model, _graph, _pl_model, company, register, rounded, values_sql
from .sources import lens
from .types import binary_result, currency_of, is_money, money, parse_type

_NATIONS = lens.profit_and_loss_sql("nation")


def _code(fn) -> str:
    """The result as text, or the code of the error."""
    try:
        return str(fn())
    except ModelError as e:
        return e.code


def _long(sql: str, *names: str) -> str:
    """Literal rows whose columns of these names are long."""
    return sql.replace("SELECT *", f"SELECT * REPLACE ({', '.join(f'CAST({n} AS BIGINT) AS {n}' for n in names)})", 1)


# -- graphs written and read back, then evaluated
def _again(spark: SparkSession, sf_dir: str, change) -> DataFrame:
    g = change(_pl_model(spark, sf_dir).module)
    m = FinancialModel.from_ir(g).bind(lens.profit_and_loss(spark, sf_dir, "region"))
    return rounded(m.evaluate().frame, ["entity"], {"ebitda": 2, "opex_ratio": 9})


_AGAIN = f"SELECT entity, round(revenue - cogs - opex, 2) AS ebitda, round(opex / revenue, 9) AS opex_ratio FROM ({_PL})"


@register("module_json", _AGAIN)
def module_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir, lambda g: Graph.from_json(json.dumps(g.to_json())))


@register("module_text", _AGAIN)
def module_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir, lambda g: parse(g.to_text()))


_DOT = [
    ("revenue", "gross_profit"), ("cogs", "gross_profit"), ("gross_profit", "ebitda"), ("opex", "ebitda"), ("debt", "interest"), ("rate", "interest"),
    ("opex", "opex_ratio"), ("revenue", "opex_ratio"), ("ebitda", "pretax"), ("interest", "pretax"), ("cogs", "unused"),
]


@register("graph_dot", values_sql("src, dst", _DOT))
def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that the DOT text states."""
    lines = spark.createDataFrame([(line,) for line in parse(_MODEL).to_dot().splitlines()], "line string")
    edge = r'^  "(\w+)" -> "(\w+)";$'
    return lines.where(F.col("line").rlike(edge)).select(F.regexp_extract("line", edge, 1).alias("src"), F.regexp_extract("line", edge, 2).alias("dst"))


_EDITS = [
    ("1 dirty cogs", "cogs,ebitda,gross_profit,pretax,unused"), ("2 duplicate", "validation_error"), ("3 replace unknown", "validation_error"), ("4 removed unused", "cogs,ebitda,gross_profit,pretax"),
    ("5 clone apart", "10 11"), ("6 replaced ebitda", "gross_profit,opex_ratio,pretax"), ("7 outputs", "pretax,opex_ratio,ebitda"), ("8 dangling", "validation_error"), ("9 cycle", "validation_error"),
]


@register("module_edits", values_sql("step, result", _EDITS))
def module_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of a graph, and what a change then reaches."""
    g, named = _graph(), lambda names: ",".join(sorted(names))
    node = lambda name, text: Node(name, "computed", None, None, parse_expr(text))
    got = [named(g.cone(["cogs"])), _code(lambda: g.add(node("ebitda", "cogs"))), _code(lambda: g.replace(node("nothing", "cogs")))]
    whole = g.clone()
    g.remove("unused")
    got += [named(g.cone(["cogs"])), f"{len(g.nodes)} {len(whole.nodes)}"]
    g.replace(node("ebitda", "revenue - opex"))
    got.append(named(g.cone(["revenue"]) - {"revenue", "ebitda"}))
    g.set_output("ebitda")
    got.append(",".join(g.outputs))
    broken, looped = g.clone(), g.clone()
    broken.remove("debt")
    looped.replace(node("ebitda", "pretax - opex"))
    got += [_code(broken.validate), _code(looped.validate)]
    return spark.createDataFrame([(step, r) for (step, _), r in zip(_EDITS, got, strict=True)], "step string, result string")


# -- types and registry
_HELPERS = [
    ("money[ZAR]", True, "ZAR"), ("money[USD]", True, "USD"), ("series[money[EUR],month]", True, "EUR"), ("scenario[money[ZAR]]", True, "ZAR"), ("scenario[series[money[ZAR],year]]", True, "ZAR"),
    ("percentage", False, None), ("series[days,month]", False, None), ("quantity[kg]", False, None), ("scalar", False, None),
]


@register("type_helpers", values_sql("type, money, currency", _HELPERS))
def type_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, is_money(parse_type(t)), currency_of(parse_type(t))) for t, _, _ in _HELPERS], "type string, money boolean, currency string")


_REGISTRY = [
    ("has npv", "True"), ("has nothing", "False"), ("unknown", "kernel_error"), ("arity", "kernel_error"), ("duplicate", "kernel_error"), ("overwrite", "double"), ("result always", "percentage"),
    ("result same as first", "money[ZAR]"), ("result first money", "money[USD]"), ("result no money", "scalar"), ("own registry only", "True False"), ("convert", "money[USD]"),
    ("unknown operator", "type_error"), ("unknown type", "type_error"), ("parse", "parse_error"), ("strategy", "backend_error"), ("policy", "numeric_error"), ("intent", "intent_validation_error"),
]


@register("registry_rules", values_sql("item, result", _REGISTRY))
def registry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration, arity, result rules, and the codes of errors."""
    own = Registry(default_registry())
    own.add("double", lambda policy, a: f"({a} * 2)", same_as_first, arity=1)
    own.add("share", lambda policy, a, b: f"({a} / {b})", always(parse_type("percentage")), arity=2)
    own.add("pick", lambda policy, *a: a[0], first_money)
    zar, usd, plain = money("ZAR"), money("USD"), parse_type("scalar")
    got = [
        own.has("npv"), own.has("nothing"), _code(lambda: own.get("nothing")), _code(lambda: own.result_type("growth", [zar])), _code(lambda: own.add("double", None, same_as_first)),
        own.add("double", lambda policy, a: f"(2 * {a})", same_as_first, arity=1, overwrite=True).name, own.result_type("share", [zar, zar]).textual(), own.result_type("double", [zar]).textual(),
        own.result_type("pick", [plain, usd, zar]).textual(), own.result_type("pick", [plain]).textual(), f"{own.has('double')} {default_registry().has('double')}", own.result_type("fx_convert.USD", [zar, plain]).textual(),
        _code(lambda: binary_result("^", zar, zar)), _code(lambda: parse_type("banana")), _code(lambda: parse_expr("1 +")), _code(lambda: Planner().get("gpu")), _code(lambda: NumericPolicy("maybe")), _code(lambda: intents.check({"operations": [{}]})),
    ]
    return spark.createDataFrame([(item, str(r)) for (item, _), r in zip(_REGISTRY, got, strict=True)], "item string, result string")


@register("kernel_of_sql", f"SELECT entity, round(least(revenue, 3 * cogs) * 0.9::DOUBLE, 6) AS capped FROM ({_NATIONS})")
def kernel_of_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's kernel in SQL, with the type of its first argument."""
    own = Registry(default_registry())
    kernel("at_most", result=same_as_first, arity=2, registry=own)(lambda a, top: f"least({a}, {top})")
    m = FinancialModel("capped", kernels=own).input("revenue", currency="ZAR").input("cogs", currency="ZAR").bind(lens.profit_and_loss(spark, sf_dir, "nation").select("entity", "revenue", "cogs"))
    return rounded(m.define("capped", "at_most(revenue, cogs * 3) * 90%", output=True).evaluate().frame, ["entity"], {"capped": 6})


@register("kernel_of_numpy", f"SELECT entity, round(sqrt(revenue * revenue + cogs * cogs) / 2, 4) AS middle FROM ({_NATIONS})")
def kernel_of_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's kernel over NumPy arrays, in Arrow batches."""
    import numpy as np

    own = Registry(default_registry())
    kernel("length", arity=2, registry=own, python=True)(lambda a, b: np.sqrt(a * a + b * b))
    m = FinancialModel("lengths", kernels=own).input("revenue").input("cogs").bind(lens.profit_and_loss(spark, sf_dir, "nation").select("entity", "revenue", "cogs"))
    return rounded(m.define("middle", "length(revenue, cogs) / 2", output=True).evaluate().frame, ["entity"], {"middle": 4})


# -- strategies
class Thousands(Batches):
    """A user's strategy: nodes count in thousands, and leave as they are counted."""

    name = "thousands"

    def prepare(self, values):
        return values / 1000.0 if values.dtype.kind == "f" else values


@register("user_strategy", f"SELECT entity, round((revenue - cogs - opex) / 1000, 5) AS ebitda, round(opex / revenue, 9) AS opex_ratio FROM ({_NATIONS})")
def user_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _pl_model(spark, sf_dir, "nation").set_backend(Thousands())
    return rounded(m.evaluate().frame, ["entity"], {"ebitda": 5, "opex_ratio": 9})


@register("arrow_strategy", f"SELECT entity, round(revenue - cogs - opex, 2) AS ebitda, round(opex / revenue, 9) AS opex_ratio FROM ({_NATIONS})")
def arrow_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pl_model(spark, sf_dir, "nation").evaluate(backend="arrow").frame, ["entity"], {"ebitda": 2, "opex_ratio": 9})


_CHOICES = [(1, 10, False, "columns"), (1_000_000, 10, False, "columns"), (1, 5_000, False, "columns"), (1, 5_001, False, "arrow"), (1, 10, True, "arrow")]


@register("strategy_choice", _long(values_sql("scenarios, nodes, python, strategy", _CHOICES), "scenarios", "nodes"))
def strategy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = [(s, n, p, Planner().choose(WorkloadProfile(s, n, p)).name) for s, n, p, _ in _CHOICES]
    return spark.createDataFrame(got, "scenarios long, nodes long, python boolean, strategy string")


_COUNTERS = [("1 first", 0, 4, 4), ("2 repeat", 4, 4, 0), ("3 reset", 0, 0, 0), ("4 after reset", 4, 0, 0), ("5 invalidated", 4, 4, 4), ("6 set", 6, 6, 2)]


@register("cache_counters", _long(values_sql("step, hits, misses, recomputed", _COUNTERS), "hits", "misses", "recomputed"))
def cache_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, rows = _golden_model(spark), []

    def note(step: str, recomputed: int = 0) -> None:
        stats = m.cache_stats()
        rows.append((step, stats["hits"], stats["misses"], recomputed))

    note("1 first", len(m.evaluate().recomputed))
    note("2 repeat", len(m.evaluate().recomputed))
    m.reset_cache_stats()
    note("3 reset")
    note("4 after reset", len(m.evaluate().recomputed))
    m.invalidate_all()
    note("5 invalidated", len(m.evaluate().recomputed))
    note("6 set", len(m.set("cogs", 1e6).evaluate().recomputed))
    return spark.createDataFrame(rows, "step string, hits long, misses long, recomputed long")


@register("decimal_money", f"SELECT entity, CAST(CAST(revenue - cogs AS DECIMAL(38, 2)) AS VARCHAR) AS gross_profit FROM ({_PL})")
def decimal_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money as decimals, for output."""
    policy = NumericPolicy(money_scale=2)
    m = company(lens.profit_and_loss(spark, sf_dir), policy).define("gross_profit", "revenue - cogs", output=True)
    return m.evaluate().frame.select("entity", policy.decimal(F.col("gross_profit")).cast("string").alias("gross_profit"))


@register("synthetic_graph", "SELECT c_custkey, round(1.092::DOUBLE * (c_acctbal + 9 * 1000000 + 45000), 4) AS total FROM customer")
def synthetic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten segments of three nodes; every customer's balance is the first segment's input: ((x * 1.05) - x * 0.01) * 1.05."""
    m = segmented(10, 3)
    m.bind(lens.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("seg0_in")))
    return rounded(m.evaluate().frame, ["c_custkey"], {"total": 4})


# -- requests and instructions
_DICTS = [
    ("operations", '{"schema_version":"1.0","status":"valid","operations":[{"operation":"set","target":"opex","value":5.0}]}'),
    ("reason", '{"schema_version":"1.0","status":"unsupported","reason":"no","operations":[]}'),
    ("scenarios", '{"schema_version":"1.0","status":"valid","scenarios":[{"name":"base","operations":[]}]}'),
    ("single", '{"schema_version":"1.0","status":"valid","operations":[{"operation":"relative_change","target":"cogs","value":0.04}]}'),
]
_SOURCES = [{"operations": [{"operation": "set", "target": "opex", "value": 5}]}, {"status": "unsupported", "reason": "no"}, {"scenarios": [{"name": "base"}]}, {"operation": "change", "metric": "cogs", "relative_change": 0.04}]


@register("intent_json", values_sql("id, payload", _DICTS))
def intent_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of several forms in their canonical form."""
    got = [(i, json.dumps(intents.to_dict(intents.check(p)), separators=(",", ":"))) for (i, _), p in zip(_DICTS, _SOURCES, strict=True)]
    return spark.createDataFrame(got, "id string, payload string")


_NAMED = "Base scenario: no change. Downside scenario: revenue falls 8% and COGS rises 5%. Upside scenario: increase sales by 10%"


@register("nl_scenarios", f"""SELECT s.scenario, entity, round(revenue * ru - cogs * cu - opex, 2) AS ebitda FROM ({_PL}),
    (VALUES ('base', 1::DOUBLE, 1::DOUBLE), ('downside', 0.92::DOUBLE, 1.05::DOUBLE), ('upside', 1.1::DOUBLE, 1::DOUBLE)) AS s(scenario, ru, cu)""")
def nl_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named scenarios in plain English, run on every region in one plan."""
    read = intents.check(nl.compile_text(_NAMED))
    frame = _pl_model(spark, sf_dir).scenario_frame({s["name"]: intents.changes_of(s["operations"]) for s in read["scenarios"]})
    return rounded(frame, ["scenario", "entity"], {"ebitda": 2})


@register("nl_sweep", f"SELECT CAST(i AS BIGINT) AS scenario_id, entity, round(revenue - cogs - (1000 + i * 400), 2) AS ebitda FROM ({_PL}), range(11) AS r(i)")
def nl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _pl_model(spark, sf_dir).apply_intent(nl.compile_text("Sweep opex from R1,000 to R5,000 in 11 steps")).frame
    return rounded(frame, ["scenario_id", "entity"], {"ebitda": 2})


_SIMPLE = [
    ("Raise rent by 5%", "valid", "relative_change", "opex", 0.05), ("Cut COGS by 4 percent", "valid", "relative_change", "cogs", -0.04), ("Extend payment terms from 30 to 60 days", "valid", "set", "payment_terms", 60.0),
    ("Improve revenue", "ambiguous", None, None, None), ("Do something nice", "ambiguous", None, None, None), ("Acquire a competitor", "unsupported", None, None, None),
]


@register("nl_simple", values_sql("text, status, operation, target, value", _SIMPLE))
def nl_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiler of one operation, with a name of the user's."""
    simple, rows = nl.SimpleIntentCompiler({"rent": "opex"}), []
    for text, *_ in _SIMPLE:
        got = simple.compile(text)
        op = next(iter(got.get("operations") or []), {})
        rows.append((text, got["status"], op.get("operation"), op.get("target"), op.get("value")))
    return spark.createDataFrame(rows, "text string, status string, operation string, target string, value double")


def labelled_instructions() -> list[dict]:
    """183 labelled instructions from a rule: changes by percent and by amount, terms, sweeps, pairs, scenarios, currencies that the
    model refuses, vague and impossible requests; the last 20 (stress) use verbs that the rules do not read as a fall."""
    rows: list[dict] = []
    valid = lambda *ops: {"schema_version": "1.0", "status": "valid", "operations": list(ops)}
    none = lambda status: {"schema_version": "1.0", "status": status, "operations": []}
    change = lambda target, value: {"operation": "relative_change", "target": target, "value": value}
    names = ("revenue", "cogs", "opex", "capex", "inventory")

    def put(category: str, text: str, intent: dict, difficulty: str = "core", outcome: str = "") -> None:
        rows.append({"id": f"i{len(rows):03d}", "category": category, "difficulty": difficulty, "text": text, "execution_expectation": outcome, "expected_intent": json.dumps(intent)})

    for name in names:
        for k in range(1, 11):  # 100
            put("valid_simple", f"Increase {name} by {k}%", valid(change(name, k / 100)))
            put("valid_simple", f"Reduce {name} by {k} percent", valid(change(name, -k / 100)))
        put("valid_money", f"Raise {name} by R5,000,000", valid({"operation": "absolute_change", "target": name, "value": 5e6, "currency": "ZAR"}))  # 5
        put("range", f"Sweep {name} from 100 to 200 in 5 steps", valid({"operation": "range", "target": name, "min": 100.0, "max": 200.0, "steps": 5}))  # 5
        put("semantic_reject", f"Increase {name} by USD 2,000,000", valid({"operation": "absolute_change", "target": name, "value": 2e6, "currency": "USD"}), outcome="semantic_reject")  # 5
        put("ambiguous", f"Make {name} better", none("ambiguous"))  # 5
    for k in (15, 45, 60, 75, 90):  # 5
        put("valid_days", f"Extend payment terms from 30 to {k} days", valid({"operation": "set", "target": "payment_terms", "value": float(k), "unit": "days"}))
    for a in names:
        for b in names[:4]:
            if a != b:  # 16
                put("multi_operation", f"Increase {a} by 3% and reduce {b} by 2%", valid(change(a, 0.03), change(b, -0.02)))
    for k in range(1, 13):  # 12
        named = [{"name": "base", "operations": []}, {"name": "downside", "operations": [change("revenue", -k / 100), change("cogs", 0.05)]}]
        put("scenario", f"Base scenario: no change. Downside scenario: revenue falls {k}% and COGS rises 5%", {"schema_version": "1.0", "status": "valid", "scenarios": named})
    for text in ("Fire 100 employees", "Acquire a competitor", "Take the company public", "Merge with a rival", "List on the stock exchange", "Merge with a competitor", "Fire 20 employees", "Fire 30 employees", "Acquire a rival", "Fire 5 employees"):  # 10
        put("unsupported", text, none("unsupported"))
    for k in range(1, 21):  # 20
        put("valid_simple", f"Slash opex by {k}%", valid(change("opex", -k / 100)), "stress")
    return rows


def _instruction_model(spark: SparkSession) -> FinancialModel:
    m = FinancialModel("reference", spark=spark)
    for name in ("revenue", "cogs", "opex", "capex", "inventory"):
        m.input(name, 1e6, currency="ZAR")
    return m.input("payment_terms", 30, type="days").define("ebitda", "revenue - cogs - opex", output=True)


def _benchmark(spark: SparkSession) -> dict[str, DataFrame]:
    rows = labelled_instructions()
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in rows[0]))
    return nl.benchmark(df, _instruction_model(spark))


_METRICS = "schema_validity, status_accuracy, operation_accuracy, target_accuracy, value_accuracy, unit_accuracy, currency_accuracy, refusal_precision, refusal_recall, multi_operation_accuracy, scenario_accuracy, execution_success, semantic_rejection, refusal_f1"
#: Of 196 operations the rules read the 20 of the stress rows with the wrong sign, and nothing else wrongly.
_MEASURED = [
    (None, 183, *[1.0] * 4, round(176 / 196, 4), *[1.0] * 9),
    ("core", 163, *[1.0] * 14),
    ("stress", 20, *[1.0] * 4, 0.0, *[1.0] * 2, *[None] * 4, 1.0, None, None),
]
_OUTCOMES = [
    ("valid_simple", "core", "valid", "valid", "executed", 100, 100), ("valid_simple", "stress", "valid", "valid", "executed", 20, 0), ("valid_money", "core", "valid", "valid", "executed", 5, 5),
    ("range", "core", "valid", "valid", "executed", 5, 5), ("valid_days", "core", "valid", "valid", "executed", 5, 5), ("semantic_reject", "core", "valid", "valid", "rejected", 5, 5),
    ("multi_operation", "core", "valid", "valid", "executed", 16, 16), ("scenario", "core", "valid", "valid", "executed", 12, 12), ("ambiguous", "core", "ambiguous", "ambiguous", "refused", 5, 5),
    ("unsupported", "core", "unsupported", "unsupported", "refused", 10, 10),
]
_TYPED = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _METRICS.split(", "))


@register("instruction_metrics", values_sql(f"difficulty, n, {_METRICS}", _MEASURED).replace("SELECT *", f"SELECT difficulty, CAST(n AS BIGINT) AS n, {_TYPED}"))
def instruction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled instructions read, compared and run, by difficulty."""
    return _benchmark(spark)["metrics"]


@register("instruction_outcomes", _long(values_sql("category, difficulty, expected, predicted, outcome, n, exact", _OUTCOMES), "n", "exact"))
def instruction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark)["examples"].groupBy("category", "difficulty", "expected", "predicted", "outcome").agg(F.count("*").alias("n"), F.sum(F.col("exact").cast("long")).alias("exact"))
