"""Registered queries over the driver tables, and the same results as DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import intents, nl, templates
from .expr import parse_expr
from .functions.sql import NumericPolicy
from .graph import Graph, parse
from .model import FinancialModel
from .operators import changes, series
from .plans.passes import compile_module
from .sources import lens
from .streaming.changes import windowed_pressure
from .types import binary_result, parse_type

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def company(df: DataFrame, policy: NumericPolicy | None = None) -> FinancialModel:
    """A model whose inputs are the lens columns, bound to its rows."""
    m = FinancialModel("company", policy=policy)
    for n in ("revenue", "cogs", "opex", "inventory"):
        m.input(n, currency="ZAR")
    for n in ("receivable_days", "payable_days"):
        m.input(n, type="days")
    return m.bind(df)


def rounded(df: DataFrame, keys: list[str], digits: dict[str, int]) -> DataFrame:
    return df.select(*keys, *[F.round(c, d).alias(c) for c, d in digits.items()])


def values_sql(columns: str, rows: list[tuple]) -> str:
    """Literal rows as SQL, for results that are known by hand."""
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


# -- expressions and kernels, one row per nation
_EXPRESSIONS = {
    # name: (formula of the model, SQL, digits)
    "expr_arith": ("revenue - cogs - opex", "revenue - cogs - opex", 6),
    "expr_precedence": ("(revenue - cogs) * 2 / 4 - opex * 10%", "(revenue - cogs) * 2 / 4 - opex * 0.1::DOUBLE", 6),
    "expr_unary_minus": ("-revenue + cogs", "-revenue + cogs", 6),
    "k_add": ("add(cogs, opex)", "cogs + opex", 6),
    "k_subtract": ("subtract(revenue, cogs)", "revenue - cogs", 6),
    "k_multiply": ("multiply(revenue, 0.25)", "revenue * 0.25::DOUBLE", 6),
    "k_divide": ("divide(cogs, revenue)", "cogs / revenue", 9),
    "k_ratio": ("ratio(opex, revenue)", "opex / revenue", 9),
    "k_percentage_change": ("percentage_change(cogs, revenue)", "(revenue - cogs) / cogs", 9),
    "k_growth": ("growth(revenue, 0.08)", "revenue * (1 + 0.08::DOUBLE)", 6),
    "k_compound": ("compound(revenue, 0.05, 3)", "revenue * pow(1 + 0.05::DOUBLE, 3)", 3),
    "k_discount": ("discount(revenue, 0.05, 3)", "revenue / pow(1 + 0.05::DOUBLE, 3)", 3),
    "k_gross_profit": ("gross_profit(revenue, cogs)", "revenue - cogs", 6),
    "k_gross_margin": ("gross_margin(gross_profit(revenue, cogs), revenue)", "(revenue - cogs) / revenue", 9),
    "k_ebitda": ("ebitda(revenue - cogs, opex)", "revenue - cogs - opex", 6),
    "k_ebitda_margin": ("ebitda_margin(revenue - cogs - opex, revenue)", "(revenue - cogs - opex) / revenue", 9),
    "k_operating_margin": ("operating_margin(revenue - opex, revenue)", "(revenue - opex) / revenue", 9),
    "k_fcf": ("free_cash_flow(revenue - cogs, opex, opex * 28%, inventory)", "revenue - cogs - opex - opex * 0.28::DOUBLE - inventory", 6),
    "k_break_even": ("break_even(opex, revenue / receivable_days * 1, cogs / receivable_days * 1)", "opex / (revenue / receivable_days * 1 - cogs / receivable_days * 1)", 6),
    "k_receivables": ("receivables(revenue, receivable_days)", "revenue * (receivable_days / 365)", 6),
    "k_payables": ("payables(cogs, payable_days)", "cogs * (payable_days / 365)", 6),
    "k_inventory_days": ("inventory_days(inventory, cogs)", "inventory / cogs * 365", 6),
    "k_ccc": ("cash_conversion_cycle(receivable_days, inventory_days(inventory, cogs), payable_days)", "receivable_days + inventory / cogs * 365 - payable_days", 6),
    "k_working_capital": ("working_capital(receivables(revenue, receivable_days), inventory, payables(cogs, payable_days))", "revenue * (receivable_days / 365) + inventory - cogs * (payable_days / 365)", 6),
    "k_wc_change": ("working_capital_change(inventory, opex)", "inventory - opex", 6),
    "k_future_value": ("future_value(0.01, 24, opex, -revenue)", "-(-revenue * pow(1.01, 24) + opex * (pow(1.01, 24) - 1) / 0.01::DOUBLE)", 2),
    "k_present_value": ("present_value(0.01, 24, opex, revenue)", "-(revenue + opex * (pow(1.01, 24) - 1) / 0.01::DOUBLE) / pow(1.01, 24)", 2),
    "k_annuity": ("annuity(0.01, 24, revenue)", "-revenue * 0.01::DOUBLE * pow(1.01, 24) / (pow(1.01, 24) - 1)", 2),
    "k_annuity_zero_rate": ("annuity(0, 24, revenue)", "-revenue / 24", 6),
    "k_fx_convert": ("fx_convert.USD(revenue, 0.055)", "revenue * 0.055::DOUBLE", 6),
}


def _expression(formula: str, digits: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = company(lens.profit_and_loss(spark, sf_dir, "nation")).define("result", formula, output=True)
        return rounded(m.evaluate().frame, ["entity"], {"result": digits})

    return run


for _name, (_formula, _sql, _digits) in _EXPRESSIONS.items():
    register(_name, f"SELECT entity, round({_sql}, {_digits}) AS result FROM ({lens.profit_and_loss_sql('nation')})")(_expression(_formula, _digits))


@register("income_statement", f"SELECT entity, round(revenue - cogs, 2) AS gross_profit, round((revenue - cogs) / revenue, 6) AS gross_margin, round(revenue - cogs - opex, 2) AS ebitda, round((revenue - cogs - opex) / revenue, 6) AS operating_margin FROM ({lens.profit_and_loss_sql()})")
def income_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = templates.income_statement(company(lens.profit_and_loss(spark, sf_dir))).output("gross_profit", "gross_margin", "ebitda", "operating_margin")
    return rounded(m.evaluate().frame, ["entity"], {"gross_profit": 2, "gross_margin": 6, "ebitda": 2, "operating_margin": 6})


# Division by zero: the cost of every third nation is taken as zero.
_ZEROED = f"SELECT * REPLACE (CASE WHEN length(entity) % 3 = 0 THEN 0 ELSE cogs END AS cogs) FROM ({lens.profit_and_loss_sql('nation')})"


def _zeroed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.profit_and_loss(spark, sf_dir, "nation").withColumn("cogs", F.expr("CASE WHEN length(entity) % 3 = 0 THEN 0D ELSE cogs END"))


@register("safe_div_zero", f"SELECT entity, round(CASE WHEN cogs = 0 THEN 0 ELSE revenue / cogs END, 9) AS cover FROM ({_ZEROED})")
def safe_div_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = company(_zeroed(spark, sf_dir), NumericPolicy(on_div_zero="zero")).define("cover", "revenue / cogs", output=True)
    return rounded(m.evaluate().frame, ["entity"], {"cover": 9})


@register("safe_div_nan", f"SELECT entity, cogs = 0 AS undefined, CASE WHEN cogs <> 0 THEN round(revenue / cogs, 9) END AS cover FROM ({_ZEROED})")
def safe_div_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = company(_zeroed(spark, sf_dir)).define("cover", "revenue / cogs", output=True).evaluate().frame
    return df.select("entity", F.isnan("cover").alias("undefined"), F.when(~F.isnan("cover"), F.round("cover", 9)).alias("cover"))


# -- types
_TYPE_RULES = [
    ("+", "money[ZAR]", "money[ZAR]", "money[ZAR]"), ("-", "money[ZAR]", "money[USD]", "currency_error"), ("+", "days", "days", "days"), ("+", "scalar", "percentage", "type_error"),
    ("-", "quantity[kg]", "quantity[units]", "quantity[kg]"), ("+", "rate[day]", "rate[day]", "type_error"), ("*", "money[ZAR]", "percentage", "money[ZAR]"), ("*", "ratio", "money[USD]", "money[USD]"),
    ("*", "quantity[kg]", "money[ZAR]", "money[ZAR]"), ("*", "days", "ratio", "days"), ("*", "scalar", "rate[year]", "rate[year]"), ("*", "percentage", "ratio", "percentage"),
    ("*", "money[ZAR]", "money[ZAR]", "type_error"), ("*", "quantity[kg]", "scalar", "type_error"), ("/", "money[ZAR]", "money[ZAR]", "ratio"), ("/", "money[ZAR]", "money[USD]", "currency_error"),
    ("/", "money[ZAR]", "quantity[units]", "money[ZAR]"), ("/", "money[ZAR]", "days", "rate[day]"), ("/", "days", "scalar", "days"), ("/", "days", "days", "ratio"), ("/", "scalar", "scalar", "scalar"),
    ("/", "percentage", "scalar", "ratio"), ("/", "quantity[kg]", "quantity[kg]", "scalar"), ("/", "days", "money[ZAR]", "type_error"), ("+", "series[money[ZAR],month]", "money[ZAR]", "series[money[ZAR],month]"),
    ("*", "series[money[ZAR],month]", "scenario[percentage]", "scenario[money[ZAR]]"), ("-", "series[days,year]", "series[days,month]", "series[days,year]"), ("+", "bool", "bool", "type_error"),
]


@register("type_rules", values_sql('op, "left", "right", result', _TYPE_RULES))
def type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    def result(op: str, a: str, b: str) -> str:
        try:
            return binary_result(op, parse_type(a), parse_type(b)).textual()
        except Exception as e:
            return e.code

    return spark.createDataFrame([(op, a, b, result(op, a, b)) for op, a, b, _ in _TYPE_RULES], "op string, `left` string, `right` string, result string")


# -- graphs
_MODEL = """model income {
  input revenue: money[ZAR]; input cogs: money[ZAR]
  opex = input money[ZAR]   # the other form
  input debt: money[ZAR]
  const rate = 0.11 : percentage
  gross_profit = revenue - cogs
  ebitda = gross_profit - opex
  interest = debt * rate
  opex_ratio = opex / revenue  // a comment
  pretax = ebitda - interest
  unused = cogs * 2
  output pretax, opex_ratio
}"""
_EDGES = [("revenue", "gross_profit"), ("cogs", "gross_profit"), ("gross_profit", "ebitda"), ("opex", "ebitda"), ("debt", "interest"), ("rate", "interest"), ("opex", "opex_ratio"), ("revenue", "opex_ratio"), ("ebitda", "pretax"), ("interest", "pretax"), ("cogs", "unused")]
_EDGES_CTE = "edges AS (" + values_sql("src, dst", _EDGES) + ")"


def _graph() -> Graph:
    return parse(_MODEL)


@register("graph_edges", values_sql("src, dst", _EDGES))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph().tables(spark)[1].select(F.col("from").alias("src"), F.col("to").alias("dst"))


@register("dirty_cone", f"WITH RECURSIVE {_EDGES_CTE}, c(seed, node) AS (SELECT DISTINCT src, src FROM edges UNION SELECT seed, dst FROM c JOIN edges ON node = src) SELECT seed, node FROM c")
def dirty_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph()
    rows = [(s, n) for s in g.nodes if g.dependents(s) for n in sorted(g.cone([s]))]
    return spark.createDataFrame(rows, "seed string, node string")


@register("dirty_cone_rows", ORACLES["dirty_cone"])
def dirty_cone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the edge table, by a recursive query; for graphs that are data."""
    graph_edges(spark, sf_dir).createOrReplaceTempView("__edges")
    return spark.sql("WITH RECURSIVE c(seed, node) AS (SELECT DISTINCT src, src FROM __edges UNION ALL SELECT seed, dst FROM c JOIN __edges ON node = src) SELECT DISTINCT seed, node FROM c")


@register("needed_closure", f"WITH RECURSIVE {_EDGES_CTE}, c(target, node) AS (SELECT DISTINCT dst, dst FROM edges UNION SELECT target, src FROM c JOIN edges ON node = dst) SELECT target, node FROM c")
def needed_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph()
    return spark.createDataFrame([(n.name, m) for n in g.of_kind("computed") for m in sorted(g.closure([n.name]))], "target string, node string")


@register("topo_levels", f"WITH RECURSIVE {_EDGES_CTE}, p(node, depth) AS (SELECT DISTINCT dst, 1 FROM edges WHERE dst IN (SELECT dst FROM edges) UNION SELECT e.dst, depth + 1 FROM p JOIN edges e ON e.src = node) SELECT node, CAST(max(depth) AS BIGINT) AS depth FROM p GROUP BY node")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, d) for d, level in enumerate(_graph().levels(), 1) for n in level], "node string, depth long")


@register("graph_nodes", values_sql("id, kind, type, output", [(n, k, t, n in ("pretax", "opex_ratio")) for n, k, t in (
    *((x, "input", "money[ZAR]") for x in ("revenue", "cogs", "opex", "debt")), ("rate", "const", "percentage"), *((x, "computed", "money[ZAR]") for x in ("gross_profit", "ebitda", "interest", "pretax", "unused")), ("opex_ratio", "computed", "ratio"))]))
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = FinancialModel.from_ir(_graph(), spark=spark)
    return m.module.tables(spark, m.types())[0]


@register("expr_round_trip", values_sql("text, printed", [
    ("a + b * c", "a + b * c"), ("(a + b) * c", "(a + b) * c"), ("a - (b - c)", "a - (b - c)"), ("a / b / c", "a / b / c"), ("a / (b / c)", "a / (b / c)"), ("-a", "0 - a"),
    ("growth(a, 5%) - 2", "growth(a, 5%) - 2"), ("npv(0.1, a, b, c)", "npv(0.1, a, b, c)"), ("1e3 * x.y", "1000 * x.y")]))
def expr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .expr import to_text

    texts = ["a + b * c", "(a + b) * c", "a - (b - c)", "a / b / c", "a / (b / c)", "-a", "growth(a, 5%) - 2", "npv(0.1, a, b, c)", "1e3 * x.y"]
    return spark.createDataFrame([(t, to_text(parse_expr(t))) for t in texts], "text string, printed string")


@register("pass_report", values_sql("pass, item, n", [
    ("validation", "ok", 1), ("validation", "nodes", 7), ("type_check", "typed_nodes", 7), ("constant_folding", "folded_nodes", 3), ("common_subexpression_elimination", "hoisted", 1),
    ("dead_node_elimination", "removed", 3), ("dependency_pruning", "reachable", 5), ("scenario_vectorization", "vectorizable_nodes", 3), ("scenario_vectorization", "total_computed", 3),
    ("kernel_fusion", "fusable_chains", 3), ("cache_planning", "cacheable_nodes", 3), ("cache_planning", "inputs", 2)]).replace("SELECT *", "SELECT pass, item, CAST(n AS BIGINT) AS n"))
def pass_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = parse("input a: scalar; input b: scalar; const k = 2; c = k * 3 + 1; x = a + b + c; y = (a + b) * k; z = a * 5; output x, y")
    return spark.createDataFrame(compile_module(g).report.rows(), "pass string, item string, n long")


# -- series
_YEARS = lens.series_sql("region", "year")
_MONTHS = lens.series_sql("nation", "month")
_FLOWS = f"SELECT entity, t, CASE WHEN t = 0 THEN -cogs - opex ELSE (value - cogs - opex) * 0.4::DOUBLE END AS cf FROM ({_YEARS})"
_RETURNS = f"SELECT entity, t, (value - prev) / prev AS r FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY t) AS prev FROM ({_MONTHS})) WHERE prev IS NOT NULL"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.series(spark, sf_dir, "region", "year").select("entity", "t", F.expr("CASE WHEN t = 0 THEN -cogs - opex ELSE (value - cogs - opex) * 0.4D END").alias("cf"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = series.period_change(lens.series(spark, sf_dir, "nation", "month", ("value",)), ["entity"], "t", "value", "r", relative=True)
    return got.where("r IS NOT NULL").select("entity", "t", "r")


@register("k_npv", f"SELECT entity, round(sum(cf / pow(1.1, t)), 2) AS npv FROM ({_FLOWS}) GROUP BY entity")
def k_npv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.npv(flows(spark, sf_dir), ["entity"], "t", "cf", 0.1), ["entity"], {"npv": 2})


@register("k_npv_array", ORACLES["k_npv"])
def k_npv_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel over a series held as an array, inside a model."""
    rows = series.collect_series(flows(spark, sf_dir), ["entity"], "t", "cf", "cashflows")
    m = FinancialModel("dcf").input("cashflows", type="series[money[ZAR],year]").input("discount_rate", 0.1).bind(rows)
    df = templates.dcf(m).output("enterprise_value").evaluate().frame
    return df.select("entity", F.round("enterprise_value", 2).alias("npv"))


def _bisection_sql(years: str) -> str:
    at = lambda r: f"list_sum(list_transform(list_zip(cf, yr), lambda p: p[1] / pow(1 + ({r}), p[2])))"
    return f"""WITH RECURSIVE f AS (SELECT entity, list(cf ORDER BY t) AS cf, list(CAST({years} AS DOUBLE) ORDER BY t) AS yr FROM ({_FLOWS}) GROUP BY entity),
    b AS (SELECT entity, cf, yr, -0.9999::DOUBLE AS lo, 10::DOUBLE AS hi, {at("-0.9999")} AS flo, 0 AS k, NULL::DOUBLE AS root FROM f WHERE {at("-0.9999")} * {at("10")} <= 0
        UNION ALL SELECT entity, cf, yr, CASE WHEN flo * fm < 0 THEN lo ELSE m END, CASE WHEN flo * fm < 0 THEN m ELSE hi END, CASE WHEN flo * fm < 0 THEN flo ELSE fm END, k + 1, CASE WHEN abs(fm) < 1e-9 THEN m END
        FROM (SELECT *, {at("m")} AS fm FROM (SELECT *, 0.5 * (lo + hi) AS m FROM b WHERE k < 200 AND root IS NULL)))
    SELECT entity, round(coalesce(max(root), max_by(0.5 * (lo + hi), k)), 9) AS irr FROM b GROUP BY entity"""


@register("k_irr", _bisection_sql("t"))
def k_irr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.irr(flows(spark, sf_dir), ["entity"], "t", "cf"), ["entity"], {"irr": 9})


@register("k_xirr", _bisection_sql("t * 0.75"))
def k_xirr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flows(spark, sf_dir).withColumn("yr", F.col("t") * 0.75)
    return rounded(series.irr(df, ["entity"], "t", "cf", years="yr"), ["entity"], {"irr": 9})


@register("k_variance", f"SELECT entity, round(var_pop(r), 9) AS variance FROM ({_RETURNS}) GROUP BY entity")
def k_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.variance(returns(spark, sf_dir), ["entity"], "r"), ["entity"], {"variance": 9})


@register("k_volatility", f"SELECT entity, round(stddev_pop(r), 9) AS volatility FROM ({_RETURNS}) GROUP BY entity")
def k_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.volatility(returns(spark, sf_dir), ["entity"], "r"), ["entity"], {"volatility": 9})


@register("k_var95", f"SELECT entity, round(-quantile_cont(r, 0.05), 9) AS var FROM ({_RETURNS}) GROUP BY entity")
def k_var95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.value_at_risk(returns(spark, sf_dir), ["entity"], "r"), ["entity"], {"var": 9})


@register("k_cvar95", f"SELECT entity, round(-avg(r), 9) AS cvar FROM (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY entity) AS q FROM ({_RETURNS})) WHERE r <= q GROUP BY entity")
def k_cvar95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.expected_shortfall(returns(spark, sf_dir), ["entity"], "r"), ["entity"], {"cvar": 9})


@register("k_drawdown", f"SELECT entity, round(max((top - value) / top), 9) AS drawdown FROM (SELECT *, max(value) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS top FROM ({_MONTHS})) GROUP BY entity")
def k_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.drawdown(lens.series(spark, sf_dir, "nation", "month", ("value",)), ["entity"], "t", "value")
    return rounded(df, ["entity"], {"drawdown": 9})


@register("t_return_risk", f"SELECT entity, round(stddev_pop(r), 9) AS volatility, round(-quantile_cont(r, 0.05), 9) AS value_at_risk, round(-avg(r) FILTER (WHERE r <= q), 9) AS shortfall, round(var_pop(r), 9) AS spread FROM (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY entity) AS q FROM ({_RETURNS})) GROUP BY entity")
def t_return_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk kernels over arrays, inside a model."""
    rows = series.collect_series(returns(spark, sf_dir), ["entity"], "t", "r", "returns")
    m = templates.return_risk(FinancialModel("risk").input("returns", type="series[scalar,month]").bind(rows))
    m.define("shortfall", "cvar(returns)").define("spread", "variance(returns)").output("volatility", "value_at_risk", "shortfall", "spread")
    return rounded(m.evaluate().frame, ["entity"], {c: 9 for c in m.module.outputs})


@register("mom_change", f"SELECT entity, t, round(value - prev, 4) AS change, round((value - prev) / prev, 9) AS share FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY t) AS prev FROM ({_MONTHS}))")
def mom_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.period_change(lens.series(spark, sf_dir, "nation", "month", ("value",)), ["entity"], "t", "value")
    df = series.period_change(df, ["entity"], "t", "value", "share", relative=True)
    return rounded(df, ["entity", "t"], {"change": 4, "share": 9})


@register("series_elementwise", f"SELECT entity, t, round(value * 1.05::DOUBLE - cogs, 2) AS margin FROM ({_YEARS})")
def series_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic between series held as arrays, exploded again."""
    rows = series.collect_series(lens.series(spark, sf_dir, "region", "year", ("value", "cogs")), ["entity"], "t", "value", "sales", costs="cogs")
    m = FinancialModel("s").input("sales", type="series[money[ZAR],year]").input("costs", type="series[money[ZAR],year]").bind(rows)
    df = m.define("margin", "sales * 1.05 - costs", output=True).evaluate().frame
    return series.explode_series(df, "margin", "t", "m").select("entity", F.col("t").cast("long").alias("t"), F.round("m", 2).alias("margin"))


@register("rollup_consolidation", f"SELECT r_name AS region, entity AS nation, round(sum(revenue), 2) AS total, CAST(grouping(r_name) * 2 + grouping(entity) AS BIGINT) AS level FROM ({lens.profit_and_loss_sql('nation')}) JOIN nation ON entity = n_name JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, entity)")
def rollup_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = lens.table(spark, sf_dir, "nation").join(lens.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    rows = lens.profit_and_loss(spark, sf_dir, "nation").withColumnRenamed("entity", "nation").join(places, "nation")
    return series.consolidate(rows, ["region", "nation"], "revenue").select("region", "nation", F.round("total", 2).alias("total"), "level")


# -- scenarios
def _pl_model(spark: SparkSession, sf_dir: str, entity: str = "region") -> FinancialModel:
    m = company(lens.profit_and_loss(spark, sf_dir, entity))
    return m.define("gross_profit", "revenue - cogs").define("ebitda", "gross_profit - opex").define("opex_ratio", "opex / revenue").output("ebitda", "opex_ratio")


_PL = lens.profit_and_loss_sql()
_OUT = {"ebitda": 2, "opex_ratio": 9}


@register("what_if_cogs_up", f"SELECT entity, round(revenue - cogs * 1.04::DOUBLE - opex, 2) AS ebitda, round(opex / revenue, 9) AS opex_ratio FROM ({_PL})")
def what_if_cogs_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pl_model(spark, sf_dir).what_if(cogs="+4%").frame, ["entity"], _OUT)


@register("what_if_simultaneous", f"SELECT entity, round(revenue * 0.92::DOUBLE - (cogs + 1000) - 500, 2) AS ebitda, round(500 / (revenue * 0.92::DOUBLE), 9) AS opex_ratio FROM ({_PL})")
def what_if_simultaneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pl_model(spark, sf_dir).what_if({"revenue": "-8%", "cogs": {"delta": 1000}, "opex": 500}).frame, ["entity"], _OUT)


@register("named_scenarios", f"""SELECT s.scenario, entity, round(revenue * ru - (cogs * cu + cd) - opex, 2) AS ebitda, round(opex / (revenue * ru), 9) AS opex_ratio FROM ({_PL}),
    (VALUES ('base', 1::DOUBLE, 1::DOUBLE, 0::DOUBLE), ('upside', 1.1::DOUBLE, 1::DOUBLE, 0::DOUBLE), ('downside', 0.92::DOUBLE, 1.05::DOUBLE, 0::DOUBLE), ('shock', 1::DOUBLE, 1::DOUBLE, 5000::DOUBLE)) AS s(scenario, ru, cu, cd)""")
def named_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"base": {}, "upside": {"revenue": "+10%"}, "downside": {"revenue": "-8%", "cogs": {"relative": 0.05}}, "shock": {"cogs": {"delta": 5000}}}
    return rounded(_pl_model(spark, sf_dir).scenario_frame(spec), ["scenario", "entity"], _OUT)


@register("range_sweep", f"SELECT CAST(i AS BIGINT) AS scenario_id, entity, round(revenue - (1000 + i * (99000::DOUBLE / 100)) - opex, 2) AS ebitda, round(opex / revenue, 9) AS opex_ratio FROM ({_PL}), range(101) AS r(i)")
def range_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pl_model(spark, sf_dir).sweep("cogs", 1000.0, 100000.0, 101).frame, ["scenario_id", "entity"], _OUT)


@register("batch_zip", f"SELECT CAST(i AS BIGINT) AS scenario_id, entity, round(revenue - i * 1000 - 5000, 2) AS ebitda, round(5000 / revenue, 9) AS opex_ratio FROM ({_PL}), range(50) AS r(i)")
def batch_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrays by position, the second of one value."""
    return rounded(_pl_model(spark, sf_dir).run_scenarios(cogs=[1000.0 * i for i in range(50)], opex=[5000.0]).frame, ["scenario_id", "entity"], _OUT)


@register("batch_customers", "SELECT CAST(i AS BIGINT) AS scenario_id, c_custkey, round(c_acctbal * (1 + i / 100::DOUBLE) * 0.28::DOUBLE, 6) AS tax, round(c_acctbal * (1 + i / 100::DOUBLE) * 0.72::DOUBLE, 6) AS net FROM customer, range(20) AS r(i)")
def batch_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer under twenty scenarios whose factor is a column of the scenario rows."""
    rows = lens.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    m = FinancialModel("tax").input("balance", currency="ZAR").input("uplift", 0.0).bind(rows)
    m.define("grown", "balance * (1 + uplift)").define("tax", "grown * 0.28", output=True).define("net", "grown * 0.72", output=True)
    scenarios = spark.range(20).select(F.col("id").alias("scenario_id"), (F.col("id") / 100).alias("u"))
    return rounded(m.run_frame(scenarios, {"uplift": "u"}).frame, ["scenario_id", "c_custkey"], {"tax": 6, "net": 6})


_SPECS = [("+8%", 100.0, 108.0), ("-8%", 100.0, 92.0), ("30d->60d", 30.0, 60.0), ("60", 30.0, 60.0), ("60 days", 30.0, 60.0), ("8%", 100.0, 8.0), ("+8", 100.0, 8.0), ("+ 12.5 %", 200.0, 225.0), ("soon", 1.0, None)]


@register("change_specs", values_sql("spec, present, result", _SPECS))
def change_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(s, c) for s, c, _ in _SPECS], "spec string, present double")
    return df.select("spec", "present", F.round(changes.change_column(F.col("spec"), F.col("present")), 9).alias("result"))


def _golden_model(spark: SparkSession) -> FinancialModel:
    m = FinancialModel("income", spark=spark)
    for n, v in (("revenue", 500e6), ("cogs", 300e6), ("opex", 120e6), ("debt", 80e6)):
        m.input(n, v, currency="ZAR")
    m.input("rate", 0.11).define("gross_profit", "revenue - cogs").define("ebitda", "gross_profit - opex")
    return m.define("interest", "debt * rate").define("opex_ratio", "opex / revenue").output("ebitda", "interest", "opex_ratio")


@register("state_chain", values_sql("step, revenue, cogs, ebitda", [(0, 500e6, 300e6, 80e6), (1, 500e6, 330e6, 50e6), (2, 550e6, 330e6, 100e6), (3, 550e6, 250e6, 180e6)]).replace("SELECT *", "SELECT CAST(step AS BIGINT) AS step, revenue::DOUBLE AS revenue, cogs::DOUBLE AS cogs, ebitda::DOUBLE AS ebitda"))
def state_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of states as rows of one evaluation."""
    m = _golden_model(spark)
    chain = [m.state()]
    for change in ({"relative": 0.10, "name": "cogs"}, {"delta": 50e6, "name": "revenue"}, {"absolute": 250e6, "name": "cogs"}):
        chain.append(chain[-1].with_change(change.pop("name"), **change))
    rows = spark.createDataFrame([(i, *(float(s.values[n]) for n in ("revenue", "cogs", "opex", "debt", "rate"))) for i, s in enumerate(chain)], "step long, revenue double, cogs double, opex double, debt double, rate double")
    df = _golden_model(spark).bind(rows).evaluate(["revenue", "cogs", "ebitda"]).frame
    return rounded(df, ["step"], {"revenue": 2, "cogs": 2, "ebitda": 2})


_ACCOUNTS = [
    ("1 first", 4, 0), ("2 repeat", 0, 4), ("3 set cogs", 2, 2), ("4 what-if debt", 1, 3), ("5 scenario base", 0, 4), ("6 scenario up", 3, 1), ("7 batch cogs", 2, 2), ("8 state", 4, 0),
]


@register("reuse_accounting", values_sql("step, recomputed, reused", _ACCOUNTS).replace("SELECT *", "SELECT step, CAST(recomputed AS BIGINT) AS recomputed, CAST(reused AS BIGINT) AS reused"))
def reuse_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _golden_model(spark)
    runs = [m.evaluate(), m.evaluate(), m.set("cogs", 312e6).evaluate(), m.what_if(debt="+5%")]
    runs += m.scenarios({"base": {}, "up": {"revenue": "+10%"}}).values()
    runs += [m.run_scenarios(cogs=[1.0, 2.0]), m.evaluate_state(m.state())]
    return spark.createDataFrame([(a[0], len(r.recomputed), len(r.reused)) for a, r in zip(_ACCOUNTS, runs, strict=True)], "step string, recomputed long, reused long")


# -- templates
@register("t_operating_model", f"SELECT entity, round((revenue - cogs) / revenue, 9) AS gross_margin, round(revenue - cogs - opex - inventory * 0.1::DOUBLE - opex * 0.28::DOUBLE - inventory * 0.02::DOUBLE, 4) AS free_cash_flow FROM ({lens.profit_and_loss_sql('segment')})")
def t_operating_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lens.profit_and_loss(spark, sf_dir, "segment").withColumns({"capex": F.expr("inventory * 0.1D"), "tax": F.expr("opex * 0.28D"), "wc_change": F.expr("inventory * 0.02D")})
    m = FinancialModel("operating")
    for n in ("revenue", "cogs", "opex", "capex", "tax", "wc_change"):
        m.input(n, currency="ZAR")
    df = templates.operating_model(m.bind(rows.drop("receivable_days", "payable_days", "inventory"))).output("gross_margin", "free_cash_flow").evaluate().frame
    return rounded(df, ["entity"], {"gross_margin": 9, "free_cash_flow": 4})


@register("t_working_capital", f"SELECT entity, round(revenue * (receivable_days / 365), 4) AS receivables, round(cogs * (payable_days / 365), 4) AS payables, round(revenue * (receivable_days / 365) + inventory - cogs * (payable_days / 365), 4) AS net_working_capital FROM ({lens.profit_and_loss_sql('segment')})")
def t_working_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = templates.working_capital(company(lens.profit_and_loss(spark, sf_dir, "segment"))).output("receivables", "payables", "net_working_capital")
    return rounded(m.evaluate().frame, ["entity"], {c: 4 for c in m.module.outputs})


@register("t_dcf", f"SELECT entity, round(sum(cf / pow(1.08, t)), 2) AS enterprise_value FROM ({_FLOWS}) GROUP BY entity")
def t_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.collect_series(flows(spark, sf_dir), ["entity"], "t", "cf", "cashflows")
    m = FinancialModel("dcf").input("cashflows", type="series[money[ZAR],year]").input("discount_rate", 0.08).bind(rows)
    return rounded(templates.dcf(m).output("enterprise_value").evaluate().frame, ["entity"], {"enterprise_value": 2})


@register("t_saas", "SELECT entity, round(1 / churn, 6) AS lifetime_months, round(arpu * 0.8::DOUBLE * (1 / churn), 4) AS ltv, round(arpu * 0.8::DOUBLE * (1 / churn) / 50, 6) AS ltv_cac FROM (SELECT event_type AS entity, round(avg(value), 6) AS arpu, round(count(DISTINCT user_id) / count(*)::DOUBLE, 6) AS churn FROM events GROUP BY event_type)")
def t_saas(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lens.table(spark, sf_dir, "events")
    rows = events.groupBy(F.col("event_type").alias("entity")).agg(F.round(F.avg("value"), 6).alias("arpu"), F.round(F.count_distinct("user_id") / F.count("*"), 6).alias("monthly_churn"))
    m = FinancialModel("saas").input("arpu", currency="ZAR").input("gross_margin_pct", 0.8, type="ratio").input("monthly_churn", type="ratio").input("cac", 50.0, currency="ZAR")
    df = templates.saas(m.bind(rows)).output("lifetime_months", "ltv", "ltv_cac").evaluate().frame
    return rounded(df, ["entity"], {"lifetime_months": 6, "ltv": 4, "ltv_cac": 6})


# -- intents
_op = lambda kind, target, **more: {"operation": kind, "target": target} | more
_PAYLOADS: list[tuple[str, dict, int]] = [
    ("absolute", {"schema_version": "1.0", "status": "valid", "operations": [_op("absolute_change", "opex", value=5e6, currency="ZAR")]}, 0),
    ("bad currency", {"schema_version": "1.0", "status": "valid", "operations": [_op("set", "opex", value=5e6, currency="rand")]}, 1),
    ("bad unit", {"schema_version": "1.0", "status": "valid", "operations": [_op("set", "opex", value=5e6, unit="bananas")]}, 1),
    ("duplicates", {"schema_version": "1.0", "status": "valid", "operations": [_op("set", "opex", value=1), _op("set", "opex", value=2)]}, 1),
    ("lone range", {"schema_version": "1.0", "status": "valid", "operations": [_op("range", "cogs", min=1, max=2, steps=10)]}, 0),
    ("missing value", {"schema_version": "1.0", "status": "valid", "operations": [_op("relative_change", "cogs")]}, 1),
    ("mixed range", {"schema_version": "1.0", "status": "valid", "operations": [_op("range", "cogs", min=1, max=2, steps=1), _op("set", "opex", value=2)]}, 2),
    ("ops on ambiguous", {"schema_version": "1.0", "status": "ambiguous", "operations": [_op("set", "opex", value=2)]}, 1),
    ("range in scenario", {"schema_version": "1.0", "status": "valid", "scenarios": [{"name": "a", "operations": [_op("range", "cogs", min=1, max=2, steps=3)]}, {"name": "", "operations": []}]}, 2),
    ("relative", {"schema_version": "1.0", "status": "valid", "operations": [_op("change", "cogs", value=0.04)]}, 0),
    ("relative with unit", {"schema_version": "1.0", "status": "valid", "operations": [_op("relative_change", "cogs", value=0.04, unit="money")]}, 1),
    ("scenarios", {"schema_version": "1.0", "status": "valid", "scenarios": [{"name": "base", "operations": []}, {"name": "up", "operations": [_op("relative_change", "revenue", value=0.1)]}]}, 0),
    ("unsupported", {"schema_version": "1.0", "status": "unsupported", "reason": "x", "operations": []}, 0),
    ("wrong version", {"schema_version": "2.0", "status": "valid", "operations": [_op("set", "opex", value=2)]}, 1),
]


def _payload_rows(spark: SparkSession) -> DataFrame:
    return intents.parse_rows(spark.createDataFrame([(i, json.dumps(p)) for i, p, _ in _PAYLOADS], "id string, payload string"))


@register("intent_structural", values_sql("id, errors", [(i, n) for i, _, n in _PAYLOADS]).replace("SELECT *", "SELECT id, CAST(errors AS BIGINT) AS errors"))
def intent_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payload_rows(spark).select("id", F.size(intents.structural_errors_column()).cast("long").alias("errors"))


_SEMANTIC = [
    ("a", "set", "revenue", "money", "ZAR", None), ("b", "set", "revenue", None, "USD", "currency mismatch"), ("c", "set", "cogs", "days", None, "unit mismatch"), ("d", "set", "payment_terms", "days", None, None),
    ("e", "set", "payment_terms", None, "ZAR", "no currency expected"), ("f", "set", "profit", None, None, "not an input"), ("g", "relative_change", "payment_terms", None, None, None), ("h", "set", "rate", "percentage", None, None),
]


@register("intent_semantic", values_sql("id, problem", [(r[0], r[5]) for r in _SEMANTIC]))
def intent_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = spark.createDataFrame([r[:5] for r in _SEMANTIC], "id string, operation string, target string, unit string, currency string")
    inputs = spark.createDataFrame([("revenue", "money", "ZAR"), ("cogs", "money", "ZAR"), ("opex", "money", "ZAR"), ("payment_terms", "days", None), ("rate", "percentage", None)], "name string, kind string, currency string")
    return intents.semantic_rows(ops, inputs).select("id", "problem")


@register("intent_execute", f"""SELECT 'absolute' AS id, NULL AS scenario, entity, round(revenue - cogs - (opex + 5000), 2) AS ebitda FROM ({_PL}) UNION ALL SELECT 'relative', NULL, entity, round(revenue - cogs * 1.04::DOUBLE - opex, 2) FROM ({_PL})
    UNION ALL SELECT 'scenarios', s, entity, round(revenue * f - cogs - opex, 2) FROM ({_PL}), (VALUES ('base', 1::DOUBLE), ('up', 1.1::DOUBLE)) AS v(s, f)""")
def intent_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _pl_model(spark, sf_dir)
    one = lambda i, s, e: e.frame.select(F.lit(i).alias("id"), F.lit(s).cast("string").alias("scenario"), "entity", F.round("ebitda", 2).alias("ebitda"))
    out = one("absolute", None, m.apply_intent({"status": "valid", "operations": [_op("delta", "opex", value=5000, currency="ZAR")]}))
    out = out.union(one("relative", None, m.apply_intent(_op("change", "cogs", value=0.04))))
    for label, e in m.apply_intent(dict(_PAYLOADS[11][1])).items():
        out = out.union(one("scenarios", label, e))
    return out


_TEXTS: list[tuple[str, str, str | None, str | None, float | None, str | None, str | None]] = [
    # text, status, operation, target, value, unit, currency
    ("Increase revenue by 8%", "valid", "relative_change", "revenue", 0.08, None, None),
    ("Supplier costs decrease 5%", "valid", "relative_change", "cogs", -0.05, None, None),
    ("Extend payment terms from 30 to 60 days", "valid", "set", "payment_terms", 60.0, "days", None),
    ("Set the interest rate to 9.5%", "valid", "set", "interest_rate", 0.095, "percentage", None),
    ("Set opex to 45%", "ambiguous", None, None, None, None, None),
    ("Raise capex by R5,000,000", "valid", "absolute_change", "capex", 5_000_000.0, None, "ZAR"),
    ("Cut opex by five million rand", "valid", "absolute_change", "opex", -5_000_000.0, None, "ZAR"),
    ("Boost sales volume by twelve percent", "valid", "relative_change", "volume", 0.12, None, None),
    ("Set cash to $250000", "valid", "set", "cash", 250_000.0, None, "USD"),
    ("Make revenue better", "ambiguous", None, None, None, None, None),
    ("Fire 100 employees", "unsupported", None, None, None, None, None),
    ("Acquire a competitor", "unsupported", None, None, None, None, None),
    ("Raise revenue by 5% and raise sales by 3%", "ambiguous", None, None, None, None, None),
]


@register("nl_intent", values_sql("text, status, operation, target, value, unit, currency", _TEXTS))
def nl_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = nl.compile_rows(spark.createDataFrame([(t[0],) for t in _TEXTS], "text string"))
    o = F.get("operations", F.lit(0))
    return df.select("text", "status", *[o[c].alias(c) for c in ("operation", "target", "value", "unit", "currency")])


@register("nl_scores")
def nl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark)["overall"]


def _scores(spark: SparkSession) -> dict[str, DataFrame]:
    """Scores of four labelled instructions, one of which the rules read wrongly."""
    valid = lambda *ops: {"schema_version": "1.0", "status": "valid", "operations": list(ops)}
    none = {"schema_version": "1.0", "status": "ambiguous", "operations": []}
    rows = [
        ("1", "core", "Increase revenue by 8%", valid(_op("relative_change", "revenue", value=0.08))),
        ("2", "core", "Cut opex by 5% and raise capex by 2%", valid(_op("relative_change", "opex", value=-0.05), _op("relative_change", "capex", value=0.02))),
        ("3", "stress", "Slash opex by 12%", valid(_op("relative_change", "opex", value=-0.12))),
        ("4", "stress", "Improve margins", none),
    ]
    df = spark.createDataFrame([(i, d, t, json.dumps(e)) for i, d, t, e in rows], "id string, difficulty string, text string, payload string")
    predicted = nl.compile_rows(df.select("id", "text"))
    return nl.score(intents.parse_rows(df), predicted)


_SCORES = [(None, 4, 1.0, 1.0, 1.0, 0.75, 1.0, 1.0, 1.0, 1.0), ("core", 2, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None, None), ("stress", 2, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0)]
_SCORE_COLUMNS = "difficulty, n, status_accuracy, operation_accuracy, target_accuracy, value_accuracy, unit_accuracy, currency_accuracy, refusal_precision, refusal_recall"
ORACLES["nl_scores"] = values_sql(_SCORE_COLUMNS, _SCORES).replace("SELECT *", "SELECT difficulty, CAST(n AS BIGINT) AS n, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SCORE_COLUMNS.split(", ")[2:]))


@register("nl_confusion", values_sql("expected, predicted, count", [("valid", "valid", 3), ("ambiguous", "ambiguous", 1)]).replace("SELECT *", "SELECT expected, predicted, CAST(count AS BIGINT) AS count"))
def nl_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark)["confusion"]


@register("event_pressure", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_pressure(lens.table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


from . import queries_surface  # noqa: E402, F401  (registers the rest)
