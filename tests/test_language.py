"""Expressions, types, graphs and passes: no Spark needed."""

import pytest

from finmodel import compile_model, parse
from finmodel.errors import CurrencyError, ParseError, TypeRuleError, ValidationError
from finmodel.expr import Bin, Call, Lit, Ref, free_refs, from_json, parse_expr, structural_key, to_json, to_text
from finmodel.functions.kernels import Registry, default_registry, kernel
from finmodel.graph import Graph, Node
from finmodel.types import PERCENTAGE, binary_result, currency_of, is_money, money, parse_type

TEXT = """
model income {
  input revenue: money[ZAR]   # sales
  cogs = input money[ZAR]; input opex: money[ZAR] // costs
  const tax_rate = 0.28 : percentage
  gross_profit = revenue - cogs
  ebitda = gross_profit - opex
  tax = ebitda * tax_rate
  output ebitda, tax
}
"""


@pytest.mark.parametrize("text", ["a + b * c", "(a + b) * c", "a - (b - c)", "a / (b / c)", "growth(a, 5%) - 2", "npv(0.1, a, b)", "f()", "x.y * 1000"])
def test_expressions_print_and_parse_back(text):
    e = parse_expr(text)
    assert to_text(e) == text and parse_expr(to_text(e)) == e and from_json(to_json(e)) == e


def test_precedence_and_literals():
    assert parse_expr("a - b - c") == Bin("-", Bin("-", Ref("a"), Ref("b")), Ref("c"))
    assert parse_expr("4%") == Lit(0.04, PERCENTAGE)
    assert parse_expr("-2 * a") == Bin("*", Lit(-2.0), Ref("a"))
    assert parse_expr("f(a, g(b), 1)") == Call("f", (Ref("a"), Call("g", (Ref("b"),)), Lit(1.0)))
    assert free_refs(parse_expr("f(a, b) + a")) == {"a", "b"}
    assert structural_key(parse_expr("a + b")) != structural_key(parse_expr("b + a"))


@pytest.mark.parametrize("text", ["", "a +", "(a", "a)", "f(a,)", "f(,a)", "a b", "a ? b", "* a", "a , b", "()"])
def test_bad_expressions(text):
    with pytest.raises(ParseError):
        parse_expr(text)


def test_long_sums_do_not_recurse():
    e = parse_expr(" + ".join(f"n{i}" for i in range(20_000)))
    assert len(free_refs(e)) == 20_000 and to_text(e).count("+") == 19_999


def test_type_rules():
    zar, usd, t = money("ZAR"), money("USD"), parse_type
    assert binary_result("+", zar, zar) == zar and binary_result("/", zar, zar).kind == "ratio"
    for op in "+-/":
        with pytest.raises(CurrencyError):
            binary_result(op, zar, usd)
    for op, a, b in (("+", "scalar", "percentage"), ("*", "money", "money"), ("+", "rate[day]", "rate[day]"), ("+", "bool", "bool"), ("^", "scalar", "scalar")):
        with pytest.raises(TypeRuleError):
            binary_result(op, t(a), t(b))
    assert binary_result("*", t("series[money[ZAR],month]"), t("scenario[ratio]")).textual() == "scenario[money[ZAR]]"
    assert t("PCT") == PERCENTAGE and t("money") == zar and t("quantity[]").arg == "units" and t("rate[]").arg == "year"
    for bad in ("quantity", "rate", "series[scalar]", "text"):
        with pytest.raises(TypeRuleError):
            t(bad)
    s = t("series[money[USD],quarter]")
    assert is_money(s) and currency_of(s) == "USD" and t(s.textual()) == s


def test_unary_minus_keeps_the_type():
    g = parse("input a: money[ZAR]; b = -a; c = 1 - 2")
    assert g.infer_types(default_registry().result_type)["b"] == money("ZAR")


def test_graph_text_and_json_round_trip():
    g = parse(TEXT)
    assert parse(g.to_text()).to_json() == g.to_json() == Graph.from_json(g.to_json()).to_json()
    assert g.outputs == ["ebitda", "tax"] and g.nodes["tax_rate"].value == 0.28
    assert g.topo_order().index("gross_profit") < g.topo_order().index("ebitda")
    assert g.cone(["cogs"]) == {"cogs", "gross_profit", "ebitda", "tax"}
    assert g.closure(["gross_profit"]) == {"gross_profit", "revenue", "cogs"}
    assert g.dependents("ebitda") == ["tax"] and g.dependencies("ebitda") == ["gross_profit", "opex"]
    assert '"cogs" -> "gross_profit"' in g.to_dot(g.infer_types(default_registry().result_type))


@pytest.mark.parametrize("text", ["a = input scalar; b = a + c; c = b + a", "input a: scalar; b = a + missing", "a = a + 1", "input a: scalar; output z", ""])
def test_invalid_graphs(text):
    with pytest.raises(ValidationError):
        parse(text).validate()


@pytest.mark.parametrize("text", ["nonsense", "const a = 5%", "const a = +1", "input a"])
def test_bad_statements(text):
    with pytest.raises(ParseError):
        parse(text)


def test_duplicate_nodes():
    g = Graph()
    g.add(Node("a", "input"))
    with pytest.raises(ValidationError):
        g.add(Node("a", "input"))


def test_passes():
    folded = compile_model("const a = 2; const b = 3; c = a * b + 1; output c").module.nodes["c"].expr
    assert folded == Lit(7.0)
    dead = compile_model("input a: scalar; input b: scalar; used = a + 1; unused = b * 5; output used")
    assert dead.report.details["dead_node_elimination"]["removed"] == 2
    shared = compile_model("input a: scalar; input b: scalar; x = a + b; y = (a + b) * 2; output x, y")
    assert shared.report.details["common_subexpression_elimination"]["hoisted"] == 1
    large = compile_model("input a: scalar; input b: scalar; x = (a + b) * a - 1; y = 2 - (a + b) * a; z = growth(a, b) + growth(a, b); output x, y, z")
    assert large.report.details["common_subexpression_elimination"]["hoisted"] == 2  # a + b only stands inside a shared product
    assert len(shared.report.passes) == 9 and shared.types["y"].kind == "scalar"
    with pytest.raises(ValueError):
        compile_model("a = 1", pipeline=["nothing"])


def test_registry():
    reg = Registry(default_registry())
    assert len(reg.names()) >= 33
    kernel("landed", arity=2, registry=reg)(lambda a, b: f"({a} + {b})")
    assert reg.has("landed") and not default_registry().has("landed")
    from finmodel.errors import KernelError

    with pytest.raises(KernelError):
        reg.add("landed", lambda p, a: a, lambda t: t[0])
    with pytest.raises(KernelError):
        reg.result_type("growth", [money("ZAR")])
    with pytest.raises(KernelError):
        reg.get("nothing")
    assert reg.result_type("fx_convert.USD", [money("ZAR"), parse_type("scalar")]) == money("USD")
