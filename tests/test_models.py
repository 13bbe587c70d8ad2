"""Models on Spark: values, reuse accounting, scenarios, batches, kernels against NumPy."""

import math
import random

import numpy as np
import pytest

from finmodel import FinancialModel, NumericPolicy, Registry, default_registry, kernel, parse
from finmodel.errors import CurrencyError, ExecutionError, IntentError, ValidationError
from finmodel.operators.changes import resolve_change
from finmodel.plans.planner import Planner, WorkloadProfile
from finmodel.plans.synthetic import incremental_benchmark, segmented


@pytest.fixture
def model(spark):
    m = FinancialModel("income", spark=spark)
    for n, v in (("revenue", 500e6), ("cogs", 300e6), ("opex", 120e6), ("debt", 80e6)):
        m.input(n, v, currency="ZAR")
    m.input("rate", 0.11).input("payment_terms", 30, type="days")
    m.define("gross_profit", "revenue - cogs").define("ebitda", "gross_profit - opex", output=True)
    return m.define("interest", "debt * rate", output=True).define("opex_ratio", "opex / revenue", output=True)


def test_base_and_reuse(model):
    r = model.evaluate()
    assert r.values == {"ebitda": 80e6, "interest": 8.8e6, "opex_ratio": 0.24}
    assert set(r.recomputed) == {"gross_profit", "ebitda", "interest", "opex_ratio"} and not r.reused
    assert model.evaluate().recomputed == []
    w = model.what_if(cogs="+4%")
    assert set(w.recomputed) == {"gross_profit", "ebitda"} and set(w.reused) == {"interest", "opex_ratio"} and w["ebitda"] == 68e6
    assert model.dirty_nodes("debt") == ["debt", "interest"]
    assert model.set("cogs", 300e6).evaluate().stats.nodes_evaluated == 2
    assert 0 < model.cache_stats()["hit_ratio"] < 1


def test_cached_base_gives_the_same(model):
    plain = model.what_if({"cogs": "+4%", "revenue": {"delta": 1e6}}).values
    assert model.cache_base().what_if({"cogs": "+4%", "revenue": {"delta": 1e6}}).values == plain
    model.set("opex", 100e6)
    assert model.evaluate()["ebitda"] == 100e6
    model.invalidate_all()


def test_scenarios_batches_and_states(model):
    got = model.scenarios({"base": {}, "up": {"revenue": "+10%"}, "down": {"revenue": "-8%", "cogs": "+5%"}})
    assert {k: e["ebitda"] for k, e in got.items()} == {"base": 80e6, "up": 130e6, "down": pytest.approx(25e6)}
    assert got["base"].recomputed == [] and "interest" in got["up"].reused
    batch = model.run_scenarios(cogs=np.linspace(300e6, 400e6, 1000), opex=120e6)
    assert len(batch["ebitda"]) == 1000 and batch["ebitda"][0] == 80e6
    assert model.sweep("cogs", 300e6, 400e6, 5)["ebitda"].tolist() == [80e6, 55e6, 30e6, 5e6, -20e6]
    with pytest.raises(ExecutionError):
        model.run_scenarios(cogs=[1, 2, 3], opex=[1, 2])
    s = model.state().with_change("cogs", relative=0.1).with_change("revenue", delta=50e6)
    assert s.changed == ("revenue",) and model.evaluate_state(s)["ebitda"] == pytest.approx(100e6)
    with pytest.raises(ValueError):
        model.state().with_change("cogs")


def test_structure_edits_keep_values_and_bad_targets_are_refused(model):
    model.set("cogs", 310e6).define("margin", "ebitda / revenue", output=True)
    assert model.evaluate()["ebitda"] == 70e6
    for bad in ("ebitda", "nothing"):
        with pytest.raises(ValidationError):
            model.what_if({bad: 1})
    with pytest.raises(CurrencyError):
        model.input("foreign", 1, currency="USD").define("mixed", "foreign + revenue").evaluate()


@pytest.mark.parametrize("spec, current, want", [("+8%", 100, 108), ("-8%", 100, 92), ("30d->60d", 30, 60), (60, 30, 60), ("60", 30, 60), ("8%", 100, 8), ({"relative": 0.5}, 100, 150), ({"delta": 5, "absolute": 1}, 100, 105)])
def test_change_specs(spec, current, want):
    assert resolve_change(current, spec) == pytest.approx(want)


def test_division_policies(spark):
    for policy, want in (("nan", math.nan), ("zero", 0.0)):
        m = FinancialModel(policy=NumericPolicy(on_div_zero=policy), spark=spark).input("a", 1).input("b", 0).define("c", "a / b", output=True)
        assert m.evaluate()["c"] == pytest.approx(want, nan_ok=True)
    for policy in (NumericPolicy(on_div_zero="raise"), NumericPolicy(on_nonfinite="raise")):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO|not finite"):
            FinancialModel(policy=policy, spark=spark).input("a", 1).input("b", 0).define("c", "a / b", output=True).evaluate().values


def test_company_goldens(spark):
    m = FinancialModel(spark=spark)
    for n, v in (("revenue", 500e6), ("cogs", 300e6), ("inventory", 50e6)):
        m.input(n, v, currency="ZAR")
    m.input("receivable_days", 30, type="days").input("payable_days", 45, type="days")
    from finmodel import templates

    v = templates.working_capital(m).evaluate(["receivables", "payables", "net_working_capital"]).values
    assert [round(x, 2) for x in v.values()] == [41095890.41, 36986301.37, 54109589.04]


def is_root(rate, flows, years):
    """Whether the flows' present value vanishes at the rate; without one, whether it has the same sign at both ends of the search."""
    value = lambda r: np.sum(flows * np.exp(-np.log1p(r) * years))
    if math.isnan(rate):
        return value(-0.9999) * value(10.0) > 0
    scale = np.sum(np.abs(flows) * np.exp(-np.log1p(rate) * years))
    return abs(value(rate)) <= 1e-7 * scale and -1.0 < rate <= 10.0


def test_series_kernels_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [([-100.0, 60.0, 60.0], [0.0, 1.0, 2.0]), ([100.0, 110.0, 121.0], [0.0, 1.0, 2.0]), ([5.0], [0.0])]
    rows += [((x := rng.normal(0, 50, n)).tolist(), np.sort(rng.uniform(0, 5, n)).tolist()) for n in rng.integers(2, 30, 25)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, s array<double>, y array<double>")
    m = FinancialModel(spark=spark).input("s", type="series[scalar,month]").input("y", type="series[scalar,month]").bind(df)
    formulas = {"npv": "npv(0.1, s)", "irr": "irr(s)", "xirr": "xirr(s, y)", "variance": "variance(s)", "volatility": "volatility(s)", "var": "var(s)", "cvar": "cvar(s, 0.8)", "drawdown": "drawdown(s)"}
    for n, f in formulas.items():
        m.define(f"k_{n}", f, output=True)
    got = {r["i"]: r for r in m.evaluate().frame.collect()}
    for i, (a, b) in enumerate(rows):
        s, t = np.array(a), np.arange(len(a))
        q, top = np.quantile(s, 1 - 0.8), np.maximum.accumulate(s)
        with np.errstate(all="ignore"):
            fall = np.where(top != 0, (s - top) / top, 0.0)
        want = {"npv": np.sum(s / 1.1**t), "variance": s.var(), "volatility": s.std(), "var": -np.quantile(s, 1 - 0.95), "cvar": -s[s <= q].mean(), "drawdown": -fall.min()}
        assert is_root(got[i]["k_irr"], s, t) and is_root(got[i]["k_xirr"], s, np.array(b))
        for n, w in want.items():
            assert got[i][f"k_{n}"] == pytest.approx(w, rel=1e-7, abs=1e-9, nan_ok=True), (i, n)


def test_payments_are_inverse(spark):
    m = FinancialModel(spark=spark).input("r", 0.05).define("fv", "future_value(r, 10, 0, -100)").define("pv", "present_value(r, 10, 0, fv)", output=True).define("pay", "annuity(0, 4, 100)", output=True)
    assert m.evaluate().values == {"pv": pytest.approx(-100), "pay": -25.0}


def test_python_kernels_run_in_batches(spark):
    reg = Registry(default_registry())
    kernel("hyp", arity=2, registry=reg, python=True)(lambda a, b: np.sqrt(a * a + b * b))
    df = spark.createDataFrame([(i, float(i), 4.0) for i in range(50)], "k int, a double, b double")
    m = FinancialModel(kernels=reg, spark=spark).input("a").input("b").bind(df).define("h", "hyp(a, b) / 2", output=True)
    r = m.evaluate()
    assert r.stats.backend == "arrow" and {x["k"]: x["h"] for x in r.frame.collect()}[3] == 2.5
    assert Planner().choose(WorkloadProfile(1, 10_000)).name == "arrow"


def test_save_and_load(model, tmp_path):
    path = str(tmp_path / "m.json")
    model.set("cogs", 310e6).save(path)
    again = FinancialModel.load(path, spark=model.spark)
    assert again.evaluate().values == model.evaluate().values and again.types() == model.types()


def test_intents(model):
    run = model.apply_intent
    assert run({"operation": "change", "metric": "cogs", "relative_change": 0.04})["ebitda"] == 68e6
    assert run({"status": "valid", "operations": [{"operation": "absolute_change", "target": "opex", "value": 5e6, "currency": "ZAR"}]})["ebitda"] == 75e6
    assert len(run({"operations": [{"operation": "range", "target": "cogs", "min": 1, "max": 2, "steps": 7}]})["ebitda"]) == 7
    assert run({"scenarios": [{"name": "base", "operations": []}, {"name": "up", "operations": [{"operation": "relative_change", "target": "revenue", "value": 0.1}]}]})["up"]["ebitda"] == 130e6
    one = lambda **op: {"operations": [{"operation": "set", "value": 1.0, "target": "opex"} | op]}
    for bad in (one(currency="USD"), one(unit="days"), one(target="ebitda"), one(currency="rand"), one(operation="range"), {"status": "ambiguous", "operations": []}, {"status": "odd"}, {"operations": []}, 5, one(value=None), {"schema_version": "2.0", **one()}):
        with pytest.raises(IntentError):
            run(bad)


def test_random_changes_equal_full_evaluation(spark):
    rng = random.Random(5)
    m, fresh = segmented(6, 3, tree=True), segmented(6, 3, tree=True)
    m._spark = fresh._spark = spark
    m.evaluate()
    for _ in range(4):
        name, value = f"seg{rng.randrange(6)}_in", rng.uniform(1, 9)
        r = m.set(name, value).evaluate()
        assert set(r.recomputed) == m.module.cone([name]) - {name}
        assert r.values == fresh.set(name, value).evaluate().values
    assert incremental_benchmark(3, 2, 2)["recomputed"] < incremental_benchmark(3, 2, 2)["full"]


def test_unaffected_columns_are_pruned(spark, model):
    df = spark.createDataFrame([(1, 2.0, 1.0)], "id int, revenue double, cogs double")
    plan = model.bind(df).what_if(cogs="+4%", targets=["opex_ratio"]).frame._jdf.queryExecution().optimizedPlan().toString()
    assert "gross_profit" not in plan
    with pytest.raises(ValidationError):
        model.bind(df.withColumnRenamed("cogs", "ebitda"))


def test_text_model_with_lengths_that_differ(spark):
    m = FinancialModel.from_ir(parse("input a: series[scalar,month]; input b: series[scalar,month]; c = a + b; output c"), spark=spark)
    m._values = {"a": [1.0, 2.0], "b": [5.0]}
    assert m.evaluate()["c"].tolist() == [6.0, 7.0]
    m.set("b", [1.0, 2.0, 3.0])
    with pytest.raises(Exception, match="lengths differ"):
        m.evaluate().values


def test_set_leaves_clean_columns_alone(spark):
    """What is listed as reused is not in the plan; what is stale is."""
    def steps(frame):
        return frame._jdf.queryExecution().optimizedPlan().toString()

    df = spark.createDataFrame([(i, 100.0 + i) for i in range(20)], "k int, a double")
    m = FinancialModel(spark=spark).input("a").input("b", 3.0).input("c", 5.0).bind(df)
    m.define("u", "a * 17").define("v", "b + a * 19").define("w", "c - a * 23").define("out", "u + v + w", output=True)
    assert m.evaluate().reused == []  # nothing is kept yet
    m.cache_base(["out"])
    m.set("b", 4.0)
    r = m.evaluate()
    assert set(r.recomputed) == {"v", "out"} and set(r.reused) == {"u", "w"}
    above = steps(r.frame).split("InMemoryRelation")[0]
    assert "19.0" in above and "17.0" not in above and "23.0" not in above
    assert {x["k"]: x["out"] for x in r.frame.collect()} == {i: (100.0 + i) * 17 + 4 + (100.0 + i) * 19 + 5 - (100.0 + i) * 23 for i in range(20)}
    w = m.what_if({"c": {"delta": 1.0}})
    assert set(w.reused) == {"u"} and "17.0" not in steps(w.frame).split("InMemoryRelation")[0]
    assert {x["k"]: x["out"] for x in w.frame.collect()}[0] == 1700 + 4 + 1900 + 6 - 2300
    one = FinancialModel(spark=spark).input("a", 2.0).input("b", 3.0).define("u", "a * 17").define("v", "u + b * 19").define("out", "v * 2", output=True)
    assert one.evaluate().values == {"out": 182.0}
    r = one.set("b", 4.0).evaluate()
    assert set(r.recomputed) == {"v", "out"} and r.reused == ["u"] and r.values == {"out": 220.0}
    again = one.evaluate()
    assert again.recomputed == [] and again.values == r.values and again.frame.collect()[0]["out"] == 220.0
    w = one.what_if({"b": "+100%"})
    assert w.reused == ["u"] and "17.0" not in steps(w.frame) and w.values == {"out": 372.0}
