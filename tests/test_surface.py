"""Strategies of the user, saved rows, and instructions from files."""

import json

import pytest

from finmodel import FinancialModel, nl
from finmodel.errors import BackendError, ValidationError
from finmodel.plans.planner import Batches, Planner, Strategy
from finmodel.queries_surface import _instruction_model, labelled_instructions
from finmodel.sources.files import read_instructions, read_model, write_model


class Nulls(Strategy):
    """A strategy over columns: no node has a value."""

    name = "nulls"

    def add_nodes(self, df, g, names, types, kernels, policy):
        return df.selectExpr("*", *[f"CAST(NULL AS DOUBLE) AS `{n}`" for level in g.levels(names) for n in level])


def test_strategies_of_the_user(spark):
    class Doubled(Batches):
        """A strategy whose sums count twice, and whose results are negated on the way out."""

        name = "doubled"

        def binary(self, op, a, b, table):
            return super().binary(op, a, b, table) * (2 if op == "+" else 1)

        def finalize(self, values):
            return -values

    m = FinancialModel(spark=spark).input("a", 2.0).input("b", 3.0).define("s", "a + b").define("t", "s * 10", output=True)
    assert m.evaluate()["t"] == 50.0
    r = m.set_backend(Doubled()).evaluate()
    assert r["t"] == -100.0 and r.stats.backend == "doubled" and r.recomputed == ["s", "t"]  # nothing of another strategy is kept
    m.planner.register(Nulls())
    assert m.set_backend("nulls").evaluate()["t"] is None and m.set_backend(None).evaluate()["t"] == 50.0
    for wrong in (lambda: m.set_backend("gpu"), lambda: m.planner.register(Nulls()), lambda: m.planner.register("nulls"), lambda: m.planner.register(Strategy())):
        with pytest.raises(BackendError):
            wrong()
    assert Planner(Nulls()).names == ("columns", "arrow", "nulls")


def test_rows_are_saved_with_what_is_kept(spark, tmp_path):
    url = f"{tmp_path.as_uri()}/m.json"
    df = spark.createDataFrame([(i, 100.0 + i) for i in range(20)], "k int, a double")
    m = FinancialModel(spark=spark).input("a").input("b", 3.0).bind(df).define("u", "a * 17").define("v", "b + a").define("out", "u + v", output=True)
    m.cache_base().set("b", 4.0)  # v and out are out of date and are not saved
    m.save(url, rows=True)
    again = FinancialModel.load(url, spark=spark)
    r = again.evaluate()
    assert r.reused == ["u"] and set(r.recomputed) == {"v", "out"}
    want = {i: (100.0 + i) * 18 + 4 for i in range(20)}
    assert {x["k"]: x["out"] for x in r.frame.collect()} == want == {x["k"]: x["out"] for x in m.evaluate().frame.collect()}
    again.save(url, rows=True)  # over the file that it came from, whose rows it still reads
    third = FinancialModel.load(url, spark=spark).set("b", 5.0)
    assert {x["k"]: x["out"] for x in third.evaluate().frame.collect()} == {k: v + 1 for k, v in want.items()}
    m.save(str(tmp_path / "plain.json"), rows=True)
    assert FinancialModel.load(tmp_path / "plain.json", spark=spark).evaluate().frame.count() == 20
    m.save(str(tmp_path / "bare.json"))
    assert FinancialModel.load(tmp_path / "bare.json", spark=spark).evaluate()["out"] == 4.0
    with pytest.raises(ValidationError):
        FinancialModel(spark=spark).input("a", 1.0).save(url, rows=True)
    for name in ("g.json", "g.fin"):
        write_model(m.module, f"{tmp_path.as_uri()}/{name}")
        assert read_model(f"{tmp_path.as_uri()}/{name}").to_text() == m.module.to_text()


def test_labelled_instructions_from_files(spark, tmp_path):
    rows, fixtures = labelled_instructions(), tmp_path / "fixtures"
    assert len(rows) == len({r["id"] for r in rows}) == 183
    fixtures.mkdir()
    for r in rows[:3]:
        (fixtures / f"{r['id']}.json").write_text(r.pop("expected_intent"))
        r["fixture"] = f"{r['id']}.json"
    rows[1]["fixture"] = "missing.json"
    rows[4]["expected_intent"] = json.loads(rows[4]["expected_intent"])  # as an object
    del rows[5]["difficulty"]
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    df = read_instructions(spark, str(path), str(fixtures))
    got = {r["id"]: r for r in df.collect()}
    assert len(got) == 183 and got["i001"]["expected_intent"] is None and got["i005"]["difficulty"] == "core"
    judged = nl.benchmark(df, _instruction_model(spark))
    one = {r["id"]: r for r in judged["examples"].collect()}
    assert one["i000"]["exact"] and one["i002"]["exact"] and one["i004"]["exact"] and one["i001"]["expected"] is None
    plan = judged["examples"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # that with the fixtures; judging joins nothing


def test_benchmark_on_awkward_rows(spark):
    rows = [("1", None, "core", None, None, None), ("2", "x", None, "", "semantic_reject", "{"), ("3", "scenario", "core", "Increase revenue by 8%", "", '{"status": "valid"}')]
    schema = "id string, category string, difficulty string, text string, execution_expectation string, expected_intent string"
    judged = nl.benchmark(spark.createDataFrame(rows, schema), _instruction_model(spark))
    got = {r["id"]: r for r in judged["examples"].collect()}
    assert got["1"]["outcome"] == "refused" and got["1"]["ops"] == 0 and got["3"]["outcome"] == "executed" and not got["3"]["exact"]
    assert judged["metrics"].where("difficulty = 'core'").collect()[0]["operation_accuracy"] is None
    assert nl.benchmark(spark.createDataFrame([], schema), _instruction_model(spark))["examples"].count() == 0


def test_one_row_without_a_job_equals_generated_code(spark):
    """Every kernel with a batch form, signs, zero divisors and non-finite values: the driver's row against columns."""
    import math

    from finmodel import NumericPolicy, default_registry
    from finmodel.plans.planner import _numpy_kernels

    names = sorted(k for k in _numpy_kernels(NumericPolicy()) if not k.startswith("__"))
    inputs = ("a", "b", "c", "d")
    for policy in ("nan", "zero"):
        for values in ((3.0, 2.0, 4.0, 1.5), (0.0, 0.0, 0.0, 0.0), (-5.0, 0.0, 2.0, 1e300), (math.nan, 1.0, math.inf, -1.0)):
            m = FinancialModel(policy=NumericPolicy(on_div_zero=policy), spark=spark)
            for n, v in zip(inputs, values, strict=True):
                m.input(n, v)
            for name in names:
                m.define(f"k_{name}", f"{name}({', '.join(inputs[: default_registry().get(name).arity or 2])})", output=True)
            m.define("minus", "-a", output=True).define("mixed", "(a - b) / c + d * (a / b)", output=True)
            row = m.evaluate()
            columns = m.set_backend("columns").evaluate()
            assert (row.stats.backend, columns.stats.backend) == ("row", "columns") and row.recomputed == columns.recomputed
            for n, v in columns.values.items():
                assert row[n] == pytest.approx(v, rel=1e-12, nan_ok=True), (policy, values, n)
            m.set_backend(None)
            for change in ({"a": "+10%"}, {"b": {"delta": 2}, "c": 7}):
                got, want = m.what_if(change), m.what_if(change, backend="columns")
                assert (got.stats.backend, want.stats.backend) == ("row", "columns") and (got.recomputed, got.reused) == (want.recomputed, want.reused)
                for n, v in want.values.items():
                    assert got[n] == pytest.approx(v, rel=1e-12, nan_ok=True), (policy, values, change, n)
                read = got.frame.collect()[0].asDict()
                assert list(read) == got.targets and all(read[n] == pytest.approx(got[n], nan_ok=True) for n in read)


def test_large_and_deep_graphs(spark):
    from finmodel.plans.synthetic import segmented

    m = segmented(1000, 5)
    want = sum((1_000_000.0 + 1000 * i) * (1.05 * (1.05 * (1.05 - 0.01) - 0.01)) for i in range(1000))
    assert m.evaluate()["total"] == pytest.approx(want)
    r = m.set("seg0_in", 2e6).evaluate()
    assert len(r.recomputed) == 6 and r["total"] == pytest.approx(want + 1e6 * (1.05 * (1.05 * (1.05 - 0.01) - 0.01)))
    bound = segmented(450, 1).bind(spark.createDataFrame([(1, 5.0)], "k int, seg0_in double")).evaluate()
    assert bound.stats.backend == "arrow" and bound.frame.collect()[0]["total"] == pytest.approx(sum(1.05 * (1_000_000.0 + 1000 * i) for i in range(1, 450)) + 5.25)
