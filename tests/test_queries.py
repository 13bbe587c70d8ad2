"""Every query of the engine against its DuckDB SQL on the smallest tables, and the rest of the surface."""

import glob
import json
import math
import os

import duckdb
import pytest

from finmodel import cli, intents, nl, queries
from finmodel.streaming.changes import apply_changes, windowed_pressure

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c in cols)} FROM ({queries.ORACLES[name]})').fetchall()
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    assert got and plain(got) == plain(want)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Base scenario: no change. Downside scenario: revenue falls 8% and COGS rises 5%", [("base", []), ("downside", [("revenue", -0.08), ("cogs", 0.05)])]),
        ("Upside scenario: increase sales by 10%; Stress scenario: cut price by 3 percent", [("upside", [("revenue", 0.1)]), ("stress", [("price", -0.03)])]),
    ],
)
def test_named_scenarios_in_text(text, want):
    got = nl.compile_text(text)
    assert [(s["name"], [(o["target"], o["value"]) for o in s["operations"]]) for s in got["scenarios"]] == want
    intents.check(got)


def test_text_to_sweep_and_refusals():
    assert nl.compile_text("Sweep price from R1,000 to R1,500 in 11 steps")["operations"] == [{"operation": "range", "target": "price", "min": 1000.0, "max": 1500.0, "steps": 11}]
    for text in ("Take the company public", "There is an emergency: merge with a rival", "List on the stock exchange"):
        assert nl.compile_text(text)["status"] == "unsupported"
    assert nl.compile_text("This is an issue about emergency stock")["status"] == "ambiguous"
    assert nl.spelled(nl.tokens("two hundred fifty-five thousand rand"), 0) == (255_000.0, 6) and nl.spelled(nl.tokens("bananas"), 0) is None
    assert nl.clauses(nl.tokens("Raise revenue by 1,500; then cut opex, and trim debt by 3 and also stock."))[1][0].text == "cut"
    assert nl.SimpleIntentCompiler({"rent": "opex"}).compile("Raise rent 5%")["operations"][0]["target"] == "opex"


def test_contract_agrees_with_the_checker():
    schema = intents.json_schema()
    assert schema["properties"]["status"]["enum"] == list(intents.STATUSES) and not schema["additionalProperties"]
    whole = intents.check({"operations": [{"operation": "delta", "target": "a", "value": 1}]})
    assert json.loads(json.dumps(intents.to_dict(whole))) == {"schema_version": "1.0", "status": "valid", "operations": [{"operation": "absolute_change", "target": "a", "value": 1.0}]}


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "m.fin"
    path.write_text("input a: scalar; input b: scalar; c = a + b; output c")
    assert cli.main(["run", str(path), "--set", "a=2", "--set", "b=3", "--json"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"c": 5.0}
    for args in (["version"], ["doctor"], ["inspect", str(path)], ["graph", str(path)], ["graph", str(path), "--format", "json"], ["compile", str(path), "--show-passes"]):
        assert cli.main(args) == 0
    assert "constant_folding" in capsys.readouterr().out
    assert cli.main(["benchmark", "--segments", "4", "--depth", "2", "--turns", "2"]) == 0
    bench = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert bench["turns"]["recomputed"] < bench["turns"]["full"] and bench["locality"][-1]["recomputed"] == bench["locality"][-1]["nodes"]
    assert cli.main(["run", str(path), "--set", "zzz=1"]) == 1


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source = str(tmp_path / "events")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    q = windowed_pressure(stream).writeStream.format("memory").queryName("pressure").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("pressure").select("start", "event_type", "n").collect())) == sorted(map(tuple, windowed_pressure(events).select("start", "event_type", "n").collect()))
    changes = str(tmp_path / "changes")
    spark.createDataFrame([(1, "cogs", "+10%"), (2, "cogs", "+4%"), (1, "opex", "100"), (1, "other", "5")], "ts long, input string, spec string").write.parquet(changes)
    m = queries._golden_model(spark)
    apply_changes(m, spark.readStream.schema("ts long, input string, spec string").parquet(changes), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    assert [r["ebitda"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [500e6 - 300e6 * 1.04 - 100]


def test_entry_imports_without_the_optional_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "finmodel"), tmp_path / "finmodel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'income_statement' in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0


def test_fact_tables_are_read_once(spark):
    """No plan reads line items twice; revenue alone does not read the price list."""
    from finmodel import queries

    sf = "/root/testdata/sf0.001"

    def reads(name, table):
        scans = queries.QUERIES[name](spark, sf).select("*")._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(f"{table}.parquet" in str(scans.apply(i).relation().location().rootPaths()) for i in range(scans.size()) if "LogicalRelation" in scans.apply(i).getClass().getName())

    for name in ("k_cvar95", "k_xirr", "k_irr", "series_elementwise", "k_var95", "k_drawdown", "mom_change", "income_statement"):
        assert reads(name, "lineitem") == 1, name
    for name in ("k_cvar95", "k_var95", "k_drawdown", "k_variance", "k_volatility", "t_return_risk", "mom_change"):
        assert reads(name, "part") == 0, name


def test_column_checks_agree_with_those_of_one_request(spark):
    import json
    import random

    from finmodel import intents

    rng = random.Random(17)

    def operation():
        op = {"operation": rng.choice(["set", "relative_change", "absolute_change", "range"]), "target": rng.choice(["a", "b", "c"])}
        for field, some in {"value": [1.0, 0.5], "min": [1.0], "max": [9.0], "steps": [1, 5], "unit": ["days", "cats"], "currency": ["ZAR", "zar"]}.items():
            if rng.random() < (0.75 if (field == "value") != (op["operation"] == "range") else 0.1):
                op[field] = rng.choice(some)
        return op

    payloads = []
    for _ in range(400):
        p = {"schema_version": rng.choice(["1.0", "1.0", "1.0", "9"]), "status": rng.choice(["valid", "valid", "valid", "ambiguous"])}
        if rng.random() < 0.6:
            p["operations"] = [operation() for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.6:
            p["scenarios"] = [{"name": rng.choice(["x", "y", "z", ""]), "operations": [operation() for _ in range(rng.randint(0, 3))]} for _ in range(rng.randint(0, 3))]
        payloads.append(p)
    df = intents.parse_rows(spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "id int, payload string"))
    got = {r.id: r.e for r in df.select("id", intents.structural_errors_column().alias("e")).collect()}
    for i, p in enumerate(payloads):
        want = intents.structural_errors(intents.normalise(p))
        assert len(got[i]) == len(want), (p, got[i], want)
        assert ("repeated" in " ".join(got[i])) == ("repeated" in " ".join(want))
