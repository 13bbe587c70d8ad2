"""The pipeline against a brute-force version of every stage, on awkward rows."""

from collections import Counter

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from test_text_operators import _WORD, exact_components, plain_fusion, plain_pack

from finmodel.llm import langid, packing, quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "row_", "my col", "a-b", "a.b", "key", "n_words", "node", "label"]


def awkward(spark):
    """The given documents, and rows with nulls, repeats and one id under two texts; extra columns have clashing and odd names."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").collect()]
    long = next(r for r in rows if r[1] and len(r[1].split()) > 150)
    words = long[1].split()
    near = " ".join([*words[:60], "altered", *words[61:]])
    rows += [rows[7], rows[7], (None, long[1], long[2], long[3], 1), (None, near, "en", None, 1), (long[0], " ".join(reversed(words)), long[2], long[3], 1)]
    rows += [(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, near, long[2], "src2", 1), (9004, " \n\t ", "en", "src1", 3), (9005, " ".join(words * 12), long[2], "src3", 1)]
    rows += [(9006, "123 456 " * 40, "en", "src1", 1), (9007, "быстрая лиса бежит через лес и поле домой " * 9, None, "src1", 1)]
    extra = ("x", 1, 2, "dot", 3, "n", None, "l")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_ string, `my col` int, `a-b` int, `a.b` string, key int, n_words string, node string, label string"
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)


def brute_good(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(rows)), "text": [r["text"] for r in rows], "lang": [r["lang"] for r in rows], "source": [r["source"] for r in rows]}))
    kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({quality.ORACLE_SQL})").fetchall() if k}
    return [r for i, r in enumerate(rows) if i in kept]


def brute_identified(spark, rows, df):
    model = langid.fit(df.selectExpr("doc_id AS id", "text", "lang"))
    found = plain_fusion([(r["text"], r["lang"], r["source"]) for r in rows], model.languages, model.log, model.mean, model.deviation)
    return [r for r, f in zip(rows, found, strict=True) if f is not None]


def brute_one(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0))
    place = {i: k for k, i in enumerate(order)}
    classes = exact_components([(place[i], rows[i]["text"]) for i in range(len(rows))])
    return [rows[i] for i in range(len(rows)) if classes[i] == place[i]]


def brute_packed(rows):
    pieces = []
    for r in rows:
        n = len(_WORD.findall(r["text"] or ""))
        pieces += [(r["doc_id"], p, 2048 * p, max(0, min(2048, n - 2048 * p)), r["source"], r["text"] or None) for p in range(max(1, -(-n // 2048)))]
    pieces.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    bins = plain_pack([p[3] for p in pieces], [p[4] for p in pieces], [p[5] for p in pieces], packing.CAPACITY)
    return Counter((*p[:4], *b) for p, b in zip(pieces, bins, strict=True))


def key(r):
    return r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]


def test_stages_equal_brute_force_one_after_the_other(spark):
    docs = awkward(spark)
    rows = [r.asDict() for r in docs.collect()]
    for (_, stage), brute in zip(corpus_pipeline.STAGES[:3], (brute_good, lambda r: brute_identified(spark, r, docs), brute_one), strict=True):
        got = stage(spark, docs, SF)
        assert got.columns == COLUMNS
        rows = brute(rows)
        assert Counter(map(key, got.collect())) == Counter(map(key, rows))
        docs = spark.createDataFrame(got.collect(), got.schema)  # each stage is judged on its own input
    assert 50 < len(rows) < 190
    got = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.bin, r.bin_start) for r in got.collect()) == brute_packed(rows)


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = brute_good([r.asDict() for r in docs.collect()])
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    rows = brute_one(brute_identified(spark, rows, good))
    got = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.bin, r.bin_start) for r in got.collect()) == brute_packed(rows)


def test_stages_compose_without_being_written_between(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = corpus_pipeline.language_id(spark, corpus_pipeline.quality_rules(spark, docs, SF), SF)
    assert 0 < both.count() < docs.count()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, stage):
    assert stage(spark, awkward(spark).limit(0), SF).count() == 0
