"""Operators on pages, conversations and vectors, and the pipeline, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from finmodel.llm import chat, components, topk, warc


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(0, i) for i in range(1000, 1300)] + [(i, i + 1) for i in range(2000, 2100)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert {k: got.get(k, k) for k in parent} == {k: find(k) for k in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc(spark):
    body = "<html>" + "é" * 80
    rows = [(5, "http://a/1\r\nX: y", body, 1), (3, "http://a/2", body, 1), (9, None, "short", 1), (8, "u", "short", 1), (7, "u", None, 1), (3, "http://a/2", body, 1), (None, "n", body, 1), (11, "z", "WARC/1.1\r\n\r\n" * 50_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = Counter(map(tuple, warc.op1(pages).collect()))
    want = Counter()
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        revisit = html == body and page != 3
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None] += 1
    assert got == want
    assert warc.op1(pages.limit(0)).count() == 0


def test_warc_members_stand_alone(tmp_path):
    import gzip
    import io

    records = [warc.record(i, "u", b"x" * i, "0", None) for i in range(50)]
    out = io.BytesIO()
    index = warc.normalise(io.BytesIO(gzip.compress(b"".join(records))), out)
    raw = out.getvalue()
    assert [gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]) for e in index] == records
    assert gzip.decompress(raw) == b"".join(records)
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(b"".join(records)[:-9])), io.BytesIO())


def test_a_gzip_that_is_cut_off_is_an_error():
    import gzip
    import io

    whole = gzip.compress(b"".join(warc.record(i, "u", b"x" * 500, "0", None) for i in range(20)))
    assert len(warc.normalise(io.BytesIO(whole + whole), io.BytesIO())) == 40
    for cut in (1, 4, 8, 20, len(whole) // 2):
        with pytest.raises(ValueError):
            warc.normalise(io.BytesIO(whole[:-cut]), io.BytesIO())


def test_chat_round_trip(spark):
    rng = random.Random(3)
    alphabet = [*chat.CONTROL, "\\", " ", "] ", "a", "é", "\n", "[", "<"]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "to] ol\\", None]), rng.choice([None, "".join(rng.choices(alphabet, k=rng.randint(0, 12)))]), 0))
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, piece int")
    got = {r.conv_id: r for r in chat.op4(df).collect()}
    hard = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", hard, 0), (-7, 1, "assistant", hard, 0)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.op4(df.limit(0)).count() == 1


def test_plain_turns_are_not_escaped():
    assert chat.render_turn("user", "hello [x] <y>") == ("[INST] hello [x] <y> [/INST]", None)


def test_top_k_over_several_files_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = rng.integers(-300, 300, (900, 7))
    df = spark.createDataFrame([(int(i), (v / 256).tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>").repartition(3)
    want = Counter()
    for q in range(0, 900, 50):
        scored = sorted((-int(s), c) for c, s in enumerate(values @ values[q]) if c != q)[:5]
        want.update((q, k, c, -s) for k, (s, c) in enumerate(scored, 1))
    monkeypatch.setattr(topk, "FILE_BYTES", 400)
    assert Counter(map(tuple, topk.top_k(df).collect())) == want


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) if rng.random() < 0.7 else 0.0 for x in rng.integers(-3, 4, 6) / 4]) for i in range(120)]
    rows += [(200, None), (250, [1.0, None]), (300, [float("nan")] * 6), (350, [float("inf")] + [0.0] * 5), (400, [1.0]), (150, []), (7, rows[7][1]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, score int")
    ok = [(a, [int(np.floor(256 * x)) for x in b]) for a, b in rows if a is not None and b is not None and None not in b and all(np.isfinite(b))]
    want = Counter()
    for q, v in ok:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), c) for c, w in ok if c != q)[:5]
            want.update((q, k, c, -s) for k, (s, c) in enumerate(scored, 1))
    assert Counter(map(tuple, topk.top_k(df).collect())) == want
    assert topk.top_k(df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e30, 2.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(big).collect()] == [(1, 2**63 - 1), (2, -(2**63))]
