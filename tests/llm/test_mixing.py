from __future__ import annotations

import random
from pathlib import Path

import pytest
from conftest import rows

from rillstone.llm import mixing
from rillstone.llm.mixing import allot, encoding, mix, pivot


def test_allot():
    assert allot({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 100) == {"a": 50.0, "b": 50.0}
    out = allot({"a": 100, "b": 10, "d": 50}, {"a": 0.4, "b": 0.4, "c": 0.1, "d": 0.1}, {"a": 3, "b": 2, "c": 5, "d": 1}, 160)
    assert out["b"] == 20 and out["c"] == 0 and out["a"] == pytest.approx(4 * out["d"]) and sum(out.values()) == pytest.approx(160)
    assert sum(allot({"a": 5}, {"a": 1.0}, {"a": 2}, 100).values()) == 10
    assert allot({}, {"a": 1.0}, {"a": 2}, 0) == {"a": 0.0}


def test_pivot_keeps_mass_and_expectation():
    r = random.Random(0)
    for i in range(500):
        a, b = (i, r.randrange(1, 50), r.random()), (i + 9999, r.randrange(1, 50), r.random())
        x, y = pivot(a, b, 3)
        assert x[1] * x[2] + y[1] * y[2] == pytest.approx(a[1] * a[2] + b[1] * b[2])
        assert {x[2], y[2]} & {0.0, 1.0} and all(-1e-9 <= z[2] <= 1 + 1e-9 for z in (x, y))
    ends = [pivot((s, 3, 0.3), (s + 1, 5, 0.6), 7)[0][2] for s in range(20000)]
    assert sum(ends) / len(ends) == pytest.approx(0.3, abs=0.01)


def docs(spark, n=900):
    r = random.Random(8)
    names = ["Web-Site", " web_site", "book", "BOOK ", "forum", None, "other"]
    data = [(i, " ".join(r.choice(["tree", "running", "x1", "straße"]) for _ in range(r.randrange(0, 40))), r.choice(names)) for i in range(n)]
    data += [(5001, None, "book"), (5002, "", "book"), (None, "lost text", "book"), (5003, "word " * 4000, "forum")]
    return spark.createDataFrame([(*x, 1) for x in data], "d long, t string, s string, _text int")


TARGETS = [("web_site", 0.5, 1), ("book", 0.3, 2), ("forum", 0.1, 3), ("missing", 0.1, 9), (None, 0.3, 1)]


@pytest.mark.parametrize("fan_in", [2, 32])
def test_mix_reaches_its_tokens(spark, monkeypatch, fan_in):
    monkeypatch.setattr(mixing, "FAN_IN", fan_in)
    df = docs(spark).repartition(9)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeat int")
    copies, shares = mix(df, "d", "t", "s", targets, 12_000)
    enc = encoding(Path(mixing.TOKENIZER).read_bytes())
    text = {r["d"]: r["t"] for r in df.collect()}
    got = copies.collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    assert all(r["n_tokens"] == len(enc.encode_ordinary(text[r["doc_id"]])) for r in got)
    most = {s: m for s, _, m in TARGETS}
    assert all(1 <= r["copies"] <= most[r["source"]] for r in got)
    out = {r["source"]: r for r in shares.collect()}
    assert sum(r["mix_tokens"] for r in out.values()) == pytest.approx(12_000, abs=4100)
    for s, t in (("web_site", 0.5 / 0.9), ("book", 0.3 / 0.9)):
        assert out[s]["mix_tokens"] == pytest.approx(12_000 * t, abs=60)  # but for one document
    assert out["missing"]["mix_tokens"] == 0 and sum(r["reached_share"] for r in out.values()) == pytest.approx(1)


def test_same_mix_however_the_documents_are_partitioned(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 100)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeat int")
    one, other = (rows(mix(docs(spark).repartition(n), "d", "t", "s", targets, 12_000)[0], "doc_id", "source", "n_tokens", "copies") for n in (2, 11))
    assert one == other and len(one) > 50
    assert rows(mix(docs(spark), "d", "t", "s", targets, 12_000, seed=12)[0], "doc_id", "source", "n_tokens", "copies") != one


def test_empty(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeat int")
    copies, shares = mix(docs(spark).limit(0), "d", "t", "s", targets)
    assert copies.count() == 0 and {r["mix_tokens"] for r in shares.collect()} == {0}
    assert mix(docs(spark, 20), "d", "t", "s", targets.limit(0))[0].count() == 0
