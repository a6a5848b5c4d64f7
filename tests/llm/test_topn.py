from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillstone.llm.topn import GroupIndex, expand_requests, scan_bin


def data(n=4000, seed=2):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        g = None if r.random() < 0.02 else (5 if r.random() < 0.5 else r.randrange(30))
        s = None if r.random() < 0.03 else float("nan") if r.random() < 0.03 else round(r.random(), 1) * r.choice([1, -1, 1])
        out.append((g, None if r.random() < 0.02 else r.randrange(400), s))
    return out + out[:100]


def brute(got, ask):
    best = {}
    for g, i, s in got:
        if g is not None and i is not None and s is not None and s == s:
            best.setdefault(g, {})
            best[g][i] = max(best[g].get(i, -9e9), s)
    return {g: [i for i, _ in sorted(best.get(g, {}).items(), key=lambda x: (-x[1], x[0]))[:n]] for g, n in ask.items()}


def test_equals_brute_force_with_ties_repeats_and_a_split_group(spark):
    got = data()
    df = spark.createDataFrame(got, "g int, i int, s double").withColumn("grp", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("_bin", F.lit(2))
    ask = {5: 150, 1: 3, 2: 1000, 29: 1, 77: 5}
    index = GroupIndex.build(df, "g", "i", "s", row_group_bytes=2000)
    assert len(index.plan.placed.get(5, [])) > 1
    lists = index.top_n(spark.createDataFrame([*ask.items(), (None, 3), (3, 0), (4, None), (1, 2)], "g int, n int"), "g", "n")
    out = {}
    for r in lists.collect():
        out.setdefault(r["grp"], []).append((r["rank"], r["item"]))
    want = {g: v for g, v in brute(got, ask).items() if v}
    assert {g: [i for _, i in sorted(v)] for g, v in out.items()} == want
    assert all(sorted(k for k, _ in v) == list(range(1, len(v) + 1)) for v in out.values())
    asks = spark.createDataFrame([(1, 5, 149), (2, 5, 2), (2, 5, 2), (3, 1, 1), (4, 99, 3), (5, None, 2), (6, 1, -1)], "r int, g int, n int")
    dealt = {(r["request"], r["item"]) for r in expand_requests(asks, "r", "g", "n", lists, block=16).collect()}
    assert dealt == {(1, i) for i in want[5][:149]} | {(2, i) for i in want[5][:2]} | {(3, want[1][0])}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g int, i int, s double")
    ask = spark.createDataFrame([(1, 2)], "g int, n int")
    assert GroupIndex.build(empty, "g", "i", "s").top_n(ask, "g", "n").count() == 0
    full = GroupIndex.build(spark.createDataFrame([(1, 2, 0.5)], "g int, i int, s double"), "g", "i", "s")
    assert full.top_n(ask.limit(0), "g", "n").count() == 0
    assert rows(full.top_n(ask, "g", "n")) == [(1, 2, 0.5, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_row_groups_are_skipped_but_ties_are_read(tmp_path, seed):
    r = np.random.default_rng(seed)
    n = 5000
    grp = np.sort(r.choice([1, 2, 3], n, p=[0.05, 0.9, 0.05]))
    score, item = np.round(r.random(n), 2), r.integers(0, 3000, n)
    order = np.lexsort((item, -score, grp))
    t = pa.table({"grp": grp[order], "item": item[order], "score": score[order]})
    pq.write_table(t, tmp_path / "f.parquet", row_group_size=100)
    stats = {}
    pieces = [p for p in scan_bin([pq.ParquetFile(tmp_path / "f.parquet")], np.array([2, 3]), np.array([130, 4]), stats) if len(p[0])]
    found = {}
    for p in pieces:
        for g, i in zip(p[0], p[1], strict=True):
            found.setdefault(int(g), set()).add(int(i))
    want = brute(list(zip(grp.tolist(), item.tolist(), score.tolist(), strict=True)), {2: 130, 3: 4})
    assert found == {g: set(v) for g, v in want.items()}
    assert stats["skipped"] > 30


def test_a_group_that_a_third_of_the_requests_ask_for(spark):
    lists = spark.createDataFrame([(g, 1000 * g + r, 1.0 / r, r) for g in range(20) for r in range(1, 41)], "grp long, item long, score double, rank long")
    asks = [(i, 3 if i % 3 == 0 else i % 20, 1 + i % 50) for i in range(3000)]
    got = expand_requests(spark.createDataFrame([*asks, *asks[:50]], "q int, g int, n int"), "q", "g", "n", lists, block=8)
    n = {r["request"]: r["n"] for r in got.groupBy("request").agg(F.count("*").alias("n")).collect()}
    assert n == {i: min(n, 40) for i, _, n in asks}


def test_an_index_is_built_once_and_opened_again(spark, tmp_path):
    got = data(500)
    GroupIndex.build(spark.createDataFrame(got, "g int, i int, s double"), "g", "i", "s", path=f"file://{tmp_path}/index")
    index = GroupIndex.open(spark, f"file://{tmp_path}/index")
    out = {}
    for r in index.top_n(spark.createDataFrame([(5, 20), (3, 7)], "g int, n int"), "g", "n").collect():
        out.setdefault(r["grp"], []).append((r["rank"], r["item"]))
    assert {g: [i for _, i in sorted(v)] for g, v in out.items()} == brute(got, {5: 20, 3: 7})
