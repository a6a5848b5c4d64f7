from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillstone.operators.balance import fragment_replicate_join, heavy_keys, key_stats, pack, plan_loads, spread


def data(spark, n=3000, seed=1):
    r = random.Random(seed)
    got = [(None if r.random() < 0.03 else (7 if r.random() < 0.4 else r.randrange(40)), None if r.random() < 0.05 else r.randrange(60), None if r.random() < 0.1 else r.randrange(1, 6)) for _ in range(n)]
    return got, spark.createDataFrame(got, "k int, m int, v int")


def test_pack_splits_large_keys_and_evens_loads():
    plan = pack([("a", 600.0), ("b", 100.0), ("c", 90.0)], 1000.0, 10)
    assert len(plan.placed["a"]) == 6 and len(plan.placed["b"]) == 1
    held = [21.0] * 10
    for key, load in (("a", 100.0), ("b", 100.0), ("c", 90.0)):
        for b in plan.placed[key]:
            held[b] += load
    assert max(held) <= 121 + 1e-9


def test_hot_key_is_spread(spark):
    _, df = data(spark)
    plan = plan_loads(df, "k", bins=8, fraction=0.5)
    sizes = [r["count"] for r in spread(df.where("k = 7"), "k", plan, F.xxhash64("m")).groupBy("_bin").count().collect()]
    assert len(plan.placed[7]) > 2 and len(sizes) > 2


def test_key_stats_equals_plain_groups(spark):
    got, df = data(spark)
    want = {}
    for k, m, v in got:
        if k is not None:
            g = want.setdefault(k, [0, set(), []])
            g[0] += 1
            g[1] |= {m} - {None}
            g[2] += [v] if v is not None else []
    out = {r["k"]: (r["n_rows"], r["n_members"], r["mean_value"]) for r in key_stats(df, "k", "m", "v").collect()}
    assert out.keys() == want.keys()
    for k, (n, ms, vs) in want.items():
        assert out[k][:2] == (n, len(ms)) and out[k][2] == pytest.approx(sum(vs) / len(vs))


def test_key_stats_edges(spark):
    empty = spark.createDataFrame([], "k int, m int, v int, _bin int, _key string, _bins int")
    assert key_stats(empty, "k", "m", "v").count() == 0
    one = spark.createDataFrame([(1, None, None), (1, None, None), (None, 2, 3)], "k int, m int, v int")
    assert rows(key_stats(one, "k", "m", "v")) == [(1, 2, 0, None)]
    assert rows(key_stats(one, "k")) == [(1, 2, None, None)]
    assert rows(heavy_keys(key_stats(one, "k"), "k", 0.5)) == [(1, 2)]
    with pytest.raises(ValueError):
        key_stats(one.withColumnRenamed("k", "n_rows"), "n_rows")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_plain_join(spark, how):
    _, df = data(spark, 1500)
    df = df.withColumn("_bin", F.lit("x")).withColumn("_key", F.lit("y"))
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 45, 2)] + [(7, 70), (7, 71), (None, 0)], "k int, w int")
    assert rows(fragment_replicate_join(df, right, "k", how).select(*(["k", "m", "v", "_bin"] + (["w"] if how in ("inner", "left") else [])))) == rows(
        df.join(right, "k", how).select(*(["k", "m", "v", "_bin"] + (["w"] if how in ("inner", "left") else [])))
    )


def test_join_refuses_clashes(spark):
    _, df = data(spark, 10)
    with pytest.raises(ValueError):
        fragment_replicate_join(df, df, "k")
