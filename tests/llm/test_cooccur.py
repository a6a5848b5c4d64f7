from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillstone.llm.cooccur import associations, clean_basket, latest, pair_counts


def baskets(n=300, seed=4):
    r = random.Random(seed)
    out = [[r.choice([None, 1, 2, *range(-3, 40)]) for _ in range(r.randrange(0, 12))] for _ in range(n)]
    return [*out, None, [], [None], [5], list(range(100)), [5, 5, 5, 6]]


def brute(lists):
    sets = [s for s in ({x for x in (b or []) if x is not None} for b in lists) if s]
    single = Counter(x for s in sets for x in s)
    pairs = Counter(p for s in sets for p in combinations(sorted(s), 2))
    return len(sets), single, pairs


@pytest.mark.parametrize("block", [512, 7])
def test_equals_brute_force(spark, block):
    lists = baskets()
    n, single, pairs = brute(lists)
    df = spark.createDataFrame([(b,) for b in lists], "b array<int>").withColumn("m", F.lit(1))
    got = pair_counts(df.select(clean_basket(F.col("b")).alias("m")), "m", part=block)
    assert {(r["a"], r["b"]): r["n_ab"] for r in got.collect()} == dict(pairs)
    if block == 512:
        out = {(r["a"], r["b"]): (r["n_ab"], r["lift"]) for r in associations(df, "b", 3, 1.2).collect()}
        want = {p: (c, c * n / (single[p[0]] * single[p[1]])) for p, c in pairs.items() if c >= 3 and c * n >= 1.2 * single[p[0]] * single[p[1]]}
        assert out.keys() == want.keys() and all(out[p] == (want[p][0], pytest.approx(want[p][1])) for p in want)


def test_latest_and_empty(spark):
    df = spark.createDataFrame([(1, 1, [1]), (2, 1, [2]), (3, None, [3]), (4, 2, None)], "e int, u int, x array<int>")
    assert rows(latest(df, ["u"], "e", "x")) == [(1, [2]), (2, None)]
    assert associations(df.limit(0), "x").count() == 0


def test_ids_beyond_32_bits(spark):
    far = 2**32 + 2
    df = spark.createDataFrame([([1, far],), ([far, 1, -far],), ([1, 2],)], "b array<bigint>")
    assert rows(associations(df, "b").select("a", "b", "n_ab")) == [(-far, 1, 1), (-far, far, 1), (1, 2, 1), (1, far, 2)]


def test_bounds_lose_no_pair(spark):
    """Items in nearly every basket and rare ones are left out of the matrix, pairs that pass are the same."""
    r = random.Random(9)
    lists = [[0, *([1, 2] if r.random() < 0.1 else []), *[r.randrange(3, 400) for _ in range(5)]] for _ in range(400)]
    n, single, pairs = brute(lists)
    got = {(x["a"], x["b"]): x["n_ab"] for x in associations(spark.createDataFrame([(b,) for b in lists], "b array<int>"), "b", 5, 4.0).collect()}
    assert got == {p: c for p, c in pairs.items() if c >= 5 and c * n >= 4.0 * single[p[0]] * single[p[1]]} and (1, 2) in got
