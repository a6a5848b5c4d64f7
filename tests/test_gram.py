from __future__ import annotations

import random
from collections import defaultdict

import pytest

from rillstone.operators import gram, similarity


def frame(spark, data):
    return spark.createDataFrame([(r["user"], r["item"], r["label"]) for r in data], "user int, item int, label double")


def log(seed=3, hot=400):
    """Rows of 30 users and 500 items; user 0 has most items."""
    r = random.Random(seed)
    pairs = {(0, i) for i in range(hot)} | {(r.randrange(1, 30), r.randrange(500)) for _ in range(600)}
    return [{"user": u, "item": i, "label": float(r.randrange(1, 6))} for u, i in sorted(pairs)]


def brute(data):
    by = defaultdict(list)
    for r in data:
        by[r["user"]].append((r["item"], r["label"]))
    out = defaultdict(lambda: [0.0, 0])
    for items in by.values():
        for i, (a, x) in enumerate(items):
            for b, y in items[i + 1 :]:
                out[a, b][0] += x * y
                out[a, b][1] += 1
    return {k: (round(d, 6), n) for k, (d, n) in out.items()}


@pytest.mark.parametrize("part", [1024, 37])
def test_crowded_key_in_parts(spark, part):
    data = log()
    work = gram.keyed_records(frame(spark, data), "user", "item", "label", part)
    cells = gram.gram(work, gram.cells_of(), "a long, b long, n long, dot double", valued=True)
    assert {(r["a"], r["b"]): (round(r["dot"], 6), r["n"]) for r in cells.collect()} == brute(data)


@pytest.mark.parametrize("kind", ["cosine", "pearson", "jaccard"])
def test_lists_equal_pairs(spark, kind):
    df = frame(spark, log(5, 60))
    lists = similarity.top_neighbors(df, "item", "user", "label", kind, 4, digits=6)
    pairs = similarity.neighbors(similarity.similarities(df, "item", "user", "label", kind), 4, 6)
    pick = lambda d: sorted((r["entity"], r["rank"], r["neighbor"], r["sim"]) for r in d.collect())
    assert pick(lists) == pick(pairs)


def test_other_ids_are_refused_and_empty_tables_give_nothing(spark):
    with pytest.raises(ValueError, match="integers"):
        similarity.pair_sums(spark.createDataFrame([("a", 1, 1.0)], "item string, user int, label double"), "item", "user", "label")
    assert similarity.top_neighbors(frame(spark, log()).limit(0), "item", "user", "label").count() == 0
