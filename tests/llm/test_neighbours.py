from __future__ import annotations

import numpy as np
import pytest
from conftest import rows

from rillstone.llm import neighbours as nb
from rillstone.llm.neighbours import exact_neighbours, neighbours, recall, usable_vectors


def vectors(n=1500, dim=16, seed=0):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((n // 6, dim))
    return centers[r.integers(0, len(centers), n)] + 0.12 * r.standard_normal((n, dim))


def test_recall_against_brute_force(spark):
    x = vectors()
    x *= np.random.default_rng(1).uniform(1e-3, 1e3, (len(x), 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "u int, v array<float>")
    for floor in (-2.0, 0.9):
        exact = exact_neighbours(df, "u", "v", 16, 5, floor, every=5)
        row = recall(neighbours(df, "u", "v", 16, 5, floor), exact).first()
        assert row["n_exact"] > 300 and row["recall"] >= 0.9


def test_exact_neighbours(spark):
    x = vectors(300)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "u int, v array<float>")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(0, 300, 20) for j in np.argsort(-s[i], kind="stable")[:4]}
    assert {tuple(r) for r in rows(exact_neighbours(df, "u", "v", 16, 4, every=20, block=128), "id", "near")} == want


def test_unusable_vectors_copies_and_newest(spark):
    nan = float("nan")
    good = [1.0, 2.0, 3.0, 4.0]
    data = [(1, good, 1), (1, [9.0] * 4, 0), (2, None, 1), (3, [], 1), (4, [1.0], 1), (5, [nan, 1.0, 1.0, 1.0], 1), (6, [0.0] * 4, 1), (None, good, 1), (7, [1.0, None, 2.0, 3.0], 1), (8, [float("inf"), 1.0, 1.0, 1.0], 1)]
    data += [(i, good, 1) for i in range(10, 40)]
    df = spark.createDataFrame([(u, v, f"2020-01-0{t + 1}", "x", "y") for u, v, t in data], "u int, v array<double>, t string, id string, vec string").withColumn("t", nb.F.col("t").cast("timestamp"))
    assert [r[0] for r in rows(usable_vectors(df, "u", "v", 4, "t"), "id")] == sorted([1, *range(10, 40)], key=lambda i: str((i,)))
    got = {}
    for a, b in rows(neighbours(df, "u", "v", 4, 3, 0.9, newest="t"), "id", "near"):
        got.setdefault(a, set()).add(b)
    ids = [1, *range(10, 40)]
    assert got == {i: set([j for j in ids if j != i][:3]) for i in ids}
    assert neighbours(df.limit(0), "u", "v", 4, 3).count() == 0


def test_crowded_cell_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nb, "DB_BLOCK", 150)
    monkeypatch.setattr(nb, "QUERY_BLOCK", 100)
    x = np.random.default_rng(3).standard_normal((600, 8)) * 0.05 + 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "u int, v array<float>")
    row = recall(neighbours(df, "u", "v", 8, 5, cells=2), exact_neighbours(df, "u", "v", 8, 5)).first()
    assert row["recall"] >= 0.9


@pytest.mark.parametrize("floor", [-2.0, 0.9])
def test_group_of_near_copies_is_not_cut(spark, floor):
    """A third of the vectors within a cosine of 0.99 of each other: all probed, so all neighbours are found."""
    x = vectors(3000, 48)
    r = np.random.default_rng(6)
    x[::3] = r.standard_normal(48) + 0.08 * r.standard_normal((1000, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "u int, v array<float>")
    row = recall(neighbours(df, "u", "v", 48, 5, floor, probes=2, cells=2), exact_neighbours(df, "u", "v", 48, 5, floor)).first()
    assert row["n_exact"] >= 5000 and row["recall"] == 1


def test_codes_round_trip_and_score_error():
    x = nb._unit(vectors(2000, 16)).astype(np.float32)
    q = nb.fit(x, 20)
    cell = q.assign(x, 1)[:, 0]
    codes = q.encode(x, cell)
    assert codes.max() < 16 and np.array_equal(nb.unpack(nb.pack(codes), codes.shape[1]), codes)
    plain = nb.Quantiser(q.cells, q.books, 1.0)
    along = lambda z: np.abs(((x - z.decode(z.encode(x, cell), cell)) * x).sum(1)).mean()
    assert along(q) < along(plain)
    rounded = x.astype(np.float16).astype(np.float32)[:300]
    table, base, step, slack = nb.tables(q, rounded)
    score = nb.scan_codes(table, nb.pack(codes)) * step + base + (q.cells[cell] @ rounded.T)
    assert np.abs(score - q.decode(codes, cell) @ x[:300].T).max() < (slack * step).max() + nb.HALF * 1.5
    assert nb.parallel_weight(48, 0.2) == pytest.approx(47 * 0.04 / 0.96)


def test_cells_grow_beyond_what_the_sample_can_carry():
    x = nb._unit(vectors(640, 8)).astype(np.float32)
    cells = nb.coarse_cells(x, 400, 4, np.random.default_rng(1))
    assert len(cells) == 40 * 10 and np.allclose(np.linalg.norm(cells, axis=1), 1, atol=1e-5)
    few = nb.coarse_cells(x, 40, 4, np.random.default_rng(1))
    assert (x @ cells.T).max(1).mean() > (x @ few.T).max(1).mean()


def test_odd_dimensions(spark):
    x = vectors(600, 7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "u int, v array<float>")
    row = recall(neighbours(df, "u", "v", 7, 5), exact_neighbours(df, "u", "v", 7, 5)).first()
    assert row["n_exact"] == 3000 and row["recall"] >= 0.9


def near_floor(n=4000, dim=48, group=10):
    """Groups larger than k of vectors whose cosines lie about 0.92."""
    r = np.random.default_rng(11)
    x = np.repeat(nb._unit(r.standard_normal((n // group, dim))), group, 0)
    return x + 0.29 * nb._unit(r.standard_normal(x.shape))


def test_with_a_floor_a_pair_counts_from_either_side(spark):
    """Whoever probes the other's cell, both vectors get the pair."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near_floor())], "u int, v array<float>")
    got = {(a, b): c for a, b, c in rows(neighbours(df, "u", "v", 48, 5, 0.9, probes=2, cells=60), "id", "near", "cos")}
    lists = {}
    for (a, _), c in got.items():
        lists.setdefault(a, []).append(c)
    assert len(got) > 10_000 and max(map(len, lists.values())) == 5
    assert all((b, a) in got or len(lists.get(b, [])) == 5 and min(lists[b]) >= c - 1e-12 for (a, b), c in got.items())


def test_neighbours_from_a_floor_are_all_found(spark):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near_floor())], "u int, v array<float>")
    row = recall(neighbours(df, "u", "v", 48, 5, 0.9), exact_neighbours(df, "u", "v", 48, 5, 0.9)).first()
    assert row["n_exact"] > 10_000 and row["recall"] == 1
