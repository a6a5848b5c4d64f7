from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillstone.functions import arrays
from rillstone.functions import autodiff as ad
from rillstone.operators import bipartite, factor, graph, knn, metrics, neural, ranking, sampling, serving, similarity
from rillstone.session import scratch
from rillstone.streaming import updates
from rillstone.streaming.updates import CosineStream

MATRIX = [[1, 1, 0, 0], [2, 1, 0, 0], [0, 1, 1, 0], [2, 1, 1, 0], [0, 1, 2, 0]]


def frame(spark, matrix):
    return spark.createDataFrame([(i, u, float(x)) for i, r in enumerate(matrix) for u, x in enumerate(r) if x], "item int, user int, label double")


def order(pairs):
    out = {}
    for e, n, _, r in rows(similarity.neighbors(pairs, 9).select("entity", "neighbor", "sim", "rank")):
        out.setdefault(e, []).append((r, n))
    return {e: [n for _, n in sorted(v)] for e, v in out.items()}


def test_neighbours(spark):
    got = order(similarity.similarities(frame(spark, MATRIX), "item", "user", "label"))
    assert got == {0: [1, 3, 2, 4], 1: [0, 3, 2, 4], 2: [4, 3, 0, 1], 3: [1, 0, 2, 4], 4: [2, 3, 0, 1]}


@pytest.mark.parametrize("kind", ["cosine", "pearson", "jaccard"])
@pytest.mark.parametrize("least", [1, 2])
def test_similarities_equal_brute_force(spark, kind, least):
    m = np.array(MATRIX, float)
    got = {(r["a"], r["b"]): r["sim"] for r in similarity.similarities(frame(spark, MATRIX), "item", "user", "label", kind, least).collect()}
    x, has = m.copy(), m > 0
    if kind == "pearson":
        x = np.where(has, m - (m.sum(1) / has.sum(1))[:, None], 0)
    want = {}
    for a in range(5):
        for b in range(a + 1, 5):
            c = (has[a] & has[b]).sum()
            if c >= least:
                n = np.linalg.norm(x[a]) * np.linalg.norm(x[b])
                want[a, b] = c / (has[a].sum() + has[b].sum() - c) if kind == "jaccard" else (x[a] @ x[b] / n if n else 0.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert similarity.similarities(frame(spark, MATRIX).limit(0), "item", "user", "label", kind).count() == 0


def test_increments_equal_all_at_once(spark, monkeypatch):
    full = frame(spark, MATRIX)
    path = scratch(spark, "cos")
    open_ = lambda: CosineStream(spark, path, "item", "user", "label")
    open_().merge(full.where("user < 2"), 0)
    open_().merge(full.where("user >= 2"), 1)  # a new object finds the state of the one before
    s = open_()
    s.merge(full.where("user >= 2"), 1)  # replayed
    s.merge(full.where("user < 1"), 2)  # known rows add nothing
    want = {(r["a"], r["b"]): r["sim"] for r in similarity.similarities(full, "item", "user", "label").collect()}
    assert len(s.manifest.read()["parts"]) == 3
    monkeypatch.setattr(updates, "COMPACT", 4)
    for b in (3, 4):
        got = {(r["a"], r["b"]): r["sim"] for r in s.similarities().collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        s.merge(full.limit(0), b)
    assert len(s.manifest.read()["parts"]) == 2


def test_swing(spark):
    df = frame(spark, [[1, 1, 1], [1, 1, 0], [1, 0, 1], [1, 1, 1], [0, 0, 1]])
    w0, w1, w2 = 1 / math.sqrt(4), 1 / math.sqrt(3), 1 / math.sqrt(4)
    got = {(r["a"], r["b"]): r["sim"] for r in similarity.swing(df, "user", "item").collect()}
    want = {(0, 1): w0 * w1 / 3, (0, 2): w0 * w2 / 3, (0, 3): w0 * w1 / 3 + w0 * w2 / 3 + w1 * w2 / 2}
    assert {k: v for k, v in got.items() if k[0] == 0} == pytest.approx(want)


def test_ranking(spark):
    preds = {1: [-0.1, -0.01, 0, 0.1, 0.01], 2: [1.0, -2.0, 4.0, 5.0, 6.0]}
    scores = spark.createDataFrame([(u, i, float(x)) for u, v in preds.items() for i, x in enumerate(v)], "user int, item int, score double")
    seen = spark.createDataFrame([(1, 3), (1, 4), (2, 4)], "user int, item int")
    lists = lambda n: {u: [i for _, i in sorted((r["rank"], r["item"]) for r in ranking.recommend_top_n(scores, "user", "item", seen, n, 5).collect() if r["user"] == u)] for u in (1, 2)}
    assert lists(2) == {1: [2, 1], 2: [3, 2]}
    assert lists(4) == {1: [3, 4, 2, 1], 2: [3, 2, 0, 1]}
    with pytest.raises(ValueError):
        lists(12)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.1), (1, 1, 0.1), (2, 1, 0.3), (2, 1, 0.7)], "user int, label int, pred double")
    assert metrics.roc_auc(df).first()[0] == pytest.approx((3 + 0.5) / 4)
    assert metrics.roc_gauc(df, "user").first()[0] == pytest.approx(0.75 * 3 / 5)
    recs = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "user int, item int, rank int")
    truth = spark.createDataFrame([(1, 8), (1, 9), (1, 50), (1, 8)], "user int, item int")
    r = metrics.user_list_metrics(recs, truth, "user", "item", 3).first()
    assert (r["n_hits"], r["precision"], r["recall"]) == (2, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert r["map"] == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert r["ndcg"] == pytest.approx((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)))
    with pytest.raises(ValueError):
        metrics.check_metrics("rating", ["ndcg"], 10)


def test_blocked_product(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 30)
    x = np.round(np.random.default_rng(0).standard_normal((100, 6)), 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    for kind in ("cosine", "inner-product"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True) if kind == "cosine" else x
        s = np.round(u @ u.T, 9)
        got = rows(knn.blocked_top_k(df, df, "id", "id", "v", 4, kind), "q", "rank", "i")
        assert sorted(got) == sorted((q, r + 1, int(i)) for q in range(100) for r, i in enumerate(np.lexsort((np.arange(100), -s[q]))[:4]))


def test_inverted_file_reaches_its_recall(spark):
    x = np.random.default_rng(4).standard_normal((1200, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    want = set(rows(knn.blocked_top_k(df, df, "id", "id", "v", 10, "inner-product"), "q", "i"))
    index = knn.IvfIndex(df, "id", "v")
    assert len(want & set(rows(index.search(df, "id", "v", 10), "q", "i"))) / len(want) >= 0.9
    assert index.choose_probes(df, "id", "v", 10, 0.5) < index.choose_probes(df, "id", "v", 10) <= index.nlist


def test_propagation(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "src int, dst int")
    x = np.array([[1.0, 0], [0, 1], [2, 2]])
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node int, vec array<double>")
    a = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]]) / np.sqrt(np.outer([1, 2, 1], [1, 2, 1]))
    want = (x + a @ x + a @ a @ x) / 3
    got = dict(rows(graph.lightgcn(edges, vec, "node", "vec", 2, 2), "node", "vec"))
    assert np.allclose([got[i] for i in range(3)], want)
    w1, w2 = np.eye(2), np.ones((2, 2))
    r = np.array([[1, 1, 0], [1, 1, 1], [0, 1, 1]]) / np.array([[2], [3], [2]])
    side = r @ x
    y = side @ w1 + (side * x) @ w2
    y = np.where(y > 0, y, 0.2 * y)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    got = dict(rows(graph.ngcf(edges, vec, "node", "vec", 2, [(w1, w2)]), "node", "vec"))
    assert np.allclose([got[i] for i in range(3)], np.hstack([x, y]))


def test_als_explicit_solves_its_normal_equations(spark):
    r = np.random.default_rng(0)
    u, v = r.standard_normal((12, 2)), r.standard_normal((10, 2))
    data = [(i, j, float(u[i] @ v[j])) for i in range(12) for j in range(10) if (i + j) % 4]
    users, items = factor.als(spark.createDataFrame(data, "u int, i int, r double"), "u", "i", "r", 2, 12, 0.01, implicit=False)
    a, b = ({x["id"]: np.array(x["f"]) for x in f.collect()} for f in (users, items))
    assert np.sqrt(np.mean([(x - a[i] @ b[j]) ** 2 for i, j, x in data])) < 0.1
    with pytest.raises(ValueError):
        factor.als(None, "u", "i", "r", reg=0)


def test_gradients_are_right():
    r = np.random.default_rng(1)
    n = 6
    b = {
        "user": r.integers(0, 5, n), "item": r.integers(0, 7, n), "negative": r.integers(0, 7, n), "label": r.integers(0, 2, n).astype(float), "rate": np.full(n, 0.2),
        "sparse": r.integers(0, 9, (n, 2)), "dense": r.standard_normal((n, 4)), "seq": r.integers(0, 8, (n, 4)), "seq_len": r.integers(1, 5, n),
    }
    for name in neural.MODELS:
        for loss in ("cross_entropy", "focal", "bpr") if name != "TwoTower" else ("softmax", "max_margin"):
            spec = neural.ModelSpec(name, 5, 7, 4, (5,), 9, 2, 4, 4, loss=loss, layers=1)
            p = neural.Init(spec)
            value = neural.loss_of(spec, p, b)
            for v in p.values.values():
                v.value = v.value + r.normal(0, 0.1, v.shape)
            value = neural.loss_of(spec, p, b)
            value.backward()
            for k in list(p.values)[:4]:
                v = p.values[k]
                at = tuple(r.integers(0, d) for d in v.shape) if v.grad is None else np.unravel_index(np.abs(v.grad).argmax(), v.shape)
                keep, h = v.value[at], 1e-5
                v.value[at] = keep + h
                up = float(neural.loss_of(spec, p, b).value)
                v.value[at] = keep - h
                down = float(neural.loss_of(spec, p, b).value)
                v.value[at] = keep
                want = (up - down) / (2 * h)
                assert (0 if v.grad is None else v.grad[at]) == pytest.approx(want, rel=2e-3, abs=1e-6), (name, loss, k)


def test_training_learns_and_grows(spark):
    r = np.random.default_rng(2)
    data = [(int(u), int(i), float((u % 2) == (i % 2))) for u, i in zip(r.integers(0, 20, 2000), r.integers(0, 20, 2000), strict=True)]
    df = spark.createDataFrame(data, "user int, item int, label double")
    spec = neural.ModelSpec("NCF", 20, 20, 8, (16,), rounds=4, lr=0.02, batch=64)
    m = neural.train(df, spec)
    assert m.losses[-1] < m.losses[0]
    assert metrics.roc_auc(m.score(df, ["label"])).first()[0] > 0.9
    big = neural.NeuralModel.loads(m.dumps()).rebuild(30, 25)
    assert big.params["user"].shape[0] == 31 and np.array_equal(big.params["user"][:20], m.params["user"][:20])
    assert big.embeddings("item").shape == (26, 8)
    with pytest.raises(ValueError):
        neural.ModelSpec("DIN", 1, 1)
    with pytest.raises(ValueError):
        neural.train(df.limit(0), spec)


def test_steps_of_touched_rows_equal_those_of_a_dense_adam():
    """Rows that are seldom read miss no step of the momentum; only touched rows are held and sent."""
    r = np.random.default_rng(3)
    one, dense, adam = neural.Touched(neural.ModelSpec("BPR", 3, 3), {"x": np.zeros((3, 4))}, 0.01), {"x": ad.Var(np.zeros((3, 4)))}, neural.Adam(0.01)
    for _ in range(300):
        hit = np.flatnonzero(r.random(3) < np.array([0.5, 0.05, 0.01]))
        g = np.zeros((3, 4))
        g[hit] = r.normal(0, 1e-3, (len(hit), 4))
        if len(hit):
            one.rows("x", (3, 4), hit)
            one.read[-1][2].grad = g[hit]
        one.step()
        dense["x"].grad = g
        adam.step(dense)
    moved = np.zeros((3, 4))
    for _, _, ids, change in one.changes():
        moved[ids] += change
    assert np.allclose(moved, dense["x"].value, atol=5e-6)
    for name, loss in (("NCF", "cross_entropy"), ("YouTubeRanking", "cross_entropy"), ("TwoTower", "bpr"), ("SVDpp", "cross_entropy")):
        spec = neural.ModelSpec(name, 400, 300, 4, (5,), 9, 2, 4, 4, loss=loss, lr=0.01)
        draw = lambda: {
            "user": (r.random(16) ** 3 * 200).astype(int), "item": (r.random(16) ** 3 * 200).astype(int), "negative": r.integers(0, 200, 16), "label": r.integers(0, 2, 16).astype(float), "sparse": r.integers(0, 9, (16, 2)),
            "dense": r.standard_normal((16, 4)), "seq": r.integers(0, 200, (16, 4)), "seq_len": r.integers(1, 5, 16),
        }
        batches = [draw() for _ in range(120)]
        dense, adam = neural.Init(spec), neural.Adam(spec.lr)
        neural.MODELS[name][0](dense, batches[0])
        start = {k: v.value.copy() for k, v in dense.values.items()}
        touched = neural.Touched(spec, start, spec.lr)
        for b in batches:
            for p, step in ((dense, lambda: adam.step(dense.values)), (touched, touched.step)):  # noqa: B023
                neural.loss_of(spec, p, b).backward()
                step()
        got = {k: v.copy() for k, v in start.items()}
        for k, _, ids, change in touched.changes():
            got[k].reshape(-1, got[k].shape[-1])[ids] += change
        for k, v in dense.values.items():
            assert np.abs(got[k] - v.value).mean() < 2e-3 * np.abs(start[k] - v.value).mean() + 1e-12, (name, k)  # kinks spread what eps leaves
        assert touched.tables["user"]["n"] < 200 and len(touched.tables["user"]["p"]) <= 401


def test_graph_models_learn_through_propagation(spark):
    """Two groups of users and items: trained pairwise, the own group's unseen items score higher; training and scores agree."""
    r = np.random.default_rng(5)
    pairs = sorted({(int(u), int(2 * i + u % 2)) for u, i in zip(r.integers(0, 20, 120), r.integers(0, 10, 120), strict=True)})
    df = spark.createDataFrame(pairs, "user int, item int")
    data = [(u, i, int(j), 1.0) for u, i in pairs for j in r.integers(0, 10, 6) * 2 + 1 - u % 2]
    triples = spark.createDataFrame(data, "user int, item int, negative int, label double")
    grid = spark.createDataFrame([(u, i) for u in range(20) for i in range(20)], "user int, item int")
    seen, scores = set(pairs), []
    for name in neural.GRAPH_MODELS:
        spec = neural.ModelSpec(name, 20, 20, 8, layers=1, rounds=4, lr=0.02, batch=32, loss="bpr")
        rows_ = neural.with_graph_samples(triples, df, spec, 40)  # all neighbours
        m = neural.train(rows_, spec)
        got = {(u, i): x for u, i, x in rows(m.score_graph(grid, df), "user", "item", "pred")}
        own, other = ([got[u, i] for u in range(20) for i in range(20) if (u, i) not in seen and (u + i) % 2 == k] for k in (0, 1))
        assert m.losses[-1] < m.losses[0] and np.mean(own) > np.mean(other) + 0.1
        p = neural.Init(spec)
        p.values = {k: ad.Var(v) for k, v in m.params.items()}
        b = neural._batch(rows_.limit(50).toArrow())
        z = neural.MODELS[name][0](p, b).value[:, 0]
        assert np.allclose(1 / (1 + np.exp(-z)), [got[u, i] for u, i in zip(b["user"], b["item"], strict=True)])
        scores.append(got)
        with pytest.raises(ValueError):
            neural.train(triples, spec)
    assert scores[0] != scores[1]


def test_graph_samples_estimate_the_sum(spark):
    star = [(0, 2 * k + 1) for k in range(10)]
    edges = spark.createDataFrame(star + [(b, a) for a, b in star], "src int, dst int")
    near = {n: (x, w) for n, x, w in rows(graph.sampled_sums(edges, 4))}
    assert len(near[0][0]) == 4 and sum(near[0][1]) == pytest.approx(10 / np.sqrt(10)) and near[3] == ([0], [pytest.approx(1 / np.sqrt(10))])


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [[1.0, 2.0], [3.0, 5.0]], [True, False])], "a array<double>, z array<double>, m array<array<double>>, ok array<boolean>")
    one = df.select(arrays.norm("a"), arrays.cosine("a", "z"), arrays.normalize("z"), arrays.pool(F.col("m"), F.col("ok"), 2, "mean"), arrays.pool(F.col("m"), F.array(F.lit(False), F.lit(False)), 2)).first()
    assert tuple(one) == (5.0, 0.0, [0.0, 0.0], [1.0, 2.0], [0.0, 0.0])
    x = ad.Var(np.array([0.5, -1.0]))
    ad.softmax(x)[0].backward()
    assert x.grad.sum() == pytest.approx(0)


def test_requests(spark):
    raw = spark.createDataFrame([('{"user": 1, "n_rec": 3}',), ('{"user": 1, "n_rec": 3, "x": 1}',), ("{",), ('{"n_rec": 1}',), ('{"user": "a", "n_rec": 0}',), (None,)], "value string")
    assert [r["error"] for r in serving.parse_requests(raw).collect()] == [None, "unknown field", "malformed", "no user", "bad n_rec", "malformed"]


def test_item_neighbours_of_graph_models(spark):
    """Sequences of GraphSage and PinSage come from the item's graph, not from the row's user, and PinSage's weights differ."""
    from types import SimpleNamespace

    from rillstone.plans import learned

    lists = [(0, [0, 1]), (1, [0, 1]), (2, [0, 2]), (3, [3])]
    cat = SimpleNamespace(user_consumed=spark.createDataFrame(lists, "user int, items array<int>"), n_items=4)
    data = spark.createDataFrame([(u, i, 1.0, [9], 1, [0.5]) for u, items in lists for i in items], "user int, item int, label double, seq array<int>, seq_len int, dense array<double>")
    linked = {0: {1, 2}, 1: {0, 2}, 2: {0, 1}, 3: set()}
    for name in ("GraphSage", "PinSage"):
        got = {}
        for item, seq, n, w in rows(learned._with_item_neighbors(name, cat, data), "item", "seq", "seq_len", "dense"):
            near = [x for x in seq if x != 4]
            assert len(seq) == len(w) == learned.L and set(near) <= linked[item] and n == max(len(near), 1)
            assert got.setdefault(item, (seq, w)) == (seq, w)
            if near:
                assert sum(w) == pytest.approx(1 if name == "PinSage" else len(near))
        assert any(set(s) - {4} for s, _ in got.values()) and set(got[3][0]) == {4}


def test_als_implicit_equals_dense_solves_for_any_ids(spark):
    data = [(f"u{i}", f"i{j:02}", float(1 + (i * j) % 5)) for i in range(9) for j in range(7) if (i + 2 * j) % 3]
    users, items = factor.als(spark.createDataFrame(data, "u string, i string, r double"), "u", "i", "r", 3, 2, 0.1, 2.0)
    x, y = ({r["id"]: np.array(r["f"]) for r in f.collect()} for f in (users, items))
    assert set(x) == {d[0] for d in data} and set(y) == {d[1] for d in data}
    whole = np.array(list(x.values()))
    for j in y:
        own = [(x[u], 2.0 * r + 1) for u, i, r in data if i == j]
        left = whole.T @ whole + sum((c - 1) * np.outer(v, v) for v, c in own) + 0.1 * np.eye(3)
        assert np.allclose(y[j], np.linalg.solve(left, sum(c * v for v, c in own)))


def test_pruned_top_k_equals_all_pairs_and_multiplies_few(spark, monkeypatch):
    r = np.random.default_rng(3)
    y = r.standard_normal((4000, 4)) + 2.0
    y[7] = y[3000] = y[3999]
    x = r.standard_normal((300, 4))
    x[5] = 0
    q, i = (spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(m)], "id long, v array<double>") for m in (x, y))
    assert rows(knn.pruned_top_k(q, i, "id", "id", "v", 6)) == rows(knn.blocked_top_k(q, i, "id", "id", "v", 6, "inner-product"))
    few = i.where("id < 3")
    assert rows(knn.pruned_top_k(q, few, "id", "id", "v", 6)) == rows(knn.blocked_top_k(q, few, "id", "id", "v", 6, "inner-product"))
    monkeypatch.setattr(knn, "LEAF", 8)
    monkeypatch.setattr(knn, "SMALL", 100)
    monkeypatch.setattr(knn, "LONGEST", 64)
    got = {}
    for a, b, s in knn.best_products(x, y, 6):
        for n, j, z in zip(a.tolist(), b.tolist(), s.tolist(), strict=True):
            got.setdefault(n, []).append((j, z))
    all_ = np.round(x @ y.T, 9)
    assert all([j for j, _ in got[n]] == np.lexsort((np.arange(len(y)), -all_[n]))[:6].tolist() for n in range(len(x)))


def test_cf_predicts_without_the_similar_pairs(spark):
    r = np.random.default_rng(4)
    log = spark.createDataFrame([(int(u), int(i), float(1 + (u * i) % 5)) for u in range(12) for i in r.choice(20, 7, False)], "user long, item long, label double")
    pairs = spark.createDataFrame([(u, i) for u in range(13) for i in range(22)] + [(1, 2), (None, 3), (3, None)], "user long, item long")
    for by, kind, task, least in (("item", "jaccard", "rating", 1), ("item", "cosine", "ranking", 2), ("user", "cosine", "rating", 1), ("user", "pearson", "ranking", 1)):
        m = similarity.CfModel(log, "user", "item", by, kind, 3, least, task)
        got = rows(m.predict(pairs, 2.5).select("user", "item", F.round("pred", 9)))
        assert m._sims is None  # no pairs were written
        group, other = ("user", "item") if by == "item" else ("item", "user")
        m.sims  # noqa: B018
        assert got == rows(similarity.cf_predict(pairs, m.history, similarity.both_ways(m.sims), group, other, other, task, 3, 2.5, (1, 5)).select("user", "item", F.round("pred", 9)))


def _mapped_graph(spark):
    """Random pairs, with unknown ids among them, a crowded item and items without a second user."""
    r = np.random.default_rng(11)
    pairs = sorted({(int(u), int(i)) for u, i in zip(r.integers(0, 60, 500), r.integers(0, 40, 500) ** 2 // 40, strict=True)} | {(60, 3), (4, 41)} | {(u, 1) for u in range(0, 60, 2)})
    df = spark.createDataFrame(pairs, "user int, item int")
    return pairs, df, bipartite.Bipartite.write(df.withColumn("liked", (F.col("item") % 2).cast("int")), 60, 41)


def test_mapped_graph_equals_joins(spark):
    """sampled neighbours, negatives and propagation looked up in files are those of the joins."""
    pairs, df, g = _mapped_graph(spark)
    assert rows(g.rows(spark, 5)) == sorted([(u, i, i % 2) for u, i in pairs], key=str)
    asked = df.where("user < 60 and item < 41")
    triples = sampling.unconsumed_negatives(asked.withColumn("row", F.col("user").cast("long") * 41 + F.col("item")).withColumn("label", F.lit(1.0)), "row", "user", "item", df, 41, 1)
    assert rows(g.negatives(asked, 1)) == rows(triples, "user", "item", "label", "negative")
    near = {side: g.sampled(spark, side, 6) for side in ("user", "item")}
    for name, kind in (("LightGCN", "symmetric"), ("NGCF", "row")):
        spec = neural.ModelSpec(name, 60, 41, 4, layers=1, rounds=1, loss="bpr")
        want = neural._batch(neural.with_graph_samples(triples, df, spec, 6).toArrow())
        got = bipartite.sampled_near(g, near, kind)()({c: want[c] for c in ("user", "item", "negative")})
        for c in ("user", "item", "negative"):
            assert np.array_equal(got[f"{c}_near"], want[f"{c}_near"]) and np.allclose(got[f"{c}_w"], want[f"{c}_w"])
        m = neural.train(triples, spec, look=bipartite.sampled_near(g, near, kind))
        one, two = (rows(x, "user", "item", "pred") for x in (m.score_graph(df, df), m.score_mapped(df, g)))
        assert [x[:2] for x in one] == [x[:2] for x in two] and np.allclose([x[2] for x in one], [x[2] for x in two])
        assert len({round(x[2], 9) for x in two}) > 100


def test_mapped_visits_equal_walks(spark):
    """the most visited items, looked up in files, are those of the walks by joins, with their shares."""
    pairs, df, g = _mapped_graph(spark)
    iu, ui = graph.adjacency(df, "item", "user"), graph.adjacency(df, "user", "item")
    want = {}
    for node, near, w in rows(graph.weighted_neighbors(graph.bipartite_walk_pairs(df.select("item").distinct(), "item", iu, ui, 6, 2, True), 5), "node", "neighbor", "weight"):
        want.setdefault(node, []).append((near, w))
    held = bipartite.by_key("item", g.visited(spark, 5, 6, 2))()({"item": np.arange(42)})
    for i in range(42):
        near = [(int(n), w) for n, w in zip(held["seq"][i], held["dense"][i], strict=True) if n != 41 or w]
        assert near == [(n, pytest.approx(w)) for n, w in sorted(want.get(i, []))] and held["seq_len"][i] == max(len(near), 1)


def test_graph_queries_shuffle_no_neighbours(spark, tmp_path, monkeypatch):
    """the queries train and score without a join with neighbours, walks or sequences; rows of users without features are left out, repeated rows stay."""
    from rillstone.plans import learned

    r = np.random.default_rng(2)
    orders = [(k, k % 12, f"2024-01-{1 + k % 28:02d} 00:00:00") for k in range(90)]
    lines = [(k, int(i), n, 1, float(q), 1.0) for k, _, _ in orders for n, (i, q) in enumerate(zip(r.integers(0, 15, 4), r.integers(1, 50, 4), strict=True))]
    frame_ = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    frame_(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double", "lineitem")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").select("o_orderkey", "o_custkey", F.to_timestamp("d").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    frame_([(k,) for k in range(11)], "c_custkey long", "customer")  # none for user 11
    train = learned.chrono_split(spark, str(tmp_path)).where("fold = 0")
    want = rows(train.where("user < 11").groupBy("user").count())
    for f in ("bipartite_walk_pairs", "adjacency", "sampled_sums", "normalized_edges"):
        monkeypatch.setattr(graph, f, lambda *a, **k: pytest.fail("neighbours are joined"))
    for name in ("model_pinsage", "model_lightgcn", "model_ngcf"):
        got = rows(learned.QUERIES[name](spark, str(tmp_path)), "user", "n", "mean_pred")
        assert [x[:2] for x in got] == want and all(0 < x[2] < 1 for x in got)


#: Ids of a vocabulary that is larger than a million: each has a row of its own.
MANY = 1_200_000


def test_mapped_scores_of_many_items(spark):
    """LightGCN's vectors are those of the ids themselves, however many there are."""
    pairs = [(0, 7), (0, 1_150_000), (1, 7), (1, MANY - 1), (2, 1_000_003)]
    df = spark.createDataFrame(pairs, "user int, item int")
    g = bipartite.Bipartite.write(df, 3, MANY)
    r = np.random.default_rng(4)
    e = {"user": r.standard_normal((4, 2)), "item": r.standard_normal((MANY + 1, 2))}
    m = neural.NeuralModel(neural.ModelSpec("LightGCN", 3, MANY, 2, layers=1, loss="bpr"), e, [])
    near, back = ({k: [p[1 - at] for p in pairs if p[at] == k] for k in {p[at] for p in pairs}} for at in (0, 1))

    def vector(side, k):
        own, other, far = (near, back, "item") if side == "user" else (back, near, "user")
        return (e[side][k] + sum(e[far][n] / np.sqrt(len(own[k]) * len(other[n])) for n in own[k])) / 2

    for u, i, pred in rows(m.score_mapped(df, g), "user", "item", "pred"):
        assert pred == pytest.approx(1 / (1 + np.exp(-vector("user", u) @ vector("item", i))))


def test_training_with_many_items_moves_their_own_rows(spark):
    """SVDpp trains one row for each id, however many there are, and no other."""
    spec = neural.ModelSpec("SVDpp", 3, MANY, 2, seq_len=2, rounds=1, batch=4)
    data = [(u, i, float(u % 2), [7, 1_150_000], 2) for u, i in ((0, 5), (1, 1_000_003), (2, MANY - 1))]
    m = neural.train(spark.createDataFrame(data, "user int, item int, label double, seq array<int>, seq_len int").coalesce(1), spec)
    p = neural.Init(spec)
    neural.MODELS["SVDpp"][0](p, {"user": np.zeros(1, int), "item": np.zeros(1, int), "seq": np.zeros((1, 2), int), "seq_len": np.ones(1, int)})
    moved = {k: set(np.flatnonzero((m.params[k] != p.values[k].value).any(1)).tolist()) for k in ("item", "implicit", "item.l")}
    assert moved == {"item": {5, 1_000_003, MANY - 1}, "item.l": {5, 1_000_003, MANY - 1}, "implicit": {7, 1_150_000}}
