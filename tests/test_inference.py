from __future__ import annotations

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillstone.operators import inference
from rillstone.operators.similarity import CfModel
from rillstone.session import scratch

VECTORS = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.6, 0.8]}


def embed(spark, task="ranking"):
    users = spark.createDataFrame([(u, v) for u, v in VECTORS.items()], "user long, v array<double>")
    items = spark.createDataFrame([(10, [1.0, 0.2]), (11, [0.1, 2.0]), (12, [-1.0, 0.0]), (13, [0.5, 0.5])], "item long, v array<double>")
    history = spark.createDataFrame([(1, 10), (1, 10), (2, 13), (9, 12)], "user long, item long")
    defaults = spark.createDataFrame([(12, 1), (10, 2), (11, 3)], "item long, rank long")
    return inference.EmbedModel(users, items, history, defaults, task=task)


def test_embed_model_recommends_predicts_and_comes_back(spark):
    m = embed(spark)
    ask = spark.createDataFrame([(1,), (2,), (7,), (None,), (1,)], "user long")
    got = rows(m.recommend_user(ask, 2), "user", "rank", "item")
    assert got == [(1, 1, 13), (1, 2, 11), (2, 1, 11), (2, 2, 10), (7, 1, 12), (7, 2, 10)]
    assert rows(m.recommend_user(ask, 1, filter_consumed=False).where("user = 1"), "item") == [(10,)]
    best = rows(m.default_recs(2), "rank", "item")
    assert [i for _, i in best] == [11, 10]
    assert rows(m.recommend_user(ask, 1, "average").where("user = 7"), "item") == [(11,)]
    with pytest.raises(ValueError, match="cold start"):
        m.recommend_user(ask, 1, "none")
    with pytest.raises(ValueError, match="exceeds"):
        m.recommend_user(ask, 9)
    pairs = spark.createDataFrame([(1, 10), (8, 10), (1, 99)], "user long, item long")
    p = {(r["user"], r["item"]): r["pred"] for r in m.predict(pairs, "popular", 0.25).collect()}
    assert p[1, 10] == pytest.approx(1 / (1 + math.exp(-1))) and p[8, 10] == p[1, 99] == 0.25
    mean = {(r["user"], r["item"]): r["pred"] for r in m.predict(pairs).collect()}
    assert mean[8, 10] == pytest.approx(1 / (1 + math.exp(-(1.6 / 3 + 0.2 * 1.8 / 3))))
    path = scratch(spark, "embed")
    m.save(path)
    assert rows(inference.EmbedModel.load(spark, path).recommend_user(ask, 2), "user", "rank", "item") == got
    with pytest.raises(OSError):
        inference.EmbedModel.load(spark, path + "-none")
    assert rows(m.similar("user", ask, 1), "q", "i") == [(1, 3), (2, 3)]


def test_long_histories_are_asked_in_classes(spark):
    n = 700
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "item long, v array<double>")
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "user long, v array<double>")
    history = spark.createDataFrame([(1, i) for i in range(60, n)] + [(2, i) for i in range(600, n)] + [(3, 0)], "user long, item long")
    m = inference.EmbedModel(users, items, history, items.select("item", F.lit(1).alias("rank")).limit(1))
    assert rows(m.recommend_user(users, 2), "user", "rank", "item") == [(1, 1, 59), (1, 2, 58), (2, 1, 599), (2, 2, 598), (3, 1, 1), (3, 2, 2)]


def features(spark):
    users = spark.createDataFrame([(1, 0.5, "a"), (2, 2.0, "b")], "user long, x double, g string")
    items = spark.createDataFrame([(i, float(i)) for i in range(5)], "item long, y double")
    history = spark.createDataFrame([(1, 4)], "user long, item long")
    score = F.col("x") * F.col("y") + F.when(F.col("g") == "b", -10.0).otherwise(0.0)
    return inference.FeatureModel(users, items, score, history, {"x": -1.0, "g": "a"}, {"y": 0.25})


def test_feature_model_assembles_patches_and_draws(spark):
    m = features(spark)
    ask = spark.createDataFrame([(1, None), (2, {"g": "a", "nonsense": "1"}), (5, {"x": "3"}), (None, None)], "user long, f map<string,string>")
    recs = {(r["user"], r["rank"]): (r["item"], r["score"]) for r in m.recommend_user(ask, 2, "f").collect()}
    assert recs == {(1, 1): (3, 1.5), (1, 2): (2, 1.0), (2, 1): (4, 8.0), (2, 2): (3, 6.0), (5, 1): (4, 12.0), (5, 2): (3, 9.0)}
    plain = {(r["user"], r["rank"]): r["item"] for r in m.recommend_user(ask, 1).collect()}
    assert plain == {(1, 1): 3, (2, 1): 4, (5, 1): 0}  # unknown users by their own features
    one, again = (rows(m.recommend_user(ask, 3, "f", random_rec=True, seed=s), "user", "item", "rank") for s in (1, 1))
    assert one == again and len(one) == 9 and (1, 4) not in {(u, i) for u, i, _ in one}
    pairs = spark.createDataFrame([(1, 2), (1, 77), (6, 3)], "user long, item long")
    assert {(r["user"], r["item"]): round(math.log(r["pred"] / (1 - r["pred"])), 6) for r in m.predict(pairs).collect()} == {(1, 2): 1.0, (1, 77): 0.125, (6, 3): -3.0}
    with pytest.raises(ValueError, match="both sides"):
        inference.FeatureModel(m.users, m.users, m.score, m.history, {}, {})


def test_neighbour_model_is_stored_and_not_fitted_again(spark):
    log = spark.createDataFrame([(u, i, float(1 + (u * i) % 5)) for u in range(8) for i in range(6) if (u + i) % 3], "user int, item int, label double")
    m = CfModel(log, "user", "item", "item", "cosine", 3)
    path = scratch(spark, "cf")
    inference.save_cf(m, path)
    back = inference.load_cf(spark, path)
    assert rows(back.recommend(log, 3)) == rows(m.recommend(log, 3)) and rows(back.predict(log.select("user", "item"))) == rows(m.predict(log.select("user", "item")))


def test_evaluate(spark):
    data = spark.createDataFrame([(1, 10, 1), (1, 11, 1), (2, 10, 1), (3, 12, 0)], "user long, item long, label int")
    recs = spark.createDataFrame([(1, 10, 1), (1, 13, 2), (2, 13, 1)], "user long, item long, rank int")
    pred = lambda d: d.withColumn("pred", F.when(F.col("item") == 12, 0.1).otherwise(0.8))
    row = inference.evaluate(data, "ranking", ["precision", "recall", "loss", "roc_auc"], pred, lambda u, k: recs, k=2, n_items=4).first()
    assert row["precision"] == pytest.approx(0.25) and row["recall"] == pytest.approx(0.25) and row["roc_auc"] == 1
    assert row["loss"] == pytest.approx(-(3 * math.log(0.8) + math.log(0.9)) / 4)
    assert inference.evaluate(data, "ranking", ["coverage"], None, lambda u, k: recs, k=2, n_items=4).first()[0] == 50
    assert inference.evaluate(data, "rating", ["rmse"], pred).first()[0] == pytest.approx(math.sqrt((3 * 0.04 + 0.01) / 4))
    with pytest.raises(ValueError):
        inference.evaluate(data, "rating", ["ndcg"], pred)
    zero = data.withColumn("label", F.lit(0))
    assert inference.positives(zero).count() == 4 and inference.positives(data).count() == 3 and inference.positives(data.limit(0)).count() == 0


def test_sequences(spark):
    lists = spark.createDataFrame([(1, list(range(20))), (2, [5, 6]), (3, [])], "user int, items array<int>")
    dual = {r["user"]: (r["short_seq"], r["short_len"], r["long_seq"], r["long_len"]) for r in inference.recent_dual_seqs(lists, "items", 4, 3, F.lit(-1)).collect()}
    assert dual == {1: ([17, 18, 19], 3, [13, 14, 15, 16], 4), 2: ([5, 6, -1], 2, [-1] * 4, 1), 3: ([-1] * 3, 1, [-1] * 4, 1)}
    drawn = {r["user"]: (r["seq"], r["seq_len"]) for r in inference.random_seqs(lists, "user", "items", 5, F.lit(-1)).collect()}
    assert drawn[1][1] == 5 and drawn[1][0] == sorted(set(drawn[1][0])) and drawn[2] == ([5, 6, -1, -1, -1], 2) and drawn[3] == ([-1] * 5, 1)
    other = inference.random_seqs(lists, "user", "items", 5, F.lit(-1), seed=1).where("user = 1").first()["seq"]
    assert other != drawn[1][0]


def test_feature_model_scores_only_pairs_that_can_be_among_the_best(spark):
    linear, factors = {"ua": 0.5, "ps": -0.3, "pr": 0.2}, {"ua": [0.3, -0.4], "ps": [0.2, 0.1], "pr": [-0.1, 0.6]}
    users = spark.range(40).select(F.col("id").alias("user"), F.when(F.col("id") == 3, None).otherwise((F.col("id") % 7 - 3) / 2.0).alias("ua"))
    items = spark.range(700).select(F.col("id").alias("item"), F.when(F.col("id") == 5, None).otherwise(F.col("id") % 11 / 3.0).alias("ps"), (F.col("id") * 7 % 50 / 9.0).alias("pr"))  # many ties
    history = spark.range(1200).select((F.col("id") % 41).alias("user"), (F.col("id") * 13 % 700).alias("item"))
    score = inference.fm_score(linear, factors, 0.1)
    slow = inference.FeatureModel(users, items, score, history, {"ua": 0.25}, {"ps": 0.5, "pr": 1.0})
    fast = inference.FeatureModel(users, items, score, history, {"ua": 0.25}, {"ps": 0.5, "pr": 1.0}, vectors=inference.fm_vectors(linear, factors, ["ua"], ["ps", "pr"], 0.1))
    ask = spark.createDataFrame([(u,) for u in (0, 1, 3, 6, 39, 40, 99, None)], "user long")
    assert fast._score_best(ask, 5, 700, None, True).count() < slow.score_all(ask).count() / 2
    for n, filtered in ((5, True), (5, False), (690, True)):
        assert rows(fast.recommend_user(ask, n, filter_consumed=filtered)) == rows(slow.recommend_user(ask, n, filter_consumed=filtered))
