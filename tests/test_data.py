from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillstone.operators import features, history, sampling, split, stats, vocab
from rillstone.operators.dataset import Catalog
from rillstone.session import scratch
from rillstone.sources import tables

LOG = [(1, 11), (1, 11), (1, 999), (2, 0), (2, 11), (1, 11), (2, 999), (3, 11), (2, 999), (3, 0)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(u, i, n) for n, (u, i) in enumerate(LOG)], "user int, item int, seq int")


def test_consumed(log):
    assert dict(rows(history.consumed(log, "user", "item", ["seq"]))) == {1: [11, 999, 11], 2: [0, 11, 999], 3: [11, 0]}
    assert dict(rows(history.consumed(log, "item", "user", ["seq"]))) == {11: [1, 2, 1, 3], 999: [1, 2], 0: [2, 3]}
    assert dict(rows(history.consumed(log, "user", "item", ["seq"], "all")))[1] == [11, 999]
    assert history.consumed(log.limit(0), "user", "item", ["seq"]).count() == 0


def test_merge_consumed(spark):
    old = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5])], "user int, items array<int>")
    new = spark.createDataFrame([(0, [2, 1]), (2, [7, 8])], "user int, items array<int>")
    assert dict(rows(history.merge_consumed(old, new, "user"))) == {0: [1, 2, 3, 2, 1], 1: [4, 5], 2: [7, 8]}
    assert dict(rows(history.merge_consumed(old, new, "user", merge=False))) == {0: [2, 1], 1: [4, 5], 2: [7, 8]}


SPLIT = [(4617, 296, 964138229), (4617, 296, 964138221), (4617, 296, 964138222), (1298, 208, 974849526), (4585, 1769, 964322774), (3706, 1136, 966376465), (2137, 1215, 974640099), (4617, 208, 974170662), (1298, 1769, 977854274), (4585, 208, 974607346), (263, 1136, 976651827), (5184, 1215, 961735308)]


def test_splits(spark):
    df = spark.createDataFrame([(*x, n) for n, x in enumerate(SPLIT)], "user int, item int, time long, seq int")
    sizes = lambda s: dict(rows(s.groupBy("fold").count()))
    for order in (["seq"], ["time"]):
        assert sizes(split.split_by_ratio(df, "user", order, test_size=0.5)) == {0: 10, 1: 2}
        assert sizes(split.split_by_num(df, "user", order, 1)) == {0: 11, 1: 1}
    r = split.random_split(df, ["seq"], test_size=0.5, shuffle=False)
    train, held = r.where("fold = 0"), r.where("fold = 1")
    assert split.filter_unknown(held, train, ["user", "item"]).count() == 3
    padded = split.pad_unknown(held, train, {"user": -1, "item": -1})
    assert padded.count() == 6 and padded.agg(F.min("user")).first()[0] == -1
    assert sizes(split.random_split(df, ["seq"], multi_ratios=[0.5, 0.25, 0.25])) == {0: 6, 1: 3, 2: 3}
    for bad in ({"test_size": 1.5}, {"multi_ratios": [1]}, {}, {"test_size": 0.2, "multi_ratios": [1, 1]}):
        with pytest.raises(ValueError):
            split.fold_shares(**bad)


def test_index_space(spark):
    sizes = {"sex": 2, "occupation": 3, "actor1": 4, "actor2": 5, "genre1": 4, "genre2": 3, "genre3": 4}
    space = vocab.IndexSpace(sizes)
    assert space.offsets() == [0, 3, 7, 12, 18, 23, 27] and space.oovs() == [2, 6, 11, 17, 22, 26, 31] and space.total == 32
    multi = vocab.IndexSpace({"sex": 2, "occupation": 3, "actor": 5, "genre": 5}, {"actor": ["actor1", "actor2"], "genre": ["genre1", "genre2", "genre3"]})
    assert multi.oovs()[2] == 12 and multi.oovs()[-1] == 18 and multi.offsets()[2] == multi.offsets()[3]


def test_vocabulary_growth(spark):
    old = vocab.vocabulary(spark.createDataFrame([("c",), ("a",), (None,), ("a",)], "x string"), "x")
    assert rows(old, "raw", "idx") == [("a", 0), ("c", 1)]
    grown = vocab.grow(old, spark.createDataFrame([("b",), ("d",), ("c",)], "x string"), "x")
    assert rows(grown, "raw", "idx") == [("a", 0), ("b", 2), ("c", 1), ("d", 3)]
    enc = vocab.encode(spark.createDataFrame([("M",), ("F",), (None,)], "s string"), "s", spark.createDataFrame([("M", 0)], "raw string, idx long"), 1)
    assert rows(enc, "s", "s_idx") == [("F", 1), ("M", 0), (None, 1)]


def test_multi_value_and_scalers(spark):
    df = spark.createDataFrame([(1, "|Sci Fi|Drama|", None), (2, "", "x"), (3, None, "y")], "id int, g string, other string")
    out, names = features.split_multi_value(df, ["g"], "|")
    assert names == [["g_1", "g_2"]]
    assert rows(out, "id", "other", "g_1", "g_2") == [(1, "missing", "scifi", "drama"), (2, "x", "missing", "missing"), (3, "y", "missing", "missing")]
    x = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 90)], "x double")
    for kind in features.NORMALIZERS:
        got = [r[0] for r in features.scale(x, ["x"], features.fit_scaler(x, ["x"], kind)).collect()]
        if kind in ("standard", "power"):
            assert sum(got) == pytest.approx(0, abs=1e-9) and sum(g * g for g in got) / 5 == pytest.approx(1)
    assert features.transform_dense(spark.createDataFrame([(-1.0,)], "x double"), ["x"]).columns == ["x"]
    with pytest.raises(ValueError):
        features.fit_scaler(x, ["x"], "nope")


def test_sampling(log):
    r = log.withColumn("row", F.col("seq").cast("long"))
    neg = sampling.unconsumed_negatives(r, "row", "user", "item", r.select("user", "item").distinct(), 1500, 3)
    assert neg.count() == 30
    assert neg.select("user", F.col("negative").alias("item")).join(r.select("user", "item"), ["user", "item"]).count() == 0
    assert rows(neg, "row", "negative") == rows(sampling.unconsumed_negatives(r.repartition(7), "row", "user", "item", r.select("user", "item").distinct(), 1500, 3), "row", "negative")
    ev = sampling.eval_negatives(r, "row", "user", "item", r.select("user", "item").distinct(), 1500, 2)
    assert dict(rows(ev.groupBy("label").count())) == {0: 20, 1: 10}


def test_popular_and_stats(log, spark):
    assert [tuple(r) for r in stats.popular_items(log, "user", "item", 2).collect()] == [(11, 3), (0, 2)]
    one = stats.dataset_stats(log.withColumn("label", F.lit(2)), "user", "item", "label").first()
    assert (one["data_size"], one["n_users"], one["n_items"]) == (10, 3, 3)


def test_catalog(spark, log):
    df = log.withColumn("label", F.lit(1.0)).select("user", "item", "label", "seq")
    cat, enc = Catalog.build(df, ["seq"])
    assert (cat.n_users, cat.n_items) == (3, 3) and enc.count() == 10
    new = spark.createDataFrame([(9, 5, 1.0, 1), (1, 999, 1.0, 2)], "user int, item int, label double, seq int")
    grown, _ = cat.merge(new, ["seq"])
    assert (grown.n_users, grown.n_items, grown.old.n_users) == (4, 4, 3)
    path = scratch(spark, "cat")
    grown.save(path)
    assert rows(Catalog.load(spark, path).items) == rows(grown.items)
    test = cat.encode(spark.createDataFrame([(9, 11), (1, None)], "user int, item int"))
    assert rows(test, "user_idx", "item_idx", "label") == [(0, 3, 0), (3, 1, 0)]
    with pytest.raises(OSError):
        Catalog.load(spark, path + "-no")
    with pytest.raises(ValueError):
        Catalog.build(df.select("item", "user", "label"), ["item"])


def test_delimited_source(spark, tmp_path):
    (tmp_path / "r.dat").write_text("1::10::5::978300760\n2::20::3::978302109\n")
    df = tables.read_csv(spark, str(tmp_path / "r.dat"), "user int, item int, label int, time long", "::", False)
    assert rows(df) == [(1, 10, 5, 978300760), (2, 20, 3, 978302109)]
    assert tables.null_report(df).first()[0] == 0


def test_popular_negatives_of_a_dominating_item(spark):
    """Every row has all its negatives, the own item only where draws of others run out."""
    from rillstone.operators import sampling

    log = spark.createDataFrame([(u, 0) for u in range(1000)] + [(0, 1)], "user int, item int")
    df = spark.createDataFrame([(r, r % 2) for r in range(200)], "row int, item int")
    got = sampling.popular_negatives(df, "row", "item", log, "user", 2).select("row", "item", "negative").collect()
    assert len(got) == 400 and {r["negative"] for r in got if r["item"] == 1} == {0}


def test_sorted_vocabulary_gives_the_ids_of_the_join(spark):
    df = spark.createDataFrame([(5, "a"), (-3, "b"), (None, "c"), (9, "d"), (2**40, "e"), (5, "f")], "user long, x string")
    v = vocab.vocabulary(df.where("x <> 'd'"), "user")
    assert rows(vocab.encode_sorted(df, {"user": (v, 3)}), "x", "user_idx") == rows(vocab.encode(df, "user", v, 3), "x", "user_idx")
    assert rows(vocab.encode_sorted(df, {"user": (vocab.vocabulary(df.limit(0), "user"), 0)}), "user_idx") == [(0,)] * 6


def test_negatives_are_drawn_without_shuffling_draws(spark):
    """As the rules say, also where valid draws run out and pairs repeat; the plan explodes no draws."""
    r = spark.range(60).select(F.col("id").alias("row"), F.when(F.col("id") % 7 == 6, None).otherwise(F.col("id") % 5).alias("user"), (F.col("id") * 3 % 6).alias("item"))
    pairs = spark.range(50).select((F.col("id") % 6).alias("user"), (F.col("id") * 7 % 6).alias("item")).where("user <> 3")
    neg = sampling.unconsumed_negatives(r, "row", "user", "item", pairs, 6, 2)
    assert "Generate" not in neg._jdf.queryExecution().toString()
    seen = {tuple(p) for p in pairs.collect()}

    def mix(*parts):
        h = sampling.ADD
        for p in parts:
            h = (h * sampling.MUL_A + p % sampling.MOD * sampling.MUL_B + sampling.ADD) % sampling.MOD
            h = (h * sampling.MUL_A + (h >> 11)) % sampling.MOD
        return h

    want = []
    for row, user, item in r.collect():
        draws = dict.fromkeys(x for k in range(20) if (x := mix(row, k, 42) % 6) != item)
        want += [(row, user, x) for x in sorted(draws, key=lambda x: (user, x) in seen)[:2]]
    assert rows(neg, "row", "user", "negative") == sorted(want, key=str)
