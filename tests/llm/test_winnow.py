from __future__ import annotations

import random

import pyarrow as pa
from conftest import rows

from rillstone.llm import queries
from rillstone.llm.winnow import fingerprints, overlaps


def test_shared_stretch_is_always_found(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    k, w = 6, 5
    pairs = []
    for i in range(200):
        same = word(k + w - 1)
        pairs.append((i, word(r.randrange(0, 9)) + same + word(r.randrange(0, 9)), word(r.randrange(0, 9)) + same + word(r.randrange(0, 9))))
    left = spark.createDataFrame([(i, a, "x") for i, a, _ in pairs], "id int, s string, _hash string")
    right = spark.createDataFrame([(i + 1000, b, "x") for i, _, b in pairs], "id int, s string, _hash string")
    got = {(x["left_id"], x["right_id"]): x["coverage"] for x in overlaps(left, right, "id", "s", k, w).collect()}
    assert {(i, i + 1000) for i, _, _ in pairs} <= got.keys()
    assert all(0 <= c <= 1 for c in got.values())


def test_short_records_match_when_equal(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (4, "abcdef"), (5, "abcdefg"), (None, "abc"), (6, "abd")], "id int, s string")
    got = {(r["left_id"], r["right_id"]): r["coverage"] for r in overlaps(df, df, "id", "s", 6, 4).collect()}
    assert {p for p, c in got.items() if c == 1} == {(i, i) for i in (3, 4, 5, 6)}
    assert got.keys() <= {(3, 3), (4, 4), (5, 5), (6, 6), (4, 5), (5, 4)} and got.get((4, 5), 6 / 7) == 6 / 7
    assert overlaps(df.limit(0), df, "id", "s", 6, 4).count() == 0


def test_fingerprints_equal_a_plain_winnowing():
    r = random.Random(8)
    k, w = 5, 4
    texts = ["".join(r.choice("ab€😀") for _ in range(r.randrange(0, 30))) for _ in range(60)]
    rec, h, at = fingerprints(pa.array(texts), k, w)
    grams = {}
    for i, t in enumerate(texts):  # the hash of each k-gram, from texts that are one k-gram
        for p in range(len(t) - k + 1):
            grams[i, p] = int(fingerprints(pa.array([t[p : p + k]]), k, w)[1].view("uint64")[0])
    want = set()
    for i, t in enumerate(texts):
        n = len(t) - k + 1
        for p in range(max(1, n - w + 1) if n > 0 else 0):
            least = min(range(p, min(p + w, n)), key=lambda q: (grams[i, q], -q))
            want.add((i, least + 1))
    assert {(a, b) for a, b in zip(rec.tolist(), at.tolist(), strict=True) if len(texts[a]) >= k} == want
    assert sorted(i for i, t in enumerate(texts) if 0 < len(t) < k) == sorted(a for a in rec.tolist() if len(texts[a]) < k)


def test_alignment_tells_near_records_from_those_that_share_a_seed(spark):
    left = spark.createDataFrame([(1, "abcdefgh" + "x" * 30)], "id int, s string")
    right = spark.createDataFrame([(2, "y" * 30 + "abcdefgh"), (3, "abcdefgh" + "x" * 29 + "z")], "id int, s string")
    got = {r["right_id"]: r["matched"] for r in overlaps(left, right, "id", "s", 6, 2).collect()}
    assert got == {2: 0, 3: 37}


def test_ratings_across_splits(spark, tmp_path):
    r = random.Random(5)
    data = []
    for i in range(1200):
        pick = lambda x: None if r.random() < 0.03 else x
        data.append((i, pick(r.randrange(12)), pick(9 if r.random() < 0.3 else r.randrange(30)), pick(r.randrange(2, 11) / 2), 5, pick(r.choice(["train", " Train", "TRAIN ", "eval", "Test", "test "])), "web"))
    cols = "row_id long, user_id int, item int, label double, time_sec long, split_name string, feed string"
    spark.createDataFrame(data, cols).write.parquet(f"{tmp_path}/split_ratings.parquet")
    norm = [(i, u, m, lab, (s or "").strip().lower()) for i, u, m, lab, _, s, _ in data if None not in (u, m, lab)]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in norm if a[4] == "train" for b in norm if b[4] in ("eval", "test") and a[1:3] == b[1:3] and abs(a[3] - b[3]) <= 0.5}
    assert {tuple(x) for x in queries.p6_found(spark, str(tmp_path)).collect()} == want
