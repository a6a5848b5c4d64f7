from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rillstone.operators.sessions import SessionTable, sessions, whole_seconds
from rillstone.session import jvm_fs, scratch


def brute(data, gap):
    by = {}
    for u, t in data:
        if u is None or t is None or t <= 0:
            continue
        by.setdefault(u, []).append(t if t < 10**12 else t // 1000 if t < 10**15 else t // 10**6)
    out = []
    for u, ts in by.items():
        ts.sort()
        cur = [ts[0], ts[0], 1]
        for t in ts[1:]:
            if t - cur[1] <= gap:
                cur[1] = t
                cur[2] += 1
            else:
                out.append((u, *cur))
                cur = [t, t, 1]
        out.append((u, *cur))
    return sorted(out, key=str)


def log(n=2500, seed=3):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        u = None if r.random() < 0.02 else (1 if r.random() < 0.4 else r.randrange(2, 15))
        t = 1_600_000_000 + r.randrange(400_000)
        x = r.random()
        t = None if x < 0.02 else -t if x < 0.04 else 0 if x < 0.05 else t * 1000 + r.randrange(1000) if x < 0.15 else t * 10**6 + r.randrange(10**6) if x < 0.2 else t
        out.append((u, t))
    return out + out[:50]


def test_whole_seconds(spark):
    df = spark.createDataFrame([(x,) for x in (None, 0, -5, 1600000000, 1600000000999, 1600000000999999)], "t long")
    assert [r[0] for r in df.select(whole_seconds(F.col("t"))).collect()] == [None, None, None] + [1600000000] * 3


@pytest.mark.parametrize("gap", [1, 60, 1800])
def test_sessions_equal_brute_force(spark, gap):
    data = log()
    df = spark.createDataFrame(data, "u int, t long").withColumn("user_id", F.lit("clash")).withColumn("_slot", F.lit(0))
    assert rows(sessions(df, "u", "t", gap), "user_id", "start_sec", "end_sec", "n_events") == brute(data, gap)


def test_gap_edge_and_empty(spark):
    df = spark.createDataFrame([(1, 1000), (1, 2800), (1, 4601), (1, 4601)], "u int, t long")
    assert rows(sessions(df, "u", "t"), "start_sec", "end_sec", "n_events", "duration_sec") == [(1000, 2800, 2, 1800), (4601, 4601, 2, 0)]
    assert sessions(df.limit(0), "u", "t").count() == 0


def test_table_in_batches_equals_all_at_once(spark):
    data = log()
    random.Random(9).shuffle(data)  # late rows bridge stored sessions
    table = SessionTable(spark, scratch(spark, "t"), 1800, 3)
    for i in range(0, len(data), 700):
        table.merge(spark.createDataFrame(data[i : i + 700], "u int, t long"), "u", "t")
    table.merge(spark.createDataFrame([], "u int, t long"), "u", "t")
    assert rows(table.read(), "user_id", "start_sec", "end_sec", "n_events") == brute(data, 1800)


def test_version_conflict_and_untouched_buckets(spark):
    path = scratch(spark, "t")
    table = SessionTable(spark, path, 1800, 4)
    table.merge(spark.createDataFrame([(u, 1000) for u in range(20)], "u int, t long"), "u", "t")
    before = table.manifest.read()["files"]
    table.merge(spark.createDataFrame([(3, 1500)], "u int, t long"), "u", "t")
    after = table.manifest.read()["files"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert (3, 1000, 1500, 2) in rows(table.read())
    with pytest.raises(RuntimeError):
        table.manifest.commit(table.manifest.read())
    assert SessionTable(spark, scratch(spark, "none")).read().count() == 0


def test_a_day_rewrites_its_own_slice_and_old_files_go(spark):
    day = 86_400
    table = SessionTable(spark, scratch(spark, "t"), 1800, 1, slice_sec=day)
    data = [(u, d * day + 40_000 + 7_000 * (u % 3)) for u in range(12) for d in range(10)]
    table.merge(spark.createDataFrame(data, "u int, t long"), "u", "t")
    before = table.manifest.read()["files"]
    late = [(3, 6 * day + 40_500), (3, 6 * day + 80_000)]
    table.merge(spark.createDataFrame(late, "u int, t long"), "u", "t")
    after = table.manifest.read()["files"]
    assert [p for p in before if before[p] != after[p]] == ["6/0"] and before.keys() == after.keys()
    bridge = [(5, 7 * day - 1000 + 900 * k) for k in range(-48, 49)]  # from one slice into the next
    table.merge(spark.createDataFrame(bridge, "u int, t long"), "u", "t")
    fs, old = jvm_fs(spark, f"{table.path}/{before['6/0'][0]}")
    assert not fs.exists(old)  # replaced by the second batch, deleted by the third
    apart = [(4, 2 * day + 85_000)]  # in a slice whose sessions are all further away than the gap
    table.merge(spark.createDataFrame(apart, "u int, t long"), "u", "t")
    assert rows(table.read(), "user_id", "start_sec", "end_sec", "n_events") == brute(data + late + bridge + apart, 1800)


def test_a_replayed_batch_counts_once_after_a_restart_too(spark):
    path = scratch(spark, "t")
    batch = spark.createDataFrame([(1, 1000), (1, 1001), (2, 5000)], "u int, t long")
    for _ in range(2):
        SessionTable(spark, path, 1800, 2).merge(batch, "u", "t", 0)
    assert rows(SessionTable(spark, path).read()) == [(1, 1000, 1001, 2), (2, 5000, 5000, 1)]
    SessionTable(spark, path).merge(batch, "u", "t", 1)
    SessionTable(spark, path).merge(batch, "u", "t", 0)
    assert {r["n_events"] for r in SessionTable(spark, path).read().collect()} == {4, 2}
