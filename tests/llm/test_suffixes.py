from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows

from rillstone.llm import suffixes
from rillstone.llm.suffixes import leaks, suffix_array, without_leaks
from rillstone.llm.words import words


def test_words():
    assert words("So­ft​ware ﬁx_it, Ｗide Straße ²x") == ["software", "fix", "it", "wide", "straße", "2x"]
    assert words(None) == words("") == words(" -_. ") == []


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array(seed):
    s = np.random.default_rng(seed).integers(0, 3, 200)
    order = suffix_array(s, 300)
    t = s.tolist()
    assert [t[i:] for i in order] == sorted(t[i:] for i in range(len(t)))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_WORDS", 500)
    monkeypatch.setattr(suffixes, "AT_ONCE", 7)
    monkeypatch.setattr(suffixes, "PASS_WORDS", 60)
    r = random.Random(7)
    passages = [(i, " ".join(r.choice("ab cd ef gh ij kl".split()) + str(r.randrange(3)) for _ in range(r.randrange(3, 30)))) for i in range(12)]
    docs = []
    for d in range(120):
        parts = []
        for _ in range(r.randrange(0, 6)):
            p = words(r.choice(passages)[1])
            i = r.randrange(len(p))
            parts += p[i : i + r.randrange(1, 20)] + ["zz"] * r.randrange(0, 2)
        docs.append((d, ", ".join(parts).upper(), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (None, passages[0][1], "x"), (902, "long " * 3000 + passages[1][1], "x"), (903, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id int, text string, _hit string")
    pf = spark.createDataFrame([*passages, (50, None), (51, ""), (None, "a b c d e f")], "p int, t string")
    least = 5
    want = {}
    for d, t, _ in docs:
        w = words(t)
        for p, q in passages:
            v = words(q)
            best = 0
            for i in range(len(v)):
                for j in range(len(w)):
                    n = 0
                    while i + n < len(v) and j + n < len(w) and v[i + n] == w[j + n]:
                        n += 1
                    best = max(best, n)
                if d == 902:
                    continue
            if d is not None and best >= least:
                want[p, d] = best
    found = leaks(df, "doc_id", "text", pf, "p", "t", least)
    assert {(r["passage_id"], r["doc_id"]): r["n_words"] for r in found.collect()} == want
    kept = {r[0] for r in without_leaks(df, "doc_id", found).select("doc_id").collect()}
    assert kept == {d for d, _, _ in docs} - {d for _, d in want}
    assert leaks(df.limit(0), "doc_id", "text", pf, "p", "t", least).count() == 0
    assert leaks(df, "doc_id", "text", pf.limit(0), "p", "t", least).count() == 0
    assert rows(found, "doc_word")[0][0] >= 0


def test_one_very_long_passage_needs_memory_once(spark):
    """A passage of 60,000 words beside short ones: nothing is padded to its length."""
    import tracemalloc

    r = np.random.default_rng(1)
    long = r.integers(1, 5000, 60_000)
    short = [r.integers(1, 5000, 30) for _ in range(200)]
    s = np.concatenate([long[10_000:50_000], [0], *[np.r_[p[3:], 0] for p in short]]).astype(np.int32)
    start = np.r_[0, 40_001 + 28 * np.arange(200)]
    order = suffix_array(s, 20).astype(np.int32)
    tracemalloc.start()
    got = {(int(a), int(b)): int(n) for w, d, ns, *_ in suffixes.matches(s, order, start, [long, *short], 20) for a, b, n in zip(w, d, ns, strict=True)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {(0, 0): 40_000, **{(i + 1, i + 1): 27 for i in range(200)}}
    assert peak < 120 << 20


def test_an_index_is_built_once_and_searched_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "x c d e f y"), (3, None)], "d int, t string")
    suffixes.SuffixIndex.build(df, "d", "t", 3).write(f"file://{tmp_path}/index")
    index = suffixes.SuffixIndex.open(spark, f"file://{tmp_path}/index", 3)
    find = lambda t: rows(index.search(spark.createDataFrame([(7, t)], "p int, t string"), "p", "t"), "doc_id", "n_words")
    assert find("c d e f") == [(1, 4), (2, 4)] and find("b c d q") == [(1, 3)] and find("q q q") == []
