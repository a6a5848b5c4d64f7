from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F

from rillstone.llm.subjects import document_subjects, sentences

WORDS = {"sea": ["boat", "harbour", "tide", "anchor", "sail", "gull"], "Farm": ["cow", "barn", "wheat", "plough", "tractor", "hay"], "city": ["tram", "square", "tower", "museum", "subway", "bridge"]}


def corpus(n=500, seed=2):
    r = random.Random(seed)
    docs, truth = [], {}
    for d in range(n):
        subjects = r.sample(list(WORDS), r.choice([1, 1, 2]))
        lines = []
        for _ in range(r.randrange(6, 14)):
            if r.random() < 0.2:
                lines.append(f"I saw {r.choice(['nothing', 'little'])} new in place{r.randrange(400)}.")
            else:
                lines.append(f"The {r.choice(WORDS[s := r.choice(subjects)])} was near the {r.choice(WORDS[s])}, name{r.randrange(400)}.")
        count = {s: sum(any(w in x for w in WORDS[s]) for x in lines) for s in WORDS}
        truth[d] = {s for s, c in count.items() if c and c >= len(lines) / 4}
        docs.append((d, r.choice([" ", "\n", "\n\n"]).join(lines), "en"))
    return docs, truth


def test_sentences():
    assert len(sentences("One a. Two b? \n\n***\nThree<br/>four 1.5 x")) == 4
    assert sentences(None) == sentences("") == sentences("... !!") == []


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    r = random.Random(3)
    labels = [(d, r.choice([str.upper, str.title, lambda x: f" {x} "])(s if r.random() > 0.05 else "city"), "x") for d, ss in truth.items() if d < 250 for s in ss] * 2
    labels += [(None, "sea", "x"), (3, None, "x"), (4, "nonsense", "x"), (99999, "sea", "x")]
    docs += [(1000, None, "en"), (1001, "", None), (None, "The cow.", "en"), (1002, docs[0][1], "und"), (1003, "***", "en"), (1004, "The cow was near the barn. " * 3000, "en")]
    df = spark.createDataFrame(docs, "doc_id int, text string, lang string").withColumn("labels", F.lit("clash")).withColumn("subject", F.lit(1))
    areas = spark.createDataFrame([(s, "about") for s in WORDS] + [(None, "x")], "subject string, about string")
    lf = spark.createDataFrame(labels, "doc_id int, subject string, rater string")
    out = {}
    for d, s in rows(document_subjects(df, "doc_id", "text", "lang", areas, "subject", lf, "doc_id", "subject"), "doc_id", "subject"):
        out.setdefault(d, set()).add(s)
    right = sum(out.get(d, set()) == truth[d] for d in range(250, 500))
    assert right / 250 >= 0.95
    assert out[1002] == out[0] and out[1004] == {"Farm"} and not {1000, 1001, 1003, None} & out.keys()


def test_empty(spark):
    docs, _ = corpus(5)
    df = spark.createDataFrame(docs, "doc_id int, text string, lang string")
    areas = spark.createDataFrame([("sea",)], "subject string")
    lf = spark.createDataFrame([], "doc_id int, subject string")
    ask = lambda d, a: document_subjects(d, "doc_id", "text", None, a, "subject", lf, "doc_id", "subject").count()
    assert ask(df, areas) == ask(df.limit(0), areas) == ask(df, areas.limit(0)) == 0


def test_sparse_products_equal_dense_ones(spark, monkeypatch):
    import numpy as np

    from rillstone.llm import subjects

    monkeypatch.setattr(subjects, "TERM_BLOCK", 7)
    monkeypatch.setattr(subjects, "FAN_IN", 2)
    r = np.random.default_rng(2)
    docs = [[int(x) for x in r.integers(0, 40, r.integers(0, 12))] for _ in range(90)]
    weight, q = r.random(40), r.standard_normal((40, 5))
    x = np.zeros((90, 40))
    for i, d in enumerate(docs):
        for t in d:
            x[i, t] += 1
    x = np.log1p(x) * weight
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    got = subjects._gram_times(spark.createDataFrame([(d,) for d in docs], "ids array<int>").repartition(5), weight, q)
    assert np.allclose(got, x.T @ (x @ q))
