"""Subject areas of documents: term weighting, truncated SVD and seed centroids.

Terms are weighted by how much they tell about the subject (the divergence of
a term's subjects from all subjects, over a bounded sample of labelled
documents) times their inverse document frequency over the whole corpus.
The weighted document vectors of the whole corpus give the truncated SVD (a
randomised range finder whose passes sum fixed-size blocks). Sentences are
folded in; seed centroids for each subject and language come from labelled
documents and are refined by assigning the sample's sentences again and again.
A sentence is about the subject of the nearest centroid, if any of its terms
has weight; a document is about the subjects of enough of its sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.words import words
from rillstone.session import materialize

#: Labelled documents that weights and centroids are fitted on, at most.
FIT_DOCS = 20_000
#: Rank of the decomposition, and further directions of the range finder.
RANK, OVERSAMPLE = 48, 16
#: A term counts from this divergence (nats), after ``PRIOR`` documents of the usual subjects.
LEAST_WEIGHT, PRIOR = 0.25, 5.0
#: Weight of the whole document's subjects in a sentence's score.
CONTEXT = 0.25

_BREAK = re.compile(r"<br\s*/?>|&nbsp;", re.I)
_CUT = re.compile(r"(?<=[.!?…])\s+|[\r\n]+")


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence; sentences end with a mark and blank or with the line, those without words don't count."""
    if not text:
        return []
    plain = _BREAK.sub(lambda m: "\n" if m.group(0)[0] == "<" else " ", text)
    return [w for w in (words(s) for s in _CUT.split(plain)) if w]


@dataclass(frozen=True)
class SubjectModel:
    """Vectors of the terms (already weighted), centroids (unit) and the subject of each."""

    terms: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    subjects: list[str]

    def fold(self, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Unit vectors of ``n`` sentences; zero where a sentence has no term."""
        out = np.zeros((n, self.terms.shape[1]))
        np.add.at(out, owner, self.terms[ids])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, unit: np.ndarray) -> np.ndarray:
        """Best cosine with each subject's centroids."""
        cos = unit @ self.centroids.T
        return np.stack([cos[:, self.owner == s].max(1) if (self.owner == s).any() else np.full(len(unit), -1.0) for s in range(len(self.subjects))], 1)


def _compact(shared):
    """Per document: number of terms of each sentence, and the terms, ascending within a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for b in batches:
            lens, ids = [], []
            for t in b.column(2):
                found = [sorted({vocab[w] for w in s if w in vocab}) for s in sentences(t.as_py())]
                lens.append([len(x) for x in found])
                ids.append([i for x in found for i in x])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lens, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "lang", "lens", "ids"])

    return run


#: Terms in one block of a product, documents multiplied at once, and blocks that one task of the sum's next level takes.
TERM_BLOCK, AT_ONCE, FAN_IN = 512, 2_000, 32


def _entries(b: pa.RecordBatch, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, value) of the weighted unit vectors of a batch's documents, sorted by document and term."""
    ids = b.column(b.schema.get_field_index("ids"))
    n = np.diff(ids.offsets.to_numpy())
    code, tf = np.unique(np.repeat(np.arange(b.num_rows), n) * len(weight) + ids.flatten().to_numpy(), return_counts=True)
    doc, term = np.divmod(code, len(weight))
    value = np.log1p(tf) * weight[term]
    norm = np.sqrt(np.bincount(doc, value * value, b.num_rows))
    return doc, term, value / np.maximum(norm[doc], 1e-12)


def _sparse_times(b: pa.RecordBatch, weight: np.ndarray, q: np.ndarray, total: np.ndarray) -> None:
    """Add X'X q to ``total``, X being the sparse rows of the batch."""
    doc, term, value = _entries(b, weight)
    if not len(doc):
        return
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    xq = np.zeros((b.num_rows, q.shape[1]))
    xq[doc[heads]] = np.add.reduceat(q[term] * value[:, None], heads, axis=0)
    order = np.argsort(term, kind="stable")
    term, doc, value = term[order], doc[order], value[order]
    heads = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    total[term[heads]] += np.add.reduceat(xq[doc] * value[:, None], heads, axis=0)


def _gram_times(rows: DataFrame, weight: np.ndarray, right: np.ndarray) -> np.ndarray:
    """X'X times a narrow matrix, X being the weighted documents.

    Each task sends its product in blocks of ``TERM_BLOCK`` terms; equal blocks
    are added up a tree of fan-in ``FAN_IN``, so no task takes more of them.
    """
    shared = rows.sparkSession.sparkContext.broadcast((weight, right))
    schema = "block int, task int, sums binary"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, q = shared.value
        total = np.zeros(q.shape)
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):
                _sparse_times(b.slice(i, AT_ONCE), w, q, total)
        for at in range(0, len(total), TERM_BLOCK):
            cut = total[at : at + TERM_BLOCK]
            if cut.any():
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([at // TERM_BLOCK], pa.int32()), pa.array([task], pa.int32()), pa.array([cut.tobytes()])], names=["block", "task", "sums"])

    def add(t: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(r, np.float64) for r in t.sort_by("task").column("sums").to_pylist())
        return pa.table({"block": t.column("block")[:1], "task": pa.array([t.column("task")[0].as_py() // FAN_IN], pa.int32()), "sums": pa.array([sums.tobytes()])})

    n = rows.rdd.getNumPartitions()
    sums = rows.select("ids").mapInArrow(part, schema)
    while n > 1:
        sums = sums.groupBy("block", F.call_function("div", F.col("task"), F.lit(FAN_IN))).applyInArrow(add, schema)
        n = -(-n // FAN_IN)
    out = np.zeros(right.shape)
    for r in sums.collect():  # vocabulary x rank, the size of the result
        at = r["block"] * TERM_BLOCK
        out[at : at + TERM_BLOCK] = np.frombuffer(r["sums"], np.float64).reshape(-1, right.shape[1])
    return out


def term_vectors(rows: DataFrame, weight: np.ndarray, rank: int = RANK, rounds: int = 2, seed: int = 3) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the weighted documents of the whole corpus."""
    width = min(len(weight), rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(weight), width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(_gram_times(rows, weight, q))[0]
    small = q.T @ _gram_times(rows, weight, q)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    return q @ vector[:, ::-1][:, : min(rank, width)]


def _sample(docs: DataFrame, doc_id: str, labels: DataFrame, label_doc: str, label: str, subjects: list[str]) -> DataFrame:
    """Labelled documents with their distinct subjects: at most ``FIT_DOCS`` rows."""
    known = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s.strip().lower()), F.lit(i))])
    rows = labels.select(F.col(label_doc).cast("long").alias("doc_id"), F.try_element_at(known, F.lower(F.trim(F.col(label)))).alias("s")).dropna()
    rows = rows.join(docs.select(F.col(doc_id).cast("long").alias("doc_id")), "doc_id", "left_semi")
    rows = materialize(rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("labels")), "subjects-labels")
    # the hash bound leaves about twice the sample, however many documents are labelled
    least = min(1.0, 2 * FIT_DOCS / max(rows.count(), 1))
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * least))
    return some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)


def _weights(docs: DataFrame, sample: DataFrame, n_subjects: int) -> tuple[list[str], np.ndarray]:
    """Terms that tell about subjects, and how much."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted(set(words(t.as_py()))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.string()))], names=["labels", "terms"])

    share = [F.sum(F.when(F.array_contains("labels", s), 1 / F.size("labels")).otherwise(0.0)) for s in range(n_subjects)]
    all_ = sample.agg(*[x.alias(f"s{i}") for i, x in enumerate(share)]).first()
    prior = np.array([float(x or 0) for x in all_])
    if not prior.sum():
        return [], np.zeros(0)
    prior /= prior.sum()
    text = docs.join(F.broadcast(sample), "doc_id").select("labels", "text")  # the sample is bounded
    terms = text.mapInArrow(distinct, "labels array<int>, terms array<string>").select("labels", F.explode("terms").alias("term"))
    sums = terms.groupBy("term").agg(*[x.alias(f"s{i}") for i, x in enumerate(share)])
    n = sum((F.col(f"s{i}") for i in range(n_subjects)), F.lit(0.0))
    told = F.lit(0.0)
    for i, p in enumerate(prior):
        if p > 0:
            q = (F.col(f"s{i}") + PRIOR * float(p)) / (n + PRIOR)
            told = told + q * F.log(q / float(p))
    got = sums.select("term", told.alias("w")).where(F.col("w") >= LEAST_WEIGHT).collect()  # bounded by the sample's terms
    got = sorted((r["term"], r["w"]) for r in got)
    return [t for t, _ in got], np.array([w for _, w in got])


def _centroids(fit: list, terms: np.ndarray, subjects: list[str], rounds: int = 4) -> SubjectModel:
    """Seeds from sentences of documents with one subject, by language; refined among each document's subjects."""
    lens = [np.array(r["lens"], int) for r in fit]
    n = sum(map(len, lens))
    owner = np.repeat(np.arange(n), np.concatenate(lens)) if n else np.zeros(0, int)
    ids = np.concatenate([np.array(r["ids"], int) for r in fit]) if n else np.zeros(0, int)
    doc = np.repeat(np.arange(len(fit)), [len(x) for x in lens])
    unit = SubjectModel(terms, np.zeros((0, terms.shape[1])), np.zeros(0, int), subjects).fold(ids, owner, n)
    has = np.linalg.norm(unit, axis=1) > 0
    allowed = np.zeros((len(fit), len(subjects)), bool)
    for i, r in enumerate(fit):
        allowed[i, r["labels"]] = True
    allowed = allowed[doc]
    lang = np.array([(r["lang"] or "") for r in fit])[doc] if fit else np.zeros(0, str)
    seeds, own = [], []
    for s in range(len(subjects)):
        pure = has & allowed[:, s] & (allowed.sum(1) == 1)
        for g in sorted(set(lang[pure])):
            at = pure & (lang == g)
            if at.sum() >= 20:
                seeds.append(unit[at].mean(0))
                own.append(s)
        if s not in own and pure.any():
            seeds.append(unit[pure].mean(0))
            own.append(s)
    c, own = np.array(seeds).reshape(-1, terms.shape[1]), np.array(own, int)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds if len(c) else 0):
        cos = np.where(allowed[:, own], unit @ c.T, -2.0)
        best, near = cos.argmax(1), cos.max(1)
        for j in range(len(c)):
            at = has & (best == j) & (near > 0.3)
            if at.sum() >= 3:
                m = unit[at].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return SubjectModel(terms, c, own, subjects)


def _classify(shared, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: SubjectModel = shared.value
        for b in batches:
            lens, ids = b.column(1), b.column(2)
            n_sent = np.diff(lens.offsets.to_numpy())
            n_ids = np.diff(ids.offsets.to_numpy())
            each = lens.flatten().to_numpy().astype(int)
            flat = ids.flatten().to_numpy()
            n = len(each)
            unit = m.fold(flat, np.repeat(np.arange(n), each), n)
            whole = m.fold(flat, np.repeat(np.arange(b.num_rows), n_ids), b.num_rows)
            doc = np.repeat(np.arange(b.num_rows), n_sent)
            score = m.scores(unit) + CONTEXT * m.scores(whole)[doc]
            best = score.argmax(1)
            about = np.zeros((b.num_rows, len(m.subjects)))
            np.add.at(about, (doc[each > 0], best[each > 0]), 1)
            d, s = np.nonzero((about > 0) & (about >= share * n_sent[:, None]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(d)), pa.array([m.subjects[i] for i in s], pa.string()), pa.array(about[d, s].astype(np.int64)), pa.array(n_sent[d].astype(np.int64))],
                names=["doc_id", "subject", "n_about", "n_sentences"],
            )

    return run


def document_subjects(docs: DataFrame, doc_id: str, text: str, lang: str | None, subjects: DataFrame, subject: str, labels: DataFrame, label_doc: str, label: str, share: float = 0.25) -> DataFrame:
    """Subjects that at least ``share`` of a document's sentences are about: ``doc_id, subject, n_about, n_sentences``.

    Subjects are spelt as in ``subjects`` (a small table: it is collected);
    labels match them whatever the letter case. Null ids, null, empty and
    wordless texts have no subject. Without usable labels nothing is assigned.
    Sentences about no subject count in the total.
    """
    spark = docs.sparkSession
    names = sorted({r[0] for r in subjects.select(subject).dropna().collect()})
    code = F.lower(F.substring(F.trim(F.col(lang)), 1, 2)) if lang else F.lit(None).cast("string")
    corpus = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.when(code != "un", code).alias("lang"), F.col(text).alias("text"))
    schema = "doc_id long, subject string, n_about long, n_sentences long"
    sample = materialize(_sample(corpus, "doc_id", labels, label_doc, label, names), "subjects-sample") if names else None
    vocab, told = _weights(corpus, sample, len(names)) if names else ([], None)
    if not vocab:
        return spark.createDataFrame([], schema)
    rows = materialize(corpus.mapInArrow(_compact(spark.sparkContext.broadcast({t: i for i, t in enumerate(vocab)})), "doc_id long, lang string, lens array<int>, ids array<int>"), "subjects-rows")
    n = rows.count()
    df = np.zeros(len(vocab))
    for r in rows.select(F.explode(F.array_distinct("ids")).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each term
        df[r["i"]] = r["n"]
    weight = told * np.log((1 + n) / (1 + df))
    vec = term_vectors(rows, weight) * weight[:, None]
    vec = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12) * told[:, None]
    fit = rows.join(F.broadcast(sample), "doc_id").orderBy("doc_id").limit(2 * FIT_DOCS).collect()  # the bounded sample
    shared = spark.sparkContext.broadcast(_centroids(fit, vec, names))
    return rows.select("doc_id", "lens", "ids").mapInArrow(_classify(shared, share), schema)
