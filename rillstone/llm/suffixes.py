"""Evaluation texts leaking into a corpus: suffix arrays over corpus shards.

Each task turns its documents into shards of about ``SHARD_WORDS`` words and
sorts a shard's suffixes by prefix doubling, as far as the shortest match that
counts. Every suffix of every passage is looked up by binary search; the range
of equal prefixes holds all occurrences, each of which is extended to its
longest verbatim match, some words at a time. Documents are apart by a word no
passage has. Nothing of the corpus is shuffled or collected: only matches leave
a task. A ``SuffixIndex`` keeps the arrays, so that they are built once and
searched for any number of passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm.words import words
from rillstone.session import fresh, materialize

#: Words in one shard, about; a longer document is a shard of its own.
SHARD_WORDS = 1_000_000
#: Words of passages that one pass over the index looks for; more take further passes.
PASS_WORDS = 500_000
#: Suffixes looked up, and occurrences extended, at a time; words compared in one step of an extension.
AT_ONCE, STEP = 50_000, 32


def suffix_array(s: np.ndarray, length: int) -> np.ndarray:
    """Positions of ``s`` (non-negative ints) in order of their suffixes' first ``length`` or more words."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    width = 1
    order = np.argsort(rank, kind="stable")
    while width < length:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])] if n else []
        rank, width = new, width * 2
        if n and rank[order[-1]] == n - 1:
            break
    return order


def _bounds(s: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query (row of words) the range of ``order`` whose suffixes begin with it. ``s`` is padded."""
    width = np.arange(queries.shape[1])

    def search(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
        while (low < high).any():
            mid = np.minimum((low + high) // 2, len(order) - 1)
            found = s[order[mid][:, None] + width]
            differs = found != queries
            first = differs.argmax(1)
            at = np.arange(len(queries))
            less = found[at, first] < queries[at, first]
            if upper:
                less |= ~differs.any(1)
            live = low < high
            low, high = np.where(live & less, mid + 1, low), np.where(live & ~less, mid, high)
        return low

    return search(False), search(True)


def _extend(s: np.ndarray, pos: np.ndarray, joined: np.ndarray, here: np.ndarray, known: int) -> np.ndarray:
    """Lengths of the common prefixes of suffixes of both sequences that share ``known`` words; both end with ``STEP`` words that differ."""
    length = np.full(len(pos), known, np.int64)
    live = np.arange(len(pos))
    while len(live):
        at = length[live][:, None] + np.arange(STEP)
        differs = s[np.minimum(pos[live][:, None] + at, len(s) - 1)] != joined[np.minimum(here[live][:, None] + at, len(joined) - 1)]
        stops = differs.any(1)
        length[live] += np.where(stops, differs.argmax(1), STEP)
        live = live[~stops]
    return length


def matches(s: np.ndarray, order: np.ndarray, start: np.ndarray, passages: list[np.ndarray], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Left-maximal verbatim matches of at least ``least`` words: (passage, document, length, place in passage, place in document).

    ``s`` holds the documents' words (1 and up) with a 0 after each, ``order``
    its suffixes, ``start`` where each document begins; unknown words of
    passages are -1. Needs memory for the passages once, whatever their lengths.
    """
    if not len(s) or not passages:
        return
    joined = np.concatenate([*[np.r_[p, -1] for p in passages], np.full(max(STEP, least), -1)])
    begin = np.cumsum([0] + [len(p) + 1 for p in passages[:-1]])
    count = np.array([max(0, len(p) - least + 1) for p in passages])
    which = np.repeat(np.arange(len(passages)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    # suffixes whose first words the shard has all
    unknown = np.r_[0, np.cumsum(joined < 0)]
    first = begin[which] + place
    ok = unknown[first + least] == unknown[first]
    which, place = which[ok], place[ok]
    padded = np.r_[s, np.zeros(max(STEP, least) + 1, s.dtype)]
    for c in range(0, len(which), AT_ONCE):
        w, p = which[c : c + AT_ONCE], place[c : c + AT_ONCE]
        low, high = _bounds(padded, order, joined[(begin[w] + p)[:, None] + np.arange(least)])
        # occurrences, flattened and cut into portions
        n = high - low
        ends = np.cumsum(n)
        for a in range(0, int(ends[-1]), AT_ONCE):
            flat = np.arange(a, min(a + AT_ONCE, int(ends[-1])))
            q = np.searchsorted(ends, flat, side="right")
            pos = order[low[q] + flat - (ends[q] - n[q])].astype(np.int64)
            here = begin[w[q]] + p[q]
            before = (p[q] > 0) & (pos > 0) & (joined[here - 1] == s[pos - 1])  # part of a match that begins earlier
            q, pos, here = q[~before], pos[~before], here[~before]
            length = _extend(padded, pos, joined, here, least)
            doc = np.searchsorted(start, pos, side="right") - 1
            yield w[q], doc, length, p[q], pos - start[doc]


def _ints(x: list | np.ndarray, dtype: type) -> bytes:
    return np.asarray(x, dtype).tobytes()


def _shards(least: int):
    """Cut documents into shards: ids and starts of the documents, words, vocabulary and suffix array."""
    names = ["docs", "starts", "seq", "suffixes", "vocab"]

    def shard(doc_ids: list[int], starts: list[int], seq: list[int], vocab: dict[str, int]) -> pa.RecordBatch:
        s = np.array(seq, np.int32)
        parts = [_ints(doc_ids, np.int64), _ints(starts, np.int64), s.tobytes(), _ints(suffix_array(s, least), np.int32)]
        return pa.RecordBatch.from_arrays([*[pa.array([p], pa.binary()) for p in parts], pa.array([list(vocab)], pa.list_(pa.string()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, starts, seq, vocab = [], [], [], {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc)
                starts.append(len(seq))
                seq += [vocab.setdefault(w, len(vocab) + 1) for w in words(text.as_py())]
                seq.append(0)
                if len(seq) >= SHARD_WORDS:
                    yield shard(doc_ids, starts, seq, vocab)
                    doc_ids, starts, seq, vocab = [], [], [], {}
        if seq:
            yield shard(doc_ids, starts, seq, vocab)

    return run


_FOUND = "passage_id long, doc_id long, n_words long, passage_word long, doc_word long"


def _search(shared, least: int):
    """Look the passages of a pass up in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        names = np.array(ids)
        wanted = {w for t in texts for w in t}
        for batch in batches:
            for r in range(batch.num_rows):
                docs, starts = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in (0, 1))
                s, order = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int32) for c in (2, 3))
                vocab = {w: i for i, w in enumerate(batch.column(4)[r].as_py(), 1) if w in wanted}
                passages = [np.array([vocab.get(w, -1) for w in t], np.int64) for t in texts]
                for p, d, n, a, b in matches(s, order, starts, passages, least):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (names[p], docs[d], n, a, b)], names=["passage_id", "doc_id", "n_words", "passage_word", "doc_word"])

    return run


class SuffixIndex:
    """Suffix arrays of a corpus's shards, for matches of at least ``least`` words.

    ``shards`` is lazy: a single search computes the arrays in the tasks that
    search them. ``write`` keeps them, ``open`` finds them again.
    """

    def __init__(self, shards: DataFrame, least: int):
        self.shards, self.least = shards, least

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str, text: str, least: int = 20) -> SuffixIndex:
        """Null ids and null texts are left out."""
        corpus = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        schema = "docs binary, starts binary, seq binary, suffixes binary, vocab array<string>"
        return cls(corpus.mapInArrow(_shards(least), schema), least)

    def write(self, path: str) -> SuffixIndex:
        self.shards.write.parquet(path)
        return SuffixIndex.open(self.shards.sparkSession, path, self.least)

    @classmethod
    def open(cls, spark: SparkSession, path: str, least: int = 20) -> SuffixIndex:
        return cls(spark.read.parquet(path), least)

    def search(self, passages: DataFrame, passage_id: str, passage: str) -> DataFrame:
        """Longest verbatim match of each passage and document, see ``leaks``."""
        spark = self.shards.sparkSession
        rows = passages.where(F.col(passage_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(passage_id).cast("long"), passage)
        found, ids, texts, size = None, [], [], 0

        def look(found: DataFrame | None) -> DataFrame:
            shared = spark.sparkContext.broadcast((ids, texts))  # PASS_WORDS words, or one longer passage
            part = self.shards.mapInArrow(_search(shared, self.least), _FOUND)
            return part if found is None else found.unionByName(part)

        for p, t in rows.toLocalIterator():
            w = words(t)
            if len(w) < self.least:
                continue
            if size + len(w) > PASS_WORDS and ids:
                if found is None:
                    self.shards = materialize(self.shards, "suffixes")  # further passes follow
                found, ids, texts, size = look(found), [], [], 0
            ids.append(p)
            texts.append(w)
            size += len(w)
        if ids:
            found = look(found)
        if found is None:
            return spark.createDataFrame([], _FOUND)
        best = F.max_by(F.struct("n_words", "passage_word", "doc_word"), F.struct("n_words", -F.col("passage_word"), -F.col("doc_word")))
        return found.groupBy("passage_id", "doc_id").agg(best.alias("m")).select("passage_id", "doc_id", "m.*")


def leaks(docs: DataFrame, doc_id: str, text: str, passages: DataFrame, passage_id: str, passage: str, least: int = 20) -> DataFrame:
    """Longest verbatim match of each passage and document that share ``least`` words in a row.

    Result: ``passage_id, doc_id, n_words, passage_word, doc_word`` (places
    count from 0; of equally long matches the first). Null ids and null or
    shorter texts match nothing. Passages come to the driver in blocks of
    ``PASS_WORDS`` words, each searched in a pass of its own over suffix arrays
    that are then written once.
    """
    return SuffixIndex.build(docs, doc_id, text, least).search(passages, passage_id, passage)


def without_leaks(docs: DataFrame, doc_id: str, found: DataFrame) -> DataFrame:
    """The corpus without the documents that hold a passage."""
    (name,) = fresh(docs.columns, "_hit")
    hit = found.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.col(doc_id).cast("long") == F.col(name), "left_anti")
