"""Same or near-same records across splits by winnowing fingerprints.

A record is a sequence of characters. All its k-grams are hashed by a rolling
hash, of every ``w`` neighbouring hashes the least is selected, so two records
that share at least ``k + w - 1`` characters in a row share a selected hash; a
record too short for a k-gram has the hash of its whole text instead. Selected
hashes travel with id and place only. They are joined across splits, a pair's
seeds are chained along one diagonal, and each chained pair fetches its two
texts once and is extended over them by alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.operators.balance import fragment_replicate_join, plan_loads
from rillstone.session import materialize

# Odd multipliers of the rolling hash and of its last mixing step.
_ROLL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Characters fingerprinted at once; a longer record is taken as a whole.
AT_ONCE = 4_000_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def fingerprints(texts: pa.Array, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, hash, place) of the winnowed k-grams of non-null texts; places from 1, rightmost of equal hashes."""
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(n) - n
    rec = np.repeat(np.arange(len(n)), n)
    empty = np.zeros(0, np.int64)
    got = [(empty, empty, empty)]
    total = len(chars) - k + 1
    grams = n - k + 1
    if total > 0 and (grams > 0).any():
        h = np.zeros(total, np.uint64)
        for j in range(k):
            h = h * _ROLL + chars[j : j + total]
        h = _mixed(h)
        left = (start + grams)[rec[:total]] - np.arange(total)  # grams of the record from here on
        opens = np.flatnonzero((left >= w) | ((left > 0) & (start[rec[:total]] == np.arange(total))))
        best, at = h[opens].copy(), opens.copy()
        for t in range(1, w):
            ok = np.flatnonzero(left[opens] > t)
            other = h[opens[ok] + t]
            less = other <= best[ok]
            best[ok[less]], at[ok[less]] = other[less], opens[ok[less]] + t
        at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
        got.append((rec[at], h[at].view(np.int64), at - start[rec[at]] + 1))
    short = np.flatnonzero((n < k) & (n > 0))
    if len(short):
        power = np.cumprod(np.r_[np.uint64(1), np.full(k, _ROLL)])
        take = np.concatenate([np.arange(a, b) for a, b in zip(start[short], start[short] + n[short], strict=True)])
        value = chars[take] * power[take - start[rec[take]]]
        whole = np.add.reduceat(value, np.cumsum(n[short]) - n[short]) + n[short].astype(np.uint64)
        got.append((short, _mixed(whole * _ROLL).view(np.int64), np.ones(len(short), np.int64)))
    return tuple(np.concatenate(c) for c in zip(*got, strict=True))


def _prints(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
                part = batch.slice(at, to - at)
                rec, h, place = fingerprints(part.column(1), k, w)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rec)), pa.array(h), pa.array(place)], names=["id", "hash", "pos"])
                at = to

    return run


def overlaps(left: DataFrame, right: DataFrame, record: str, sequence: str, k: int, w: int, carry: list[str] | None = None) -> DataFrame:
    """Pairs of a left and a right record that overlap: ``left_id, right_id, n_seeds, matched, coverage``.

    Records that share ``k + w - 1`` characters in a row are found, shorter
    records than k if they are equal. ``n_seeds`` are the seeds of the longest
    chain on one diagonal, ``matched`` the characters of the longer record that
    the alignment needn't edit, ``coverage`` their share of it: what a caller
    decides by. Columns named in ``carry`` come along as structs ``left_row`` and
    ``right_row``.

    ``record`` is a BIGINT id, unique on its side. Null ids and null and empty
    sequences match nothing. Every shared fingerprint counts, however frequent:
    the larger side's hot fingerprints are split over tasks, the other side is
    replicated to them. Empty tables give no pairs.
    """

    def rows(df: DataFrame) -> DataFrame:
        ok = df.where(F.col(record).isNotNull() & (F.length(sequence) > 0))
        return ok.select(F.col(record).cast("long").alias("id"), F.col(sequence).cast("string").alias("seq"), *[F.col(c).alias(f"_{c}") for c in carry or []])

    def prints(df: DataFrame, side: str) -> DataFrame:
        got = rows(df).select("id", "seq").mapInArrow(_prints(k, w), "id long, hash long, pos long")
        return materialize(got.select("hash", F.col("id").alias(f"{side}_id"), F.col("pos").alias(f"{side}_pos")), f"prints-{side}")

    def texts(df: DataFrame, side: str) -> DataFrame:
        facts = F.struct(*[F.col(f"_{c}").alias(c) for c in carry]) if carry else F.lit(None).cast("string")
        return rows(df).select(F.col("id").alias(f"{side}_id"), F.col("seq").alias(f"_{side}_seq"), facts.alias(f"{side}_row"))

    a, b = prints(left, "left"), prints(right, "right")
    seeds = fragment_replicate_join(a, b, "hash", plan=plan_loads(a, "hash"))
    # collinear seeds: those of one pair on one diagonal
    chains = seeds.groupBy("left_id", "right_id", (F.col("left_pos") - F.col("right_pos")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n"))
    pairs = chains.groupBy("left_id", "right_id").agg(F.max("n").alias("n_seeds"))
    both = pairs.join(texts(left, "left"), "left_id").join(texts(right, "right"), "right_id")
    longest = F.greatest(F.length("_left_seq"), F.length("_right_seq"))
    aligned = both.withColumn("_longest", longest).withColumn("matched", F.col("_longest") - F.levenshtein("_left_seq", "_right_seq"))
    aligned = aligned.withColumn("coverage", F.col("matched") / F.col("_longest"))
    return aligned.select("left_id", "right_id", "n_seeds", "matched", "coverage", *(["left_row", "right_row"] if carry else []))
