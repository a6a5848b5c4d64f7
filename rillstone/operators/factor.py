"""Factorisation and item embeddings: alternating least squares, Word2Vec over histories and walks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.operators import mapped, vocab
from rillstone.session import materialize, sweep

#: Entries of the log whose products are held at a time.
ENTRIES = 32_768


def fast_als(df: DataFrame, user: str, item: str, label: str, rank: int = 16, rounds: int = 10, reg: float = 0.1, alpha: float = 10.0, implicit: bool = True, seed: int = 42):
    """Spark's ALS: regularisation scaled by counts, confidence 1 + alpha * |label|."""
    from pyspark.ml.recommendation import ALS

    als = ALS(rank=rank, maxIter=rounds, regParam=reg, alpha=alpha, implicitPrefs=implicit, userCol=user, itemCol=item, ratingCol=label, seed=seed, coldStartStrategy="drop")
    return als.fit(df.select(F.col(user).cast("int"), F.col(item).cast("int"), F.col(label).cast("float")))


def _start(df: DataFrame, key: str, rank: int, seed: int) -> DataFrame:
    """Seeded factors of each key, small and independent of the partitioning."""
    draw = lambda j: (F.pmod(F.xxhash64(F.lit(seed), F.lit(j), key), F.lit(20001)).cast("double") - 10000) / 100000
    return df.select(key).distinct().select(F.col(key).alias("id"), F.array(*[draw(j) for j in range(rank)]).alias("f"))


def _solve(other: mapped.Flat, gram: np.ndarray, rank: int, reg: float, alpha: float, implicit: bool):
    """Factors of keys from their lists ``key, ids, r`` and the other side's factors, many normal equations at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = other.open()
        for b in batches:
            if not b.num_rows:
                continue
            length = np.diff(b.column(1).offsets.to_numpy())
            at = np.searchsorted(held["id"], b.column(1).flatten().to_numpy())
            r = b.column(2).flatten().to_numpy()
            key = np.repeat(np.arange(b.num_rows), length)
            left, right = np.zeros((b.num_rows, rank * rank)), np.zeros((b.num_rows, rank))
            for lo in range(0, len(key), ENTRIES):
                k, y, w = key[lo : lo + ENTRIES], held["f"][at[lo : lo + ENTRIES]], r[lo : lo + ENTRIES]
                first = np.flatnonzero(np.diff(k, prepend=-1))
                own, c = (w * alpha, w * alpha + 1) if implicit else (np.ones(len(w)), w)
                left[k[first]] += np.add.reduceat(((y * own[:, None])[:, :, None] * y[:, None, :]).reshape(len(y), -1), first)
                right[k[first]] += np.add.reduceat(y * c[:, None], first)
            x = np.linalg.solve(left.reshape(-1, rank, rank) + gram + reg * np.eye(rank), right[:, :, None])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, rank), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["id", "f"])

    return run


def _gram(factors: DataFrame, rank: int) -> np.ndarray:
    """Y'Y, each task adding up its part."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((rank, rank))
        for b in batches:
            y = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            g += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": np.arange(rank * rank), "x": g.ravel()})

    cells = factors.select("f").mapInArrow(part, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(rank * rank)
    for r in cells.collect():  # rank squared
        out[r["i"]] = r["x"]
    return out.reshape(rank, rank)


def als(df: DataFrame, user: str, item: str, label: str, rank: int = 16, rounds: int = 5, reg: float = 0.1, alpha: float = 10.0, implicit: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Factors ``id, f`` of users and items by exact alternating least squares.

    The regularisation isn't scaled by counts. Implicit: confidence is
    label * alpha + 1 and every stored pair has preference 1. The log is written
    once as lists by user and once by item; a half step looks the other side's
    factors up in a mapped file, so no factor is shuffled.
    """
    if reg <= 0:
        raise ValueError("reg must be positive")
    log = df.select(F.col(user).alias("u"), F.col(item).alias("i"), F.col(label).cast("double").alias("r")).dropna()
    words = {c: materialize(vocab.vocabulary(log, c), "als-ids") for c in "ui" if not isinstance(log.schema[c].dataType, T.IntegralType)}
    for c, v in words.items():
        log = vocab.encode(log, c, v, -1, f"{c}_").drop(c).withColumnRenamed(f"{c}_", c)
    log = materialize(log, "als")

    def lists(own: str, other: str) -> DataFrame:
        rows = log.groupBy(own).agg(F.collect_list(F.struct(F.col(other).cast("long").alias("o"), "r")).alias("l"))
        return materialize(rows.select(own, F.col("l.o").alias("ids"), F.col("l.r").alias("r")), "als-lists")

    by = {}
    for own, other in ("ui", "iu"):
        by[own] = lists(own, other)
        sweep(log.sparkSession)
    factors = {"i": _start(by["i"], "i", rank, seed)}

    def half(own: str, other: str) -> DataFrame:
        held = mapped.write_flat(factors[other].select(F.col("id").cast("long").alias("id"), "f"), ["id"], {"id": ("int64", 0), "f": ("float64", rank)}, "als-flat")
        gram = _gram(factors[other], rank) if implicit else np.zeros((rank, rank))
        kind = log.schema[own].dataType.simpleString()
        return materialize(by[own].mapInArrow(_solve(held, gram, rank, reg, alpha, implicit), f"id {kind}, f array<double>"), "als-factors")

    for _ in range(rounds):
        factors["u"] = half("u", "i")
        factors["i"] = half("i", "u")
    out = {c: vocab.decode(f.withColumnRenamed("id", "_x"), "_x", words[c], "id").select("id", "f") if c in words else f for c, f in factors.items()}
    return out["u"], out["i"]


def item_vectors(sentences: DataFrame, col: str, rank: int = 16, window: int = 5, rounds: int = 1, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Skip-gram vectors ``item, v`` of the items in array column ``col`` (histories, walks)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    texts = sentences.select(F.transform(col, lambda x: x.cast("string")).alias("s"))
    n = partitions or max(1, min(8, texts.sparkSession.sparkContext.defaultParallelism))
    model = Word2Vec(vectorSize=rank, windowSize=window, maxIter=rounds, minCount=1, seed=seed, numPartitions=n, inputCol="s", outputCol="o").fit(texts)
    return model.getVectors().select(F.col("word").alias("item"), vector_to_array("vector").alias("v"))


def walk_sentences(walks: DataFrame) -> DataFrame:
    """Walk rows (walk, step, node) as sentences."""
    steps = F.array_sort(F.collect_list(F.struct("step", "node")))
    return walks.groupBy("walk").agg(F.transform(steps, lambda x: x["node"]).alias("nodes"))
