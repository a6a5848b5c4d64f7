"""Vocabularies, inner ids and the global index space of sparse features."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.operators.ordering import global_rank
from rillstone.session import scratch, small


def vocabulary(df: DataFrame, col: str | list[str], pad: object | None = None) -> DataFrame:
    """Distinct sorted values of a column, or pooled over several: ``raw, idx``. Nulls and the pad value are left out."""
    cols = [col] if isinstance(col, str) else col
    values = df.select(F.col(cols[0]).alias("raw")) if len(cols) == 1 else df.select(F.explode(F.array(*cols)).alias("raw"))
    values = values.where(F.col("raw").isNotNull())
    if pad is not None:
        values = values.where(F.col("raw") != F.lit(pad))
    return global_rank(values.distinct(), ["raw"], "idx")


def grow(old: DataFrame, df: DataFrame, col: str | list[str], pad: object | None = None) -> DataFrame:
    """Append values that are new, in their order, behind the old ones, whose ids stay."""
    cols = [col] if isinstance(col, str) else col
    values = df.select(F.explode(F.array(*cols)).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    if pad is not None:
        values = values.where(F.col("raw") != F.lit(pad))
    fresh = global_rank(values.join(old, "raw", "left_anti"), ["raw"], "idx")
    size = old.agg(F.count(F.lit(1)).alias("_n"))
    fresh = fresh.crossJoin(F.broadcast(size)).select("raw", (F.col("idx") + F.col("_n")).alias("idx"))
    return old.select("raw", "idx").unionByName(fresh)


def encode(df: DataFrame, col: str, vocab: DataFrame, oov: Column | int, out: str | None = None, size: int | None = None) -> DataFrame:
    """Inner id of a column; unknown and null values get ``oov``.

    The vocabulary is broadcast only if its ``size`` is known and small.
    """
    v = vocab.select(F.col("raw").alias("_raw"), F.col("idx").alias("_idx"))
    v = small(v, size) if size is not None else v
    out = out or f"{col}_idx"
    return df.join(v, F.col(col) == F.col("_raw"), "left").withColumn(out, F.coalesce("_idx", F.lit(oov) if isinstance(oov, int) else oov)).drop("_raw", "_idx")


def _open(path: str, write: bool):
    """The local path of a file in the shared folder, or a stream of its file system."""
    if path.startswith("file:") or "://" not in path:
        local = path.removeprefix("file://")
        if write:
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return local, None
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    return None, fs.open_output_stream(at) if write else fs.open_input_stream(at)


def _write_sorted(vocab: DataFrame) -> str:
    """The raw integers of a vocabulary in the order of their ids, as one file of 8 bytes each."""
    path = scratch(vocab.sparkSession, "sorted-vocab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, stream = _open(path, True)
        n = 0
        with stream or open(local, "wb") as f:
            for b in batches:
                f.write(b.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes())
                n += b.num_rows
        yield pa.RecordBatch.from_pydict({"n": [n]})

    vocab.repartition(1).sortWithinPartitions("idx").select("raw").mapInArrow(run, "n long").collect()  # one number
    return path


def encode_sorted(df: DataFrame, vocabs: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """As ``encode`` of several integer columns by vocabularies of ``vocabulary``, each with its size (also the id of others), without a shuffle.

    An id is the value's place among the sorted ones, so a task finds it by
    binary search in a file that is mapped rather than held (8 bytes a value).
    """
    paths = {c: _write_sorted(v) for c, (v, _) in vocabs.items()}
    sizes = {c: n for c, (_, n) in vocabs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for c, p in paths.items():
            local, stream = _open(p, False)
            known[c] = np.zeros(0, np.int64) if not sizes[c] else np.memmap(local, np.int64, "r") if local else np.frombuffer(stream.read(), np.int64)
        for b in batches:
            cols = [*b.columns]
            for c, k in known.items():
                raw = b.column(b.schema.get_field_index(c))
                x = raw.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                at = np.searchsorted(k, x)
                hit = np.asarray(k)[np.minimum(at, len(k) - 1)] == x if len(k) else np.zeros(len(x), bool)
                cols.append(pa.array(np.where(hit & raw.is_valid().to_numpy(zero_copy_only=False), at, sizes[c])))
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *[f"{c}_idx" for c in known]])

    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}_idx", T.LongType()) for c in vocabs]])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, idx: str, vocab: DataFrame, out: str) -> DataFrame:
    """Raw values of inner ids; ids beyond the vocabulary are dropped."""
    return df.join(vocab.select(F.col("idx").alias(idx), F.col("raw").alias(out)), idx)


@dataclass(frozen=True)
class IndexSpace:
    """Offsets and out-of-vocabulary positions of sparse fields in one index space.

    A field takes its number of values and one slot for unknown ones. Fields
    with several columns (``multi``: name to columns) share one range, after all
    plain fields.
    """

    sizes: dict[str, int]
    multi: dict[str, list[str]] = field(default_factory=dict)

    @property
    def fields(self) -> list[str]:
        return [f for f in self.sizes if f not in self.multi] + list(self.multi)

    def field_offset(self, name: str) -> int:
        names = self.fields
        return dict(zip(names, [0, *accumulate(self.sizes[f] + 1 for f in names)], strict=False))[name]

    def columns(self) -> list[tuple[str, str]]:
        """(column, field) in the order of the index array."""
        return [(c, f) for f in self.fields for c in self.multi.get(f, [f])]

    def offsets(self) -> list[int]:
        return [self.field_offset(f) for _, f in self.columns()]

    def oovs(self) -> list[int]:
        return [self.field_offset(f) + self.sizes[f] for _, f in self.columns()]

    @property
    def total(self) -> int:
        return sum(n + 1 for n in self.sizes.values())


def sparse_indices(df: DataFrame, space: IndexSpace, vocabs: dict[str, DataFrame], out: str = "sparse") -> DataFrame:
    """One array of global indices of all sparse columns; unknown values take their field's last slot."""
    for column, name in space.columns():
        df = encode(df, column, vocabs[name], space.sizes[name], f"_{column}_i", space.sizes[name])
    parts = [(F.col(f"_{c}_i") + space.field_offset(f)).cast("int") for c, f in space.columns()]
    return df.withColumn(out, F.array(*parts)).drop(*[f"_{c}_i" for c, _ in space.columns()])
