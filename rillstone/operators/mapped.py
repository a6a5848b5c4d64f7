"""Sorted tables as flat files in the shared folder, which tasks map instead of joining with the table."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillstone.session import parallelism, scratch


def _file(path: str, write: bool = False):
    """A file of the shared folder to read or write: a local or mounted one, else a stream of its file system."""
    if path.startswith("file:") or "://" not in path:
        local = path.removeprefix("file://")
        if write:
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb" if write else "rb")
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    return fs.open_output_stream(at) if write else fs.open_input_stream(at)


def _delete(path: str) -> None:
    if path.startswith("file:") or "://" not in path:
        os.remove(path.removeprefix("file://"))
    else:
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(path)
        fs.delete_file(at)


@dataclass(frozen=True)
class Flat:
    """Columns of a table in an order, each in one file: paths, types and widths (0 for numbers) by name."""

    base: str
    kinds: dict[str, tuple[str, int]]
    rows: int

    def open(self) -> dict[str, np.ndarray]:
        """Arrays by name: mapped from a local or mounted file, so that only what is looked at is read, else read whole."""
        out = {}
        for c, (kind, width) in self.kinds.items():
            path, shape = f"{self.base}/{c}", (self.rows, width) if width else (self.rows,)
            if not self.rows:
                out[c] = np.zeros(shape, kind)
            elif path.startswith("file:") or "://" not in path:
                out[c] = np.memmap(path.removeprefix("file://"), kind, "r", shape=shape)
            else:
                with _file(path) as f:
                    out[c] = np.frombuffer(f.read(), kind).reshape(shape)
        return out


def write_flat(df: DataFrame, order: list[str] | None, kinds: dict[str, tuple[str, int]], name: str) -> Flat:
    """Write columns without nulls sorted by ``order``: tasks sort and write ranges, one task puts them one behind the other. Without ``order`` rows stay as they stand, partition by partition."""
    spark = df.sparkSession
    base = scratch(spark, name)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, n = uuid.uuid4().hex, 0  # a repeated task writes files of its own
        files = {c: _file(f"{base}/{own}.{c}", True) for c in kinds}
        for b in batches:
            for c, (kind, width) in kinds.items():
                x = b.column(b.schema.get_field_index(c))
                x = x.flatten() if width else x
                files[c].write(np.ascontiguousarray(x.to_numpy(zero_copy_only=False).astype(kind)).tobytes())
            n += b.num_rows
        for f in files.values():
            f.close()
        yield pa.RecordBatch.from_pydict({"at": [TaskContext.get().partitionId()], "file": [own], "n": [n]})

    df = df.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order) if order else df
    parts = df.select(*dict.fromkeys([*kinds])).mapInArrow(part, "at long, file string, n long")
    done = sorted(tuple(r) for r in parts.collect())  # a row for each task

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                with _file(f"{base}/{c}", True) as out:
                    for _, own, n in done:
                        if n:
                            with _file(f"{base}/{own}.{c}") as f:
                                shutil.copyfileobj(f, out, 1 << 20)
                        _delete(f"{base}/{own}.{c}")
            yield b

    spark.createDataFrame([(c,) for c in kinds], "c string").repartition(len(kinds), "c").mapInArrow(join, "c string").collect()  # a row for each column
    return Flat(base, kinds, sum(r[2] for r in done))
