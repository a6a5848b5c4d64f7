"""Structured Streaming: sessions, popularity, recent histories and incremental similarity as streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillstone.operators.manifest import Manifest
from rillstone.operators.sessions import SESSION_GAP, SessionTable
from rillstone.operators.similarity import cosine_from_state, cosine_increment, sum_pairs


def parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def session_sink(stream: DataFrame, path: str, user: str, time: str, checkpoint: str, gap: int = SESSION_GAP):
    """Feed a stream to a session table; every micro-batch is one atomic version, a replayed one is passed over."""
    table = SessionTable(stream.sparkSession, path, gap)

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, user, time, batch_id)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def popularity(stream: DataFrame, time: str, item: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows of each item in tumbling windows, late rows within the watermark included."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), item).agg(F.count(F.lit(1)).alias("n"))


def session_windows(stream: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions closed by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("n_events"))


def recent_history(stream: DataFrame, user: str, item: str, time: str, length: int = 10) -> DataFrame:
    """The last items of each user after every micro-batch: ``user, items`` (comma-separated); state is bounded by ``length``."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for p in parts:
            held += list(zip(p[time].astype("int64"), p[item].astype("int64"), strict=True))
            held = sorted(held)[-length:]
        state.update(([int(t) for t, _ in held], [int(i) for _, i in held]))
        yield pd.DataFrame({"user": [key[0]], "items": [",".join(str(i) for _, i in held)]})

    return stream.groupBy(user).applyInPandasWithState(update, "user long, items string", "t array<long>, i array<long>", "update", GroupStateTimeout.NoTimeout)


#: Increments that are kept apart before they are summed up.
COMPACT = 16


class CosineStream:
    """Cosine state kept up to date by micro-batches.

    Each batch adds its increments of pair sums, norms and rows as files of its
    own; one manifest commits all three and remembers the batch, so a replayed
    batch is passed over, also by a new object after a restart. Readers sum the
    increments up; every ``COMPACT`` batches they are rewritten as one.
    """

    TABLES = ("pairs", "norms", "rows")

    def __init__(self, spark: SparkSession, path: str, entity: str, key: str, value: str):
        self.spark, self.path, self.entity, self.key, self.value = spark, path.rstrip("/"), entity, key, value
        self.manifest = Manifest(spark, path)

    def _table(self, name: str, parts: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/{p}/{name}" for p in parts])
        if name == "pairs":
            return sum_pairs(rows)
        return rows.groupBy("entity").agg(F.sum("sq").alias("sq")) if name == "norms" else rows

    def merge(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Take in a batch: null ids, keys and values are left out, of a repeated entity and key any one counts, the earlier batch's first."""
        if self.manifest.holds(batch_id):
            return
        state = self.manifest.read() or {"version": 0, "parts": []}
        parts = state["parts"]
        new = batch.select(self.entity, self.key, self.value).dropna().dropDuplicates([self.entity, self.key])
        if parts:
            new = new.join(self._table("rows", parts), [self.entity, self.key], "left_anti")
        here = f"{state['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        new.write.parquet(f"{self.path}/{here}/rows")
        new = self.spark.read.schema(new.schema).parquet(f"{self.path}/{here}/rows")
        old = self._table("rows", parts) if parts else new.limit(0)
        pairs, norms = cosine_increment(old, new, self.entity, self.key, self.value)
        pairs.write.parquet(f"{self.path}/{here}/pairs")
        norms.write.parquet(f"{self.path}/{here}/norms")
        parts, dropped = [*parts, here], []
        if len(parts) >= COMPACT:
            whole = f"{state['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
            for name in self.TABLES:
                self._table(name, parts).write.parquet(f"{self.path}/{whole}/{name}")
            parts, dropped = [whole], parts
        last = batch_id if batch_id is not None else state.get("batch")
        self.manifest.commit({"version": state["version"] + 1, "batch": last, "parts": parts, "dropped": dropped})

    def similarities(self) -> DataFrame:
        parts = (self.manifest.read() or {"parts": []})["parts"]
        if not parts:
            raise ValueError("no batch was taken in yet")
        return cosine_from_state(self._table("pairs", parts), self._table("norms", parts))

    def sink(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)
