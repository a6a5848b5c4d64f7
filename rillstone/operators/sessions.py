"""Sessions of activity, kept in an incremental table.

Rows are first cut into fragments: one per user and slot of ``gap`` seconds,
with first and last second and number of rows. Rows of one slot are less than
the gap apart, so a fragment never spans two sessions, and fragments combine
on the map side: a user with a third of all rows, even all within one slot,
leaves no more than one fragment per slot. Everything after that is work on
fragments and sessions, whose number per user is bounded by the time range.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rillstone.operators.manifest import Manifest
from rillstone.session import jvm_fs, parallelism

SESSION_GAP = 1800
#: Seconds of start times that one file of the table holds, unless the table is made with others.
SLICE_SECONDS = 90 * 86_400


def whole_seconds(time: Column) -> Column:
    """Seconds of a time in seconds, milliseconds (13 digits) or microseconds (16), cut off.

    Null, zero and negative times give null.
    """
    unit = F.when(time < 10**12, 1).when(time < 10**15, 1000).otherwise(10**6).cast("long")
    return F.when(time > 0, F.call_function("div", time.cast("long"), unit))


def fragments(df: DataFrame, user: str, time: str, gap: int = SESSION_GAP) -> DataFrame:
    """First and last second and rows of each user and slot of ``gap`` seconds."""
    return (
        df.select(F.col(user).alias("user_id"), whole_seconds(F.col(time)).alias("_sec"))
        .where(F.col("user_id").isNotNull() & F.col("_sec").isNotNull())
        .groupBy("user_id", ((F.col("_sec") - F.pmod("_sec", F.lit(gap)))).alias("_slot"))
        .agg(F.min("_sec").alias("start_sec"), F.max("_sec").alias("end_sec"), F.count(F.lit(1)).alias("n_events"))
    )


def components(pieces: DataFrame, gap: int) -> DataFrame:
    """Number the connected components (``_comp``) of each user's pieces within ``gap``."""
    order = Window.partitionBy("user_id").orderBy("start_sec", "end_sec")
    before = F.max("end_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start_sec") - before > gap), 1).otherwise(0)
    return (
        pieces.withColumn("_opens", opens)
        .withColumn("_comp", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .drop("_opens")
    )


def sessions(df: DataFrame, user: str, time: str, gap: int = SESSION_GAP) -> DataFrame:
    """Sessions of every user: ``user_id, start_sec, end_sec, n_events, duration_sec``.

    A session is a longest series of one user's rows in which each is at most
    ``gap`` seconds after the one before. Rows with null user or with null,
    zero or negative time are left out; ties and repeated rows count as rows
    of one session. An empty table has no sessions.
    """
    return (
        components(fragments(df, user, time, gap), gap)
        .groupBy("user_id", "_comp")
        .agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.sum("n_events").alias("n_events"))
        .select("user_id", "start_sec", "end_sec", "n_events", (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"))
    )


class SessionTable:
    """Stored sessions that take in batches, late rows included.

    Files lie in ``path/data/<version>/slice=<s>/bucket=<b>``: a session is in
    the slice of ``slice_sec`` seconds in which it starts, and in a bucket by a
    hash of the user. A version is a manifest that names the folder of each
    slice and bucket with the first start and last end in it; writing it under
    a new name commits the batch at once, so readers see all of a batch or
    nothing, and a job that dies leaves the last version. A batch reads and
    rewrites only the slices and buckets within the gap of its own sessions:
    a day's rows don't touch older slices, however long the table is. Files
    that a version replaced are deleted with the version after it.
    """

    SCHEMA = T.StructType([
        T.StructField("user_id", T.LongType()), T.StructField("start_sec", T.LongType()),
        T.StructField("end_sec", T.LongType()), T.StructField("n_events", T.LongType()),
    ])

    def __init__(self, spark: SparkSession, path: str, gap: int = SESSION_GAP, buckets: int | None = None, slice_sec: int = SLICE_SECONDS):
        self.spark, self.path, self.gap = spark, path.rstrip("/"), gap
        self.manifest = Manifest(spark, path)
        state = self.manifest.read()
        self.buckets = state["buckets"] if state else (buckets or parallelism(spark))
        self.slice_sec = state["slice_sec"] if state else slice_sec

    def _slice(self, second: Column) -> Column:
        return F.floor(second / F.lit(self.slice_sec)).cast("long")

    def _placed(self, df: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(F.col("user_id").cast("long")), F.lit(self.buckets)).cast("int")
        return df.withColumn("slice", self._slice(F.col("start_sec"))).withColumn("bucket", bucket)

    def read(self, places: list[str] | None = None) -> DataFrame:
        """The stored sessions: ``user_id, start_sec, end_sec, n_events`` (user as BIGINT)."""
        files = (self.manifest.read() or {"files": {}})["files"]
        paths = [f"{self.path}/{f[0]}" for p, f in files.items() if places is None or p in places]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*paths)

    def merge(self, batch: DataFrame, user: str, time: str, batch_id: int | None = None) -> None:
        """Take in a batch: sessions it bridges become one, others stay or are added.

        The batch's local sessions and the stored ones of the slices within the
        gap of them are put in one order of time; components that hold a local
        session replace their stored parts. A batch without usable rows changes
        nothing, and so does a ``batch_id`` that was taken in before.
        """
        if self.manifest.holds(batch_id):
            return
        state = self.manifest.read() or {"version": 0, "files": {}}
        version = f"{state['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        local = sessions(batch, user, time, self.gap).withColumn("user_id", F.col("user_id").cast("long")).drop("duration_sec")
        files, touched = dict(state["files"]), []
        if not files:
            files = self._write(local, f"data/{version}")
        else:
            self._placed(local).write.parquet(f"{self.path}/batch/{version}")
            local = self.spark.read.schema(self._placed(local).schema).parquet(f"{self.path}/batch/{version}")
            fresh = self._spans(local)
            if fresh:
                # a local place reaches from its first start to its last end, and the gap on both sides
                spans: dict[str, list[tuple[int, int]]] = {}
                for place, (low, high) in fresh.items():
                    spans.setdefault(place.split("/")[1], []).append((low - self.gap, high + self.gap))
                touched = [p for p, (_, low, high) in files.items() if p in fresh or any(low <= b and high >= a for a, b in spans.get(p.split("/")[1], []))]
                both = self.read(touched).unionByName(local.select(*self.SCHEMA.fieldNames()))
                merged = (
                    components(both, self.gap).groupBy("user_id", "_comp")
                    .agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.sum("n_events").alias("n_events"))
                    .drop("_comp")
                )
                new = self._write(merged, f"data/{version}")
                files = {p: f for p, f in files.items() if p not in touched} | new
            self.manifest.delete(f"batch/{version}")
            if not fresh and batch_id is None:
                return
        dropped = [state["files"][p][0] for p in touched]
        last = batch_id if batch_id is not None else state.get("batch")
        self.manifest.commit({"version": state["version"] + 1, "buckets": self.buckets, "slice_sec": self.slice_sec, "batch": last, "files": files, "dropped": dropped})

    def _write(self, df: DataFrame, where: str) -> dict[str, list]:
        """Write sessions by slice and bucket, a bucket in one task; folder, first start and last end of each place."""
        rows = self._placed(df).repartitionById(self.buckets, F.col("bucket")).sortWithinPartitions("slice")
        rows.write.partitionBy("slice", "bucket").parquet(f"{self.path}/{where}")
        fs, root = jvm_fs(self.spark, f"{self.path}/{where}")
        if not any("=" in s.getPath().getName() for s in fs.listStatus(root)):
            return {}
        written = self.spark.read.schema("start_sec long, end_sec long, slice long, bucket int").parquet(f"{self.path}/{where}")
        return {p: [f"{where}/slice={p.split('/')[0]}/bucket={p.split('/')[1]}", *span] for p, span in self._spans(written).items()}

    @staticmethod
    def _spans(placed: DataFrame) -> dict[str, tuple[int, int]]:
        """First start and last end of each place: a row for each file of the table."""
        spans = placed.groupBy("slice", "bucket").agg(F.min("start_sec").alias("low"), F.max("end_sec").alias("high")).collect()
        return {f"{r['slice']}/{r['bucket']}": (r["low"], r["high"]) for r in spans}
