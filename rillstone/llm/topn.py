"""Top N items of every group by statistics-guided skipping.

The scores are written once, clustered by group: the bins of a load plan
(groups above a task's capacity are split by item), each a file sorted by
group, falling score and item, in small row groups. A query reads a file's
row groups in falling order of their maximum score and skips those in which no
wanted group can still gain: none is asked for, or the maximum lies strictly
below the current N-th score of every group the row group may hold. Equal
scores are read, so the tie rule (smaller item first) holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillstone.operators.balance import LoadPlan, fragment_replicate_join, plan_loads, replicate, spread
from rillstone.session import jvm_fs, materialize, scratch

#: Bytes of a row group, the unit of skipping.
ROW_GROUP_BYTES = 256 << 10


@dataclass(frozen=True)
class GroupIndex:
    """Scores clustered by group, below ``path``; group and item are integers."""

    spark: SparkSession
    path: str
    plan: LoadPlan

    @classmethod
    def build(cls, df: DataFrame, group: str, item: str, score: str, row_group_bytes: int = ROW_GROUP_BYTES, path: str | None = None) -> GroupIndex:
        """Write the clustered files, below ``path`` for later use by ``open``.

        Rows with null group or item or null or NaN score are left out.
        """
        rows = df.select(F.col(group).cast("long").alias("grp"), F.col(item).cast("long").alias("item"), (F.col(score).cast("double") + F.lit(0.0)).alias("score"))
        rows = rows.where("grp is not null and item is not null and score is not null and not isnan(score)")
        plan = plan_loads(rows, "grp")
        path = path or scratch(df.sparkSession, "topn")
        (
            spread(rows, "grp", plan, F.xxhash64("item")).repartitionById(plan.bins, F.col("_bin"))
            .sortWithinPartitions("_bin", "grp", F.desc("score"), "item")
            .write.partitionBy("_bin").option("parquet.block.size", row_group_bytes)
            .option("parquet.block.size.row.check.min", 1000).option("parquet.page.size.row.check.min", 1000).parquet(f"{path}/data")
        )
        fs, p = jvm_fs(df.sparkSession, f"{path}/plan.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"bins": plan.bins, "total": plan.total, "placed": list(plan.placed.items())}).encode()))
        out.close()
        return cls(df.sparkSession, path, plan)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GroupIndex:
        """An index built before: any number of queries share one clustering."""
        plan = json.loads(spark.read.text(f"{path}/plan.json").first()[0])
        return cls(spark, path, LoadPlan(plan["bins"], plan["total"], {k: v for k, v in plan["placed"]}))

    def top_n(self, wanted: DataFrame, group: str, n: str) -> DataFrame:
        """The ``n`` best items of each wanted group: ``grp, item, score, rank``.

        An item counts once, with its highest score; equal scores go to the
        smaller item. Groups with fewer items give all; null groups and null or
        non-positive ``n`` give none; of a repeated group the largest ``n`` holds.
        """
        ask = wanted.select(F.col(group).cast("long").alias("grp"), F.col(n).cast("long").alias("n")).where("grp is not null and n >= 1")
        ask = ask.groupBy("grp").agg(F.max("n").alias("n"))
        sidecar = scratch(self.spark, "wanted")
        (
            replicate(ask, "grp", self.plan).repartitionById(self.plan.bins, F.col("_bin"))
            .sortWithinPartitions("_bin", "grp").write.partitionBy("_bin").parquet(sidecar)
        )
        split = sorted(k for k, bins in self.plan.placed.items() if len(bins) > 1)  # at most one a bin
        read = _reader(f"{self.path}/data", sidecar)
        bins = self.spark.range(self.plan.bins).select(F.col("id").cast("int").alias("bin")).repartitionById(self.plan.bins, F.col("bin"))
        local = materialize(bins.mapInArrow(read, "grp long, item long, score double, rank long, n long"), "topn-local")
        whole = local.where(~F.col("grp").isin(split)) if split else local
        out = whole.select("grp", "item", "score", "rank")
        if split:
            out = out.unionByName(_merge_shards(local.where(F.col("grp").isin(split)), self.plan.bins))
        return out


def _merge_shards(rows: DataFrame, parts: int) -> DataFrame:
    """Rank the shards' lists of split groups together, without gathering a group in one task.

    A range exchange sorts them over all tasks; a row's rank is its place in its
    partition plus the group's rows in earlier partitions.
    """
    order = [F.col("grp"), F.desc("score"), F.col("item")]
    placed = rows.drop("rank").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "topn-merge").withColumn("_part", F.shiftright("_at", 33))
    starts = placed.groupBy("grp", "_part").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_len"))  # at most groups + parts rows
    before = F.coalesce(F.sum("_len").over(Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumn("_before", before).select("grp", "_part", "_start", "_before")
    ranked = placed.join(F.broadcast(starts), ["grp", "_part"]).withColumn("rank", F.col("_at") - F.col("_start") + F.col("_before") + 1)
    return ranked.where("rank <= n").select("grp", "item", "score", "rank")


def _best(grp: np.ndarray, item: np.ndarray, score: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort by group, falling score, item; drop repeats of an item; cut at each row's ``limit``."""
    by_item = np.lexsort((-score, item, grp))
    g, i = grp[by_item], item[by_item]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
    keep = by_item[first]
    keep = keep[np.lexsort((item[keep], -score[keep], grp[keep]))]
    g = grp[keep]
    start = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1] if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)])) + 1
    ok = rank <= limit[keep]
    keep = keep[ok]
    return grp[keep], item[keep], score[keep], rank[ok], limit[keep]


def scan_bin(files: list, ask_grp: np.ndarray, ask_n: np.ndarray, stats: dict | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Read one bin's files, skipping row groups; yields (grp, item, score, rank, n) in pieces.

    ``ask_grp`` is sorted. Groups inside a row group are complete, as the file
    is sorted by group; only those at its edges wait for other row groups, and
    are merged when as many rows wait as are held, so in linear-logarithmic time.
    """
    held: dict[int, tuple] = {}
    waiting: dict[int, list[tuple]] = {}

    def merge(x: int) -> None:
        all_ = [*([held[x]] if x in held else []), *waiting.pop(x)]
        c = [np.concatenate(c) for c in zip(*all_, strict=True)]
        held[x] = _best(c[0], c[1], c[2], c[4])

    for file in files:
        md = file.metadata
        names = [md.schema.column(j).name for j in range(md.num_columns)]
        g, s = names.index("grp"), names.index("score")
        parts = []
        for r in range(md.num_row_groups):
            col, sc = md.row_group(r).column(g).statistics, md.row_group(r).column(s).statistics
            parts.append((-sc.max, r, col.min, col.max))
        for top, r, low, high in sorted(parts):
            at, to = np.searchsorted(ask_grp, [low, high + 1])
            nth = [held[x][2][-1] for x in ask_grp[at : min(to, at + 3)] if x in held and len(held[x][2]) >= held[x][4][0]]
            if at == to or (to - at <= 2 and len(nth) == to - at and all(-top < x for x in nth)):
                if stats is not None:
                    stats["skipped"] = stats.get("skipped", 0) + 1
                continue
            rows = file.read_row_group(r, columns=["grp", "item", "score"])
            grp, item, score = (rows.column(c).to_numpy() for c in ("grp", "item", "score"))
            place = np.minimum(np.searchsorted(ask_grp, grp), len(ask_grp) - 1)
            ok = ask_grp[place] == grp
            best = _best(grp[ok], item[ok], score[ok], ask_n[place[ok]])
            edge = (best[0] == low) | (best[0] == high)
            yield tuple(x[~edge] for x in best)
            for x in {low, high}:
                new = tuple(c[best[0] == x] for c in best)
                if len(new[0]):
                    waiting.setdefault(x, []).append(new)
                    if sum(len(p[0]) for p in waiting[x]) >= (len(held[x][0]) if x in held else 0):
                        merge(x)
    for x in list(waiting):
        merge(x)
    yield from held.values()


def _reader(data: str, sidecar: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        def files(root: str, b: int) -> list:
            fs, path = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
            found = fs.get_file_info(pafs.FileSelector(f"{path}/_bin={b}", allow_not_found=True))
            return [pq.ParquetFile(fs.open_input_file(f.path)) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".parquet")]

        for batch in batches:
            for b in batch.column(0).to_pylist():
                ask = [f.read() for f in files(sidecar, b)]
                if not ask:
                    continue
                ask = pa.concat_tables(ask)
                for piece in scan_bin(files(data, b), ask.column("grp").to_numpy(), ask.column("n").to_numpy()):
                    for i in range(0, len(piece[0]), 100_000):
                        cut = [pa.array(c[i : i + 100_000]) for c in piece]
                        yield pa.RecordBatch.from_arrays([x.cast(pa.float64() if k == 2 else pa.int64()) for k, x in enumerate(cut)], names=["grp", "item", "score", "rank", "n"])

    return read


def expand_requests(requests: DataFrame, request: str, group: str, n: str, lists: DataFrame, block: int = 256) -> DataFrame:
    """Deal the ranked lists out to requests: distinct ``request, item, rank``.

    Joined by group and block of ranks, so a long list isn't met in one task,
    and by fragment-replicate, so neither are the requests of a group that most
    of them ask for. A request's blocks end with the list.
    """
    ask = requests.select(F.col(request).alias("request"), F.col(group).cast("long").alias("grp"), F.col(n).cast("long").alias("_n")).where("grp is not null and _n >= 1")
    ask = materialize(ask.groupBy("request", "grp").agg(F.max("_n").alias("_n")), "topn-requests")
    length = lists.groupBy("grp").agg(F.max("rank").alias("_len"))
    ask = fragment_replicate_join(ask, length, "grp").withColumn("_n", F.least("_n", "_len")).drop("_len")
    ask = ask.withColumn("_block", F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("_n") - 1, F.lit(block)).cast("int"))))
    ask = materialize(ask.withColumn("_key", F.xxhash64("grp", "_block")), "topn-blocks")
    at = F.call_function("div", F.col("rank") - 1, F.lit(block)).cast("int")
    ranked = lists.select("item", "rank", F.col("grp").alias("_g"), at.alias("_b")).withColumn("_key", F.xxhash64("_g", "_b"))
    both = fragment_replicate_join(ask, ranked, "_key").where("grp = _g and _block = _b and rank <= _n")
    return both.groupBy("request", "item").agg(F.min("rank").alias("rank"))
