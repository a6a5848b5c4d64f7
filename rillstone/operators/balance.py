"""Per-key work without imbalance: fragment-replicate by estimated load.

Keys get tasks by a plan made before the shuffle: loads are estimated on a
sample, keys above a share of one task's capacity are bin-packed (longest
first, least loaded bin), keys above the capacity are split into shards in
proportion to their load. All other keys are hashed over the bins. The plan
has at most ``9 x bins`` entries whatever the data, so it may be broadcast.
An estimate that is off costs balance, never rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.session import fresh, parallelism

#: Rows of one bin, about, where the number of bins is free.
BIN_ROWS = 4_000_000
#: Keys with at least this share of a task's capacity are placed one by one.
PLACED_SHARE = 0.125


@dataclass(frozen=True)
class LoadPlan:
    """Placement of the loaded keys: ``placed[key]`` lists the bin of each shard."""

    bins: int
    total: float
    placed: dict

    def frame(self, spark, key_type: T.DataType, key: str, bins: str) -> DataFrame:
        """The plan as rows (``key``, ``bins``); at most 9 x bins entries."""
        schema = T.StructType([T.StructField(key, key_type), T.StructField(bins, T.ArrayType(T.IntegerType()))])
        return spark.createDataFrame([(k, list(v)) for k, v in self.placed.items()], schema)


def pack(loads: list[tuple[object, float]], total: float, bins: int) -> LoadPlan:
    """Bin-pack the loaded keys; the rest of ``total`` is spread evenly by hash."""
    capacity = max(total / bins, 1e-9)
    shards = [(load / n, key) for key, load in loads for n in [min(bins, math.ceil(load / capacity))] for _ in range(n)]
    rest = max(0.0, total - sum(load for _, load in loads)) / bins
    heap = [(rest, b) for b in range(bins)]
    placed: dict = {}
    for load, key in sorted(shards, key=lambda s: (-s[0], str(s[1]))):
        held, b = heapq.heappop(heap)
        placed.setdefault(key, []).append(b)
        heapq.heappush(heap, (held + load, b))
    return LoadPlan(bins, total, {k: sorted(v) for k, v in placed.items()})


def plan_loads(df: DataFrame, key: str, bins: int | None = None, fraction: float = 0.1, seed: int = 7) -> LoadPlan:
    """Estimate the load of each key on a sample and pack the loaded ones.

    ``fraction`` of the rows is counted by key with map-side combining. Unless
    given, there are as many ``bins`` as reduce tasks, or more if a bin would
    have more than ``BIN_ROWS`` rows. Only keys that would fill an eighth of a
    task come to the driver: 8 x bins at most, as their loads sum to no more
    than the total.
    """
    counts = df.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).sample(fraction, seed).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("double").alias("_total"))  # one row, from the same exchange
    n_bins = F.lit(float(bins)) if bins else F.greatest(F.lit(float(parallelism(df.sparkSession))), F.ceil(F.col("_total") / fraction / BIN_ROWS).cast("double"))
    loaded = F.col("_n") >= F.greatest(F.lit(PLACED_SHARE) * F.col("_total") / F.col("_bins"), F.lit(2.0))
    top = F.broadcast(total.withColumn("_bins", n_bins)).join(counts, loaded, "left").collect()  # the row of the total stays if no key is loaded
    rows, wide = float(top[0]["_total"]), int(top[0]["_bins"])
    loads = sorted(((r["_key"], float(r["_n"])) for r in top if r["_n"] is not None), key=lambda x: (-x[1], str(x[0])))
    return pack(loads, rows, wide)


def _placed(df: DataFrame, key: str, plan: LoadPlan) -> tuple[DataFrame, str, str]:
    """The rows with the plan's bins of their key (null for keys that are hashed)."""
    k, bins = fresh(df.columns, "_key", "_bins")
    frame = F.broadcast(plan.frame(df.sparkSession, df.schema[key].dataType, k, bins))
    return df.join(frame, F.col(key) == F.col(k), "left"), k, bins


def spread(df: DataFrame, key: str, plan: LoadPlan, by: Column, out: str = "_bin") -> DataFrame:
    """Give each row its bin: shard ``by`` for split keys, the hash of the key for others."""
    rows, k, bins = _placed(df, key, plan)
    at = F.pmod(by, F.size(bins).cast("long")).cast("int")
    return rows.withColumn(out, F.coalesce(F.get(bins, at), F.pmod(F.xxhash64(key), F.lit(plan.bins)).cast("int"))).drop(k, bins)


def replicate(df: DataFrame, key: str, plan: LoadPlan, out: str = "_bin") -> DataFrame:
    """The matching side: one copy for each bin that holds a shard of the row's key."""
    rows, k, bins = _placed(df, key, plan)
    own = F.array(F.pmod(F.xxhash64(key), F.lit(plan.bins)).cast("int"))
    return rows.withColumn(out, F.explode(F.array_distinct(F.coalesce(bins, own)))).drop(k, bins)


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", plan: LoadPlan | None = None) -> DataFrame:
    """Equi join on ``key`` whose work is even however skewed ``left`` is.

    Rows of ``left`` are fragmented over the shards of their key, rows of
    ``right`` are replicated to just those bins. ``how`` is inner, left,
    left_semi or left_anti, for which each left row is in one bin only.
    Null keys match nothing; left and anti joins keep them. Columns of
    ``right`` other than the key must not be named as those of ``left``
    (``ValueError``).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how={how!r}")
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash and how in ("inner", "left"):
        raise ValueError(f"both sides have {sorted(clash)}")
    plan = plan or plan_loads(left, key)
    by = F.xxhash64(*[F.col(f"`{c}`") for c in _hashable(left)])
    (at,) = fresh([*left.columns, *right.columns], "_bin")
    a = spread(left, key, plan, by, at).repartitionById(plan.bins, F.col(at))
    b = replicate(right.where(F.col(key).isNotNull()), key, plan, at).repartitionById(plan.bins, F.col(at))
    return a.join(b, [at, key], how).drop(at)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def key_stats(df: DataFrame, key: str, member: str | None = None, value: str | None = None, plan: LoadPlan | None = None) -> DataFrame:
    """Rows, distinct members and mean value of every key, in evenly loaded tasks.

    Result: ``key, n_rows, n_members, mean_value``. Split keys are sharded by
    ``member``, so each shard counts its own distinct members exactly and the
    shards' counts add up. One shuffle carries rows; the second only one row for
    each key and bin. Rows without member need no distinct count and are
    combined on the map side instead.

    Null keys have no group; null members and values don't count (a key with
    none has 0 and null). Repeated rows all count. An empty table gives none.
    ``member`` and ``value`` may be left out, their results are then null.
    """
    if key in ("n_rows", "n_members", "mean_value", "_bin", "_member", "_value"):
        raise ValueError(f"rename the key column {key}")
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias(key),
        (F.col(member) if member else F.lit(None).cast("int")).alias("_member"),
        (F.col(value) if value else F.lit(None)).cast("double").alias("_value"),
    )
    sums = [F.sum("_value").alias("_sum"), F.count("_value").alias("_valued")]
    parts = rows.where("_member is null").groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.lit(0).cast("long").alias("_members"), *sums)
    if member:
        plan = plan or plan_loads(df, key)
        pairs = (
            spread(rows.where("_member is not null"), key, plan, F.xxhash64("_member")).repartitionById(plan.bins, F.col("_bin"))
            .groupBy("_bin", key, "_member").agg(F.count(F.lit(1)).alias("_n"), *sums)
        )
        shards = pairs.groupBy("_bin", key).agg(
            F.sum("_n").alias("_n"), F.count("_member").alias("_members"), F.sum("_sum").alias("_sum"), F.sum("_valued").alias("_valued")
        )
        parts = shards.drop("_bin").unionByName(parts)
    out = parts.groupBy(key).agg(F.sum("_n").alias("n_rows"), F.sum("_members").alias("n_members"), F.try_divide(F.sum("_sum"), F.sum("_valued")).alias("mean_value"))
    if not member:
        out = out.withColumn("n_members", F.lit(None).cast("long"))
    return out


def heavy_keys(stats: DataFrame, key: str, share: float) -> DataFrame:
    """Of ``key_stats``, the keys with at least ``share`` of all rows that have a key."""
    total = stats.agg(F.sum("n_rows").alias("_total"))  # one row
    return stats.join(F.broadcast(total), F.col("n_rows") >= F.col("_total") * F.lit(share)).select(key, "n_rows")
