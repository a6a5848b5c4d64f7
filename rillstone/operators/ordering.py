"""Global ranks without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillstone.session import fresh, materialize, parallelism


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Add the 0-based place of each row in a total order.

    A range exchange sorts over all tasks; the place is the row's place in its
    partition plus the rows of earlier partitions, of which there is one number
    each. ``order`` should be unique, else tied rows are in any order.
    """
    parts = parallelism(df.sparkSession)
    at, part, start, length, before = fresh([*df.columns, name], "_place", "_part", "_start", "_len", "_before")
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = materialize(placed, "rank").withColumn(part, F.shiftright(at, 33))
    starts = placed.groupBy(part).agg(F.min(at).alias(start), F.count(F.lit(1)).alias(length))
    earlier = F.coalesce(F.sum(length).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumn(before, earlier).select(part, start, before)  # a row for each partition
    return placed.join(F.broadcast(starts), part).withColumn(name, F.col(at) - F.col(start) + F.col(before)).drop(at, part, start, before)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; cut on the map side before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(rank) <= k)
