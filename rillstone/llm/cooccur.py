"""Items that stand together: blocked Gram matrix over baskets.

With X the binary matrix of baskets and items, the pair counts are the upper
triangle of X'X: baskets become sparse item blocks, the products X_I' X_J are
summed over record blocks (``operators/gram.py``), and the counts are set
against what chance gives from the items' own counts.

Two bounds hold before any product is formed, so they lose no pair: a pair
stands together no more often than its rarer item stands at all, so items of
too few baskets are left out of the matrix; and a lift of at least L is out of
reach of items that stand in more than every L-th basket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.operators import gram
from rillstone.session import materialize

#: Slots of the support filter, a prime: one bit each (half a megabyte), for any number of items.
SLOTS = 4_194_301


def clean_basket(items: Column) -> Column:
    """Sorted distinct non-null members."""
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))


def latest(df: DataFrame, keys: list[str], version: str, value: str) -> DataFrame:
    """The value of the highest version of each key; null keys are left out."""
    rows = df.dropna(subset=keys)
    top = rows.groupBy(*keys).agg(F.max(version).alias(version))
    return rows.join(top, [*keys, version], "left_semi").select(*keys, F.col(value))


def pair_counts(baskets: DataFrame, items: str, min_count: int = 1, part: int = gram.PART) -> DataFrame:
    """``a, b, n_ab`` (BIGINT) with a < b: the number of baskets that hold both, from ``min_count``.

    ``items`` must be sorted distinct integer arrays (``clean_basket``).
    Baskets with fewer than two members form no pair.
    """
    cells = gram.gram(gram.array_records(baskets, items, part), gram.cells_of(min_count), "a long, b long, n long, dot double")
    return cells.select("a", "b", F.col("n").alias("n_ab"))


def _support_bits(single: DataFrame, min_count: int) -> np.ndarray:
    """One bit a slot: whether the items of the slot have ``min_count`` baskets together.

    An item of enough baskets always has its bit set; others may share a slot
    with one, which costs work but no pair. At most ``SLOTS`` numbers come here.
    """
    slots = single.groupBy(F.pmod(F.col("x").cast("long"), F.lit(SLOTS)).alias("s")).agg(F.sum("n_x").alias("n")).where(F.col("n") >= min_count)
    on = np.zeros(SLOTS, bool)
    on[slots.select("s").toArrow().column(0).to_numpy()] = True
    return np.packbits(on)


def _prune(shared):
    """Members that may still be part of a pair; baskets with less than two of them are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often = shared.value
        for b in batches:
            col = b.column(0)
            x = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            slot = x % SLOTS
            keep = (bits[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool) & ~np.isin(x, often)
            n = np.add.reduceat(np.r_[keep, False].astype(np.int64), col.offsets.to_numpy()[:-1] - col.offsets[0].as_py()) if len(col) else np.zeros(0, np.int64)
            full = n > 1
            x = x[keep & np.repeat(full, np.diff(col.offsets.to_numpy()))]
            yield pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[full])], pa.int64()), pa.array(x)).cast(pa.list_(pa.int64()))], names=["m"])

    return run


def associations(baskets: DataFrame, items: str, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Pairs with count and lift: ``a, b, n_ab, n_a, n_b, n, lift``.

    Lift is how many times more often the pair stands together than chance
    gives: n_ab * n / (n_a * n_b), n being the number of non-empty baskets.
    Null members and repeats in a basket don't count, null and empty baskets
    are none. No baskets give no pairs. Items are integers of any width;
    ``a`` and ``b`` keep their type.
    """
    spark = baskets.sparkSession
    kind = baskets.schema[items].dataType.elementType
    sets = materialize(baskets.select(clean_basket(F.col(items)).cast("array<bigint>").alias("m")).where(F.size("m") > 0), "baskets")
    single = materialize(sets.select(F.explode("m").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n_x")), "basket-items")
    n = sets.count()
    # more than n / min_lift baskets: no more items than min_lift times the mean length of a basket
    often = single.where(F.col("n_x") * F.lit(float(min_lift)) > F.lit(float(n))).select("x").toArrow().column(0).to_numpy() if min_lift > 1 else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((_support_bits(single, min_count), often))
    pairs = pair_counts(sets.mapInArrow(_prune(shared), "m array<bigint>"), "m", min_count)
    out = pairs.join(single.select(F.col("x").alias("a"), F.col("n_x").alias("n_a")), "a").join(single.select(F.col("x").alias("b"), F.col("n_x").alias("n_b")), "b")
    out = out.withColumn("n", F.lit(n).cast("long")).withColumns({c: F.col(c).cast(kind) for c in ("a", "b")})
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    return out.withColumn("lift", lift).where(F.col("n_ab") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
