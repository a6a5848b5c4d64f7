"""Train, eval and test splits, and the treatment of unknown users and items.

Splits add a column ``fold`` (0 is the training part) rather than making
several frames, so one pass serves all folds.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillstone.operators.ordering import global_rank

#: Users with at most this many rows are never split.
RARE = 3


def fold_shares(test_size: float | None = None, multi_ratios: list[float] | None = None) -> list[float]:
    """Shares of the folds; exactly one argument, a float in (0, 1) or several positive numbers."""
    if (test_size is None) == (multi_ratios is None):
        raise ValueError("give either test_size or multi_ratios")
    if test_size is not None:
        if not isinstance(test_size, float) or not 0 < test_size < 1:
            raise ValueError("test_size must be a float in (0, 1)")
        return [1 - test_size, test_size]
    if not isinstance(multi_ratios, (list, tuple)) or len(multi_ratios) < 2 or min(multi_ratios) <= 0:
        raise ValueError("multi_ratios must be two or more positive numbers")
    whole = math.fsum(multi_ratios)
    return [r / whole for r in multi_ratios]


def _placed(df: DataFrame, user: str, order: list[Column | str]) -> DataFrame:
    """Place of each row in its user's order and the user's number of rows."""
    by = Window.partitionBy(user)
    return df.withColumn("_at", F.row_number().over(by.orderBy(*order))).withColumn("_len", F.count(F.lit(1)).over(by))


def split_by_ratio(df: DataFrame, user: str, order: list[Column | str], test_size: float | None = None, multi_ratios: list[float] | None = None) -> DataFrame:
    """Each user's rows cut at ``round(cumulative share x rows)``, half to even."""
    shares = fold_shares(test_size, multi_ratios)
    fold = F.lit(0)
    for cum in list(accumulate(shares))[:-1]:
        fold = fold + (F.col("_at") > F.bround(F.lit(cum) * F.col("_len"), 0)).cast("int")
    return _placed(df, user, order).withColumn("fold", F.when(F.col("_len") <= RARE, 0).otherwise(fold)).drop("_at", "_len")


def split_by_num(df: DataFrame, user: str, order: list[Column | str], test_size: int = 1) -> DataFrame:
    """The last ``test_size`` rows of each user; one row of users with no more than that."""
    if not isinstance(test_size, int) or test_size < 1:
        raise ValueError("test_size must be a positive int")
    take = F.when(F.col("_len") <= test_size, 1).otherwise(test_size)
    fold = F.when(F.col("_len") <= RARE, 0).otherwise((F.col("_at") > F.col("_len") - take).cast("int"))
    return _placed(df, user, order).withColumn("fold", fold).drop("_at", "_len")


def random_split(df: DataFrame, order: list[Column | str], test_size: float | None = None, multi_ratios: list[float] | None = None, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """Folds of exact size: rows in order of a seeded hash (or as they are), the last fold rounded up first."""
    shares = fold_shares(test_size, multi_ratios)
    sort = [F.xxhash64(F.lit(seed), *order), *order] if shuffle else order
    ranked = global_rank(df, sort, "_at")
    left, sizes = df.count(), []
    for k in range(len(shares) - 1, 0, -1):
        n = math.ceil(round(left * shares[k] / math.fsum(shares[: k + 1]), 9))
        sizes.insert(0, n)
        left -= n
    fold = F.lit(0)
    for cut in accumulate([left, *sizes[:-1]]):
        fold = fold + (F.col("_at") >= cut).cast("int")
    return ranked.withColumn("fold", fold).drop("_at")


def filter_unknown(df: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose every key occurs in the training rows."""
    for k in keys:
        df = df.join(train.select(k).distinct(), k, "left_semi")
    return df


def pad_unknown(df: DataFrame, train: DataFrame, pads: dict[str, object]) -> DataFrame:
    """Replace keys that do not occur in the training rows by a pad value."""
    for k, pad in pads.items():
        known = train.select(F.col(k).alias("_known")).where(F.col("_known").isNotNull()).distinct()
        df = df.join(known, F.col(k) == F.col("_known"), "left").withColumn(k, F.when(F.col("_known").isNull(), F.lit(pad)).otherwise(F.col(k))).drop("_known")
    return df
