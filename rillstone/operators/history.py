"""Consumption histories and behaviour sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def consumed(df: DataFrame, user: str, item: str, order: list[Column | str], dedup: str = "consecutive", out: str = "items") -> DataFrame:
    """Ordered list of each user's items; consecutive repeats are dropped, or all but the first ("all")."""
    if dedup not in ("consecutive", "all"):
        raise ValueError(f"dedup={dedup!r}")
    rows = df.where(F.col(user).isNotNull() & F.col(item).isNotNull())
    if dedup == "consecutive":
        before = F.lag(item).over(Window.partitionBy(user).orderBy(*order))
        rows = rows.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(item)))
    pairs = F.array_sort(F.collect_list(F.struct(*[F.struct(*order).alias("o"), F.col(item).alias("v")])))
    lists = rows.groupBy(user).agg(F.transform(pairs, lambda x: x["v"]).alias(out))
    return lists.withColumn(out, F.array_distinct(out)) if dedup == "all" else lists


def merge_consumed(old: DataFrame, new: DataFrame, key: str, items: str = "items", merge: bool = True) -> DataFrame:
    """Old lists followed by new ones, or the new list where there is one."""
    both = old.select(key, F.col(items).alias("_old")).join(new.select(key, F.col(items).alias("_new")), key, "full_outer")
    none = F.array().cast(old.schema[items].dataType)
    joined = F.concat(F.coalesce("_old", none), F.coalesce("_new", none)) if merge else F.coalesce("_new", "_old")
    return both.select(key, joined.alias(items))


def pad(array: Column, length: int, value: object) -> Column:
    """Left-aligned array of exactly ``length``, filled with ``value``."""
    return F.slice(F.concat(array, F.array_repeat(F.lit(value), length)), 1, length)


def last_n(array: Column, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - F.lit(n - 1), F.lit(1)), n)


def recent_seq(lists: DataFrame, items: str, length: int, pad_value: object) -> DataFrame:
    """Add the last ``length`` items (``seq``, padded) and ``seq_len`` (1 for an empty history)."""
    recent = last_n(F.col(items), length)
    return lists.withColumn("seq", pad(recent, length, pad_value)).withColumn("seq_len", F.greatest(F.size(recent), F.lit(1)))


def _before(items: Column, item: Column) -> Column:
    """Items before the first occurrence of an item; all if it does not occur."""
    at = F.array_position(items, item).cast("int")
    return F.slice(items, F.lit(1), F.when(at > 0, at - 1).otherwise(F.size(items)))


def train_seq(df: DataFrame, lists: DataFrame, user: str, item: str, length: int, pad_value: object, items: str = "items") -> DataFrame:
    """For each row the last ``length`` items consumed before the item's first occurrence."""
    seq = last_n(_before(F.col(items), F.col(item)), length)
    return df.join(lists, user).withColumn("_s", seq).withColumn("seq", pad(F.col("_s"), length, pad_value)).withColumn("seq_len", F.greatest(F.size("_s"), F.lit(1))).drop("_s", items)


def dual_seq(df: DataFrame, lists: DataFrame, user: str, item: str, long: int, short: int, pad_value: object, items: str = "items") -> DataFrame:
    """Short (the most recent ``short``) and long (``long`` before them) sequence of each row."""
    before = F.col("_b")
    s = last_n(before, short)
    older = F.slice(before, F.lit(1), F.greatest(F.size(before) - F.lit(short), F.lit(0)))
    out = df.join(lists, user).withColumn("_b", _before(F.col(items), F.col(item)))
    out = out.withColumn("_s", s).withColumn("_l", last_n(older, long))
    for name, src, n in (("short", "_s", short), ("long", "_l", long)):
        out = out.withColumn(f"{name}_seq", pad(F.col(src), n, pad_value)).withColumn(f"{name}_len", F.greatest(F.size(src), F.lit(1)))
    return out.drop("_b", "_s", "_l", items)


def sparse_history(df: DataFrame, lists: DataFrame, row: str, user: str, item: str, length: int, items: str = "items") -> DataFrame:
    """History as (row, pos, item) pairs; rows without history give none."""
    seq = last_n(_before(F.col(items), F.col(item)), length)
    return df.join(lists, user).select(row, F.posexplode(seq).alias("pos", "past_item"))


def encode_seq(seq: Column, vocab: dict, oov: int) -> Column:
    """Inner ids of an ad-hoc sequence by a small literal vocabulary; unknown items get ``oov``."""
    m = F.create_map(*[x for k, v in vocab.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(seq, lambda x: F.coalesce(F.try_element_at(m, x), F.lit(oov)))


def consecutive_edges(df: DataFrame, user: str, item: str, order: list[Column | str]) -> DataFrame:
    """Pairs of items that follow each other in a user's list of distinct neighbours: ``src, dst, weight``."""
    w = Window.partitionBy(user).orderBy(*order)
    rows = df.withColumn("_b", F.lag(item).over(w)).where(~F.col("_b").eqNullSafe(F.col(item)))
    pairs = rows.withColumn("dst", F.lead(item).over(w)).where(F.col("dst").isNotNull())
    return pairs.groupBy(F.col(item).alias("src"), "dst").agg(F.count(F.lit(1)).alias("weight"))


def causal_mask(length: int, spark) -> DataFrame:
    """Positions (``query, key``) with whether the query may see the key."""
    r = spark.range(length)
    return r.select(F.col("id").alias("query")).crossJoin(r.select(F.col("id").alias("key"))).withColumn("visible", F.col("key") <= F.col("query"))


def seq_mask(lens: Column, length: int) -> Column:
    """Array of flags: whether a position holds an item."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i < lens)
