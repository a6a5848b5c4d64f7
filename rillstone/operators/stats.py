"""Statistics of an interaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.operators.ordering import top_k


def dataset_stats(df: DataFrame, user: str, item: str, label: str) -> DataFrame:
    """One row: sizes, density in percent, mean and range of labels."""
    out = df.agg(
        F.count(F.lit(1)).alias("data_size"), F.count_distinct(user).alias("n_users"), F.count_distinct(item).alias("n_items"),
        F.avg(label).alias("global_mean"), F.min(label).alias("min_label"), F.max(label).alias("max_label"),
    )
    return out.withColumn("density", F.try_divide(F.lit(100.0) * F.col("data_size"), F.col("n_users") * F.col("n_items")))


def popular_items(df: DataFrame, user: str, item: str, num: int = 100) -> DataFrame:
    """Items with the most distinct users: ``item, n_users``; ties to the smaller item."""
    n = df.select(user, item).dropna().distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n_users"))
    return n.orderBy(F.desc("n_users"), item).limit(num)


def top_up_popular(new: DataFrame, old: DataFrame, item: str, num: int = 100) -> DataFrame:
    """New popular items followed by old ones that are not among them, ``num`` in all (both are at most that long)."""
    a = new.select(item, F.lit(0).alias("_g"), F.col("n_users").alias("_n"))
    b = old.join(new, item, "left_anti").select(item, F.lit(1).alias("_g"), F.col("n_users").alias("_n"))
    return a.unionByName(b).orderBy("_g", F.desc("_n"), item).limit(num).select(item)


def item_frequency(df: DataFrame, user: str, item: str) -> DataFrame:
    return df.groupBy(item).agg(F.count_distinct(user).alias("n_users"))


def negative_probabilities(df: DataFrame, user: str, item: str, temperature: float = 0.75) -> DataFrame:
    """Sampling probability of each item: its distinct users to a power, normalised."""
    f = item_frequency(df, user, item).withColumn("_f", F.pow(F.col("n_users").cast("double"), F.lit(temperature)))
    whole = f.agg(F.sum("_f").alias("_t"))
    return f.crossJoin(F.broadcast(whole)).select(item, (F.col("_f") / F.col("_t")).alias("prob"))


def positive_probabilities(df: DataFrame, user: str, item: str, alpha: float = 1e-3) -> DataFrame:
    """Keep probability of frequent items: (sqrt(p / alpha) + 1) * alpha / p."""
    n = df.agg(F.count_distinct(user).cast("double").alias("_n"))
    p = F.col("n_users") / F.col("_n")
    return item_frequency(df, user, item).crossJoin(F.broadcast(n)).select(item, ((F.sqrt(p / alpha) + 1) * (alpha / p)).alias("prob"))


def sampling_correction(df: DataFrame, item: str) -> DataFrame:
    """Share of each item in all rows, the expected sampling rate of in-batch negatives."""
    n = df.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("_c")).crossJoin(F.broadcast(n)).select(item, (F.col("_c") / F.col("_n")).alias("rate"))


def mutual_information(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mutual information of each pair of columns in nats: ``a, b, mi``; one contingency pass per pair."""
    n = df.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    out = None
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            cells = df.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("c"))
            px = cells.groupBy("x").agg(F.sum("c").alias("cx"))
            py = cells.groupBy("y").agg(F.sum("c").alias("cy"))
            full = cells.join(px, cells.x.eqNullSafe(px.x)).drop(px.x).join(py, cells.y.eqNullSafe(py.y)).drop(py.y).crossJoin(F.broadcast(n))
            mi = F.sum(F.col("c") / F.col("_n") * F.log(F.col("c") * F.col("_n") / (F.col("cx") * F.col("cy"))))
            part = full.agg(mi.alias("mi")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "mi")
            out = part if out is None else out.unionByName(part)
    return out


def mutual_partners(mi: DataFrame, n: int) -> DataFrame:
    """The ``n`` columns with the highest mutual information with each column."""
    both = mi.unionByName(mi.select(F.col("b").alias("a"), F.col("a").alias("b"), "mi"))
    return top_k(both, ["a"], [F.desc("mi"), F.asc("b")], n)


def vector_means(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector of each key, position by position."""
    parts = df.select(key, F.posexplode(vec).alias("_p", "_v")).groupBy(key, "_p").agg(F.avg("_v").alias("_m"))
    sort = F.array_sort(F.collect_list(F.struct("_p", "_m")))
    return parts.groupBy(key).agg(F.transform(sort, lambda x: x["_m"]).alias(vec))
