"""Canonical views over the test tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order of the interactions: time first, then the row's keys.
ORDER = ["time", "k1", "k2", "item", "k3", "k4"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str, join: str | None = None) -> DataFrame:
    """``user, item, label (1..5), time`` of every order line, with the keys of ``ORDER``; ``join`` hints how orders are joined."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = orders.hint(join) if join else orders
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(
        F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.ceil(F.col("l_quantity") / 10).cast("long").alias("label"), F.col("o_orderdate").alias("time"),
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_suppkey").alias("k3"), F.col("l_extendedprice").alias("k4"),
    )


SQL_I = """
i0 as (select o_custkey as "user", l_partkey as item, cast(ceil(l_quantity / 10) as bigint) as label, o_orderdate as time,
         l_orderkey as k1, l_linenumber as k2, l_suppkey as k3, l_extendedprice as k4
       from lineitem join orders on l_orderkey = o_orderkey)"""
#: One row for each (user, item), the last.
SQL_D = SQL_I + """,
d as (select "user", item, label, time, k1, k2, k3, k4 from (
        select *, row_number() over (partition by "user", item order by time desc, k1 desc, k2 desc, k3 desc, k4 desc) as rn from i0) where rn = 1)"""
SQL_ORDER = "time, k1, k2, item, k3, k4"
#: Folds of the chronological ratio split 0.8 / 0.2.
SQL_SPLIT = SQL_I + f""",
s0 as (select *, row_number() over (partition by "user" order by {SQL_ORDER}) as at_, count(*) over (partition by "user") as n from i0),
s as (select * exclude (at_, n), case when n <= 3 then 0 when at_ > cast(round_even(0.8::double * n, 0) as bigint) then 1 else 0 end as fold from s0)"""
#: Consumption lists without consecutive repeats.
SQL_LISTS = SQL_I + f""",
c0 as (select *, lag(item) over (partition by "user" order by {SQL_ORDER}) as before from i0),
l as (select "user", list(item order by {SQL_ORDER}) as items from c0 where before is null or before <> item group by "user")"""
