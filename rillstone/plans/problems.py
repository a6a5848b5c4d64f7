"""Queries of the general training-data problems (skewed keys, sessions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.balance import fragment_replicate_join, heavy_keys, key_stats
from rillstone.operators.sessions import SessionTable, sessions
from rillstone.session import scratch

#: Batches in which p2 feeds the log to the session table, in order of arrival.
SESSION_BATCHES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = key_stats(table(spark, sf_dir, "ratings"), "item", "user_id", "label")
    return heavy_keys(stats, "item", 0.01).select("item")


def p1_item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = key_stats(table(spark, sf_dir, "ratings"), "item", "user_id", "label")
    return stats.select("item", "n_rows", F.col("n_members").alias("n_users"), F.round("mean_value", 6).alias("mean_label"))


def p1_catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings joined with their item's consumption chunks, counted by feed."""
    chunks = table(spark, sf_dir, "item_consumed").where("item is not null").groupBy("item").agg(F.countDistinct("chunk_no").alias("n_chunks"))
    ratings = table(spark, sf_dir, "ratings").select("row_id", "item", "feed")
    joined = fragment_replicate_join(ratings, chunks, "item")
    return joined.groupBy("feed").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chunks").alias("sum_chunks"))


def _session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed the log to a session table batch by batch, as it arrived."""
    log = table(spark, sf_dir, "ratings").select("row_id", "user_id", "time_sec")
    first, last = log.agg(F.min("row_id"), F.max("row_id")).first()  # from the files' statistics
    stored = SessionTable(spark, scratch(spark, "sessions"))
    if first is None:
        return stored.read()
    step = (last - first) // SESSION_BATCHES + 1
    for low in range(first, last + 1, step):
        stored.merge(log.where(F.col("row_id").between(low, low + step - 1)), "user_id", "time_sec")
    return stored.read()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_table(spark, sf_dir).select(F.col("user_id").cast("int").alias("user_id"), "start_sec", "end_sec")


def p2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions at once, with duration and number of rows."""
    out = sessions(table(spark, sf_dir, "ratings"), "user_id", "time_sec")
    return out.select("user_id", "start_sec", "end_sec", "duration_sec", "n_events")


QUERIES = {f.__name__: f for f in (p1_found, p1_item_stats, p1_catalogue_rows, p2_found, p2_sessions)}

_SESSIONS = """
with t0 as (
  select user_id, case when time_sec < 1000000000000 then time_sec
                       when time_sec < 1000000000000000 then time_sec // 1000 else time_sec // 1000000 end as s
  from ratings where user_id is not null and time_sec > 0),
t as (select user_id, s, count(*) as n from t0 group by user_id, s),
g as (select user_id, s, n, case when s - lag(s) over (partition by user_id order by s) <= 1800 then 0 else 1 end as opens from t),
c as (select user_id, s, n, sum(opens) over (partition by user_id order by s rows unbounded preceding) as k from g),
f as (select user_id, k, min(s) as start_sec, max(s) as end_sec, cast(sum(n) as bigint) as n_events from c group by user_id, k)
"""

ORACLE = {
    "p1_found": """
        select item from ratings where item is not null group by item
        having count(*) >= 0.01 * (select count(item) from ratings)""",
    "p1_item_stats": """
        select item, count(*) as n_rows, count(distinct user_id) as n_users, round(avg(label), 6) as mean_label
        from ratings where item is not null group by item""",
    "p1_catalogue_rows": """
        with c as (select item, count(distinct chunk_no) as n_chunks from item_consumed where item is not null group by item)
        select feed, count(*) as n_rows, cast(sum(n_chunks) as bigint) as sum_chunks
        from ratings join c using (item) group by feed""",
    "p2_found": _SESSIONS + "select user_id, start_sec, end_sec from f",
    "p2_sessions": _SESSIONS + "select user_id, start_sec, end_sec, end_sec - start_sec as duration_sec, n_events from f",
}
