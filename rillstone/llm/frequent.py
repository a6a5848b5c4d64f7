"""Most frequent values: exact, spillable aggregation.

Every task combines its rows on the map side, hash partitions are merged and
spill to disk when they outgrow memory, each partition keeps its own k best
and one ordered limit merges those. No task holds more than its share of the
distinct values; a value with a third of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_values(df: DataFrame, value: str, k: int | None, distinct_by: str | None = None) -> DataFrame:
    """The ``k`` most frequent values of a column: ``value, n``, ties to the smaller value.

    With ``distinct_by`` a value counts once for each non-null value of that
    column, however often the pair is repeated. Null values don't count; an
    empty table gives no rows; ``k=None`` gives all values.
    """
    rows = df.select(F.col(value).alias("value"), *([F.col(distinct_by).alias("_by")] if distinct_by else [])).dropna()
    if distinct_by:
        rows = rows.distinct().select("value")
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts if k is None else counts.orderBy(F.desc("n"), "value").limit(k)


def frequent_elements(df: DataFrame, values: str, k: int | None, distinct_by: str | None = None) -> DataFrame:
    """``frequent_values`` over the elements of an array column.

    Repeats within one array are dropped before it is unfolded when counting
    distinct rows; null and empty arrays and null elements don't count.
    """
    array = F.array_distinct(values) if distinct_by else F.col(values)
    rows = df.select(F.explode(array).alias("value"), *([F.col(distinct_by).alias("_by")] if distinct_by else []))
    return frequent_values(rows, "value", k, "_by" if distinct_by else None)
