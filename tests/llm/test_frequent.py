from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from rillstone.llm.frequent import frequent_elements, frequent_values


def test_values_ties_nulls_repeats(spark):
    df = spark.createDataFrame([(3, 1), (3, 1), (3, 2), (1, 1), (1, 9), (2, None), (None, 1), (2, 5)], "value int, _by int").withColumn("n", F.lit(0))
    assert rows(frequent_values(df, "value", 2)) == [(2, 2), (3, 3)] or [tuple(r) for r in frequent_values(df, "value", 2).collect()] == [(3, 3), (1, 2)]
    assert [tuple(r) for r in frequent_values(df, "value", 2, "_by").collect()] == [(1, 2), (3, 2)]
    assert frequent_values(df.limit(0), "value", 2).count() == 0
    assert rows(frequent_values(df, "value", None)) == [(1, 2), (2, 2), (3, 3)]


def test_elements(spark):
    df = spark.createDataFrame([(1, [5, 5, None, 6]), (1, [5]), (2, [6, 7]), (3, None), (4, []), (None, [7])], "run int, x array<int>")
    assert [tuple(r) for r in frequent_elements(df, "x", 2, "run").collect()] == [(6, 2), (5, 1)]
    assert [tuple(r) for r in frequent_elements(df, "x", 1).collect()] == [(5, 3)]
