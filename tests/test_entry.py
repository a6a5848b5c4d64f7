from __future__ import annotations

import __spark_entry__ as entry
from rillstone.plans import catalogue


def test_queries_and_sql_fit_together():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and set(catalogue.QUERIES) <= set(queries)
    assert len(queries) > 100 and all(callable(q) for q in queries.values())
    assert sum(len(p.QUERIES) for p in catalogue._PARTS) == len(catalogue.QUERIES)  # no name twice


def test_shared_folder(spark, monkeypatch):
    """The session's folder where it names one, else one of our own."""
    from rillstone import session

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.shared_dir(spark) == named.rstrip("/")

    class Unset:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default=None: default)

    was = spark.sparkContext.getCheckpointDir()
    own = session.shared_dir(Unset)
    assert own == session.shared_dir(Unset) and session.scratch(Unset, "x").startswith(own)
    if was:
        spark.sparkContext.setCheckpointDir(was)


def test_written_tables_are_released(spark):
    from rillstone.session import jvm_fs, materialize, release, scratch

    df = materialize(spark.range(5), "five")
    fs, root = jvm_fs(spark, scratch(spark, "x").rpartition("/")[0])
    assert df.count() == 5 and fs.exists(root)
    release(spark)
    assert not fs.exists(root)
