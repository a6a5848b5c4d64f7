"""Session, shared storage and checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has a proven bound of at most this many rows.
BROADCAST_ROWS = 200_000

_own_dirs: dict[str, str] = {}


def build_session(cpus: int | str = "*", app: str = "rillstone", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (a cluster brings its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode (tests, a laptop) and where none is named a folder of our
    own is made and removed at exit; a cluster must set it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="rillstone-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in the application's own part of it."""
    return f"{shared_dir(spark)}/rillstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; frames that read it are then void."""
    fs, p = jvm_fs(spark, f"{shared_dir(spark)}/rillstone/{spark.sparkContext.applicationId}")
    fs.delete(p, True)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage by a written table in the shared folder.

    Parquet rather than ``checkpoint()``: columnar and compressed, and later
    readers prune columns. Survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more; it does so only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    """Number of reduce tasks to plan for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when ``rows``, a proven bound, is small enough.

    Beyond the limit the frame is returned as it is, so the join shuffles.
    """
    return F.broadcast(df) if rows <= limit else df


def fresh(names: list[str], *wanted: str) -> list[str]:
    """Column names that none of ``names`` has, whatever the letter case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = f"{w}_"
        taken.add(w.lower())
        out.append(w)
    return out


def jvm_fs(spark: SparkSession, path: str):
    """Hadoop file system and path object of a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
