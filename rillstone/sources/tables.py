"""Reading interaction logs; saving and loading catalogues and models."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.session import jvm_fs


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text, also with separators of several characters; give a schema at scale (else it is inferred)."""
    r = spark.read.option("sep", sep).option("header", header)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    return spark.createDataFrame(frame)


def check_interactions(df: DataFrame, train: bool = True, needs_time: bool = False) -> DataFrame:
    """The first two columns must be user and item; training data needs a label, chronological splits a time."""
    if list(df.columns[:2]) != ["user", "item"]:
        raise ValueError("the first two columns must be named user and item")
    for name, needed in (("label", train), ("time", needs_time)):
        if needed and name not in df.columns:
            raise ValueError(f"column {name} is missing")
    return df


def check_features(sparse: list[str], dense: list[str], user: list[str], item: list[str]) -> None:
    """Sparse and dense columns together must be the user and item columns."""
    if set(sparse) | set(dense) != set(user) | set(item):
        raise ValueError(f"columns without a side or kind: {sorted((set(sparse) | set(dense)) ^ (set(user) | set(item)))}")


def null_report(df: DataFrame) -> DataFrame:
    """Number of nulls of each column, in one pass; training data should have none."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def save_frames(spark: SparkSession, path: str, frames: dict[str, DataFrame], meta: dict) -> None:
    """Parquet for each component and a JSON file of metadata, written last."""
    for name, df in frames.items():
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"bad name {name!r}")
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    fs, p = jvm_fs(spark, f"{path}/metadata.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(meta | {"frames": sorted(frames)}).encode()))
    out.close()


def load_frames(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """What ``save_frames`` wrote; ``OSError`` if it is not there."""
    fs, p = jvm_fs(spark, f"{path}/metadata.json")
    if not fs.exists(p):
        raise OSError(f"no metadata at {path}")
    meta = json.loads(spark.read.text(f"{path}/metadata.json", wholetext=True).first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in meta["frames"]}, meta
