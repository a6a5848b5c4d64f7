"""Versions of a stored table: one manifest a version, published by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from rillstone.session import jvm_fs

#: Manifests that stay for readers of an earlier version.
KEEP = 2


class Manifest:
    """States of a table as JSON below ``path/versions``; the last one holds.

    A state has ``version`` and may have ``batch`` (the last micro-batch it
    holds) and ``dropped`` (folders no longer needed), which are deleted when
    the version after it is published, so that readers of the last version
    before keep their files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self) -> list[str]:
        fs, root = jvm_fs(self.spark, f"{self.path}/versions")
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(root)) if n.endswith(".json")) if fs.exists(root) else []

    def read(self) -> dict | None:
        names = self._names()
        return json.loads(self.spark.read.text(f"{self.path}/versions/{names[-1]}", wholetext=True).first()[0]) if names else None

    def holds(self, batch: int | None) -> bool:
        """Whether a micro-batch (they come in order) was taken in before."""
        state = self.read() or {}
        return batch is not None and state.get("batch") is not None and batch <= state["batch"]

    def commit(self, state: dict) -> None:
        """Publish a version; fails if another writer published it first."""
        jvm = self.spark.sparkContext._jvm
        draft = f"{self.path}/draft-{uuid.uuid4().hex}"
        before = self.read() or {}
        fs, p = jvm_fs(self.spark, draft)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions"))
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{state['version']:012d}.json")
        if fs.exists(target) or not fs.rename(p, target):
            fs.delete(p, False)
            raise RuntimeError(f"version {state['version']} exists: another batch was merged meanwhile")
        for folder in before.get("dropped", []):
            self.delete(folder)
        for name in self._names()[:-KEEP]:
            self.delete(f"versions/{name}")

    def delete(self, relative: str) -> None:
        fs, p = jvm_fs(self.spark, f"{self.path}/{relative}")
        fs.delete(p, True)
