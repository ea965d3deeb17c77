"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage here.  The folder is `spark.checkpoint.dir` of the session.  Only a session whose
tasks run in the driver's own process (tests, a laptop) may leave it unset; a temporary folder of that process is then used.
Nothing is ever kept on one executor, so a lost executor costs a recomputation of the running stage and no more.

Folders are deleted at the end of the `scope` they were made in, outside of any when the process ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_SCOPES: list[list[Workspace]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one if the session names none and is local; otherwise an error, as executors would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
    return _FALLBACK[app]


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end; results must have been written or collected by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for ws in _SCOPES.pop():
            ws.close()


class Workspace:
    """Writes DataFrames as Parquet below the shared folder and reads them back with a short lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/lodegraph-{label}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        if _SCOPES:
            _SCOPES[-1].append(self)
        atexit.register(self.close)

    def measured(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
        """As `save`, with aggregates of the stored rows."""
        out = self.save(df)
        return out, out.agg(*[c.alias(n) for n, c in figures.items()]).first().asDict()

    def save(self, df: DataFrame) -> DataFrame:
        """Write now, return the stored table with the same schema."""
        path = f"{self.root}/{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a stored table that nothing reads any more."""
        if path := self.paths.pop(id(df), None):
            self._delete(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone; the folder then goes with the cluster's own clean-up
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
