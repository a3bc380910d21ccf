"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder that becomes the checkpoint folder; on a cluster that is an error."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="silkloom-")
        context.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/silkloom/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Paths that stored() has written and nothing has deleted yet, by application.
_LEFT: dict[str, set[str]] = {}


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage is cut and survives lost executors. The table stays until clear(); see temporary()."""
    path = scratch(df.sparkSession, name)
    _LEFT.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    return written(df, path)


def clear(spark: SparkSession) -> int:
    """Deletes all tables of this application that are still there, results of operators included, and tells how many. For between jobs: nothing that was returned before can be read after it."""
    left = _LEFT.pop(spark.sparkContext.applicationId, set())
    for path in left:
        removed(spark, path)
    return len(left)


class Tables:
    """Tables of one job in the shared folder: called like stored(), and dropped one by one or at the job's end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = scratch(self.spark, name)
        out = written(df, path, **options)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing still to be run reads."""
        for t in tables:
            path, _ = self.paths.pop(id(t), (None, None))
            if path:
                removed(self.spark, path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Tables]:
    """Tables that are deleted when the block ends; what the block returns must be stored() before, as it is read later."""
    tables = Tables(spark)
    try:
        yield tables
    finally:
        tables.drop(*[t for _, t in tables.paths.values()])
