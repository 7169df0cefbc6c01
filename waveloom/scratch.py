"""Tables between the steps of a query, in the folder that driver and executors share."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []
_COLLECTED = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs in one process, a folder below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new table; the innermost scope() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and a lost executor costs nothing. What the job shuffled is
    not needed any more; Spark's cleaner removes it once the driver has collected its garbage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if time.monotonic() - _COLLECTED[0] > 1:
        spark._jvm.System.gc()
        _COLLECTED[0] = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keep_last(made: list[str]) -> None:
    """The table made last stays when its scope ends; the scope around it takes it over."""
    path = made.pop()
    if len(_SCOPES) > 1:
        _SCOPES[-2].append(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables made inside are deleted at the end, but for those taken off the list: what is lazily read later must stay."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)
