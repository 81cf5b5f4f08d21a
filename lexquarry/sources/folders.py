"""Folders of tables in the place that all executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/lexquarry-{what}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def removed(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


@contextlib.contextmanager
def temporary(spark: SparkSession, what: str) -> Iterator[str]:
    """A folder that goes when the block ends: what is lazy must be settled before."""
    path = new_path(spark, what)
    try:
        yield path
    finally:
        removed(spark, path)


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; without one, no rows."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def tabled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. In long loops this is better than a checkpoint: a checkpoint hands on the plan's estimate of
    its size, which joins multiply, round after round, until planning takes minutes; a table has its real size."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
