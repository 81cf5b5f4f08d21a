"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    ops: tuple[str, ...]
    run: Query
    sql: str | None
    module: str


REGISTRY: dict[str, Entry] = {}


class Tables:
    """Tables of one folder by name: t.documents."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, ops: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register a plan over Tables under a name, with the operator ids it shows."""

    def add(plan: Callable[[Tables], DataFrame]) -> Query:
        if name in REGISTRY:
            raise ValueError(f"two queries named {name}")
        run: Query = lambda spark, folder: plan(Tables(spark, folder))
        REGISTRY[name] = Entry(name, tuple(ops.split()), run, sql, plan.__module__.rpartition(".")[2])
        return run

    return add
