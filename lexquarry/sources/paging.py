"""Pages over a snapshot: files sorted by key, of which the smallest and largest key are kept.

A write adds files and a new version of the list of files; files never change, so a cursor pages over the version it was opened on
whatever is written later. A page reads only the files that can hold its keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folders import exists, read_or_none

_VERSIONS = "version string, no long"


class PagedTable:
    """A table in a folder of the shared file system, ordered by `key`. Rows without a key are refused."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def _versions(self) -> list[str]:
        return [r["version"] for r in read_or_none(self.spark, f"{self.path}/versions", _VERSIONS).orderBy("no").collect()]

    def files(self, version: str) -> DataFrame:
        """(file, least, most, n) of a version."""
        return self.spark.read.parquet(f"{self.path}/files/{version}")

    def append(self, rows: DataFrame) -> str:
        """Add rows; the version counts once its row is written."""
        key, version, before = F.col(self.key), uuid.uuid4().hex, self._versions()
        known = F.when(key.isNull(), F.raise_error(F.lit(f"a row has no {self.key}")).cast(rows.schema[self.key].dataType)).otherwise(key)
        where = f"{self.path}/rows/{version}"
        rows.withColumn(self.key, known).repartitionByRange(self.key).sortWithinPartitions(self.key).write.parquet(where)
        held = self.spark.read.schema(rows.schema).parquet(where)
        listed = held.groupBy(held.metadataColumn("_metadata")["file_path"].alias("file")).agg(F.min(self.key).alias("least"), F.max(self.key).alias("most"), F.count("*").alias("n"))
        every = listed.unionByName(self.files(before[-1])) if before else listed
        every.coalesce(1).write.parquet(f"{self.path}/files/{version}")
        self.spark.createDataFrame([(version, len(before))], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return version

    def open(self, size: int) -> Cursor:
        """A cursor on what is there now."""
        versions = self._versions() if exists(self.spark, f"{self.path}/versions") else []
        return Cursor(self, versions[-1] if versions else None, size)


class Cursor:
    """Pages of `size` rows in order of the key. Rows that share the key of a page's last row are on that page too."""

    def __init__(self, table: PagedTable, version: str | None, size: int, after=None):
        self.table, self.version, self.size, self.after, self.opened = table, version, size, after, []

    def next(self) -> DataFrame | None:
        """The next page, or None after the last. What a cursor holds is its version and the last key: a new one can go on from there."""
        if self.version is None:
            return None
        t, key = self.table, F.col(self.table.key)
        files = t.files(self.version)
        ahead = files if self.after is None else files.filter(F.col("most") > self.after)
        # A page ends at the latest where files that begin after the last key have `size` rows in all.
        whole = ahead if self.after is None else ahead.filter(F.col("least") > self.after)
        upto = F.sum("n").over(Window.orderBy("most", "file").rowsBetween(Window.unboundedPreceding, 0))
        bound = whole.select("most", upto.alias("upto")).filter(F.col("upto") >= self.size).agg(F.min("most")).first()[0]
        wanted = ahead if bound is None else ahead.filter(F.col("least") <= bound)
        self.opened = sorted(r["file"] for r in wanted.select("file").collect())
        if not self.opened:
            return None
        rows = t.spark.read.parquet(*self.opened)
        rows = rows if self.after is None else rows.filter(key > self.after)
        last = rows.select(key.alias("k")).orderBy("k").limit(self.size).agg(F.max("k")).first()[0]
        if last is None:
            return None
        begin, self.after = self.after, last
        page = rows.filter(key <= last)
        return page if begin is None else page.filter(key > begin)
