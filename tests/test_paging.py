"""Cursors over snapshots."""

import pytest
from pyspark.sql import functions as F

from lexquarry.sources.paging import Cursor, PagedTable


def pages(cursor):
    out = []
    while (page := cursor.next()) is not None:
        out.append((page.collect(), len(cursor.opened)))
    return out


def test_pages_are_the_table(spark, tmp_path):
    table = PagedTable(spark, str(tmp_path), "id")
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        table.append(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    cursor = table.open(90)
    first = cursor.next().collect()
    table.append(spark.range(500, 1500).select("id", F.lit("later").alias("t")))  # does not reach the open cursor
    got = [first, *(x for x, _ in pages(cursor))]
    assert [len(p) for p in got] == [90] * 11 + [10]
    flat = [r["id"] for p in got for r in sorted(p)]
    assert flat == list(range(1000)) and all(r["t"] != "later" for p in got for r in p)
    n_files = table.files(cursor.version).count()
    assert n_files >= 15
    again = pages(Cursor(table, cursor.version, 90, after=499))  # a new cursor goes on from a key
    assert sorted(r["id"] for p, _ in again for r in p) == list(range(500, 1000))
    assert max(n for _, n in again) <= n_files / 3
    newest = pages(table.open(400))
    keys = [r["id"] for p, _ in newest for r in p]
    assert len(keys) == 2000 and all(max(r["id"] for r in a) < min(r["id"] for r in b) for (a, _), (b, _) in zip(newest, newest[1:], strict=False))


def test_ties_strings_and_nothing(spark, tmp_path):
    assert PagedTable(spark, str(tmp_path / "none"), "k").open(3).next() is None
    table = PagedTable(spark, str(tmp_path / "t"), "k")
    table.append(spark.createDataFrame([], "k string, v int"))
    assert table.open(3).next() is None
    table.append(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 5)], "k string, v int"))
    assert [sorted(r["v"] for r in p) for p, _ in pages(table.open(2))] == [[1, 2, 3, 4], [5]]
    with pytest.raises(Exception, match="no k"):
        table.append(spark.createDataFrame([(None, 1)], "k string, v int"))
    assert sum(len(p) for p, _ in pages(table.open(10))) == 5
