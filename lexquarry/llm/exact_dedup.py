"""Exact dedup by a log-structured merge index of text digests. DataFrame functions only.

Memtables: rows come in BATCHES batches. A batch is dealt by digest into memtables of about MEMTABLE rows, each of which keeps one
entry per digest (how many, and which row stays) and is flushed as a run sorted by digest. Compaction: when a level has over FANOUT
runs, they are merged in groups of FANOUT into runs of the next level, all groups at once, so levels grow with the logarithm of the
input. Of each digest the row with the most code points stays, then the smallest identifier.

Filters: every batch leaves a Bloom filter, as rows (word_no, bits) of 64-bit words, made by bit_or. Each batch is probed against the
filters of those before it by an equality join on word_no, which reads two bytes or so an entry. Only digests that an earlier filter
may hold, or that came twice in their own batch, are looked up in the runs. A hit (a row whose digest another row keeps) is then
compared byte by byte with the kept text.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, dropped, kept_rows, normal_text, on_files, removed, shared_path, shuffles_freed, stored, table, with_row_id

BATCHES = 4
MEMTABLE = 1_000_000
FANOUT = 2
#: Entries a filter word, and bits set for each: with 10 bits an entry a blocked filter passes some 2 % of strangers.
PER_WORD = 6
BITS = 4


def bare(text: Column) -> Column:
    """The text without white space: what is compared."""
    return F.regexp_replace(normal_text(text), SPACE + "+", "")


def entries(docs: DataFrame) -> DataFrame:
    """What the index holds of each row of docs, which is on_files()."""
    text = normal_text(F.col("text"))
    return with_row_id(docs).select("rid", "doc_id", F.length(text).cast("long").alias("points"), F.sha2(bare(F.col("text")), 256).alias("digest"))


def _best() -> Column:
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")


def _merged(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*by, "digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def _word(words: Column) -> Column:
    return F.pmod(F.xxhash64("digest"), words)


def _mask() -> Column:
    """BITS bits of a word, by one hash."""
    h = F.xxhash64("digest", F.lit("bits"))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    out = one(0)
    for i in range(1, BITS):
        out = out.bitwiseOR(one(i))
    return out


class Index:
    """A log-structured merge index under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, memtable: int = MEMTABLE, fanout: int = FANOUT):
        self.spark, self.path, self.memtable, self.fanout = spark, path, memtable, fanout
        self.levels: list[list[str]] = []  # of each level, its folders of runs
        self.runs: list[int] = []  # of each level, how many runs
        self.filters: list[tuple[str, int]] = []  # folder and number of words

    def _write(self, runs: DataFrame, level: int, count: int) -> None:
        path = f"{self.path}/level={level}-{uuid.uuid4().hex}"
        with shuffles_freed(self.spark):
            runs.sortWithinPartitions("run", "digest").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
            self.runs.append(0)
        self.levels[level].append(path)
        self.runs[level] += count

    def _read(self, level: int) -> DataFrame:
        return self.spark.read.parquet(*self.levels[level])

    def add(self, rows: DataFrame, count: int) -> DataFrame:
        """Flush a batch of `count` entries, write its filter, and compact what is due; returns the digests (stored) that may have come
        before: those that an earlier batch's filter may hold or that the batch has twice. A memtable folds its copies before they
        are shuffled, so a digest with a third of all rows is one entry."""
        new = max(1, -(-count // self.memtable))
        run = F.pmod(F.xxhash64("digest", F.lit("run")), F.lit(new)).cast("int") + (self.runs[0] if self.runs else 0)
        memtables = rows.groupBy(run.alias("run"), "digest").agg(F.min(_best()).alias("best"), F.count("*").alias("n"))
        self._write(memtables, 0, new)
        flushed = self.spark.read.parquet(self.levels[0][-1])
        twice = flushed.filter("n > 1").select("digest")
        again = stored(self.maybe(flushed.filter("n = 1").select("digest")).unionByName(twice), "lsm-again")
        words = max(1, -(-count // PER_WORD))
        path = f"{self.path}/filter={len(self.filters)}"
        with shuffles_freed(self.spark):
            flushed.groupBy(_word(F.lit(words)).alias("word_no")).agg(F.bit_or(_mask()).alias("bits")).write.parquet(path)
        self.filters.append((path, words))
        level = 0
        while self.runs[level] > self.fanout:
            self.compact(level)
            level += 1
        return again

    def compact(self, level: int) -> None:
        """Merge a level's runs in groups of FANOUT into runs of the next level."""
        count = -(-self.runs[level] // self.fanout)
        after = self.runs[level + 1] if len(self.runs) > level + 1 else 0
        to = (F.floor(F.col("run") / self.fanout) + after).cast("int")
        old = self.levels[level]
        self._write(_merged(self._read(level).withColumn("run", to), "run"), level + 1, count)
        self.levels[level], self.runs[level] = [], 0
        for path in old:
            removed(self.spark, path)

    def entries_of(self, digests: DataFrame) -> DataFrame:
        """digest, best, n over all runs, of these digests (one column, each once)."""
        paths = [p for level in self.levels for p in level]
        return _merged(self.spark.read.parquet(*paths).join(digests, "digest", "left_semi"))

    def maybe(self, rows: DataFrame) -> DataFrame:
        """The rows (with a digest) that some filter may hold: all that the index has, and a few strangers."""
        found = None
        for path, words in self.filters:
            bits = self.spark.read.parquet(path).select("word_no", "bits")
            hit = rows.withColumn("word_no", _word(F.lit(words))).withColumn("mask", _mask()).join(bits, "word_no")
            hit = hit.filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select(*rows.columns)
            found = hit if found is None else found.union(hit)
        return rows.limit(0) if found is None else found.distinct()

    def lookup(self, digests: DataFrame) -> DataFrame:
        """digest, best, n of those digests (one column, each once) that the index has. Runs are read only for what passes a filter."""
        return self.entries_of(self.maybe(digests))

    def drop(self) -> None:
        removed(self.spark, self.path)


def known(index: Index, docs: DataFrame) -> DataFrame:
    """Of a new batch: its rows whose digest an index of earlier batches has: rid, doc_id, digest, keep_id (of the row kept there), n."""
    rows = stored(entries(on_files(docs)), "lsm-batch")
    met = rows.join(index.lookup(rows.select("digest").distinct()), "digest")
    return met.select("rid", "doc_id", "digest", F.col("best.doc_id").alias("keep_id"), "n")


def compared(docs: DataFrame) -> DataFrame:
    """Per row of docs, which is on_files(): rid, doc_id, keep_id, n, digest, hit, same. A hit is a row whose digest another row keeps;
    same tells of a hit whether its whole normalised text is the keeper's, and is null for other rows. Stored."""
    spark = docs.sparkSession
    rows = stored(entries(docs).withColumn("batch", F.pmod(F.xxhash64("rid", F.lit("batch")), F.lit(BATCHES)).cast("int")), "lsm-rows")
    counts = dict(rows.groupBy("batch").agg(F.count("*")).collect())
    index = Index(spark, shared_path(spark, "lsm"))
    again = [index.add(rows.filter(F.col("batch") == b), counts.get(b, 0)) for b in range(BATCHES)]
    suspects = functools.reduce(DataFrame.unionByName, again).distinct()
    # They are stored, so that a hot digest can be split when rows are joined with them.
    often = stored(index.entries_of(suspects).filter("n > 1").select("digest", "n", F.col("best.rid").alias("keeper"), F.col("best.doc_id").alias("keep_id")), "lsm-often")
    found = stored(rows.select("rid", "doc_id", "digest").join(often, "digest", "left"), "lsm-found")
    index.drop()
    # Texts are fetched by row id, a key without skew, for groups only; each hit then meets its keeper's text. Both sides of
    # that join are shuffled for it, so that a hot keeper's hits can be split over tasks.
    groups = found.filter("n > 1").select("rid", "keeper")
    members = stored(with_row_id(docs).select("rid", bare(F.col("text")).alias("bare")).join(groups, "rid"), "lsm-members")
    kept = members.filter("rid = keeper").select("keeper", F.col("bare").alias("kept_bare"))
    checked = stored(members.filter("rid != keeper").join(kept, "keeper").select("rid", (F.col("bare") == F.col("kept_bare")).alias("same")), "lsm-checked")
    alone = F.col("keeper").isNull()
    out = found.join(checked, "rid", "left").select("rid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("n"), "digest", (~alone & (F.col("rid") != F.col("keeper"))).alias("hit"), "same")
    out = stored(out, "lsm-compared")
    dropped(rows, often, found, members, checked, *again)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """Per row: rid, doc_id, keep_id, group_size, kept, text_sha256.

    Null text equals empty text. Of repeated rows that tie in everything, one stays. The byte check compares whole normalised
    texts; should two texts share a digest, a query that reads text_sha256 fails."""
    sure = F.when(~F.col("hit") | F.col("same"), F.col("digest")).otherwise(F.raise_error(F.lit("two texts share a digest")).cast("string"))
    return compared(on_files(docs)).select("rid", "doc_id", "keep_id", F.col("n").alias("group_size"), (~F.col("hit")).alias("kept"), sure.alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of docs: a row goes only if its text was compared with its keeper's and is the same."""
    docs = on_files(docs)
    copy = F.col("hit") & F.coalesce("same", F.lit(False))
    return kept_rows(docs, compared(docs).filter(~copy).select("rid"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("rid")
