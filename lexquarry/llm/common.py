"""What the training-data operators share: word pattern, shared folder, hashing, permutations."""

from __future__ import annotations

import contextlib
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (fixed values).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master, where one machine does all, gets a folder of its own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lexquarry-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


_MADE: list[list[str]] = []


def shared_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/lexquarry-{what}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Intermediate tables made inside go when it ends, but those whose paths are put in the list."""
    made: list[str] = []
    kept: list[str] = []
    _MADE.append(made)
    try:
        yield kept
    finally:
        _MADE.remove(made)
        for path in set(made) - set(kept):
            removed(spark, path)


#: Frees a job's shuffle files when it ends: what it wrote is in the shared folder, so nothing reads them again.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again. Survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables of which all that was wanted is stored elsewhere."""
    for t in tables:
        removed(t.sparkSession, t.stored_at)


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


ROW_ID = "struct<file:bigint,row:bigint>"


def _row_id(df: DataFrame) -> Column:
    meta = df.metadataColumn("_metadata")
    return F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row"))


def on_files(docs: DataFrame) -> DataFrame:
    """docs itself if its rows are rows of Parquet files, each once; else docs stored."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation":
        try:
            docs.select(_row_id(docs))
            return docs
        except AnalysisException:  # files of another format
            pass
    return stored(docs, "rows")


def with_row_id(docs: DataFrame, name: str = "rid") -> DataFrame:
    """docs, which is on_files(), with a column that tells rows apart, repeated ones too: the file and the place in it. It is the
    same in every pass, however Spark splits the files, so rows can be fetched again by it."""
    return docs.withColumn(name, _row_id(docs))


def free_name(df: DataFrame, name: str = "__row") -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def kept_rows(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of docs whose row id is in rids (one column), with the columns of docs."""
    row = free_name(docs)
    return with_row_id(docs, row).join(rids.toDF(row), row).select(*docs.columns)


def normal_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def permuted(x: Column, n: Column, *key: Column, rounds: int = 16) -> Column:
    """A keyed pseudorandom permutation of 0..n-1, evaluated at x by JVM expressions (swap-or-not rounds).

    Each round pairs x with (k_r - x) mod n and swaps on a hashed bit of the pair, which is a bijection
    for any n, so no table of the permutation is ever built."""
    n = F.greatest(n, F.lit(1).cast("long"))

    def one(acc: Column, r: Column) -> Column:
        other = (F.pmod(F.xxhash64(F.lit("pair"), *key, r), n) - acc + n) % n
        bit = F.xxhash64(F.lit("swap"), *key, r, F.greatest(acc, other)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), one)


_CACHES: dict[str, list[dict]] = {}


def cached(kind: str, cache: dict) -> None:
    """cache is one of a Python worker's, for operators of this kind."""
    _CACHES.setdefault(kind, []).append(cache)


def keep_only(kind: str = "") -> None:
    """A Python worker serves one operator after another and lives on between them: what it keeps for other kinds goes, as does the
    memory that Arrow holds for later."""
    for other, caches in _CACHES.items():
        if other != kind:
            for cache in caches:
                cache.clear()
    pa.default_memory_pool().release_unused()


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 600_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def word_hashes() -> WordHashes:
    """One per Python worker."""
    hashes = WordHashes()
    cached("words", hashes)
    return hashes


def hashed_words(text: bytes) -> np.ndarray:
    """bytes.split() splits at exactly the six characters of SPACE."""
    words = text.split()
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column, null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def portions(texts: list[bytes], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Cut a batch into ranges of about `most` bytes, so that memory does not follow the batch."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + mixed(b) + np.uint64(1))


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling: a run is the pair of two overlapping shorter runs."""
    if len(w) < n:
        return w[:0]
    k, h = 1, mixed(w)
    while 2 * k <= n:
        h = paired(h[:-k], h[k:]) if k < len(h) else h[:0]
        k *= 2
    if k < n:
        h = paired(h[: len(h) - (n - k)], h[n - k :])
    return h


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cpu_bound_python() -> None:
    for k in ("OMP_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
