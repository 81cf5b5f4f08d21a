"""A stored index of vectors: cells, product-quantised codes, and the vectors themselves for the last step.

A vector lies in the cells of its `homes` nearest centres (neighbours that a border parts meet in one of them); in each, what the
centre leaves of it is coded by the nearest of up to 256 centroids in each of some parts of its width. A search visits a query's
nearest cells, scores their codes by table look-up, and scores the best of them again by their vectors. Cells are packed into blocks;
codes and vectors of a block are columns of one row, so the first step reads no vectors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.folders import read_or_none
from .graph import settled
from .ranking import top_k
from .search import SAMPLE, _cells

#: Vectors of a block, folders of cells, queries that meet a block at once, bytes of a model (it goes to every task).
BLOCK, BUCKETS, MEET, MODEL = 2048, 64, 512, 64_000_000
_MODEL = "centres binary, books binary, width int, parts int, cells int, words int, homes int"
_WRITES = "seg string, kind string"


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))


def _words(x: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Centroids by k-means."""
    centres = x[np.random.default_rng(3).choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


class _Codes:
    """Centres (cells by width) and books (parts by words by width / parts)."""

    def __init__(self, centres: np.ndarray, books: np.ndarray, homes: int = 1):
        self.centres, self.books, self.homes = centres, books, min(homes, len(centres))

    def nearest(self, v: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(v @ self.centres.T), 1, kind="stable")[:, :n]

    def coded(self, v: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = self._parts(v - self.centres[cell])
        return np.stack([((b**2).sum(1) - 2 * rest[:, p] @ b.T).argmin(1) for p, b in enumerate(self.books)], 1).astype(np.uint8)

    def _parts(self, v: np.ndarray) -> np.ndarray:
        parts, _, each = self.books.shape
        out = np.zeros((len(v), parts * each))
        out[:, : v.shape[1]] = v
        return out.reshape(len(v), parts, each)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of each query, what each word of each part adds to an inner product."""
        return np.einsum("qpe,pwe->qpw", self._parts(q), self.books)


class VectorIndex:
    """An index in a folder of the shared file system. Similarity is the cosine; rows with a null vector are left out."""

    def __init__(self, spark: SparkSession, path: str, key: T.DataType | None = None):
        self.spark, self.path, self.key = spark, path, key or T.LongType()
        self._held: _Codes | None = None

    def fit(self, vectors: DataFrame, vector: str = "embedding", cells: int = 256, parts: int = 16, words: int = 256, homes: int = 3, sample: int = SAMPLE) -> None:
        """Draw centres and books from `sample` vectors at most, chosen by hash. Later batches use the same."""
        some = vectors.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
        v = _unit(np.array([r["v"] for r in some.orderBy(F.xxhash64("v")).limit(sample).collect()]))
        if not len(v):
            raise ValueError("there are no vectors to fit an index on")
        width = v.shape[1]
        parts = min(parts, width)
        centres, each = _cells(v, cells), -(-width // parts)
        model = _Codes(centres, np.zeros((parts, 1, each)))
        rest = np.concatenate([model._parts(v - centres[c]) for c in model.nearest(v, homes).T])[: 4 * len(v) // 3 + 1]
        books = np.stack([_words(rest[:, p], words) for p in range(parts)])
        if (size := centres.nbytes + books.nbytes) > MODEL:
            raise ValueError(f"the model has {size} bytes, more than {MODEL}: fit fewer cells")
        row = [(bytearray(centres.tobytes()), bytearray(books.tobytes()), width, parts, len(centres), books.shape[1], homes)]
        self.spark.createDataFrame(row, _MODEL).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")
        self._held = None

    def _codes(self) -> _Codes:
        if self._held is None:
            r = self.spark.read.schema(_MODEL).parquet(f"{self.path}/model").first()
            self._held = _Codes(np.frombuffer(r["centres"]).reshape(r["cells"], r["width"]), np.frombuffer(r["books"]).reshape(r["parts"], r["words"], -1), r["homes"])
        return self._held

    def _blocks(self) -> DataFrame:
        segs = [r["seg"] for r in read_or_none(self.spark, f"{self.path}/writes", _WRITES).filter("kind = 'add'").collect()]
        shape = f"cell int, block long, ids array<{self.key.simpleString()}>, codes binary, v binary, seg string, bucket int"
        return read_or_none(self.spark, f"{self.path}/blocks", shape).filter(F.col("seg").isin(segs))

    def _dead(self) -> DataFrame:
        segs = [r["seg"] for r in read_or_none(self.spark, f"{self.path}/writes", _WRITES).filter("kind = 'dead'").collect()]
        rows = read_or_none(self.spark, f"{self.path}/dead", "seg string, block long, pos int").filter(F.col("seg").isin(segs))
        return rows.groupBy("block").agg(F.collect_set("pos").alias("dead"))

    def _commit(self, seg: str, kind: str) -> None:
        self.spark.createDataFrame([(seg, kind)], _WRITES).coalesce(1).write.mode("append").parquet(f"{self.path}/writes")

    def add(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Index every row: place and code it, sort by cell, and pack runs of a cell into blocks. A large cell lies in many ranges."""
        codes, kind = self._codes(), self.key.simpleString()
        width = codes.centres.shape[1]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch["v"], width)
                binary = lambda x: pa.array([y.tobytes() for y in x], pa.binary())
                for cell in codes.nearest(v, codes.homes).T:
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch["id"], binary(codes.coded(v, cell)), binary(v.astype(np.float32))], names=["cell", "id", "code", "v"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch["cell"].to_numpy()
                runs = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
                for a, z in zip(runs[:-1], runs[1:], strict=True):
                    for at in range(int(a), int(z), BLOCK):
                        part = batch.slice(at, min(BLOCK, int(z) - at))
                        no = int(np.frombuffer(uuid.uuid4().bytes[:8], np.int64)[0])
                        ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part["id"]]))
                        yield pa.RecordBatch.from_arrays([pa.array([cell[at]], pa.int32()), pa.array([no], pa.int64()), ids, pa.array([b"".join(part["code"].to_pylist())], pa.binary()), pa.array([b"".join(part["v"].to_pylist())], pa.binary())], names=["cell", "block", "ids", "codes", "v"])

        flat = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast(self.key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        placed = flat.mapInArrow(place, f"cell int, id {kind}, code binary, v binary").withColumn("mixed", F.xxhash64("id"))
        ranged = settled(placed).repartitionByRange("cell", "mixed").sortWithinPartitions("cell").drop("mixed")
        packed = ranged.mapInArrow(pack, f"cell int, block long, ids array<{kind}>, codes binary, v binary").withColumn("bucket", F.col("cell") % BUCKETS)
        seg = uuid.uuid4().hex
        packed.withColumn("seg", F.lit(seg)).write.mode("append").partitionBy("seg", "bucket").parquet(f"{self.path}/blocks")
        self._commit(seg, "add")

    def delete(self, keys: DataFrame, key: str = "vec_id") -> None:
        """Mark rows as gone: no search scores them."""
        live = self._blocks().select("block", F.posexplode("ids").alias("pos", "id"))
        gone = live.join(keys.select(F.col(key).cast(self.key).alias("id")).distinct(), "id", "left_semi").select("block", "pos")
        seg = uuid.uuid4().hex
        gone.withColumn("seg", F.lit(seg)).write.mode("append").partitionBy("seg").parquet(f"{self.path}/dead")
        self._commit(seg, "dead")

    def count(self) -> int:
        dead = self._blocks().select("block", F.size("ids").alias("n")).join(self._dead(), "block", "left")
        return dead.agg(F.coalesce(F.sum(F.col("n") - F.coalesce(F.size("dead"), F.lit(0))), F.lit(0))).first()[0] // self._codes().homes

    def search(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", probes: int = 32, again: int | None = None, skip_self: bool = True) -> DataFrame:
        """(a, b, cosine, rank): about the k nearest of each query, ties by b. Approximate: what lies in no visited cell, or not among
        the `again` best codes (20 k, if not given), is missed. Cosines are those of the vectors as stored (32-bit)."""
        codes, most, kind = self._codes(), again or 20 * k, self.key.simpleString()
        width = codes.centres.shape[1]
        asked = settled(queries.filter(F.col(vector).isNotNull()).select(F.col(key).cast(self.key).alias("q"), F.col(vector).cast("array<double>").alias("qv")))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = codes.nearest(_matrix(batch["qv"], width), probes).astype(np.int32)
                row = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch["q"].take(pa.array(row)), batch["qv"].take(pa.array(row)), pa.array(near.ravel())], names=["q", "qv", "cell"])

        def dealt(df: DataFrame, by: str, *held: str) -> DataFrame:
            """Rows in lists of about MEET that share `by`."""
            parts = df.groupBy(by).agg(F.ceil(F.count("*") / MEET).alias("lists"))
            return df.join(parts, by).groupBy(by, F.pmod(F.xxhash64("q"), F.col("lists")).alias("list")).agg(F.collect_list(F.struct(*held)).alias("queries")).drop("list")

        key_type = to_arrow_type(self.key)

        def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    asked, ids = batch["queries"][i].values, batch["ids"][i].values
                    q = _matrix(asked.field("qv"), width)
                    code = np.frombuffer(batch["codes"][i].as_py(), np.uint8).reshape(len(ids), -1)
                    base = q @ codes.centres[batch["cell"][i].as_py()]
                    table = codes.tables(q)
                    score = base[:, None] + sum(table[:, p][:, code[:, p]] for p in range(code.shape[1]))
                    if batch["dead"][i].is_valid:
                        score[:, batch["dead"][i].values.to_numpy()] = -np.inf
                    if skip_self:
                        own = asked.field("q").to_pylist()
                        place = {x: j for j, x in enumerate(ids.to_pylist())}
                        for r, x in enumerate(own):
                            if x in place:
                                score[r, place[x]] = -np.inf
                    n = min(most, score.shape[1])
                    at = np.argpartition(-score, n - 1, 1)[:, :n]
                    row = np.repeat(np.arange(len(q)), n)
                    got = score[row, at.ravel()]
                    fine = np.flatnonzero(np.isfinite(got))
                    yield pa.RecordBatch.from_arrays([asked.field("q").take(pa.array(row[fine])).cast(key_type), pa.array(np.full(len(fine), batch["block"][i].as_py(), np.int64)), pa.array(at.ravel()[fine].astype(np.int32)), pa.array(got[fine])], names=["q", "block", "pos", "about"])

        def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    asked, pos = batch["queries"][i].values, batch["queries"][i].values.field("pos").to_numpy()
                    v = np.frombuffer(batch["v"][i].as_py(), np.float32).reshape(-1, width)[pos].astype(np.float64)
                    cos = (_matrix(asked.field("qv"), width) * _unit(v)).sum(1)
                    yield pa.RecordBatch.from_arrays([asked.field("q").cast(key_type), batch["ids"][i].values.take(pa.array(pos)).cast(key_type), pa.array(cos)], names=["a", "b", "cosine"])

        visits = dealt(settled(asked.mapInArrow(visit, f"q {kind}, qv array<double>, cell int")), "cell", "q", "qv")
        blocks = self._blocks()
        met = blocks.select("cell", "block", "ids", "codes").join(visits, "cell").join(self._dead(), "block", "left")
        about = met.mapInArrow(coarse, f"q {kind}, block long, pos int, about double")
        best = settled(top_k(about, ["q"], [F.desc("about"), F.col("block"), F.col("pos")], most * codes.homes).select("q", "block", "pos"))
        held = blocks.select("block", "ids", "v").join(dealt(best.join(asked, "q"), "block", "q", "qv", "pos"), "block")
        near = held.mapInArrow(fine, f"a {kind}, b {kind}, cosine double").dropDuplicates(["a", "b"])
        return top_k(near, ["a"], [F.desc(F.round("cosine", 9)), F.col("b")], k)
