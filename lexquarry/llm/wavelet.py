"""Token ids in wavelet matrices: succinct bit planes with rank and select, one compressed file a shard.

File format (all little-endian): magic "WVM2"; then unsigned 64-bit tokens, documents, planes; then frames, each led by its unsigned
64-bit length. A frame is zstandard data. First the document ids (signed 64-bit), which of them are there (a bit each) and the
document starts (n_docs + 1 unsigned 64-bit). Then of each plane, highest bit of the ids first: the rank directory (unsigned 32-bit,
ones before every STEP-th position, and all), the ends of the plane's blocks (unsigned 32-bit), and its blocks, each compressed by
itself: BLOCK positions, eight a byte, first position in the lowest bit. Plane l + 1 has the positions of plane l with zeros first,
stably. One token, count or occurrence so costs a few blocks of each plane, not the file.
A file is one row of a Parquet table, so that Spark's writer commits it whole to any store.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_only, normal_text, shared_path, table, tokenizer_path
from .tokens import encoder

END = 2
#: Ids in a shard at least, unless input ends.
TOKENS = 1 << 21
#: Positions between entries of a rank directory, and in a block.
STEP = 512
BLOCK = 1 << 16


def encoded(ids: np.ndarray, starts: np.ndarray, keys: list[int | None]) -> bytes:
    """The file of a shard: ids, where its documents start (and the end), and the documents' ids."""
    z = zstandard.ZstdCompressor(level=1)
    frame = lambda *parts: z.compress(b"".join(x.tobytes() for x in parts))
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    known = np.array([k is not None for k in keys], bool)
    frames = [frame(np.array([k or 0 for k in keys], "<i8")), frame(np.packbits(known, bitorder="little")), frame(starts.astype("<u8"))]
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for b in range(bits - 1, -1, -1):
        one = (x >> b & 1).astype(bool)
        plane = np.packbits(one, bitorder="little")
        ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (STEP // 8)))).reshape(-1, STEP // 8).sum(1, dtype=np.int64)
        blocks = [z.compress(plane[i : i + BLOCK // 8].tobytes()) for i in range(0, len(plane), BLOCK // 8)]
        frames += [frame(np.concatenate([[0], np.cumsum(ones)]).astype("<u4")), frame(np.cumsum([0, *map(len, blocks)]).astype("<u4")), b"".join(blocks)]
        x = np.concatenate([x.compress(~one), x.compress(one)])  # indexing by a mask of random bits, or by their numbers, is slower
    return b"WVM2" + struct.pack("<QQQ", len(ids), len(keys), bits) + b"".join(struct.pack("<Q", len(f)) + f for f in frames)


class WaveletMatrix:
    """A shard's file, opened: only what is asked for is decompressed."""

    def __init__(self, data: bytes):
        if data[:4] != b"WVM2":
            raise ValueError("not a wavelet file")
        self.n, docs, self.bits = struct.unpack_from("<QQQ", data, 4)
        self.data, at, self.frames = memoryview(data), 28, []
        for _ in range(3 + 3 * self.bits):
            (k,) = struct.unpack_from("<Q", data, at)
            self.frames.append((at + 8, at + 8 + k))
            at += 8 + k
        self._z = zstandard.ZstdDecompressor()
        self._tables: dict[int, np.ndarray] = {}
        self.block = functools.lru_cache(256)(self._block)
        keys, known = self._open(0, "<i8"), np.unpackbits(self._open(1, np.uint8), count=docs, bitorder="little")
        self.keys: list[int | None] = [k if there else None for k, there in zip(keys.tolist(), known.tolist(), strict=True)]
        self.starts = self._open(2, "<u8")

    def _open(self, frame: int, kind: str | type) -> np.ndarray:
        a, b = self.frames[frame]
        return np.frombuffer(self._z.decompress(self.data[a:b]), kind)

    def _table(self, frame: int) -> np.ndarray:
        if frame not in self._tables:
            self._tables[frame] = self._open(frame, "<u4")
        return self._tables[frame]

    def _block(self, plane: int, no: int) -> np.ndarray:
        ends, begin = self._table(4 + 3 * plane), self.frames[5 + 3 * plane][0]
        return np.frombuffer(self._z.decompress(self.data[begin + int(ends[no]) : begin + int(ends[no + 1])]), np.uint8)

    def _bits(self, plane: int) -> np.ndarray:
        whole = [self._block(plane, i) for i in range(len(self._table(4 + 3 * plane)) - 1)]
        return np.unpackbits(np.concatenate(whole) if whole else np.empty(0, np.uint8), count=self.n, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: zeros of a plane come from the front of the one below, ones from its back."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one, y = self._bits(level), np.empty_like(x)
            zeros = self._zeros(level)
            y[np.flatnonzero(~one)] = x[:zeros]
            y[np.flatnonzero(one)] = x[zeros:] | x.dtype.type(1 << (self.bits - 1 - level))
            x = y
        return x

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i positions: the directory, then counting in one block."""
        step = i // STEP
        ones, rest = int(self._table(3 + 3 * plane)[step]), i - step * STEP
        if rest:
            at = step * STEP % BLOCK // 8
            part = self.block(plane, step * STEP // BLOCK)[at : at + -(-rest // 8)]
            ones += int(np.count_nonzero(np.unpackbits(part, bitorder="little")[:rest]))
        return ones

    def _zeros(self, plane: int) -> int:
        return self.n - int(self._table(3 + 3 * plane)[-1])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.bits):
            ones = self._rank1(p, i)
            bit = self._rank1(p, i + 1) - ones
            i = self._zeros(p) + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _narrow(self, token: int, i: int, j: int) -> tuple[int, int]:
        for p in range(self.bits):
            a, b = self._rank1(p, i), self._rank1(p, j)
            i, j = (self._zeros(p) + a, self._zeros(p) + b) if token >> (self.bits - 1 - p) & 1 else (i - a, j - b)
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """How often token occurs in positions i to j - 1."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._narrow(token, i, self.n if j is None else j)
        return b - a

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit in a plane: a search of the directory, then of one step."""
        ones = self._table(3 + 3 * plane).astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * STEP, self.n) - ones
        step = int(np.searchsorted(before, k, "right")) - 1
        at = step * STEP % BLOCK // 8
        part = np.unpackbits(self.block(plane, step * STEP // BLOCK)[at : at + STEP // 8], bitorder="little")[: self.n - step * STEP]
        return step * STEP + int(np.flatnonzero(part == bit)[k - int(before[step])])

    def find(self, token: int, k: int) -> int:
        """Position of token's k-th occurrence, from 0."""
        if k < 0 or k >= self.count(token):
            raise IndexError(k)
        i = self._narrow(token, 0, self.n)[0] + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select(p, bit, i - self._zeros(p) * bit)
        return i


def _writer(path: str, end: int, tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("numbers")
        code = encoder(path)
        ids, keys, lengths, held, seq = [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            x = np.concatenate(ids)
            data = encoded(x, np.cumsum([0, *lengths], dtype=np.uint64), keys)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "tokens", "data"])

        for batch in batches:
            part = batch["part"][0].as_py() if batch.num_rows else None
            doc_ids, at = batch["doc_id"].to_pylist(), 0
            for texts in code.encode_all(batch["text"]):
                ends = texts.offsets.to_numpy().astype(np.int64)
                x = np.insert(texts.values.to_numpy(), ends[1:], np.uint32(end))
                ends += np.arange(len(ends))
                a = 0
                while a < len(texts):  # a shard ends with the document that fills it
                    b = min(len(texts), max(a + 1, int(np.searchsorted(ends, ends[a] + tokens - held))))
                    ids.append(x[ends[a] : ends[b]])
                    lengths += np.diff(ends[a : b + 1]).tolist()
                    keys += doc_ids[at + a : at + b]
                    held += int(ends[b] - ends[a])
                    a = b
                    if held >= tokens:
                        yield shard()
                        ids, keys, lengths, held, seq = [], [], [], 0, seq + 1
                at += len(texts)
        if keys:
            yield shard()

    return write


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, tokens: int = TOKENS) -> None:
    """Encode and write under path, in ascending doc_id order (null first; repeated ids by a hash of the text): ranges of doc_id are
    sorted each in one task and cut into shards. doc_id is cast to long. Null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_text(F.col("text")).alias("text"))
    tie = F.xxhash64("text")
    sorted_rows = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    files = sorted_rows.withColumn("part", F.spark_partition_id()).mapInArrow(_writer(tokenizer or tokenizer_path(), end, tokens), FILES)
    files.write.parquet(path)


FILES = "part int, seq long, tokens long, data binary"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, data in zip(batch["begin"].to_pylist(), batch["data"], strict=True):
            w = WaveletMatrix(data.as_py())
            ids, starts = w.decode().astype("<u4"), w.starts.astype(np.int64)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(w.keys, pa.int64()), pa.array(starts[:-1] + begin), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Starts are summed within parts, then over parts: a number for
    each shard, then for each part, meets in one task."""
    files = spark.read.schema(FILES).parquet(path)
    sums = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    ahead = sums.select("part", (F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    begin = files.select("part", "seq", (F.sum("tokens").over(inside) - F.col("tokens")).alias("within")).join(ahead, "part").select("part", "seq", (F.col("within") + F.col("ahead")).alias("begin"))
    return files.join(begin, ["part", "seq"]).select("begin", "data").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)
