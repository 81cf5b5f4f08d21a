"""Packing by power-of-two decomposition: no sequence holds two documents, and none is padded.

A document of n ids is cut into n // 1024 pieces of 1024 and one piece for each binary digit of the rest. Every piece is a sequence
of its own; sequences of one length form a bucket, from which batches without padding are drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, normal_text, table, tokenizer_path
from .tokens import encoder

MOST = 1024
END = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids array<int>"


def lengths_of(n: int, most: int = MOST) -> list[int]:
    """most, most, ..., then the powers of two in n % most, largest first."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def _packer(path: str, most: int, end: int, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("chunks")
        code, last = encoder(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids")}
            held = 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = code.encode(text) + last
                n, start = len(data) // 4, 0
                lengths = lengths_of(n, most)
                for k in lengths:
                    piece = data[4 * start : 4 * (start + k)]
                    out["start"].append(start)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["ids"].append(np.frombuffer(piece, "<i4") if with_ids else None)
                    start += k
                out["doc_id"] += [doc_id] * len(lengths)
                out["length"] += lengths
                out["doc_tokens"] += [n] * len(lengths)
                out["bucket"] += [k.bit_length() - 1 for k in lengths]
                held += n
                if held > 1_000_000:
                    yield _batch(out)
                    out, held = {k: [] for k in out}, 0
            yield _batch(out)

    return pack


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "ids": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))


def pack(docs: DataFrame, tokenizer: str | None = None, most: int = MOST, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (length is 2 ** bucket), ids, sequence_id, offset.

    Map only: no shuffle, whatever the skew. doc_id is cast to long. Null text is empty and gives the one piece [end]; repeated rows give pieces each.
    sequence_id numbers pieces by partition and row, so it is unique and the same in reruns over the same files."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_text(F.col("text")).alias("text"))
    pieces = rows.mapInArrow(_packer(tokenizer or tokenizer_path(), most, end, with_ids), SCHEMA)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """A folder of sequences for each length."""
    pieces.select("bucket", "sequence_id", "doc_id", "start", "ids").write.partitionBy("bucket").parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False).drop("ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
