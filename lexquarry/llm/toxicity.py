"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashes of its distinct words, word pairs and pairs that skip one word, each 1 if it occurs. Rates fall
per coordinate, and L1 leaves few weights, which go to every task that scores. Fitting takes a bounded sample of labelled rows;
scoring takes every whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, cpu_bound_python, free_name, hashed_words, mixed, normal_text, paired, scratch, stored, table

#: Labelled rows that a model is fitted on (about), and their features, at most.
SAMPLE, FEATURES = 16_384, 16_000_000
#: Weights that a model may have, at most: they go to every task (16 bytes each).
WEIGHTS = 1 << 20
#: Held-out part: rows whose crc32(doc_id as text) mod 3 is 1 (fixed values).
PARTS, HELD_OUT = 3, 1
#: ASCII letters in lower case; ASCII punctuation and control characters separate words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def features(text: bytes) -> np.ndarray:
    """Distinct hashes of words, neighbours and pairs with one word between, of a whole text."""
    w = hashed_words(text.translate(_FOLD))
    m = mixed(w)
    return np.unique(np.concatenate([m, paired(m[:-1], m[1:]), paired(m[:-2] ^ np.uint64(0x5851F42D4C957F2D), m[2:])]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, text in enumerate(bytes_of(batch["text"])):
            yield pa.RecordBatch.from_arrays([batch["place"].slice(at, 1), batch["y"].slice(at, 1), pa.array([features(text).tobytes()], pa.binary())], names=["place", "y", "features"])


def ftrl(rows: list[np.ndarray], y: np.ndarray, n: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int = 5) -> np.ndarray:
    """Weights of coordinates 0..n-1 (n - 1: the bias, which has no L1) by FTRL-proximal over rows of coordinates whose value is 1."""
    z, g2 = np.zeros(n), np.zeros(n)
    penalty = np.full(n, l1)
    penalty[-1] = 0
    rng = np.random.default_rng(seed)
    shrunk = lambda z, g2, l1: np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(g2)) / alpha + l2), 0.0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            zi, gi = z[at], g2[at]
            w = shrunk(zi, gi, penalty[at])
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[i]
            new = gi + g * g
            z[at] = zi + g - (np.sqrt(new) - np.sqrt(gi)) / alpha * w
            g2[at] = new
    return shrunk(z, g2, penalty)


def _fitted(least: int, alpha: float, beta: float, l1: float, l2: float, epochs: int):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, y, size = [], [], 0
        for batch in batches:  # in hash order, so that the bound cuts the same rows however they came
            for x, label in zip(batch["features"].to_pylist(), batch["y"].to_pylist(), strict=True):
                if size + len(x) // 8 <= FEATURES:
                    size += len(x) // 8
                    held.append(np.frombuffer(x, np.uint64))
                    y.append(float(label))
        if not held:
            return
        seen = np.zeros(1 << 26, np.uint8)  # an upper bound of how many rows have a feature
        for x in held:
            slots = np.unique(x >> np.uint64(38))
            seen[slots] = np.minimum(seen[slots], 254) + 1
        for i, x in enumerate(held):  # most features are of one row: they go before anything is copied
            held[i] = x[seen[x >> np.uint64(38)] >= least]
        del seen
        names, place = np.unique(np.concatenate(held), return_inverse=True)
        sizes = [len(x) for x in held]
        held.clear()
        bias = len(names)
        cuts = np.split(place.astype(np.int32), np.cumsum(sizes)[:-1])
        w = ftrl([np.append(x, bias) for x in cuts], np.array(y), bias + 1, alpha, beta, l1, l2, epochs)
        kept = np.flatnonzero(w[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([None, *names[kept].view(np.int64).tolist()], pa.int64()), pa.array(np.append(w[-1], w[kept]))], names=["feature", "weight"])

    return fit


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % PARTS == HELD_OUT


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, least: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, epochs: int = 12) -> DataFrame:
    """(feature, weight), stored; the bias has a null feature. Fitted on at most about `sample` labelled rows that aren't held out,
    drawn by the hash of doc_id, and FEATURES features of them; features of fewer than `least` rows are left out. FTRL goes through the
    sample row after row, so one task does it: the two bounds are its size. Without any labelled row there are no weights."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    share = sample / max(1, known.count())
    hashed = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    chosen = known.filter(F.pmod(hashed, F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).select(F.col("doc_id").alias("id"), "y")
    texts = docs.select(F.col("doc_id").alias("id"), normal_text(F.col("text")).alias("text")).join(chosen, "id").select(F.xxhash64("id", "text").alias("place"), "y", "text")
    rows = stored(texts.mapInArrow(_featured, "place long, y int, features binary"), "features")
    return stored(rows.repartition(1).sortWithinPartitions("place", "y").mapInArrow(_fitted(least, alpha, beta, l1, l2, epochs), "feature long, weight double"), "weights")


def scored(docs: DataFrame, weights: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `score` (of another name, if docs has one): the probability of label 1. Null texts count as empty, which
    have the bias alone; without weights every score is 0."""
    held = weights.limit(WEIGHTS + 1).toArrow()
    if held.num_rows > WEIGHTS:
        raise ValueError(f"the model has over {WEIGHTS} weights; fit it with a larger l1")
    name, got, w = free_name(docs, "score"), held["feature"], held["weight"].to_numpy()
    none = np.array(got.is_null())
    bias = float(w[none].sum()) if none.any() else -np.inf
    keys = got.filter(got.is_valid()).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = docs.sparkSession.sparkContext.broadcast((keys[order], w[~none][order], bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, w, bias = model.value
        maybe = np.zeros(1 << 18, bool)  # most features have no weight: settled by one look
        maybe[keys >> np.uint64(46)] = True
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            for i, t in enumerate(bytes_of(batch[text])):
                if t and len(keys):
                    x = features(t)
                    x = x[maybe[x >> np.uint64(46)]]
                    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                    out[i] += w[at][keys[at] == x].sum()
            with np.errstate(over="ignore"):
                chance = 1 / (1 + np.exp(-out))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], names=[*batch.schema.names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cpu_bound_python()
    docs = table(spark, sf_dir, "documents").select("doc_id", normal_text(F.col("text")).alias("text"))
    with scratch(spark) as kept:
        weights = fitted(docs, table(spark, sf_dir, "labels"))
        kept.append(weights.stored_at)
    return scored(docs, weights).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
