"""Quality rules with suffix-array repetition.

Each text's words get a suffix array, built by doubling for a portion of texts at once; its longest-common-prefix intervals give,
for every position, the longest repeat of the same text that begins there. The union of repeats of eight words and more is the
covered part. Rules: at least 20 words, covered words at most 30 %, no single repeat of more than LONGEST words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_words, keep_only, kept_rows, normal_text, on_files, portions, table, with_row_id

LEAST_WORDS = 20
COVERED = 30  # per cent
REPEAT = 8
LONGEST = 200
MARKS = b"#*$%&|<>"  # fixed values
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long"


def suffix_ranks(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Levels of a suffix array by doubling: level l has each suffix's rank by its first 2**l words, cut at its text's end.

    ends: the end of the text each position is in. Positions of different texts never tie, as texts begin as classes of their own.
    A rank is the number of suffixes before its class, so the last level, where all differ, is the inverse suffix array."""
    n = len(words)
    _, word = np.unique(words, return_inverse=True)
    key = ends * np.int64(n + 1) + word
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    new = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    rank[order] = np.repeat(new, np.diff(np.r_[new, n]))
    levels, k, active = [rank], 1, None
    while True:
        active = order if active is None else active
        r = rank[active]
        tied = np.r_[r[1:] == r[:-1], False] | np.r_[False, r[1:] == r[:-1]]
        active = active[tied]
        if not len(active):
            return levels
        r, at = r[tied], active + k
        then = np.where(at < ends[active], rank[np.minimum(at, n - 1)] + 1, 0)
        order2 = np.lexsort((then, r))
        active, r, then = active[order2], r[order2], then[order2]
        group = np.r_[True, r[1:] != r[:-1]]
        sub = group | np.r_[True, then[1:] != then[:-1]]
        where = np.arange(len(active))
        first_of_group = np.maximum.accumulate(np.where(group, where, 0))
        first_of_sub = np.maximum.accumulate(np.where(sub, where, 0))
        rank = rank.copy()
        rank[active] = r + first_of_sub - first_of_group
        levels.append(rank)
        k *= 2


def longest_repeats(words: np.ndarray, ends: np.ndarray, least: int = REPEAT) -> np.ndarray:
    """For each position, the length of the longest run of words from there that its text has elsewhere too; 0 if under least."""
    n, out = len(words), np.zeros(len(words), np.int64)
    if not n:
        return out
    levels = suffix_ranks(words, ends)
    deep = least.bit_length() - 1
    if len(levels) <= deep:
        return out
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    close = levels[deep][order]
    at = np.flatnonzero(close[1:] == close[:-1])  # neighbours that share 2**deep words at least
    i, j = order[at], order[at + 1]
    common = np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = i + common, j + common
        same = (a < ends[i]) & (b < ends[j])
        same &= levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)]
        common += same * (1 << level)
    common[common < least] = 0
    np.maximum.at(out, i, common)
    np.maximum.at(out, j, common)
    return out


def _repetition(texts: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """Words, covered words and longest repeat of each text."""
    words = [hashed_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    last = np.cumsum(sizes)
    every = np.concatenate(words) if words else np.empty(0, np.uint64)
    long = longest_repeats(every, np.repeat(last, sizes))
    edge = np.zeros(len(every) + 1, np.int64)
    at = np.flatnonzero(long)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + long[at], -1)
    covered = np.r_[0, np.cumsum(np.cumsum(edge)[:-1] > 0)]
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(texts)), sizes), long)
    return sizes.tolist(), (covered[last] - covered[last - sizes]).tolist(), longest.tolist()


def measures(texts: list[bytes]) -> dict[str, list[int]]:
    n_words, covered, longest = _repetition(texts)
    points = [len(t.decode("utf-8", "replace")) for t in texts]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": n_words,
        "word_chars": [p - sum(map(t.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))) for p, t in zip(points, texts, strict=True)],
        "n_symbols": [sum(t.count(MARKS[i : i + 1]) for i in range(len(MARKS))) for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": covered,
        "longest_repeat": longest,
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_only("words")
    for batch in batches:
        for a, b in portions(texts := [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]):
            kept = batch.slice(a, b - a).drop_columns(["text"])
            got = measures(texts[a:b])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v, pa.int64()) for v in got.values())], names=[*kept.schema.names, *got])


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns of docs with each row's measures and verdict. Map only. Null text has no words; every row is judged alone."""
    rows = docs.select(*keep, normal_text(F.col("text")).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    m = rows.mapInArrow(_measured, f"{kinds}, {SCHEMA}")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > COVERED * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("longest_repeat") <= LONGEST))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with the columns of docs: the verdict comes first, by row id, and then meets the rows again."""
    docs = on_files(docs)
    return kept_rows(docs, measured(with_row_id(docs).select("rid", "text"), "rid").filter("kept").select("rid"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents"), "doc_id").drop("longest_repeat")
