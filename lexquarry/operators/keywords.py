"""Many keywords in one pass over the texts, by Aho-Corasick automata."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled

#: Characters of keywords that one automaton holds, at most: bounds what goes to every task (some 50 bytes each there).
LETTERS = 4_000_000


@functools.lru_cache(maxsize=2)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """One per worker and list."""
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


def _searched(shared, kept: Sequence[str], blank: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        automaton = _automaton(words) if words else None
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch["__text"].to_pylist()):
                if text is not None:
                    hits = {w for _, w in automaton.iter(text)} if automaton is not None else set()
                    hits |= {""} if blank else set()
                    rows += [i] * len(hits)
                    found += hits
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in kept), pa.array(found, pa.string())], names=[*kept, "__word"])

    return search


def occurring(docs: DataFrame, text: Column, keywords: DataFrame, keyword: str, letters: int = LETTERS) -> DataFrame:
    """The rows of docs with each distinct keyword that their text contains, in a column `keyword`; as F.contains() tells, so an empty
    keyword is in every text, and nulls are in none.

    Each text is read once and all keywords are found in that one pass, whatever their number. Their letters are counted first: one
    automaton holds at most `letters` of them, and more keywords are more automata, each a pass over the texts, in turn."""
    spark = docs.sparkSession
    if keyword in docs.columns:
        raise ValueError(f"the texts have a column {keyword} already")
    words = keywords.select(F.col(keyword).alias("w")).filter("w is not null").distinct()
    total, blank = words.agg(F.coalesce(F.sum(F.length("w")), F.lit(0)), F.coalesce(F.max(F.col("w") == ""), F.lit(False))).first()
    parts = max(1, -(-int(total) // letters))
    words = words.filter("w != ''")
    split = settled(words.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(parts)))) if parts > 1 else words.withColumn("part", F.lit(0))
    rows, out = docs.withColumn("__text", text), None
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __word string"
    for part in range(parts):
        held = tuple(sorted(r["w"] for r in split.filter(F.col("part") == part).select("w").toLocalIterator()))
        got = rows.mapInArrow(_searched(spark.sparkContext.broadcast(held), docs.columns, blank and part == 0), shape)
        out = got if out is None else out.unionByName(got)
    return out.withColumnRenamed("__word", keyword)
