"""Substring dedup with suffix automata of reference shards.

A document is streamed through an automaton of earlier documents; its matching statistics (the longest match that ends at each
word) give the maximal spans of at least WINDOW words that an earlier document has too, and these are removed.

The whole corpus is its own reference here, so its automata have no size bound and are not broadcast: they go to where the
candidates are. What can match is found first:

1. Each window of WINDOW words names the least hash of its ANCHOR-word runs. Consecutive windows with one such anchor form a
   segment, so equal windows always lie in segments with equal anchors. Segments are grouped by anchor and content; of each
   content the smallest document is kept. A later document with that very segment loses all of the segment's windows.
2. What is left are different segments with one anchor. They are the reference: dealt by anchor into shards of bounded size, each
   shard builds one automaton in order of documents and streams each segment through it before adding it.
3. An anchor with more than SHARD different segments is dealt over several shards. Windows that such a shard has not found are
   compared with those of the other shards by hash, folded map-side, so that nothing is lost at a shard's border.

Verdicts are bit masks over a segment's windows; each document gets its own and removes the union.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_ID, bytes_of, dropped, gram_hashes, hashed_words, normal_text, on_files, paired, stored, table, with_row_id

WINDOW = 50
ANCHOR = 16
#: Segments in a shard.
SHARD = 1024


def segments(w: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of a text's word hashes: anchor hash, content hash, first window and number of windows of each segment."""
    n = len(w) - window + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    h, width = gram_hashes(w, anchor), window - anchor + 1
    value, where, k = h, np.arange(len(h)), 1

    def least(v: np.ndarray, p: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        later = v[by:] < v[:-by]
        return np.where(later, v[by:], v[:-by]), np.where(later, p[by:], p[:-by])

    while 2 * k <= width:
        value, where = least(value, where, k)
        k *= 2
    if k < width:
        value, where = least(value, where, width - k)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    size = np.diff(np.r_[first, n])
    full = gram_hashes(w, window)
    content = paired(full[first], paired(full[first + size - 1], size.astype(np.uint64)))
    return value[first], content, first, size


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids, docs = batch["rid"], batch["doc_id"].to_numpy(zero_copy_only=False)
        got = [segments(hashed_words(t)) for t in bytes_of(batch["text"])]
        sizes = [len(x[0]) for x in got]
        anchor, content, first, size = (np.concatenate(x) for x in zip(*got, strict=True)) if got else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [rids.take(pa.array(np.repeat(np.arange(len(rids)), sizes))), pa.array(np.repeat(docs, sizes), pa.int64()), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))],
            names=["rid", "doc_id", "anchor", "content", "first", "windows"],
        )


class Automaton:
    """A suffix automaton of several word sequences, added in order of documents; of each state it knows the first document."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long, self.doc = [-1], [0], [-1]

    def _state(self, nxt: dict[int, int], link: int, long: int, doc: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.long.append(long)
        self.doc.append(doc)
        return len(self.long) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state for the strings of q that p's extension by word ends in."""
        if self.long[q] == self.long[p] + 1:
            return q
        clone = self._state(dict(self.next[q]), self.link[q], self.long[p] + 1, self.doc[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int], doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, q, word)
                continue
            new = self._state({}, 0, self.long[last] + 1, doc)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][word], word)
            last = new

    def found(self, words: list[int], doc: int, window: int) -> int:
        """A bit for each window of words that a document before doc has: bit i for the window that begins at i."""
        nxt, link, long, state, match, mask = self.next, self.link, self.long, 0, 0, 0
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                match = long[state]
            if word in nxt[state]:
                state = nxt[state][word]
                match += 1
            while state and long[link[state]] >= window:
                state = link[state]
                match = long[state]
            if match >= window and self.doc[state] < doc:
                mask |= 1 << (i - window + 1)
        return mask


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Build the shard's automaton and stream its segments. open: hashes of windows not found, if other shards may have them."""
    rows = rows.sort_values(["owner", "content"])
    sam, masks, left = Automaton(), [], []
    for words, doc, divided in zip(rows["words"], rows["owner"], rows["divided"], strict=True):
        mask = sam.found(w := words.tolist(), doc, WINDOW)
        sam.add(w, doc)
        masks.append(mask)
        left.append(gram_hashes(words.view(np.uint64), WINDOW).view(np.int64) if divided else None)
    return pd.DataFrame({"anchor": rows["anchor"].to_numpy(), "content": rows["content"].to_numpy(), "owner": rows["owner"].to_numpy(), "mask": masks, "open": left})


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"anchor": [], "content": [], "owner": [], "divided": [], "words": []}
        for text, wanted in zip(bytes_of(batch["text"]), batch["wanted"].to_pylist(), strict=True):
            w = hashed_words(text).view(np.int64)
            for x in wanted:
                for k in ("anchor", "content", "owner", "divided"):
                    out[k].append(x[k])
                out["words"].append(w[x["first"] : x["first"] + x["windows"] + WINDOW - 1])
        kinds = {"divided": pa.int32(), "words": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))


def _cleaned(with_text: bool):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, texts = [], [], [], []
            for text, hits in zip(bytes_of(batch["text"]), batch["hits"].to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int32)
                for x in hits or ():
                    mask, at = x["mask"], x["first"]
                    while mask:
                        low = (mask & -mask).bit_length() - 1
                        run = (~(mask >> low) & -(~(mask >> low))).bit_length() - 1
                        gone[at + low] += 1
                        gone[at + low + run - 1 + WINDOW] -= 1
                        mask = mask >> (low + run) << (low + run)
                lost = np.cumsum(gone)[:-1] > 0
                kept = b" ".join(words if not lost.any() else [w for w, x in zip(words, lost.tolist(), strict=True) if not x])
                counts.append(len(words))
                removed.append(int(lost.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return clean


def verdicts(rows: DataFrame) -> DataFrame:
    """rid and hits (first window, mask) of the rows (rid, doc_id, text) that lose words."""
    found = stored(rows.filter("doc_id is not null").mapInArrow(_segmented, f"rid {ROW_ID}, doc_id long, anchor long, content long, first int, windows int"), "segments")
    owner = F.min(F.struct("doc_id", "rid", "first", "windows")).alias("o")
    contents = found.groupBy("anchor", "content").agg(owner, F.max("doc_id").alias("last")).select("anchor", "content", F.col("o.doc_id").alias("owner"), F.col("o.rid").alias("rid"), F.col("o.first").alias("first"), F.col("o.windows").alias("windows"), "last")
    several = contents.groupBy("anchor").agg(F.count("*").alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high"), F.max("last").alias("last")).filter("last > low")
    # Stored before it is joined, as facts below: the joins then shuffle both sides and can split a hot anchor or content.
    several = stored(several, "several")
    # Only contents that another document has, or whose anchor has other contents of other documents.
    contents = stored(contents.join(several.select("anchor", "n", "low", "high"), "anchor").filter("last > owner or n > 1"), "contents")
    divided = F.ceil(F.col("n") / SHARD).cast("int")
    reference = contents.filter("n > 1 and high > low").select("anchor", "content", "owner", "rid", "first", "windows", divided.alias("divided"))
    wanted = reference.groupBy("rid").agg(F.collect_list(F.struct("anchor", "content", "owner", "first", "windows", F.when(F.col("divided") > 1, F.col("divided")).otherwise(0).alias("divided"))).alias("wanted"))
    words = rows.select("rid", "text").join(wanted, "rid").select("text", "wanted").mapInArrow(_with_words, "anchor long, content long, owner long, divided int, words array<long>")
    shards = max(1, reference.count() // SHARD + 1)
    part = F.when(F.col("divided") > 0, F.pmod(F.xxhash64("content"), F.col("divided"))).otherwise(0)
    home = F.when(F.col("divided") > 0, F.xxhash64("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    words = words.withColumn("part", part).withColumn("home", home)
    judged = stored(words.groupBy("home", "part").applyInPandas(_shard, "anchor long, content long, owner long, mask long, open array<long>"), "judged")
    windows = judged.filter("open is not null").select("anchor", "content", "owner", F.posexplode("open").alias("i", "window"))
    least = stored(windows.groupBy("anchor", "window").agg(F.min("owner").alias("low")), "least")
    more = windows.join(least, ["anchor", "window"]).filter("low < owner").groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("more"))
    masks = judged.join(more, ["anchor", "content"], "left").select("anchor", "content", F.col("mask").bitwiseOR(F.coalesce("more", F.lit(0).cast("long"))).alias("mask"))
    facts = contents.join(masks, ["anchor", "content"], "left").select("anchor", "content", "owner", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"), "last").filter("last > owner or mask != 0")
    facts = stored(facts, "facts")
    dropped(several, contents, judged, least)
    every = F.expr("shiftleft(1L, windows) - 1")
    hits = found.join(facts.select("anchor", "content", "owner", "mask"), ["anchor", "content"]).withColumn("mask", F.when(F.col("doc_id") > F.col("owner"), every).otherwise(F.col("mask"))).filter("mask != 0")
    out = stored(hits.groupBy("rid").agg(F.collect_list(F.struct("first", "mask")).alias("hits")), "hits")
    dropped(found, facts)
    return out


def dedup_spans(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A window counts as seen if a smaller doc_id has it. Rows without doc_id are no one's reference and lose nothing; rows of one
    doc_id are no reference to each other. doc_id is cast to long. Null text has no words."""
    rows = with_row_id(on_files(docs)).select("rid", F.col("doc_id").cast("long").alias("doc_id"), normal_text(F.col("text")).alias("text"))
    judged = rows.join(verdicts(rows), "rid", "left").select("doc_id", "text", "hits")
    return judged.mapInArrow(_cleaned(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
