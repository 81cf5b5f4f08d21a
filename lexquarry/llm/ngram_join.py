"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. Every text's set of five-word runs gets a MinHash signature; bands of it are hashed. Texts with one set form a class, and
   only classes go on: copies meet by the set's digest, never in pairs.
2. Classes shuffle on band hashes. All pairs of classes that share a bucket are verified on their full sets, and only these.
3. Buckets of at most PAIRS classes make candidate pairs, which are verified by set intersection in the JVM.
4. Larger buckets emit no pairs. A bucket's classes are written as differences from its smallest set and dealt into blocks; each
   pair of blocks is one group of rows, where matrix products give all intersections at once. Such a group returns each class's
   number of links and a spanning forest of them, not the links themselves.
5. A pair that shares several buckets counts once: in a large bucket if there is one, that with the least hash. So PAIRS and the
   sizes of blocks decide how pairs are verified, never which.
6. Groups of near-duplicates are the connected components of the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_ID, bytes_of, dropped, gram_hashes, hashed_words, keep_only, kept_rows, normal_text, on_files, paired, stored, table, with_row_id
from .components import components

GRAM = 5
SIMILAR = 0.8
RECALL = 0.999
HASHES = 160
PAIRS = 24
#: Classes of a bucket in a block, and n-grams of their sets, about.
BLOCK = 2048
BLOCK_GRAMS = 4_000_000


def choose_bands(similar: float = SIMILAR, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which bands of at most `hashes` hashes in all find a pair at the threshold with the wanted probability."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = hashes // rows
        if 1 - (1 - similar**rows) ** bands < recall:
            break
        best = (next(b for b in range(1, bands + 1) if 1 - (1 - similar**rows) ** b >= recall), rows)
    return best


def gram_set(text: bytes, n: int = GRAM) -> np.ndarray:
    """Sorted hashes of the text's n-word runs. A text of fewer words is one run of all its words; without words the set is empty."""
    w = hashed_words(text)
    return np.unique(gram_hashes(w, min(n, len(w)))) if len(w) else w


def _bands(grams: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        least = np.minimum(least, (x[None, i : i + 4096] * a[:, None] + b[:, None]).min(1))
    parts = least.reshape(bands, rows).astype(np.uint64)
    h = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        h = paired(h, parts[:, r])
    return h.view(np.int64)


def _signer(bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("words")
        rng = np.random.default_rng(7)
        a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for text in bytes_of(batch["text"]):
                g = gram_set(text)
                keys.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                sizes.append(len(g))
                hashes.append(_bands(g, a, b, bands, rows) if len(g) else None)
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=["rid", "doc_id", "key", "n", "bands"])

    return sign


def _gram_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_only("words")
    for batch in batches:
        grams = [gram_set(t).view(np.int64) for t in bytes_of(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["large"], pa.array(grams, pa.list_(pa.int64()))], names=["key", "large", "grams"])


def common_items(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048, few: int = 10_000) -> np.ndarray:
    """How many items each list on the left has in common with each on the right (a list has no item twice).

    Items that make up to `few` pairs add them up one by one; the others are columns of a matrix product."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for lists in (left, right):
        items = np.concatenate(lists) if lists else np.empty(0, np.int64)
        sides.append((items, np.repeat(np.arange(len(lists)), [len(x) for x in lists])))
    both = np.intersect1d(sides[0][0], sides[1][0])
    if not len(both):
        return out
    rows, starts, counts = [], [], []
    for items, who in sides:
        at = np.minimum(np.searchsorted(both, items), len(both) - 1)
        hit = both[at] == items
        at, who = at[hit], who[hit]
        order = np.argsort(at, kind="stable")
        rows.append(who[order])
        counts.append(np.bincount(at, minlength=len(both)))
        starts.append(np.cumsum(counts[-1]) - counts[-1])
    pairs = counts[0] * counts[1]
    rare = np.flatnonzero(pairs <= few)
    cuts = np.searchsorted(np.cumsum(pairs[rare]), np.arange(1, pairs[rare].sum() // 2_000_000 + 1) * 2_000_000)
    for cols in np.split(rare, cuts):
        n = pairs[cols]
        col = np.repeat(cols, n)
        k = np.arange(len(col)) - np.repeat(np.cumsum(n) - n, n)
        a = rows[0][starts[0][col] + k // counts[1][col]]
        b = rows[1][starts[1][col] + k % counts[1][col]]
        np.add.at(out.reshape(-1), a * len(right) + b, np.float32(1))
    often = np.flatnonzero(pairs > few)
    for i in range(0, len(often), width):
        cols = often[i : i + width]
        ones = []
        for side, lists in enumerate((left, right)):
            m = np.zeros((len(lists), len(cols)), np.float32)
            for j, c in enumerate(cols.tolist()):
                m[rows[side][starts[side][c] : starts[side][c] + counts[side][c]], j] = 1
            ones.append(m)
        out += ones[0] @ ones[1].T
    return out


def forest(links: np.ndarray) -> tuple[list[int], list[int]]:
    """Of links (rows by columns, both ways nodes of their own), a spanning forest as row and column numbers: breadth first."""
    new_row, new_col = np.ones(links.shape[0], bool), np.ones(links.shape[1], bool)
    a: list[int] = []
    b: list[int] = []
    for first in range(len(new_row)):
        if not new_row[first]:
            continue
        new_row[first] = False
        todo = [first]
        while todo:
            found = []
            for r in todo:
                cols = np.flatnonzero(links[r] & new_col)
                new_col[cols] = False
                a += [r] * len(cols)
                b += cols.tolist()
                found += cols.tolist()
            todo = []
            for c in found:
                more = np.flatnonzero(links[:, c] & new_row)
                new_row[more] = False
                a += more.tolist()
                b += [c] * len(more)
                todo += more.tolist()
    return a, b


def _tile(similar: float):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        """All links of a pair of blocks, or within one block."""
        keep_only()
        within = rows["ti"].iloc[0] == rows["tj"].iloc[0]
        left = rows if within else rows[rows["block"] == rows["ti"].iloc[0]]
        right = rows if within else rows[rows["block"] == rows["tj"].iloc[0]]
        na, nb = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
        # With sets as differences from one set of h: what neither lacks, plus differences in common.
        both = common_items(left["differ"].to_list(), right["differ"].to_list())
        both += rows["h"].iloc[0] - left["lacks"].to_numpy()[:, None] - right["lacks"].to_numpy()[None, :]
        links = both >= similar * (na + nb - both) - 1e-6
        links &= common_items(left["large"].to_list(), right["large"].to_list()) == 0
        if within:
            links &= ~np.eye(len(rows), dtype=bool)
        a, b = forest(links)
        ka, kb = left["key"].to_numpy(), right["key"].to_numpy()
        na, nb = links.sum(1), links.sum(0)
        some, other = np.flatnonzero(na), np.flatnonzero(nb) if not within else []
        keys = np.r_[ka[some], kb[other], ka[a]]
        return pd.DataFrame({"a": keys, "b": np.r_[np.full(len(some) + len(other), None), kb[b]], "links": np.r_[na[some], nb[other], np.zeros(len(a), np.int64)].astype(np.int64)})

    return verify


def similar_classes(classes: DataFrame, texts: DataFrame, similar: float = SIMILAR, pairs: int | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """classes: key, n (size of its set), bands, rep_rid; texts: rid, text. Returns (key, links) and link edges (a, b) that join what all links join, both stored."""
    most, block = PAIRS if pairs is None else pairs, BLOCK if block is None else block
    members = classes.select("key", "n", F.explode("bands").alias("bucket"))
    # Stored, so that the join shuffles both sides and can split a hot bucket's members.
    buckets = stored(members.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("grams"), F.min(F.struct("n", "key")).alias("hub")).filter("size > 1"), "buckets")
    members = stored(members.join(buckets.select("bucket", "size", "grams"), "bucket"), "members")

    hot = F.array_sort(F.collect_list(F.when(F.col("size") > most, F.col("bucket")))).alias("large")
    wanted = members.groupBy("key").agg(hot).join(classes.select("key", F.col("rep_rid").alias("rid")), "key")
    grams = stored(texts.join(wanted, "rid").select("key", "large", "text").mapInArrow(_gram_lists, "key binary, large array<long>, grams array<long>"), "grams")

    in_bucket = members.filter(F.col("size") <= most).groupBy("bucket").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    pairs_of = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, most), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    met = in_bucket.select(F.explode(pairs_of).alias("p")).select("p.a", "p.b").distinct()
    side = lambda s: grams.select(F.col("key").alias(s), F.col("grams").alias(f"grams_{s}"), F.col("large").alias(f"large_{s}"))
    met = met.join(side("a"), "a").join(side("b"), "b").filter(~F.arrays_overlap("large_a", "large_b"))
    met = met.select("a", "b", F.size("grams_a").alias("na"), F.size("grams_b").alias("nb"), F.size(F.array_intersect("grams_a", "grams_b")).alias("both"))
    small = stored(met.filter(F.col("both") >= similar * (F.col("na") + F.col("nb") - F.col("both")) - 1e-6).select("a", "b"), "links")

    # A hot bucket's members meet its hub's set in as many parts as it has blocks.
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("grams") / BLOCK_GRAMS)).cast("int")
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int")
    spread = members.filter(F.col("size") > most).select("bucket", "key", "n", blocks.alias("blocks")).withColumn("block", part)
    hubs = buckets.filter(F.col("size") > most).select("bucket", F.col("hub.key").alias("key"), blocks.alias("blocks")).join(grams, "key")
    hubs = hubs.select("bucket", F.col("grams").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = spread.join(grams, "key").join(hubs.hint("merge"), ["bucket", "block"])
    lacks = F.array_except("hub", "grams")
    before = F.filter("large", lambda x: x < F.col("bucket"))
    dealt = dealt.select("bucket", "key", "n", "block", "blocks", F.size("hub").alias("h"), F.size(lacks).alias("lacks"), F.concat(lacks, F.array_except("grams", "hub")).alias("differ"), before.alias("large"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "key", "n", "h", "lacks", "differ", "large", "block", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"))
    tiles = stored(dealt.groupBy("bucket", "ti", "tj").applyInPandas(_tile(similar), "a binary, b binary, links long"), "tiles")
    dropped(buckets, members, grams)

    edges = small.union(tiles.filter("b is not null").select("a", "b"))
    ends = small.select(F.col("a").alias("key")).union(small.select(F.col("b").alias("key"))).withColumn("links", F.lit(1).cast("long"))
    counts = stored(ends.union(tiles.filter("b is null").select("a", "links")).groupBy("key").agg(F.sum("links").alias("links")), "counts")
    edges = stored(edges, "all-links")
    dropped(small, tiles)
    return counts, edges


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, pairs: int | None = None) -> DataFrame:
    """One row per document: rid, doc_id, class_id (smallest doc_id of its group of near-duplicates), n_links (different sets that
    its set is linked to), copy_id (smallest doc_id with its very set), n_copies, keep (true for one row of each group).

    doc_id is cast to long. Null text is empty; rows without a word are linked to nothing, not even to each other, and stay. Repeated
    rows are copies."""
    docs = on_files(docs)
    rows = with_row_id(docs).select("rid", F.col("doc_id").cast("long").alias("doc_id"), normal_text(F.col("text")).alias("text"))
    bands, height = choose_bands(similar)
    signed = stored(rows.mapInArrow(_signer(bands, height), f"rid {ROW_ID}, doc_id long, key binary, n int, bands array<long>"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    classes = signed.filter("key is not null").groupBy("key").agg(first, F.count("*").alias("n_copies"))
    reps = classes.select("key", "n_copies", F.col("first.doc_id").alias("copy_id"), F.col("first.rid").alias("rep_rid"))
    classes = stored(reps.join(signed.select(F.col("rid").alias("rep_rid"), "n", "bands"), "rep_rid"), "classes")
    counts, edges = similar_classes(classes, rows.select("rid", "text"), similar, pairs)
    roots = components(edges)
    grouped = classes.select("key", "copy_id", "n_copies", "rep_rid").join(roots.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left").withColumn("root", F.coalesce("root", "key"))
    grouped = stored(grouped, "grouped")
    # Stored before it is joined, as the buckets above.
    best = stored(grouped.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "rep_rid")).alias("best")), "best")
    facts = stored(grouped.join(best, "root").select("key", "copy_id", "n_copies", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.col("best.copy_id").alias("class_id"), F.col("best.rep_rid").alias("keep_rid")), "facts")
    dropped(edges, roots, counts, classes, grouped, best)
    alone = F.col("copy_id").isNull() & F.col("keep_rid").isNull()
    out = signed.select("rid", "doc_id", "key").join(facts, "key", "left")
    out = out.select("rid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), (alone | (F.col("rid") == F.col("keep_rid"))).alias("keep"))
    out = stored(out, "near")
    dropped(signed, facts)
    return out


def one_of_each_group(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows that stay, with the columns of docs."""
    docs = on_files(docs)
    return kept_rows(docs, near_duplicates(docs, similar).filter("keep").select("rid"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("rid", "keep")
