"""A stored lexical index: postings by term, in blocks that are aligned to slices of documents.

Documents lie in slices of at most SLICE. A block holds a term's postings of one slice with the largest count and the shortest
document among them, which bound what the term can add to any score there, whatever the corpus' mean length becomes. Summed over a
query's terms, blocks bound a slice; a slice whose bound is below the query's k-th score so far is never opened. Blocks lie in
folders by term hash and are sorted by term, so a query reads its terms' folders and, in them, the row groups that can have its terms.

Writes add folders and count only once their commit is written. A deletion marks places in slices; compaction drops what is marked."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.folders import read_or_none
from .graph import settled
from .ranking import top_k
from .search import B, K1, tokens

#: Documents of a slice, folders of terms, queries that a task scores at once.
SLICE, BUCKETS, AT_ONCE = 1024, 64, 256
_COMMITS = "seg string, kind string, at timestamp"
_DEAD = "seg string, slice long, ord int"


def _sliced(slice_size: int):
    """Slices, each as a row of its documents and a row for every term."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, slice_size):
                batch = whole.slice(at, slice_size)
                n, lists = batch.num_rows, batch["toks"]
                dl = np.diff(lists.offsets.to_numpy()).astype(np.int32)
                coded = lists.flatten().dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                both, tf = np.unique(codes * n + np.repeat(np.arange(n), dl), return_counts=True)
                term, ord_ = both // n, (both % n).astype(np.int32)
                begin = np.flatnonzero(np.diff(term, prepend=-1))
                ends, slice_no = np.append(begin, len(both)).astype(np.int32), int(np.frombuffer(uuid.uuid4().bytes[:8], np.int64)[0])
                size = len(begin)
                docs = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(size + 1), n).astype(np.int32)), pa.concat_arrays([batch["doc"]]))
                dls = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(size + 1), n).astype(np.int32)), pa.array(dl))
                postings = lambda x: pa.ListArray.from_arrays(pa.array(np.append(ends, len(both)).astype(np.int32)), pa.array(x.astype(np.int32)))
                most = np.maximum.reduceat(tf, begin) if size else np.zeros(0)
                least = np.minimum.reduceat(dl[ord_], begin) if size else np.zeros(0)
                terms = coded.dictionary.take(pa.array(term[begin])) if size else pa.array([], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([terms.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(np.full(size + 1, slice_no)), pa.array(np.append(np.diff(ends), n).astype(np.int32)),
                     pa.array(np.append(most, 0).astype(np.int32)), pa.array(np.append(least, 0).astype(np.int32)), postings(ord_), postings(tf), docs, dls],
                    names=["term", "slice", "n", "max_tf", "min_dl", "ords", "tfs", "docs", "dls"],
                )

    return cut


def _scored(k: int, k1: float, b: float, mean: float, query: pa.DataType, doc: pa.DataType, opened):
    """The k best documents of each query of a slice, with all that tie."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, dl, dead = batch["docs"][i].values, batch["dls"][i].values.to_numpy(), batch["dead"][i].values
                norm = k1 * (1 - b + b * dl / max(mean, 1e-9))
                blocks = batch["blocks"][i].values
                if opened is not None:
                    opened.add(len(blocks))
                names, idf = blocks.field("term").to_pylist(), blocks.field("idf").to_numpy()
                place, ords, tfs = {t: j for j, t in enumerate(names)}, blocks.field("ords"), blocks.field("tfs")
                queries = batch["queries"][i].values
                asked, ids = queries.field("terms").to_pylist(), queries.field("query")
                for at in range(0, len(asked), AT_ONCE):
                    some = asked[at : at + AT_ONCE]
                    use = sorted({place[t] for ts in some for t in ts if t in place})
                    w, has = np.zeros((len(dl), len(use))), np.zeros((len(use), len(some)))
                    column = {j: c for c, j in enumerate(use)}
                    for j, c in column.items():
                        o, tf = ords[j].values.to_numpy(), tfs[j].values.to_numpy()
                        w[o, c] = idf[j] * tf * (k1 + 1) / (tf + norm[o])
                    for q, ts in enumerate(some):
                        has[[column[place[t]] for t in ts if t in place], q] = 1
                    best = np.round(w @ has, 6)
                    best[dead.to_numpy()] = 0
                    least = np.sort(best, 0)[max(0, len(best) - k)]
                    r, q = np.nonzero((best >= least) & (best > 0))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + at)).cast(query), docs.take(pa.array(r)).cast(doc), pa.array(best[r, q])], names=["query", "doc", "score"])

    return score


class LexicalIndex:
    """An index in a folder of the shared file system. Keys are any type that Parquet holds; a key is indexed once at a time."""

    def __init__(self, spark: SparkSession, path: str, key: T.DataType | None = None, slice_size: int = SLICE):
        self.spark, self.path, self.key, self.slice_size = spark, path, key or T.LongType(), slice_size

    # what is stored -------------------------------------------------------------------------------------------------------------

    def _committed(self) -> tuple[list[str], list[str]]:
        """Segments and deletions that count: those since the last compaction. A handful of rows, one a write."""
        rows = read_or_none(self.spark, f"{self.path}/commits", _COMMITS).orderBy("at", "seg").collect()
        base = max((i for i, r in enumerate(rows) if r["kind"] == "base"), default=0)
        rows = rows[base:]
        return [r["seg"] for r in rows if r["kind"] != "dead"], [r["seg"] for r in rows if r["kind"] == "dead"]

    def _commit(self, seg: str, kind: str) -> None:
        row = self.spark.range(1).select(F.lit(seg).alias("seg"), F.lit(kind).alias("kind"), F.lit(self.spark.sql("select current_timestamp()").first()[0]).alias("at"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _table(self, name: str, schema: str, segs: list[str]) -> DataFrame:
        return read_or_none(self.spark, f"{self.path}/{name}", schema).filter(F.col("seg").isin(segs))

    def _postings(self) -> DataFrame:
        return self._table("postings", "term string, slice long, n int, max_tf int, min_dl int, ords array<int>, tfs array<int>, seg string, bucket int", self._committed()[0])

    def _slices(self) -> DataFrame:
        return self._table("slices", f"slice long, docs array<{self.key.simpleString()}>, dls array<int>, seg string", self._committed()[0])

    def _dead(self) -> DataFrame:
        """(slice, dead): marked places."""
        return self._table("dead", _DEAD, self._committed()[1]).groupBy("slice").agg(F.array_sort(F.collect_set("ord")).alias("dead"))

    def _write(self, seg: str, postings: DataFrame, slices: DataFrame) -> None:
        """Ranges of (bucket, term, slice): a frequent term's blocks spread over files, and a rare one's row groups are found by term."""
        placed = postings.withColumn("bucket", _bucket(F.col("term"))).repartitionByRange("bucket", "term", "slice").sortWithinPartitions("bucket", "term", "slice")
        placed.withColumn("seg", F.lit(seg)).write.mode("append").partitionBy("seg", "bucket").parquet(f"{self.path}/postings")
        slices.withColumn("seg", F.lit(seg)).write.mode("append").partitionBy("seg").parquet(f"{self.path}/slices")

    # writes ---------------------------------------------------------------------------------------------------------------------

    def add(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> None:
        """Index documents that aren't in yet (upsert() replaces). Null texts count as empty. No shuffle but the one that writes."""
        split = docs.select(F.col(doc).cast(self.key).alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks"))
        shape = f"term string, slice long, n int, max_tf int, min_dl int, ords array<int>, tfs array<int>, docs array<{self.key.simpleString()}>, dls array<int>"
        cut = settled(split.mapInArrow(_sliced(self.slice_size), shape))
        seg = uuid.uuid4().hex
        self._write(seg, cut.filter("term is not null").drop("docs", "dls"), cut.filter("term is null").select("slice", "docs", "dls"))
        self._commit(seg, "add")

    def delete(self, keys: DataFrame, doc: str = "doc_id") -> None:
        """Mark documents as gone. Their postings stay until compact(), but no count or result has them."""
        live = self._slices().join(self._dead(), "slice", "left").select("slice", "dead", F.posexplode("docs").alias("ord", "doc"))
        live = live.filter(F.col("doc").isNotNull() & ~F.coalesce(F.array_contains("dead", F.col("ord")), F.lit(False)))
        gone = live.join(keys.select(F.col(doc).cast(self.key).alias("doc")).distinct(), "doc", "left_semi").select("slice", "ord")
        seg = uuid.uuid4().hex
        gone.withColumn("seg", F.lit(seg)).write.mode("append").partitionBy("seg").parquet(f"{self.path}/dead")
        self._commit(seg, "dead")

    def upsert(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> None:
        self.delete(docs, doc)
        self.add(docs, doc, text)

    def compact(self) -> None:
        """One segment of what is left: marked places lose their postings, and bounds are drawn anew. Slices that are empty go."""
        slices = self._slices().join(self._dead(), "slice", "left").withColumn("dead", F.coalesce("dead", F.array().cast("array<int>")))
        slices = slices.select("slice", F.transform("docs", lambda x, i: F.when(~F.array_contains("dead", i), x)).alias("docs"), "dls", "dead", F.lit(True).alias("live")).filter(F.exists("docs", lambda x: x.isNotNull()))
        slices = settled(slices)
        kept = self._postings().select("term", "slice", F.arrays_zip("ords", "tfs").alias("p")).join(slices.drop("docs"), "slice")
        kept = kept.withColumn("p", F.filter("p", lambda x: ~F.array_contains("dead", x["ords"]))).filter(F.size("p") > 0)
        lengths = F.transform("p", lambda x: F.element_at("dls", x["ords"] + 1))
        postings = kept.select("term", "slice", F.size("p").alias("n"), F.array_max("p.tfs").alias("max_tf"), F.array_min(lengths).alias("min_dl"), F.col("p.ords").alias("ords"), F.col("p.tfs").alias("tfs"))
        seg = uuid.uuid4().hex
        self._write(seg, postings, slices.select("slice", "docs", "dls"))
        self._commit(seg, "base")

    # search ---------------------------------------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int, query: str = "query_id", text: str = "query", doc: str = "doc_id", first: int = 2, k1: float = K1, b: float = B, opened=None) -> DataFrame:
        """(query, doc, score, rank): the k best documents of each query, ties by doc; the rows of bm25_top() over the live documents.

        Each query opens its `first` slices of the highest bound; from then on only slices that can still reach its k-th score. Queries,
        terms and slices meet by joins, so their number has no bound. `opened`, an accumulator, counts opened blocks."""
        asked = settled(queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("term")).distinct())
        buckets = [r[0] for r in asked.select(_bucket(F.col("term"))).distinct().collect()]  # at most BUCKETS
        postings = self._postings().filter(F.col("bucket").isin(buckets))
        kinds, slices, dead = {f.name: f.dataType for f in asked.schema}, self._slices(), self._dead()
        marked = slices.join(dead, "slice").select(F.size("dead").alias("n"), F.aggregate("dead", F.lit(0).cast("long"), lambda s, o: s + F.element_at("dls", o + 1)).alias("tokens"))
        size = slices.select(F.size(F.filter("docs", lambda x: x.isNotNull())).alias("n"), F.aggregate(F.arrays_zip("docs", "dls"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["docs"].isNotNull(), x["dls"]).otherwise(0)).alias("tokens"))
        total = size.unionAll(marked.select(-F.col("n"), -F.col("tokens"))).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        n, mean = int(total[0]), float(total[1]) / max(1, int(total[0]))
        wanted = asked.select("term").distinct()
        heads = settled(postings.select("term", "slice", "n", "max_tf", "min_dl").join(wanted, "term"))
        less = postings.join(wanted, "term").join(dead, "slice").groupBy("term").agg(F.sum(F.size(F.array_intersect("ords", "dead"))).alias("less"))
        df = heads.groupBy("term").agg(F.sum("n").alias("df")).join(less, "term", "left").select("term", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df"))
        idf = settled(df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
        most = F.col("idf") * F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_dl") / max(mean, 1e-9)))
        bounds = heads.join(idf, "term").select("term", "slice", most.alias("most")).join(asked, "term").groupBy("query", "slice").agg(F.sum("most").alias("bound"))
        bounds = settled(bounds)

        def evaluated(pairs: DataFrame) -> DataFrame:
            """Open the blocks of the queries' terms in their slices."""
            said = asked.groupBy("query").agg(F.collect_list("term").alias("terms"))
            by_slice = pairs.join(said, "query").groupBy("slice").agg(F.collect_list(F.struct("query", "terms")).alias("queries"))
            need = pairs.join(asked, "query").select("slice", "term").distinct()
            blocks = postings.select("term", "slice", "ords", "tfs").join(need, ["slice", "term"], "left_semi").join(idf, "term")
            blocks = blocks.groupBy("slice").agg(F.collect_list(F.struct("term", "idf", "ords", "tfs")).alias("blocks"))
            held = blocks.join(by_slice, "slice").join(slices.select("slice", "docs", "dls"), "slice").join(dead, "slice", "left")
            held = held.select("blocks", "queries", "docs", "dls", F.coalesce("dead", F.array().cast("array<int>")).alias("dead"))
            kernel = _scored(k, k1, b, mean, to_arrow_type(kinds["query"]), to_arrow_type(self.key), opened)
            return settled(top_k(held.mapInArrow(kernel, f"query {kinds['query'].simpleString()}, doc {self.key.simpleString()}, score double"), ["query"], [F.desc("score"), F.col("doc")], k))

        begun = settled(top_k(bounds, ["query"], [F.desc("bound"), F.col("slice")], first).drop("rank"))
        got = evaluated(begun.select("query", "slice"))
        floor = got.filter(F.col("rank") == k).select("query", F.col("score").alias("floor"))
        rest = bounds.join(begun.select("query", "slice"), ["query", "slice"], "left_anti").join(floor, "query", "left")
        more = evaluated(rest.filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-6)).select("query", "slice"))
        best = top_k(got.drop("rank").unionByName(more.drop("rank")), ["query"], [F.desc("score"), F.col("doc")], k)
        return best.select(F.col("query").alias(query), F.col("doc").alias(doc), "score", "rank")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")
