"""Lexical and vector search for whole batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .graph import settled
from .keywords import occurring
from .ranking import rrf, top_k

K1, B = 1.2, 0.75  # fixed values
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


#: Query terms times queries of one pass: bounds what goes to every task (8 bytes each).
CELLS = 8_000_000


def _batches(queries: DataFrame, query: str, text: str) -> Iterator[tuple[list, list[str], np.ndarray]]:
    """Queries in batches: their ids, their distinct terms, and which query has which term (terms by queries)."""
    held: list[tuple[object, list[str]]] = []
    terms: dict[str, int] = {}

    def made() -> tuple[list, list[str], np.ndarray]:
        has = np.zeros((len(terms), len(held)))
        for j, (_, words) in enumerate(held):
            has[[terms[w] for w in words], j] = 1
        return [q for q, _ in held], list(terms), has

    for row in queries.select(F.col(query).alias("q"), F.array_distinct(tokens(F.coalesce(F.col(text), F.lit("")))).alias("t")).toLocalIterator():
        if held and (len(terms) + len(row["t"])) * (len(held) + 1) > CELLS:
            yield made()
            held, terms = [], {}
        for w in row["t"]:
            terms.setdefault(w, len(terms))
        held.append((row["q"], row["t"]))
    if terms:
        yield made()


def _indexed(vocabulary: list[str], n: int):
    """Of each document and field: length, and numbers and counts of the terms that the vocabulary has."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(vocabulary, pa.string())
        for batch in batches:
            out, names = [batch["doc"], batch["grp"]], ["doc", "grp"]
            for f in range(n):
                lists = batch[f"f{f}"]
                sizes = np.diff(lists.offsets.to_numpy())
                found = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), sizes)[found >= 0]
                both, count = np.unique(row * len(words) + found[found >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(both, np.arange(batch.num_rows + 1) * len(words)), pa.int32())
                out += [pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(both % len(words), pa.int32())), pa.ListArray.from_arrays(ends, pa.array(count, pa.int32()))]
                names += [f"dl{f}", f"t{f}", f"c{f}"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return index


def _codes(*columns: pa.Array) -> np.ndarray:
    """Numbers for the values of columns, one after the other; null is -1."""
    return pa.chunked_array(list(columns)).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _scored(ids: list, has: np.ndarray, boosts: list[float], idf: list[np.ndarray], mean: list[float], k: int, k1: float, b: float, kind: pa.DataType, rows: int = 512):
    """The k best documents of each query and group, with all that tie, of a slice of documents."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(ids, kind)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                best = np.zeros((batch.num_rows, len(ids)))
                for f, boost in enumerate(boosts):
                    lists = batch[f"t{f}"]
                    doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                    term, tf = lists.flatten().to_numpy(), batch[f"c{f}"].flatten().to_numpy()
                    dl = batch[f"dl{f}"].to_numpy()
                    use = np.unique(term)
                    w = np.zeros((batch.num_rows, len(use)))
                    norm = k1 * (1 - b + b * dl / max(mean[f], 1e-9))
                    w[doc, np.searchsorted(use, term)] = idf[f][term] * tf * (k1 + 1) / (tf + norm[doc])
                    best = np.maximum(best, boost * (w @ has[use]))
                best = np.round(best, 6)
                groups = np.unique(_codes(batch["grp"]), return_inverse=True)[1]
                hit = np.zeros(best.shape, bool)
                for g in range(int(groups.max()) + 1 if len(groups) else 0):
                    mine = np.flatnonzero(groups == g)
                    part = best[mine]
                    least = np.sort(part, 0)[max(0, len(mine) - k)]
                    hit[mine] = (part >= least) & (part > 0)
                r, q = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), batch["doc"].take(pa.array(r)), batch["grp"].take(pa.array(r)), pa.array(best[r, q])], names=["query", "doc", "grp", "score"])

    return score


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, fields: dict[str, float] | None = None, doc: str = "doc_id", query: str = "query_id", query_text: str = "query", group: str | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query (and of each group, with the group's column), ties by doc.

    Fields are searched each by itself, a document has its best boosted score. Documents are tokenised once: what is kept of each
    is its length and its counts of the queries' terms. Scores are matrix products of slices of documents with all queries of a
    batch, and only the k best of each slice leave it: the pairs of a query and a document that share a frequent term are never rows.
    Queries are taken in batches whose terms fit CELLS; each batch is a pass over the documents."""
    fields = fields or {"text": 1.0}
    types = {f.name: f.dataType for f in docs.schema} | {"__q": queries.schema[query].dataType}
    said = lambda t: t.simpleString()
    out = None
    for ids, vocabulary, has in _batches(queries, query, query_text):
        split = docs.select(F.col(doc).alias("doc"), (F.col(group) if group else F.lit("")).alias("grp"), *(tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)))
        head = f"doc {said(types[doc])}, grp {said(types[group]) if group else 'string'}"
        shape = ", ".join(f"dl{i} int, t{i} array<int>, c{i} array<int>" for i in range(len(fields)))
        index = settled(split.mapInArrow(_indexed(vocabulary, len(fields)), f"{head}, {shape}"))
        n, *means = index.agg(F.count("*"), *(F.avg(f"dl{i}") for i in range(len(fields)))).first()
        idf = []
        for i in range(len(fields)):
            df = np.zeros(len(vocabulary))
            for r in index.select(F.explode(f"t{i}").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # one row a query term
                df[r["t"]] = r["df"]
            idf.append(np.log(1 + (n - df + 0.5) / (df + 0.5)))
        kind = to_arrow_type(types["__q"])
        kernel = _scored(ids, has, list(fields.values()), idf, [m or 0.0 for m in means], k, k1, b, kind)
        got = index.mapInArrow(kernel, f"query {said(types['__q'])}, doc {said(types[doc])}, grp {said(types[group]) if group else 'string'}, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"query {said(types['__q'])}, doc {said(types[doc])}, grp {said(types[group]) if group else 'string'}, score double")
    best = top_k(out, ["query", "grp"], [F.desc("score"), F.col("doc")], k)
    return best.select(F.col("query").alias(query), *([F.col("grp").alias(group)] if group else []), F.col("doc").alias(doc), "score", "rank")


def _packed(df: DataFrame, key: str, vector: str, group: Column, blocks: int) -> DataFrame:
    """Vectors in `blocks` blocks, a block in one row: ids and vectors as bytes, rows of one group (sizes, names) next to each other."""
    kind = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    v = F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>")
    held = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"), group.cast("string").alias("g"))
    held = held.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema) if (batches := list(batches)) and (schema := batches[0].schema) else None
        for block in rows["block"].unique().to_pylist() if rows else []:
            own = rows.filter(pc.equal(rows["block"], block)).sort_by("g").combine_chunks()
            v = own["v"].combine_chunks().flatten().to_numpy().astype(kind).reshape(own.num_rows, -1)
            sound = np.isfinite(v).all(1)  # others are never at a finite distance
            g = own["g"].filter(pa.array(sound)).combine_chunks()
            runs = g.value_counts()
            sizes, names = runs.field("counts").cast(pa.int32()), runs.field("values")
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int32()), "dim": pa.array([v.shape[1]], pa.int32()), "ids": [own["id"].to_numpy()[sound].astype("<i8").tobytes()], "v": [v[sound].tobytes()],
                "names": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), "sizes": pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), sizes)})

    packed = held.mapInArrow(pack, "block int, dim int, ids binary, v binary, names array<string>, sizes array<int>")
    return packed.select("block", F.struct("dim", F.lit(kind).alias("kind"), "ids", "v", "names", "sizes").alias("rows"))


class _Side:
    """An opened block: ids, vectors, and where each group's rows lie."""

    def __init__(self, rows: dict):
        self.ids = np.frombuffer(rows["ids"], "<i8")
        self.v = np.frombuffer(rows["v"], rows["kind"]).reshape(len(self.ids), -1 if len(self.ids) else rows["dim"])
        self.single, self.norm = self.v.astype("f4"), np.sqrt((self.v.astype("f8") ** 2).sum(1))
        ends = np.cumsum(rows["sizes"], dtype=int)
        self.groups = {g: (end - n, end) for g, n, end in zip(rows["names"], rows["sizes"], ends.tolist(), strict=True)}


#: Rows of a product that are looked at together, and products' columns that share a bound.
ROWS, LANES = 256, 64


class _Best:
    """The k best of every row of a left block, over the right blocks it has met: ties at nine digits to the smaller id."""

    def __init__(self, left: _Side, k: int, skip_self: bool, same: bool | None):
        self.left, self.k, self.skip_self, self.same = left, k, skip_self, same
        self.cos, self.ids = np.full((len(left.ids), k), -np.inf), np.zeros((len(left.ids), k), np.int64)

    def meet(self, right: _Side) -> None:
        """Products in single precision tell which cells can be among the k best, with the error they can have; those are computed in
        double precision. A row's bound is its k-th best so far, and the k-th largest of the maxima of this product's groups of columns."""
        a, n = self.left, len(right.ids)
        if not n or not len(a.ids):
            return
        most = right.norm.max()
        coarse = a.norm.max() * most < 1e30
        kind = np.dtype("f4") if coarse else np.dtype("f8")
        slack = (a.v.shape[1] + 8) * float(np.finfo(kind).eps) * a.norm * most + 1e-8
        wide = -(-n // LANES)
        x, y = (a.single, right.single) if coarse else (a.v.astype("f8"), right.v.astype("f8"))
        y = np.concatenate([y, np.zeros((wide * LANES - n, y.shape[1]), kind)]).T
        order = np.argsort(right.ids, kind="stable")
        lo, hi = (np.searchsorted(right.ids[order], a.ids, side) for side in ("left", "right"))
        for at in range(0, len(a.ids), ROWS):
            end = min(at + ROWS, len(a.ids))
            c = x[at:end] @ y
            c[:, n:] = -np.inf
            self._mask(c, at, end, right)
            if self.skip_self and (own := np.flatnonzero(hi[at:end] > lo[at:end])).size:
                many = (hi - lo)[at:end][own]
                c[np.repeat(own, many), order[np.repeat(lo[at:end][own] - (np.cumsum(many) - many), many) + np.arange(many.sum())]] = -np.inf
            lanes = c.reshape(end - at, LANES, wide)
            top = lanes.max(1)
            bound = np.partition(top, wide - self.k, 1)[:, wide - self.k] - 2 * slack[at:end] if wide >= self.k else np.full(end - at, -np.inf)
            bound = np.maximum(bound, np.maximum(self.cos[at:end, -1] - slack[at:end], np.finfo(kind).min))[:, None]
            r, g = np.nonzero(top >= bound)
            for i in range(0, len(r), 4096):
                m, lane = np.nonzero(lanes[r[i : i + 4096], :, g[i : i + 4096]] >= bound[r[i : i + 4096]])
                self._take(at + r[i + m], lane * wide + g[i + m], right)

    def _mask(self, c: np.ndarray, at: int, end: int, right: _Side) -> None:
        """With same, cells of one group stay only; without, cells of different ones. None counts as no group."""
        if self.same is None:
            return
        for g, (first, last) in self.left.groups.items():
            rows = slice(max(first - at, 0), max(min(last, end) - at, 0))
            if rows.start >= rows.stop:
                continue
            lo, hi = right.groups.get(g, (0, 0))
            if g is None:
                c[rows] = -np.inf
            elif self.same:
                c[rows, :lo] = c[rows, hi:] = -np.inf
            else:
                c[rows, lo:hi] = -np.inf
        if None in right.groups:
            c[:, slice(*right.groups[None])] = -np.inf

    def _take(self, rows: np.ndarray, columns: np.ndarray, right: _Side) -> None:
        exact = np.concatenate([np.einsum("ij,ij->i", self.left.v[rows[i : i + 65536]].astype("f8"), right.v[columns[i : i + 65536]].astype("f8")) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
        some, back = np.unique(rows, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(some)), self.k), back])
        ids, cos = np.concatenate([self.ids[some].ravel(), right.ids[columns]]), np.concatenate([self.cos[some].ravel(), exact])
        order = np.lexsort((ids, -np.round(cos, 9), row))
        first = np.searchsorted(row[order], np.arange(len(some)))
        chosen = order[first[:, None] + np.arange(self.k)]
        self.ids[some], self.cos[some] = ids[chosen], cos[chosen]


def _kept(k: int, skip_self: bool, same: bool | None):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                no = batch["block"][i].as_py()
                if no not in best:
                    best[no] = _Best(_Side(batch["left"][i].as_py()), k, skip_self, same)
                best[no].meet(_Side(batch["right"][i].as_py()))
        for x in best.values():
            rows, place = np.nonzero(np.isfinite(x.cos))
            yield pa.RecordBatch.from_arrays([pa.array(x.left.ids[rows]), pa.array(x.ids[rows, place]), pa.array(x.cos[rows, place])], names=["a", "b", "cosine"])

    return near


def _nearest(k: int, skip_self: bool, same: bool | None):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch["left"], batch["right"], strict=True):
                sides = [(x.values.field("id").to_numpy(), x.values.field("v"), x.values.field("g")) for x in (left, right)]
                (a_id, a, a_g), (b_id, b, b_g) = ((i, v.flatten().to_numpy().reshape(len(i), -1), g) for i, v, g in sides)
                cos = a @ b.T
                if skip_self:
                    cos[a_id[:, None] == b_id[None, :]] = -np.inf
                if same is not None:
                    code = _codes(a_g, b_g)
                    x, y = code[: len(a_g), None], code[None, len(a_g) :]
                    cos[((x == y) != same) | (x < 0) | (y < 0)] = -np.inf
                # all that tie with the k-th stay, so that ties are settled by id later
                least = -np.sort(-np.round(cos, 9), 1)[:, min(k, cos.shape[1]) - 1]
                rows, cols = np.nonzero((np.round(cos, 9) >= least[:, None]) & np.isfinite(cos))
                yield pa.RecordBatch.from_arrays([pa.array(a_id[rows]), pa.array(b_id[cols]), pa.array(cos[rows, cols])], names=["a", "b", "cosine"])

    return near


def knn(left: DataFrame, right: DataFrame, key: str, vector: str, k: int, skip_self: bool = True, group: str | None = None, same: bool | None = None, block: int = 8192) -> DataFrame:
    """(a, b, cosine, rank): exact nearest neighbours by cosine of unit vectors, ties by b. Filter right before, never after.

    Rows are packed into blocks of about `block`. A task meets a left block with up to 16 right blocks, a matrix product each, and
    returns the k best of each left row over all of them. With `group`, only neighbours of the same group (same) or of other groups
    count: the product's other cells are masked before the cut to k; a row without a group has no such neighbours. The work grows with
    left times right; knn_probed() is for large tables."""
    g = F.col(group) if group else F.lit(None)
    spread = 2 * left.sparkSession.sparkContext.defaultParallelism
    n, m = left.count(), right.count()
    blocks = -(-m // block) or 1
    a = _packed(left, key, vector, g, max(-(-n // block), min(spread, -(-n // ROWS)), 1)).withColumnRenamed("rows", "left")
    b = _packed(right, key, vector, g, blocks).repartitionById(-(-blocks // 16), F.floor(F.col("block") / 16).cast("int")).select(F.col("rows").alias("right"))
    near = a.crossJoin(b).mapInArrow(_kept(k, skip_self, same), "a long, b long, cosine double")
    return top_k(near, ["a"], [F.desc(F.round("cosine", 9)), F.col("b")], k)


def knn_within(df: DataFrame, group: str, key: str, vector: str, k: int, same: bool) -> DataFrame:
    """Nearest neighbours from the same group only, or from other groups only."""
    return knn(df, df, key, vector, k, group=group, same=same)


def row_and_column_best(left: DataFrame, right: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(a, b, cosine): the k best of each left vector and the k best of each right vector, each pair once."""
    rows = knn(left, right, key, vector, k, skip_self=False).select("a", "b", "cosine")
    columns = knn(right, left, key, vector, k, skip_self=False).select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")
    return rows.union(columns).groupBy("a", "b").agg(F.first("cosine").alias("cosine"))


#: Vectors from which cells are fitted, at most.
SAMPLE = 50_000


def _cells(vectors: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Unit centres by spherical k-means."""
    rng = np.random.default_rng(11)
    centres = vectors[rng.choice(len(vectors), min(n, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def knn_probed(left: DataFrame, right: DataFrame, key: str, vector: str, k: int, cells: int = 64, probes: int = 24, skip_self: bool = True, sample: int = SAMPLE) -> DataFrame:
    """knn() by an inverted file: centres are fitted on a sample of `sample` vectors at most, every right vector is in its nearest
    cell, and every left vector visits its `probes` nearest cells. A left and a right block of one cell are one matrix product.

    Approximate: a neighbour in a cell that isn't visited is missed. More probes find more; with probes = cells it is exact."""
    some = right.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    some = np.array([r["v"] for r in some.orderBy(F.xxhash64("v")).limit(sample).collect()])
    if not len(some):
        return knn(left, right, key, vector, k, skip_self)
    centres = _cells(some, cells)

    def visit(most: int):
        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1)
                near = np.argsort(-(v @ centres.T), 1, kind="stable")[:, :most]
                yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "v", "cells"])

        return visits

    def blocks(df: DataFrame, most: int, name: str, rows: int = 2048) -> DataFrame:
        flat = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        placed = flat.mapInArrow(visit(most), "id long, v array<double>, cells array<int>").select("id", "v", F.explode("cells").alias("cell"))
        sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / rows).alias("parts"))
        dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "v", F.lit(None).cast("string").alias("g"))).alias(name)).drop("part")

    met = blocks(left, probes, "left").join(blocks(right, 1, "right"), "cell").select("left", "right")
    near = met.mapInArrow(_nearest(k, skip_self, None), "a long, b long, cosine double")
    return top_k(near, ["a"], [F.desc(F.round("cosine", 9)), F.col("b")], k)


def hybrid(lexical: DataFrame, semantic: DataFrame, query: str, doc: str, n: int) -> DataFrame:
    """Both channels give 3n rows a query, are fused by reciprocal rank, and cut to n. The cosine is there for semantic hits only."""
    lists = [df.filter(F.col("rank") <= 3 * n) for df in (semantic, lexical)]
    fused = rrf(lists, [query], doc).filter(F.col("rank") <= n)
    return fused.join(semantic.select(query, doc, "cosine"), [query, doc], "left")


def overlap_score(query: Column, text: Column) -> Column:
    """The default reranker: share of the query's distinct terms that the text has."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1))


def model_score(scorer: Callable[[list[str], list[str]], list[float]], most: int = 500) -> Callable[[Column, Column], Column]:
    """A reranker from a function of batches: it gets queries and the first `most` characters of texts, and gives scores."""
    @F.pandas_udf("double")
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(queries.fillna("").to_list(), texts.fillna("").str.slice(0, most).to_list()), dtype="float64")

    return score


def expand_queries(queries: DataFrame, synonyms: DataFrame, query: str = "query_id", text: str = "query") -> DataFrame:
    """Append the other words of every synonym group (term, extra) whose term the query has."""
    found = occurring(queries.select(query, text), F.lower(text), synonyms, "term").join(synonyms, "term").select(F.col(query).alias("__q"), F.col(text).alias("__t"), "extra")
    hits = queries.join(found, F.col(query).eqNullSafe(F.col("__q")) & (F.col(text) == F.col("__t")), "left")
    return hits.groupBy(query, text).agg(F.array_sort(F.collect_set("extra")).alias("extra")).withColumn("expanded", F.concat_ws(" ", F.col(text), F.when(F.size("extra") > 0, F.array_join("extra", " "))))


def route(lists: DataFrame, query: str, group: str, doc: str, each: int) -> DataFrame:
    """The first `each` of every group, fused over groups by their rank in the group."""
    part = top_k(lists, [query, group], [F.desc("score"), F.col(doc)], each, "in_group")
    got = part.withColumn("rrf", F.lit(1.0) / (60.0 + F.col("in_group")))
    return got


def weighted_jaccard(weights: DataFrame, owner: str, key: str, weight: str, pairs: DataFrame | None = None) -> DataFrame:
    """sum of least over sum of greatest weights, for the given pairs (a, b) of owners, else for all pairs a < b that share a key.
    Only keys both have meet; what one has alone follows from the totals."""
    totals = weights.groupBy(owner).agg(F.sum(weight).alias("total"))
    a, b = (weights.select(F.col(owner).alias(s), F.col(key).alias("key"), F.col(weight).alias(f"w{s}")) for s in ("a", "b"))
    met = a.join(b, "key").filter("a < b") if pairs is None else pairs.join(a, "a").join(b, ["b", "key"])
    both = met.groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("both"))
    ta, tb = (totals.select(F.col(owner).alias(s), F.col("total").alias(f"t{s}")) for s in ("a", "b"))
    joined = (both if pairs is None else pairs.join(both, ["a", "b"], "left")).join(ta, "a").join(tb, "b")
    shared = F.coalesce("both", F.lit(0))
    return joined.select("a", "b", F.round(shared / (F.col("ta") + F.col("tb") - shared), 6).alias("jaccard"))


def centroid(df: DataFrame, by: Sequence[str], vector: str, how: str = "median") -> DataFrame:
    """Element-wise median or mean of vectors, brought to unit length."""
    part = df.select(*by, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy(*by, "pos").agg((F.median("x") if how == "median" else F.avg("x")).alias("x"))
    whole = part.groupBy(*by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return part.join(whole, list(by)).select(*by, "pos", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0).alias("x"))
