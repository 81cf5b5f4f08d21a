"""Hard-negative mining by distributed radix selection.

Rows lie in blocks of vectors. A pass lays every block against the anchors' open windows: it counts, for each window, the scores in
it by their leading digit, best first. The counts of all blocks are summed, the digit that holds the k-th score becomes the window's
new range, and the next pass counts its next digit. Scores that tie at the k-th place are refined likewise by id. At last only rows
that qualify leave their blocks. No pass makes a row for a pair of an anchor and a vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table

#: Numbers in a block of vectors, anchors in a block of anchors (about), bits of a digit.
CELLS, ANCHORS, DIGIT = 1 << 20, 2048, 10
_WINDOW = ["hi", "lo", "left", "by_id", "id_lo", "id_hi", "shift"]


def usable(vectors: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, x) of the rows that take part: with an id and a label, and a vector of finite components only."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is greater than infinity
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(finite)


def _packed(width: int, scale: float, whole: str):
    """Vectors in blocks, their components whole numbers; shorter vectors are filled with zeros."""
    most = max(1, CELLS // max(1, width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                sizes = np.diff(part["x"].offsets.to_numpy())
                v = np.zeros((part.num_rows, width))
                v[np.arange(width) < sizes[:, None]] = np.floor(scale * part["x"].flatten().to_numpy())
                ids, labels = (part[c].to_numpy().astype(np.int64) for c in ("id", "label"))
                block = int(np.frombuffer(np.random.default_rng().bytes(8), np.int64)[0])
                yield pa.RecordBatch.from_pydict({"block": [block], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "v": [v.astype(whole).tobytes()]})

    return pack


def _picked(width: int, whole: str, every: int):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels, v = _read(r, width, whole)
                at = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array(labels[at]), pa.array([x.tobytes() for x in v[at]], pa.binary())], names=["block", "pos", "id", "label", "v"])

    return pick


def _read(r: dict, width: int, whole: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), np.frombuffer(r["v"], whole).reshape(-1, width)


def _against(width: int, whole: str, same: bool, seen: Callable, names: list[str]):
    """Lay anchors with their windows against blocks: `seen` gets a window, the allowed rows' scores and their ids."""
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels, v = _read(r, width, whole)
                open_at: dict[int, list[dict]] = {}
                for w in r["windows"]:
                    open_at.setdefault(w["a"], []).append(w)
                order, out = sorted(open_at), []
                for at in range(0, len(order), 256):
                    some = order[at : at + 256]
                    scores = np.frombuffer(b"".join(r["anchors"][a]["v"] for a in some), whole).reshape(-1, width) @ v.T
                    for a, s in zip(some, scores, strict=True):
                        own = r["anchors"][a]
                        mine = labels == own["label"]
                        allowed = mine if same else ~mine
                        if own["block"] == r["block"]:
                            allowed[own["pos"]] = False
                        s, near = s[allowed].astype(np.int64), ids[allowed]
                        out += [(r["ablock"], a, w["w"], *x) for w in open_at[a] for x in seen(w, s, near)]
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

    return lay


def _counted(w: dict, s: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Rows of a window by digit, up to the digit with which this block alone has all that the window still wants: a later digit
    can't hold the k-th row, and the one that does is counted in every block."""
    if w["by_id"]:
        ids = ids[s == w["hi"]]
        keys = ids[(ids >= w["id_lo"]) & (ids <= w["id_hi"])] - w["id_lo"]
    else:
        keys = w["hi"] - s[(s <= w["hi"]) & (s >= w["lo"])]
    if len(keys):
        counts = np.bincount(keys >> w["shift"])
        stop = int(np.searchsorted(np.cumsum(counts), w["left"])) + 1
        digits = np.flatnonzero(counts[:stop])
        yield from zip(digits.tolist(), counts[digits].tolist(), [w["left"]] * len(digits), strict=True)


def _gathered(k: int):
    """Rows that qualify; of a block's, its k best."""
    def gather(w: dict, s: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        at = np.flatnonzero((s <= w["top"]) & ((s > w["lo"]) | ((s == w["lo"]) & (ids <= w["id_hi"]))))
        for i in at[np.lexsort((ids[at], -s[at]))[:k]]:
            yield int(ids[i]), int(s[i])

    return gather


def _bits(span: Column) -> Column:
    """How far to shift numbers from 0 to span so that DIGIT bits are left."""
    return F.greatest(F.lit(0), F.length(F.conv(span.cast("string"), 10, 2)) - DIGIT).cast("int")


def select(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, width: int, whole: str, id_range: tuple[int, int]) -> DataFrame:
    """(ablock, a, w, rank, id, score): of each window (ablock, a, w, lo, hi) the first k rows whose score lies in it, of the anchor's
    label (same) or of others, by score, ties by id."""
    key = ["ablock", "a", "w"]
    first, last = (F.lit(x).cast("long") for x in id_range)
    state = windows.filter("lo <= hi").select(*(F.col(c).cast("long").alias(c) for c in key), F.col("hi").alias("top"), "hi", "lo", F.lit(k).cast("long").alias("left"), F.lit(False).alias("by_id"), first.alias("id_lo"), last.alias("id_hi"), _bits(F.col("hi") - F.col("lo")).alias("shift"), F.lit(False).alias("done"))
    state = stored(state, "windows")
    number = "ablock long, a long, w long"

    def lay(open_windows: DataFrame, columns: list[str], seen: Callable, made: list[str], shape: str) -> DataFrame:
        grouped = open_windows.groupBy("ablock").agg(F.collect_list(F.struct("a", "w", *columns)).alias("windows"))
        laid = stored(anchors.join(grouped, "ablock"), "laid")  # few files, so that blocks times these are few tasks
        return blocks.crossJoin(laid).mapInArrow(_against(width, whole, same, seen, ["ablock", "a", "w", *made]), f"{number}, {shape}")

    while True:
        open_windows = state.filter(~F.col("done"))
        if open_windows.isEmpty():
            break
        counts = lay(open_windows, _WINDOW, _counted, ["digit", "n", "left"], "digit long, n long, left long").groupBy(*key, "digit", "left").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy("digit"))
        placed = counts.select(*key, "digit", "n", "left", upto.alias("upto"))
        held = placed.filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left"))).select(*key, "digit", "n", (F.col("left") - F.col("upto") + F.col("n")).alias("rest"))
        size = F.expr("shiftleft(1L, shift)")
        begin = F.expr("shiftleft(digit, shift)")
        got = state.join(held, key, "left")
        hit, narrow = F.col("digit").isNotNull(), F.col("digit").isNotNull() & ~F.col("by_id")
        hi = F.when(narrow, F.col("hi") - begin).otherwise(F.col("hi"))
        lo = F.when(narrow, F.greatest(F.col("lo"), F.col("hi") - begin - size + 1)).otherwise(F.col("lo"))
        ids = hit & F.col("by_id")
        id_hi = F.when(ids, F.least(F.col("id_hi"), F.col("id_lo") + begin + size - 1)).otherwise(F.col("id_hi"))
        id_lo = F.when(ids, F.col("id_lo") + begin).otherwise(F.col("id_lo"))
        step = got.select(*key, "top", hi.alias("hi"), lo.alias("lo"), F.coalesce("rest", "left").alias("left"), "by_id", id_lo.alias("id_lo"), id_hi.alias("id_hi"), "shift", "done", hit.alias("hit"), (F.col("n") == F.col("rest")).alias("full"))
        tie = F.col("hit") & ~F.col("full") & ~F.col("by_id") & (F.col("shift") == 0)
        ended = F.col("done") | ~F.col("hit") | F.col("full") | (F.col("by_id") & (F.col("shift") == 0))
        shift = F.when(tie, _bits(F.col("id_hi") - F.col("id_lo"))).otherwise(F.greatest(F.lit(0), F.col("shift") - DIGIT)).cast("int")
        state = stored(step.select(*key, "top", "hi", "lo", "left", (F.col("by_id") | tie).alias("by_id"), "id_lo", "id_hi", shift.alias("shift"), ended.alias("done")), "windows")
    rows = lay(state, ["top", "lo", "id_hi"], _gathered(k), ["id", "score"], "id long, score long")
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    return stored(rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*key, "rank", "id", "score"), "selected")


def hard_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores being inner products of floor(scale * x).

    Anchors are rows whose id is divisible by `every`; each has its first `positives` other rows of its label, and each of these the
    first `negatives` rows of other labels that score from `least` to `most` hundredths of it (fewer, if there are fewer). Higher
    scores come first, ties by id. Rows without an id, a label or a vector, or with a null or non-finite component take no part; an
    empty vector scores 0; a shorter vector counts as filled with zeros. Repeated rows are rows of their own: an anchor's copy can be
    its positive, and copies of an anchor each give their rows. Other columns are not read. Scores must fit a long and ids a range of
    2^62, else ValueError."""
    rows = usable(vectors, key, vector, F.col(label) if isinstance(label, str) else label)
    norm = F.aggregate("x", F.lit(0.0), lambda s, x: s + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))  # bounds every inner product
    stats = rows.agg(F.max(F.size("x")).alias("width"), F.max(norm).alias("norm"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(F.col("id") % every == 0).alias("n")).first()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not stats["n"]:
        return vectors.sparkSession.createDataFrame([], shape)
    if stats["norm"] >= 2.0**62:
        raise ValueError("inner products of these vectors don't fit a long")
    if stats["last"] - stats["first"] >= 2**62:
        raise ValueError("ids must lie within a range of 2^62")
    width, bound, whole = max(1, stats["width"]), int(stats["norm"]), "<f8" if stats["norm"] < 2.0**53 else "<i8"
    ids = (stats["first"], stats["last"])
    with scratch(vectors.sparkSession) as kept:
        blocks = stored(rows.mapInArrow(_packed(width, scale, whole), "block long, ids binary, labels binary, v binary"), "blocks")
        found = blocks.mapInArrow(_picked(width, whole, every), "block long, pos int, id long, label long, v binary")
        dealt = found.withColumn("ablock", F.pmod(F.xxhash64("block", "pos"), F.lit(-(-stats["n"] // ANCHORS))))
        anchors = stored(dealt.groupBy("ablock").agg(F.array_sort(F.collect_list(F.struct("block", "pos", "id", "label", "v"))).alias("anchors")), "anchors")
        named = anchors.select("ablock", F.posexplode("anchors").alias("a", "x")).select("ablock", "a", F.col("x.id").alias("anchor_id"))
        anywhere = named.select("ablock", "a", F.lit(0).alias("w"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"))
        near = select(blocks, anchors, anywhere, positives, True, width, whole, ids)
        pairs = near.select("ablock", "a", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        share = lambda x, how: F.expr(f"cast({how}(cast({x} as decimal(20,0)) * positive_score / 100) as long)")
        windows = pairs.select("ablock", "a", "w", share(least, "ceil").alias("lo"), share(most, "floor").alias("hi"))
        far = select(blocks, anchors, windows, negatives, False, width, whole, ids)
        joined = far.join(pairs, ["ablock", "a", "w"]).join(named, ["ablock", "a"])
        out = stored(joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        kept.append(out.stored_at)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
