"""Mixing sources to target weights: blocks of fixed length, drawn by weight into output shards. DataFrame functions only.

Method: the words of a source form one stream, cut into blocks of BLOCK words. Every output shard holds SHARD blocks; which
sources these come from is drawn at random for the shard. A source's n-th slot takes the block that the source's pseudorandom
permutation of block indices names, a new permutation for each pass over the source, and slots join blocks by that index.

The draw: every slot of a shard draws a source with the targets' odds, so a shard's counts are multinomial. Summed over shards such
counts miss the targets by their variance, and would take a source that stands at its limit (three times its size) a fourth time.
So a source that was drawn too often gives up slots picked by its permutation, and these go, permuted, to the sources that were
drawn too seldom. Every step treats all slots alike, so what results is the multinomial law given that each source gets exactly the
slots that its target needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, free_name, normal_text, on_files, permuted, stored, table, with_row_id

WEIGHTS = (5, 2, 1)  # fixed values
MOST = 3
BLOCK = 512
SHARD = 1024
SEED = 20240229
#: Rows of a source that one window sorts, about.
ROWS = 2048
#: Shards of which one task makes the slots, about, and tasks at most.
PART = 8
PARTS = 8192
#: Shards whose counts one window sums.
GROUP = 4096


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def target_sources(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, src, source_size, weight, target), and any other columns: src numbers sources by code point, null last.

    Targets by filling up: in order of most*size/weight, a source is at its limit if that is no more than an equal share by
    weight of what those before leave. One row per source meets in one task here: sums, never documents."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sources.withColumn("src", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(_lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    big = lambda c: c.cast("decimal(38,0)")
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    everyone = Window.partitionBy(F.lit(1))
    order = everyone.orderBy(F.col("limit") / F.col("weight"), "src")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    r = (
        ranked.withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("sum_w", F.sum("weight").over(everyone))
        .withColumn("limits", F.sum("limit").over(up_to) - F.col("limit"))
        .withColumn("rest_w", F.col("sum_w") - F.sum("weight").over(up_to) + F.col("weight"))
        .withColumn("capped", big(F.col("limit")) * big(F.col("rest_w")) <= big(F.col("weight")) * big(F.col("total") - F.col("limits")))
    )
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everyone)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(everyone), _lit(0))
    share = (F.col("weight") * left).cast("double") / free.cast("double")
    return r.withColumn("target", F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(share)).select("source", "src", "source_size", "weight", "target", *(c for c in sources.columns if c not in ("source", "source_size")))


def plan_sources(targets: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """Adds each source's blocks, passes and slots: whole passes take every block once, the last slot takes only the words that are left to the target."""
    size = F.col("source_size")
    quota = F.least(size * most, F.floor(F.col("target") + 0.5)).cast("long")
    p = targets.withColumn("quota", quota)
    p = p.withColumn("passes", F.when(size > 0, (quota - quota % F.greatest(size, _lit(1))) / F.greatest(size, _lit(1))).otherwise(0).cast("long"))
    p = p.withColumn("rest", F.col("quota") - F.col("passes") * size).withColumn("full", F.floor(size / block).cast("long")).withColumn("tail", size % block)
    p = p.withColumn("blocks", F.col("full") + F.when(F.col("tail") > 0, _lit(1)).otherwise(_lit(0)))
    p = p.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    order = Window.partitionBy(F.lit(1)).orderBy("src")
    return p.withColumn("base", F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("slots")).withColumn("all_slots", F.sum("slots").over(Window.partitionBy(F.lit(1))))


def _located(points: DataFrame, at: str, ranges: DataFrame, total: int, cells: int) -> DataFrame:
    """points with the columns of the one range (lo, hi exclusive) that holds their number `at`: both sides meet in cells of equal
    width, of which a range has one row each. The hint keeps Spark from broadcasting points, whose number it can't see."""
    width = max(1, -(-total // max(1, cells)))
    ranges = ranges.filter("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    met = points.withColumn("cell", F.floor(F.col(at) / width)).join(ranges.hint("shuffle_hash"), "cell")
    return met.filter((F.col("lo") <= F.col(at)) & (F.col(at) < F.col("hi"))).drop("cell", "lo", "hi")


def shard_counts(drawn: DataFrame) -> DataFrame:
    """The drawn matrix (shard, src, n), and `before`: n over all earlier shards, summed in groups of shards and over groups."""
    counts = drawn.groupBy("shard", "src").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("shard") / GROUP))
    up = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    groups = counts.groupBy("src", "part").agg(F.sum("n").alias("in_part"))
    groups = groups.select("src", "part", (F.sum("in_part").over(up("src").orderBy("part")) - F.col("in_part")).alias("ahead"))
    inside = F.sum("n").over(up("src", "part").orderBy("shard")) - F.col("n")
    return counts.withColumn("inside", inside).join(groups, ["src", "part"]).select("shard", "src", "n", (F.col("ahead") + F.col("inside")).alias("before"))


def draw_sources(plan: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The multinomial draw: shard, slot, src, as many slots as the plan has."""
    spark = plan.sparkSession
    total, n_sources = plan.agg(F.coalesce(F.sum("slots"), _lit(0)), F.count("*")).first()
    shards = -(-total // shard)
    rows = spark.range(0, shards, 1, max(1, min(PARTS, -(-shards // PART)))).withColumnRenamed("id", "shard")
    begin = F.col("shard") * shard
    slots = rows.select("shard", F.explode(F.sequence(_lit(0), F.least(_lit(shard), _lit(total) - begin) - 1)).alias("slot"))
    slots = slots.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), begin + F.col("slot")), _lit(max(1, total))))
    ranges = plan.select("src", F.col("base").alias("lo"), (F.col("base") + F.col("slots")).alias("hi"))
    return _located(slots, "draw", ranges, total, max(n_sources, shards)).select("shard", "slot", "src")


def draw_slots(plan: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row per slot: src, pass, block, take (words of the block that the mix takes), shard, slot. Stored."""
    drawn = stored(draw_sources(plan, shard, seed), "mix-drawn")
    matrix = stored(shard_counts(drawn), "mix-counts")
    up = Window.partitionBy(F.lit(1)).orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    got = plan.join(matrix.groupBy("src").agg(F.sum("n").alias("got")), "src", "left").withColumn("got", F.coalesce("got", _lit(0)))
    got = got.withColumn("over", F.greatest(F.col("got") - F.col("slots"), _lit(0))).withColumn("under", F.greatest(F.col("slots") - F.col("got"), _lit(0)))
    got = stored(got.withColumn("over_base", F.sum("over").over(up) - F.col("over")).withColumn("under_base", F.sum("under").over(up) - F.col("under")), "mix-got")
    moved, n_sources = got.agg(F.coalesce(F.sum("over"), _lit(0)), F.count("*")).first()

    # The n-th slot of a source in the order of shards becomes number `no` by the source's permutation.
    by_slot = F.row_number().over(Window.partitionBy("shard", "src").orderBy("slot")) - 1
    numbered = drawn.withColumn("n", by_slot).join(matrix.select("shard", "src", "before"), ["shard", "src"]).join(got.select("src", "got", "slots", "over_base"), "src")
    numbered = numbered.withColumn("no", permuted(F.col("before") + F.col("n"), F.col("got"), F.lit(seed), F.lit("order"), F.col("src")))
    numbered = stored(numbered.select("shard", "slot", "src", "no", (F.col("over_base") + F.col("no") - F.col("slots")).alias("given"), (F.col("no") < F.col("slots")).alias("stays")), "mix-numbered")
    given = numbered.filter("not stays").select("shard", "slot", permuted(F.col("given"), _lit(moved), F.lit(seed), F.lit("moved")).alias("to"))
    ranges = got.select("src", "got", "under_base", F.col("under_base").alias("lo"), (F.col("under_base") + F.col("under")).alias("hi"))
    to = _located(given, "to", ranges, moved, max(n_sources, -(-moved // shard))).select("shard", "slot", "src", (F.col("got") + F.col("to") - F.col("under_base")).alias("no"))
    s = numbered.filter("stays").select("shard", "slot", "src", F.col("no").alias("k")).union(to).join(plan, "src")
    s = s.withColumn("pass", ((F.col("k") - F.col("k") % F.col("blocks")) / F.col("blocks")).cast("long")).withColumn("j", F.col("k") % F.col("blocks"))
    inner = F.col("j") < F.col("full")
    s = s.withColumn("block", F.when(inner, permuted(F.col("j"), F.col("full"), F.lit(seed), F.col("src"), F.col("pass"))).otherwise(F.col("full")))
    whole = F.when(inner, _lit(block)).otherwise(F.col("tail"))
    s = s.withColumn("take", F.when(F.col("pass") < F.col("passes"), whole).otherwise(F.least(whole, F.col("rest") - F.col("j") * block)))
    slots = stored(s.select("src", "pass", "block", "take", "shard", F.col("slot").cast("int").alias("slot")), "mix-slots")
    dropped(drawn, matrix, got, numbered)
    return slots


def placed(sizes: DataFrame) -> DataFrame:
    """Adds each row's first word in its source's stream. The stream's order is by a hash of doc_id, so that the sums run over
    buckets of about ROWS rows, however many rows (column rows) a source has, and then over its buckets."""
    buckets = F.ceil(F.col("rows") / ROWS).cast("long")
    s = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "rid"), buckets))
    sums = s.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("src", "bucket", (F.sum("words").over(before) - F.col("words")).alias("ahead"))
    inside = Window.partitionBy("src", "bucket").orderBy("doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    return s.join(sums, ["src", "bucket"]).withColumn("first", F.col("ahead") + F.col("within")).drop("bucket", "ahead", "within")


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """Every document's words in the mix, one row per document, block and slot, and one at least per document.

    Columns: rid (the document's row), doc_id, size, source, source_size, target, pass, shard, slot, at (the first word's place
    in the slot), word (the first word's place in the document), taken (how many words; null: none).
    Null text has size 0, null source is a source. Repeated rows count each for itself. Stored."""
    docs = on_files(docs)
    sizes = with_row_id(docs).select("rid", "doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(normal_text(F.col("text")), F.lit(WORD)).cast("long").alias("size"))
    sizes = stored(sizes, "mix-sizes")
    plan = stored(plan_sources(target_sources(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))), block), "mix-plan")
    slots = draw_slots(plan, block, shard, seed)
    numbered = sizes.join(plan.select(F.col("source").alias("s"), "src", "source_size", "target", "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = placed(numbered)
    last = F.col("first") + F.col("size") - 1
    number = lambda c: ((c - c % block) / block).cast("long")
    pieces = rows.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(number(F.col("first")), number(last)))).alias("block"))
    begin = F.col("block") * block
    pieces = pieces.withColumn("lo", F.greatest(F.col("first") - begin, _lit(0))).withColumn("hi", F.least(F.col("first") + F.col("size") - begin, _lit(block))).withColumn("word", F.greatest(begin - F.col("first"), _lit(0)))
    met = pieces.join(slots, ["src", "block"], "left")
    taken = F.least("hi", "take") - F.col("lo")
    out = stored(met.select("rid", "doc_id", "size", "source", "source_size", "target", "pass", "shard", "slot", F.col("lo").alias("at"), "word", F.when(F.col("take").isNotNull() & (taken > 0), taken).alias("taken")), "mix")
    dropped(sizes, plan, slots)
    return out


def mixed_counts(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    return mix(docs).groupBy("rid", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum("taken"), _lit(0)).alias("taken")).drop("rid")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of docs: a row per pass in which a document has words. Taken whole, its text stays as
    it is; taken in part, its text is the taken words, in their order, joined by a space. n_chars follows the text."""
    docs = on_files(docs)
    got = mix(docs).filter("taken is not null").groupBy("rid", "pass").agg(F.sum("taken").alias("n"), F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("word", "taken"))).alias("runs"))
    row, runs = free_name(docs), free_name(docs, "__runs")
    whole = F.col("n") == F.col("size")
    texts = with_row_id(docs, row)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(words, (r["word"] + 1).cast("int"), r["taken"].cast("int")))), " ")
    out = texts.join(got.select(F.col("rid").alias(row), F.when(~whole, F.col("runs")).alias(runs)), row)
    out = out.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(table(spark, sf_dir, "documents"))
