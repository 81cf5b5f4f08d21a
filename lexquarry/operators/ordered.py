"""Operators on ordered rows: carry-forward, islands, overlap, folds whose result depends on the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled
from .ranking import top_k


def carried(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """The last known value up to this row (as-of within a group)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def backfilled(df: DataFrame, by: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Null or blank values become the group's first known one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = {c: F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns}
    return df.withColumns({c: F.coalesce(v, F.first(v, ignorenulls=True).over(w)) for c, v in known.items()})


def islands(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, name: str = "island") -> DataFrame:
    """Number runs of one value; a change begins a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    marked = df.withColumn("__new", change.cast("int"))
    return marked.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def changes(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Only the rows where the value differs from the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__last", F.lag(value).over(w)).withColumn("__no", F.row_number().over(w)).filter(F.expr(f"__no = 1 or not `{value}` <=> __last")).drop("__last", "__no")


def next_pairs(df: DataFrame, by: Sequence[str], order: Sequence[Column], item: str) -> DataFrame:
    """Each row's item with the next one's of its group."""
    return df.withColumn("next", F.lead(item).over(Window.partitionBy(*by).orderBy(*order))).filter("next is not null")


def overlap(before: Column, text: Column, least: int = 30, most: int = 170) -> Column:
    """The longest k, least <= k <= most, for which text begins with the last k characters of before; 0 if none.

    The text's first `least` characters are looked for in before's end: the first place they are found at is the longest k that can
    be. All lengths are tried only where that one doesn't fit."""
    limit = F.least(F.length(before), F.length(text), F.lit(most))
    tail = F.right(before, limit)
    at = F.instr(tail, F.substr(text, F.lit(1), F.lit(least)))
    fits = F.filter(F.sequence(F.lit(least), F.greatest(limit, F.lit(least))), lambda k: (k <= limit) & (F.substr(text, F.lit(1), k) == F.right(before, k)))
    every = F.coalesce(F.array_max(fits), F.lit(0))
    found = F.when(F.startswith(text, F.substr(tail, at)), limit - at + 1).otherwise(every)
    return F.when((limit < least) | (at == 0), 0).otherwise(found) if least > 0 else every


def joined_text(df: DataFrame, by: Sequence[str], order: str, text: str, least: int = 30, most: int = 170) -> DataFrame:
    """Texts of a group in order, each without what repeats the end of the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    cut = overlap(F.lag(text, 1, "").over(w), F.col(text), least, most)
    trimmed = df.withColumn("__cut", cut).withColumn("__part", F.substr(F.col(text), F.col("__cut") + 1))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__part").alias("t"))))
    return trimmed.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias(text))


def numbered_rows(df: DataFrame, by: str, order: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 0 within `by`, however many a group has: numbers run within ranges of the order, and the ranges' counts are
    summed over ranges. The rows are stored first, as ranges are drawn by sampling."""
    ranged = settled(df.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()))
    up = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    counts = ranged.groupBy(by, "__part").agg(F.count("*").alias("__n"))
    ahead = counts.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), (F.sum("__n").over(up) - F.col("__n")).alias("__ahead"))
    within = ranged.withColumn("__in", F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order)).cast("long") - 1)
    joined = within.join(ahead, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn(name, F.col("__ahead") + F.col("__in")).select(*df.columns, name)


def grams(text: Column, n: int = 3) -> Column:
    """The distinct runs of n characters of a text; of a shorter one, itself."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(runs)


def containing(long: DataFrame, text: str, short: DataFrame, name: str) -> DataFrame:
    """(text, name): which texts contain which names, of columns that are distinct in their tables.

    Texts are indexed by their runs of three characters, as rows of a run and the text's digest. A name meets the texts that have its
    rarest run (names of one or two characters: the texts' runs of that length), and only then are the texts fetched and compared."""
    texts = long.filter(F.col(text).isNotNull()).select(F.unhex(F.md5(text)).alias("__id"), F.col(text).alias("__text")).distinct()
    names = short.filter(F.col(name) != "").select(F.col(name).alias("__name")).distinct()
    kinds = F.array_distinct(F.concat(grams(F.col("__text"), 1), grams(F.col("__text"), 2), grams(F.col("__text"), 3)))
    wanted = names.select("__name", F.explode(grams(F.col("__name"))).alias("__gram"))
    index = settled(texts.select("__id", F.explode(kinds).alias("__gram")).join(wanted.select("__gram").distinct(), "__gram", "left_semi"))
    often = wanted.join(index.groupBy("__gram").agg(F.count("*").alias("__n")), "__gram", "left")
    rarest = often.groupBy("__name").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("gram"))).alias("__best"))
    met = rarest.filter("__best.n > 0").select("__name", F.col("__best.gram").alias("__gram")).join(index, "__gram").select("__id", "__name")
    return met.join(texts, "__id").filter(F.contains("__text", "__name")).select(F.col("__text").alias(text), F.col("__name").alias(name))


def prefixed(long: DataFrame, text: str, short: DataFrame, prefix: str) -> DataFrame:
    """Rows of long with each row of short whose prefix the text begins with: beginnings of the prefixes' lengths meet prefixes by
    equality, with the text's digest in place of the text, and rows of long meet what was found."""
    lengths = short.select(F.length(prefix).alias("n")).distinct()
    every = lengths.agg(F.array_sort(F.collect_set("n")).alias("__lengths"))  # numbers up to the longest prefix
    texts = long.select(F.col(text).alias("__text")).filter("__text is not null").distinct().join(every)
    starts = texts.select(F.unhex(F.md5("__text")).alias("__id"), F.explode(F.transform(F.filter("__lengths", lambda n: n <= F.length("__text")), lambda n: F.substr(F.col("__text"), F.lit(1), n))).alias("__start"))
    met = starts.join(short, F.col("__start") == F.col(prefix)).drop("__start")
    return long.withColumn("__id", F.unhex(F.md5(text))).join(met, "__id").drop("__id")


def greedy_distinct(items: Column, most_alike: float) -> Column:
    """Fold over an array of strings in order: keep one if its characters' Jaccard with every kept one is under the limit."""
    chars = lambda s: F.array_distinct(F.split(s, ""))
    alike = lambda a, b: F.size(F.array_intersect(chars(a), chars(b))) / F.size(F.array_union(chars(a), chars(b)))
    none = F.array().cast("array<string>")
    return F.aggregate(items, none, lambda kept, x: F.when(F.exists(kept, lambda k: alike(k, x) >= most_alike), kept).otherwise(F.array_append(kept, x)))


def greedy_quota(rows: Column, each: int, total: int) -> Column:
    """Fold over an array of (group, key, text hash) in order: take a row unless its group or the total is full, or its hash was taken."""
    kind = "array<struct<g:string,k:bigint,h:string>>"

    def step(kept: Column, x: Column) -> Column:
        same = F.size(F.filter(kept, lambda y: y["g"].eqNullSafe(x["g"])))
        seen = F.exists(kept, lambda y: y["h"] == x["h"])
        return F.when((F.size(kept) >= total) | (same >= each) | seen, kept).otherwise(F.array_append(kept, x))

    return F.aggregate(rows, F.array().cast(kind), step)


def quota_candidates(df: DataFrame, by: str, group: str, key: str, size: str, digest: str, each: int, total: int) -> DataFrame:
    """The rows that decide greedy_quota over all rows in order of size, then key: (by, group, key, size, digest, rank).

    A row left out is one the fold never takes, so leaving it out changes nothing: a second row of one group and digest; of a digest,
    what comes after as many groups as can be full and one more; of a group, what comes after each + total rows, as at most total
    digests are taken. Then the fold is done before it has passed over every row that full groups and taken digests can refuse."""
    order = [F.desc(size), F.col(key)]
    alone = F.when(F.col(digest).isNull(), F.monotonically_increasing_id())  # rows without a text are no copies of one another
    first = F.min(F.struct(F.col(size).isNull(), -F.col(size), F.col(key).alias("key"), F.col(size).alias("size")))
    got = df.groupBy(by, group, digest, alone.alias("__alone")).agg(first.alias("__first")).select(by, group, F.col("__first.key").alias(key), F.col("__first.size").alias(size), digest, "__alone")
    full = total // each
    got = top_k(got, [by, digest, "__alone"], order, full + 1).drop("rank", "__alone")
    got = top_k(got, [by, group], order, each + total).drop("rank")
    return top_k(got, [by], order, total + full * (each + total) + total * (full + 1))


def degree_capped(edges: DataFrame, by: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """Edges (a, b) in order, without those whose ends are both full when they come.

    The first `most` edges of a node are always taken, as it isn't full before; so an edge goes only if it is later than that at both
    ends, which ranks tell without a fold."""
    ends = edges.withColumn("__node", F.explode(F.array_distinct(F.array("a", "b"))))
    return top_k(ends, [*by, "__node"], order, most).drop("__node", "rank").distinct()
