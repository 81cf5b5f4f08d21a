"""Plans of test topics over regions: one family within a region, one within a document of a region, one across regions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

#: Topics with as many feasible regions at most are rare, or mid; the order in which a region takes one of each (fixed values).
RARE, MID, TIERS = 2, 5, ("rare", "mid", "common")
#: Topics of a region in the first family; rows of a region in both families, least and most in the second; regions that a topic across
#: regions needs, and how many such topics (fixed values).
WITHIN, BOTH, LEAST, MOST, ACROSS, TOPICS = 4, 6, 2, 4, 3, 8


def tiered(cells: DataFrame) -> DataFrame:
    """Feasible cells (region, topic, n) with the number of the topic's regions and its tier."""
    spread = cells.groupBy("topic").agg(F.count("*").alias("regions"))
    tier = F.when(F.col("regions") <= RARE, TIERS[0]).when(F.col("regions") <= MID, TIERS[1]).otherwise(TIERS[2])
    return cells.join(spread, "topic").withColumn("tier", tier)


def _within(order: Sequence[str]):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                pools.setdefault(r["region"], []).append(r)
        used, out = {}, []
        for region in order:
            best = lambda rows: sorted(rows, key=lambda r: (used.get(r["topic"], 0), -r["n"], r["topic"]))  # noqa: E731, B023
            pool, taken = pools.get(region, []), []
            for tier in TIERS:
                taken += best([r for r in pool if r["tier"] == tier])[:1]
            left = [r for r in pool if r["topic"] not in {t["topic"] for t in taken}]
            taken = (taken + best(left)[: max(0, WITHIN - len(taken))])[:WITHIN]
            for place, r in enumerate(taken, 1):
                used[r["topic"]] = used.get(r["topic"], 0) + 1
                out.append((region, r["topic"], place))
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("region", "topic", "place"), map(list, zip(*out, strict=True)), strict=True)), pa.schema([("region", pa.string()), ("topic", pa.string()), ("place", pa.int32())]))

    return choose


def first_family(tiers: DataFrame, order: Sequence[str]) -> DataFrame:
    """(region, topic, place): regions choose in turn, first a topic of each tier and then up to WITHIN in all, those least often chosen
    by earlier regions first, then those with most rows.

    Earlier regions have chosen fewer than WITHIN times the regions' number, so of a region's tier only as many of the largest topics
    (and a few) can be chosen: the others leave before the one task in which regions take turns. What it gets is bounded by the given
    list of regions, not by the topics."""
    most = WITHIN * (len(order) + 1)
    kept = top_k(tiers.filter(F.col("region").isin(list(order))), ["region", "tier"], [F.desc("n"), F.col("topic")], most).select("region", "topic", "tier", "n")
    return kept.repartition(1).mapInArrow(_within(order), "region string, topic string, place int")


def planned(rows: DataFrame, order: Sequence[str], least: int) -> DataFrame:
    """(family, region, topic, document, place, n) from rows (region, topic, document), a row each.

    A cell of region and topic is feasible with `least` rows. F1: first_family(). F2: a region's topics within one document, feasible
    by themselves, those not in its F1 first, then the largest; as many as bring the region to BOTH, but LEAST to MOST. F3: topics of
    at least ACROSS regions, the first TOPICS by their number, with the two regions that have most rows (ties by the order given).
    Rows with a null region or topic are left out, those of other regions than given too; null documents take no part in F2."""
    place = F.element_at(F.create_map(*(x for i, r in enumerate(order) for x in (F.lit(r), F.lit(i)))), F.col("region")) if order else F.lit(None).cast("int")
    known = rows.filter(F.col("region").isin(list(order)) & F.col("topic").isNotNull())
    cells = known.groupBy("region", "topic").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    tiers = tiered(cells)
    one = first_family(tiers, order)
    within = known.filter("document is not null").groupBy("region", "topic", "document").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    had = one.groupBy("region").agg(F.count("*").alias("had"))
    seen = within.join(one.select("region", "topic", F.lit(1).alias("seen")), ["region", "topic"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    two = top_k(seen, ["region"], [F.col("seen"), F.desc("n"), F.col("document"), F.col("topic")], MOST, "place").join(had, "region", "left")
    need = F.least(F.greatest(F.lit(BOTH) - F.coalesce("had", F.lit(0)), F.lit(LEAST)), F.lit(MOST))
    two = two.filter(F.col("place") <= need)
    chosen = top_k(tiers.filter(F.col("regions") >= ACROSS).select("topic", "regions", F.lit(1).alias("all")).distinct(), ["all"], [F.desc("regions"), F.col("topic")], TOPICS, "place").select("topic", "place")
    pair = top_k(tiers.withColumn("at", place), ["topic"], [F.desc("n"), F.col("at")], 2).join(chosen, "topic").withColumn("place", ((F.col("place") - 1) * 2 + F.col("rank")).cast("int"))
    none = F.lit(None).cast(rows.schema["document"].dataType).alias("document")
    first = one.join(cells, ["region", "topic"]).select(F.lit("F1").alias("family"), "region", "topic", none, "place", "n")
    second = two.select(F.lit("F2").alias("family"), "region", "topic", "document", "place", "n")
    return first.unionByName(second).unionByName(pair.select(F.lit("F3").alias("family"), "region", "topic", none, "place", "n"))
