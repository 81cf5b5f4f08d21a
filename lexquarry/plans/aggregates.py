"""Catalogs, dashboards and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import ranking as R
from .registry import Tables, query


@query("law_rollup", "A1 S33", """
with c as (select source, lang, count(*) as c from documents group by source, lang), m as (select source, lang, row_number() over (partition by source order by c desc, lang) as r from c)
select source, m.lang, g.chunks, g.items from m join (select source, count(*) as chunks, count(distinct n_chars % 97) as items from documents group by source) g using (source) where r = 1""")
def law_rollup(t: Tables) -> DataFrame:
    return A.rollup_groups(t.documents.select("source", "lang", (F.col("n_chars") % 97).alias("item")), "source", "lang", "item")


@query("terms_with_subterms", "A2 F11", """
with p as (select source, lang, count(*) as sub_count from documents where source not in ('src3') group by all),
t as (select source, sum(sub_count)::bigint as count from p group by source order by count desc, source limit 10),
r as (select p.source, lang, sub_count, count, row_number() over (partition by p.source order by sub_count desc, lang)::int as rank from p join t using (source))
select * from r where rank <= 3""")
def terms_with_subterms(t: Tables) -> DataFrame:
    return A.terms(t.documents, "source", "lang", 10, 3, ["src3"])


@query("topic_frequencies", "A3", "select p_type, count(*) as count from part group by p_type order by count desc, p_type limit 100")
def topic_frequencies(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "p_type").limit(100)


@query("owner_topic_distribution", "A4", """
with c as (select o_custkey % 30 as owner, p_brand as topic, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by all),
r as (select *, row_number() over (partition by owner order by n desc, topic)::int as rank from c) select * from r where rank <= 50""")
def owner_topic_distribution(t: Tables) -> DataFrame:
    li = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    c = li.groupBy((F.col("o_custkey") % 30).alias("owner"), F.col("p_brand").alias("topic")).agg(F.count("*").alias("n"))
    return R.top_k(c, ["owner"], [F.desc("n"), F.col("topic")], 50)


@query("topic_samples", "A5", """
with r as (select p_brand, p_partkey, count(*) over (partition by p_brand) as n, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey)::int as rank from part)
select * from r where rank <= 3""")
def topic_samples(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return R.top_k(t.part, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "rank").join(n, "p_brand")


@query("distinct_in_first_order", "A6 C30", """
with r as (select upper(lang) as lang, min(doc_id) as first from documents group by all) select lang, row_number() over (order by first)::int as place from r""")
def distinct_in_first_order(t: Tables) -> DataFrame:
    first = t.documents.groupBy(F.upper("lang").alias("lang")).agg(F.min("doc_id").alias("first"))
    return first.select("lang", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("first")).alias("place"))


@query("kg_stats", "A7", """
with e as (select l_suppkey % 25 as j, l_partkey as law from lineitem), tot as (select count(distinct p_partkey) as laws from part)
select j, count(*) as triples, count(distinct law) as laws, round(count(distinct law)::double / max(tot.laws), 6) as coverage from e, tot group by j""")
def kg_stats(t: Tables) -> DataFrame:
    total = t.part.agg(F.countDistinct("p_partkey").alias("all_laws"))
    got = t.lineitem.groupBy((F.col("l_suppkey") % 25).alias("j")).agg(F.count("*").alias("triples"), F.countDistinct("l_partkey").alias("laws"))
    return got.crossJoin(total).select("j", "triples", "laws", F.round(F.col("laws") / F.col("all_laws"), 6).alias("coverage"))


EDGES = """e as (select 'p' || (l_partkey % 300) as head, 'p' || (l_suppkey * 7 % 300) as tail, l_returnflag as relation, 'j' || (l_suppkey % 25) as jurisdiction,
  'a' || (l_orderkey % 60) as article, round(0.5 + l_discount * 5, 2) as confidence from lineitem)"""


def kg_edges(t: Tables) -> DataFrame:
    label = lambda c, x: F.concat(F.lit(x), c.cast("string"))
    return t.lineitem.select(
        label(F.col("l_partkey") % 300, "p").alias("head"), label(F.col("l_suppkey") * 7 % 300, "p").alias("tail"), F.col("l_returnflag").alias("relation"),
        label(F.col("l_suppkey") % 25, "j").alias("jurisdiction"), label(F.col("l_orderkey") % 60, "a").alias("article"), F.round(0.5 + F.col("l_discount") * 5, 2).alias("confidence"),
    )


@query("kg_quality", "A8", "with " + EDGES + """,
r as (select head, relation, tail, max(confidence) as c from e where head <> tail group by all),
n as (select count(distinct x) as nodes from (select head as x from e union all select tail from e)),
l as (select count(distinct x) as linked from (select head as x from r union all select tail from r)),
f as (select count(*) as edges, round(avg(c), 6) as mean_confidence, count(*) filter (c < 0.6) as below_60, count(*) filter (c >= 0.6 and c < 0.8) as below_80,
  count(*) filter (c >= 0.8 and c < 0.9) as below_90, count(*) filter (c >= 0.9) as from_90 from r)
select nodes, edges, round(2.0::double * edges / nodes, 6) as mean_degree, round(2.0::double * edges / (nodes * (nodes - 1)), 9) as density,
  round((nodes - linked)::double / nodes, 6) as orphans, mean_confidence, below_60, below_80, below_90, from_90 from f, n, l""")
def kg_quality(t: Tables) -> DataFrame:
    return A.graph_quality(kg_edges(t))


@query("kg_quality_counts", "A8", "with " + EDGES + """,
r as (select distinct head, relation, tail from e where head <> tail), n as (select distinct node from (select head as node from r union all select tail from r)),
t as (select 'p' || (p_partkey % 300) as node, min(p_brand) as type from part where p_size < 10 group by all),
c as (select 'relation' as what, relation as value, count(*) as n from r group by all union all select 'type', coalesce(type, 'unknown'), count(*) from n left join t using (node) group by all)
select what, value, n, round(n / sum(n) over (partition by what), 6) as share from c""")
def kg_quality_counts(t: Tables) -> DataFrame:
    types = t.part.filter("p_size < 10").select(F.concat(F.lit("p"), (F.col("p_partkey") % 300).cast("string")).alias("node"), F.col("p_brand").alias("type"))
    return A.graph_counts(kg_edges(t), types)


@query("concept_matrix", "A9 T5", "with " + EDGES + """,
x as (select jurisdiction, article, head as concept from e union all select jurisdiction, article, tail from e),
c as (select concept, jurisdiction, count(distinct article) as articles from x group by all),
t as (select concept, count(*) as jurisdictions, sum(articles)::bigint as total from c group by concept having count(*) >= 2 order by jurisdictions desc, total desc, concept limit 20)
select concept, jurisdiction, articles, jurisdictions, total from c join t using (concept)""")
def concept_matrix(t: Tables) -> DataFrame:
    return A.concept_matrix(kg_edges(t), 2, 20)


@query("concept_detail", "A10", "with " + EDGES + """,
x as (select jurisdiction, article, relation, head as concept from e union all select jurisdiction, article, relation, tail from e)
select jurisdiction, article, array_to_string(list_sort(list(distinct relation)), ',') as relations from x where concept = 'p7' group by jurisdiction, article""")
def concept_detail(t: Tables) -> DataFrame:
    x = kg_edges(t).filter("head = 'p7' or tail = 'p7'")
    return x.groupBy("jurisdiction", "article").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))


@query("overview_kpis", "A11", """
select count(*) as laws, count(distinct o_custkey) as owners, strftime(min(o_orderdate), '%Y-%m-%d') as first_date, strftime(max(o_orderdate), '%Y-%m-%d') as last_date,
  round(sum(o_totalprice), 2) as total, (select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 1) as last_key from orders""")
def overview_kpis(t: Tables) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.orders.agg(
        F.count("*").alias("laws"), F.countDistinct("o_custkey").alias("owners"), day(F.min("o_orderdate")).alias("first_date"), day(F.max("o_orderdate")).alias("last_date"),
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_key"),
    )


@query("by_jurisdiction_list", "A12", """
select n_name, count(*) as laws, array_to_string(list(s_name order by s_suppkey), ',') as names from supplier join nation on n_nationkey = s_nationkey group by n_name""")
def by_jurisdiction_list(t: Tables) -> DataFrame:
    s = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]), ",")
    return s.groupBy("n_name").agg(F.count("*").alias("laws"), names.alias("names"))


@query("by_topic_first_laws", "A13", """
with r as (select c_mktsegment, c_nationkey, c_custkey, row_number() over (partition by c_mktsegment order by c_custkey) as r from customer)
select c_mktsegment, count(*) as laws, count(distinct c_nationkey) as jurisdictions, array_to_string(list(c_custkey order by c_custkey) filter (r <= 5), ',') as first_laws from r group by c_mktsegment""")
def by_topic_first_laws(t: Tables) -> DataFrame:
    r = R.top_k(t.customer.select("c_mktsegment", "c_custkey"), ["c_mktsegment"], [F.col("c_custkey")], 5, "r")
    first = r.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("first_laws"))
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("laws"), F.countDistinct("c_nationkey").alias("jurisdictions")).join(first, "c_mktsegment")


@query("period_trend_cumulative", "A14 W7", """
with p as (select strftime(o_orderdate, '%Y-%m') as period, o_orderpriority as j, count(*) as n from orders group by all)
select period, j, n, sum(n) over (partition by j order by period)::bigint as cumulative, sum(n) over (partition by period)::bigint as period_total from p""")
def period_trend_cumulative(t: Tables) -> DataFrame:
    p = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderpriority").alias("j")).agg(F.count("*").alias("n"))
    return A.running_total(p, ["j"], "period", "n", "cumulative").withColumn("period_total", F.sum("n").over(Window.partitionBy("period")))


@query("radar_normalised", "A15 A39", """
with c as (select r_name as j, p_brand as topic, count(*) as n from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
  join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by all having count(*) >= 3),
t as (select topic from c group by topic order by sum(n) desc, topic limit 10), j as (select distinct j from c),
f as (select j.j, t.topic, coalesce(n, 0)::bigint as n from j cross join t left join c on c.j = j.j and c.topic = t.topic)
select j, topic, n, round(100.0::double * n / max(n) over (), 1) as scaled from f""")
def radar_normalised(t: Tables) -> DataFrame:
    li = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    li = li.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    c = li.groupBy(F.col("r_name").alias("j"), F.col("p_brand").alias("topic")).agg(F.count("*").alias("n")).filter("n >= 3")
    topics = c.groupBy("topic").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "topic").limit(10).select("topic")
    full = A.zero_filled(c, c.select("j").distinct(), topics, ["j", "topic"], "n")
    return full.withColumn("scaled", F.round(F.lit(100.0) * F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))), 1))


@query("catalog_stats", "A16", """
select n_name, o_orderstatus, year(o_orderdate)::int as year, count(*) as n, grouping(n_name, o_orderstatus, year)::int as level
from (select n_name, o_orderstatus, o_orderdate, year(o_orderdate)::int as year from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)
group by grouping sets ((n_name), (o_orderstatus), (year), ())""".replace("year(o_orderdate)::int as year, count", "year, count"))
def catalog_stats(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).withColumn("year", F.year("o_orderdate"))
    return A.grouping_sets(o, [["n_name"], ["o_orderstatus"], ["year"], []], F.count("*").alias("n"))


USAGE = """u as (select strftime(ts, '%Y-%m-%d') as day, event_type as purpose, 'm' || (user_id % 4) as model, value, event_id % 10 <> 0 as ok, (props->>'$.k')::bigint as tokens from events)"""


def usage(t: Tables) -> DataFrame:
    return t.events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("purpose"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), "value",
        (F.col("event_id") % 10 != 0).alias("ok"), F.get_json_object("props", "$.k").cast("long").alias("tokens"),
    )


@query("usage_grouping_sets", "A17", "with " + USAGE + """
select day, purpose, model, count(*) as calls, count(*) filter (ok) as good, count(*) filter (not ok) as failed, sum(tokens)::bigint as tokens,
  round(avg(value), 4) as mean_latency, round(count(*) filter (not ok) / count(*)::double, 6) as fail_rate, grouping(day, purpose, model)::int as level
from u group by grouping sets ((), (day), (purpose), (model))""")
def usage_grouping_sets(t: Tables) -> DataFrame:
    return A.grouping_sets(
        usage(t), [[], ["day"], ["purpose"], ["model"]],
        F.count("*").alias("calls"), F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("failed"), F.sum("tokens").alias("tokens"),
        F.round(F.avg("value"), 4).alias("mean_latency"), F.round(F.count_if(~F.col("ok")) / F.count("*"), 6).alias("fail_rate"),
    )


@query("ledger_daily", "A29 S18", "with " + USAGE + " select day, count(*) as calls, sum(tokens)::bigint as tokens, round(sum(value), 2) as cost from u group by day")
def ledger_daily(t: Tables) -> DataFrame:
    return usage(t).groupBy("day").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("value"), 2).alias("cost"))


QA = "q as (select d.doc_id, d.lang, l.quality, l.toxic, (d.doc_id % 6)::int as faith from labels l join documents d using (doc_id))"


def _qa(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "quality", "toxic", (F.col("doc_id") % 6).cast("int").alias("faith"))


@query("qa_eval_rollup", "A18 E8", "with " + QA + """
select lang, count(*) as n, round(avg(quality), 6) as has_answer, round(avg(nullif(faith, 0)), 6) as faithfulness,
  count(*) filter (faith between 1 and 2) as low, count(*) filter (faith = 3) as mid, count(*) filter (faith >= 4) as high from q group by rollup (lang)""")
def qa_eval_rollup(t: Tables) -> DataFrame:
    faith = F.col("faith")
    return _qa(t).rollup("lang").agg(
        F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("has_answer"), F.round(F.avg(F.nullif(faith, F.lit(0))), 6).alias("faithfulness"),
        F.count_if(faith.between(1, 2)).alias("low"), F.count_if(faith == 3).alias("mid"), F.count_if(faith >= 4).alias("high"),
    )


@query("subset_metrics", "A19 E4", "with " + QA + """, s as (select *, case when doc_id % 2 = 0 then 'template' else 'legacy' end as subset, case when doc_id % 5 = 0 then null else quality::double end as m from q)
select coalesce(subset, 'all') as subset, count(*) as n, count(m) as valid, round(avg(m), 6) as mean from s group by grouping sets ((subset), ())""")
def subset_metrics(t: Tables) -> DataFrame:
    s = _qa(t).withColumn("subset", F.when(F.col("doc_id") % 2 == 0, "template").otherwise("legacy")).withColumn("m", F.when(F.col("doc_id") % 5 != 0, F.col("quality").cast("double")))
    g = A.grouping_sets(s, [["subset"], []], F.count("*").alias("n"), F.count("m").alias("valid"), F.round(F.avg("m"), 6).alias("mean"))
    return g.select(F.coalesce("subset", F.lit("all")).alias("subset"), "n", "valid", "mean")


HITS = "h as (select l_partkey % 80 as law, l_orderkey as chunk, l_linenumber, l_suppkey, l_extendedprice as sim from lineitem where l_quantity > 25)"


def _hits(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_quantity > 25").select((F.col("l_partkey") % 80).alias("law"), F.col("l_orderkey").alias("chunk"), "l_linenumber", "l_suppkey", F.col("l_extendedprice").alias("sim"))


@query("hits_to_laws", "A20 A23 A24 A30", "with " + HITS + """,
r as (select *, row_number() over (partition by law order by sim desc, chunk, l_linenumber, l_suppkey) as r from h)
select law, max(sim) as best, count(*) as hits, array_to_string(list(chunk order by r) filter (r <= 3), ',') as top_chunks from r group by law""")
def hits_to_laws(t: Tables) -> DataFrame:
    h = _hits(t)
    totals = h.groupBy("law").agg(F.max("sim").alias("best"), F.count("*").alias("hits"))
    top = R.top_k(h, ["law"], [F.desc("sim"), F.col("chunk"), F.col("l_linenumber"), F.col("l_suppkey")], 3)
    top = top.groupBy("law").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"].cast("string")), ",").alias("top_chunks"))
    return totals.join(top, "law")


@query("compare_aggregate", "A21", "with " + HITS + """,
d as (select law, chunk % 50 as article, max(sim) as sim from h group by all)
select law, count(*) as articles, max(sim) as best, sum(sim::decimal(12,2))::double as total from d group by law""")
def compare_aggregate(t: Tables) -> DataFrame:
    d = _hits(t).groupBy("law", (F.col("chunk") % 50).alias("article")).agg(F.max("sim").alias("sim"))
    return d.groupBy("law").agg(F.count("*").alias("articles"), F.max("sim").alias("best"), F.sum(F.col("sim").cast("decimal(12,2)")).cast("double").alias("total"))


@query("compare_stats", "A22 A25", "with " + HITS + """, s as (select case when law % 2 = 0 then 'a' else 'b' end as side, * from h)
select side, count(*) as n, count(distinct law) as laws, sum(sim::decimal(12,2))::double as total, max(sim) as best from s group by side""")
def compare_stats(t: Tables) -> DataFrame:
    side = F.when(F.col("law") % 2 == 0, "a").otherwise("b").alias("side")
    return _hits(t).groupBy(side).agg(F.count("*").alias("n"), F.countDistinct("law").alias("laws"), F.sum(F.col("sim").cast("decimal(12,2)")).cast("double").alias("total"), F.max("sim").alias("best"))


@query("gold_manifest", "A32", """
select source, lang, count(*) as n, grouping(source, lang)::int as level from documents group by grouping sets ((source), (lang), ())""")
def gold_manifest(t: Tables) -> DataFrame:
    return A.grouping_sets(t.documents, [["source"], ["lang"], []], F.count("*").alias("n"))


@query("evidence_gaps", "A33", """
with e as (select lang, count(*) as n from documents where n_chars > 6000 group by lang), x(lang) as (values ('en'), ('fr'), ('it'))
select coalesce(x.lang, e.lang) as lang, coalesce(n, 0) as n, e.lang is null as gap from x full join e using (lang)""")
def evidence_gaps(t: Tables) -> DataFrame:
    e = t.documents.filter("n_chars > 6000").groupBy("lang").agg(F.count("*").alias("n"), F.lit(True).alias("found"))
    expected = t.spark.createDataFrame([("en",), ("fr",), ("it",)], "lang string")
    return expected.join(e, "lang", "full").select("lang", F.coalesce("n", F.lit(0)).alias("n"), F.col("found").isNull().alias("gap"))


@query("arm_summary", "A34", "with " + USAGE + """
select model, count(*) as n, count(distinct purpose) as kinds, sum(tokens)::bigint as tokens, round((count(*) - count(distinct tokens))::double / count(*), 6) as dup_rate,
  count(*) filter (purpose = 'view') as views, count(*) filter (purpose = 'click') as clicks from u group by model""")
def arm_summary(t: Tables) -> DataFrame:
    return usage(t).groupBy("model").agg(
        F.count("*").alias("n"), F.countDistinct("purpose").alias("kinds"), F.sum("tokens").alias("tokens"), F.round((F.count("*") - F.countDistinct("tokens")) / F.count("*"), 6).alias("dup_rate"),
        F.count_if(F.col("purpose") == "view").alias("views"), F.count_if(F.col("purpose") == "click").alias("clicks"),
    )


@query("latency_stage_summary", "A35", """
select event_type, user_id % 3 as kind, count(*) as calls, round(median(value), 4) as median, max(value) as most, round(sum(value), 2) as total from events group by all""")
def latency_stage_summary(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", (F.col("user_id") % 3).alias("kind")).agg(F.count("*").alias("calls"), F.round(F.median("value"), 4).alias("median"), F.max("value").alias("most"), F.round(F.sum("value"), 2).alias("total"))


@query("auto_relevance", "A36 E1", """
select d.doc_id, case when l.doc_id is null then 0 when l.quality = 1 then 2 else 1 end as relevance from documents d left join labels l using (doc_id)""")
def auto_relevance(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality").isNull(), 0).when(F.col("quality") == 1, 2).otherwise(1).alias("relevance"))


@query("gold_union", "A37", """
select doc_id % 30 as base, count(distinct lang || '/' || source) as gold, array_to_string(list_sort(list(distinct lang)), ',') as langs from documents group by base""")
def gold_union(t: Tables) -> DataFrame:
    return t.documents.groupBy((F.col("doc_id") % 30).alias("base")).agg(F.countDistinct(F.concat_ws("/", "lang", "source")).alias("gold"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("answer_arm_scores", "A38", """
with g as (select user_id, list(distinct event_type) filter (event_id % 2 = 0) as gold, list(distinct event_type) filter (event_id % 3 = 0) as cited from events group by user_id)
select user_id, len(coalesce(gold, [])) as gold, len(list_intersect(coalesce(gold, []), coalesce(cited, []))) as covered, len(list_intersect(coalesce(gold, []), coalesce(cited, []))) = len(coalesce(gold, [])) as complete from g""".replace("as gold, len(list", "as n_gold, len(list"))
def answer_arm_scores(t: Tables) -> DataFrame:
    pick = lambda m: F.collect_set(F.when(F.col("event_id") % m == 0, F.col("event_type")))
    g = t.events.groupBy("user_id").agg(pick(2).alias("gold"), pick(3).alias("cited"))
    covered = F.size(F.array_intersect("gold", "cited")).cast("long")
    return g.select("user_id", F.size("gold").cast("long").alias("n_gold"), covered.alias("covered"), (covered == F.size("gold")).alias("complete"))


@query("alias_statistics", "A40", """
with n as (select p_name, count(distinct p_brand) as aliases from part group by p_name)
select count(*) as names, sum(aliases)::bigint as aliases, count(*) filter (aliases > 1) as multi, max(aliases) as most from n""")
def alias_statistics(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_name").agg(F.countDistinct("p_brand").alias("aliases"))
    return n.agg(F.count("*").alias("names"), F.sum("aliases").alias("aliases"), F.count_if(F.col("aliases") > 1).alias("multi"), F.max("aliases").alias("most"))
