"""Evidence, references, ingest and rendering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import ordered as O
from ..operators import ranking as R
from ..operators import search as S
from ..sources import articles as A
from ..sources import laws as W
from ..sources import upserts as U
from ..streaming import ledger as L
from .aggregates import EDGES, kg_edges
from .registry import Tables, query
from .search import COS, HYBRID, hybrid_hits, knn_sql
from .upkeep import _text, cleaned, fresh


@query("hits_with_full_text", "J1 S6", """
with h as (select case when doc_id % 7 = 0 then doc_id + 1000000 else doc_id end as doc_id, quality from labels)
select h.doc_id, quality, md5(coalesce(text, '(no text)')) as text_md5 from h left join documents d on d.doc_id = h.doc_id and d.doc_id % 10 = h.doc_id % 10""")
def hits_with_full_text(t: Tables) -> DataFrame:
    """Hits keep their place where the article they name isn't there."""
    k = F.col("doc_id")
    hits = t.labels.select(F.when(k % 7 == 0, k + 1000000).otherwise(k).alias("doc_id"), "quality").withColumn("article", F.col("doc_id") % 10)
    texts = t.documents.select("doc_id", (k % 10).alias("article"), "text")
    return hits.join(texts, ["doc_id", "article"], "left").select("doc_id", "quality", F.md5(F.coalesce("text", F.lit("(no text)"))).alias("text_md5"))


@query("edges_by_kind", "F13", "with " + EDGES + " select distinct head, tail, relation, confidence from e where relation in ('R', 'A') and confidence >= 0.7")
def edges_by_kind(t: Tables) -> DataFrame:
    return kg_edges(t).filter(F.col("relation").isin("R", "A") & (F.col("confidence") >= 0.7)).select("head", "tail", "relation", "confidence").distinct()


ARTICLES = """
a as (select p_brand as law, p_partkey, row_number() over (partition by p_brand order by p_partkey)::int as no, p_size, p_size % 7 + 1 as other, p_retailprice as score from part)"""


@query("reference_expansion", "R16 R14", "with " + ARTICLES.strip() + """,
h as (select law, no, p_size, other, row_number() over (partition by law order by score desc, no)::int as rank from a qualify rank <= 3),
r as (select law, rank, no, p_size as target, 1 as pos from h where p_size <> no union all select law, rank, no, other, 2 from h where other <> no and other <> p_size),
f as (select law, target, min(rank * 10 + pos) as place from r where (law, target) not in (select law, no from h) and (law, target) in (select law, no from a) group by all),
x as (select law, target, row_number() over (partition by law order by place)::int as i from f qualify i <= 5)
select law, no, rank, null::double as score from h union all select law, target, 3 + i, 0.0::double from x""")
def reference_expansion(t: Tables) -> DataFrame:
    """The articles that the three best hits of a law name follow them, five at most, with score 0."""
    a = R.ranked(t.part.withColumnRenamed("p_brand", "law"), ["law"], [F.col("p_partkey")], "no")
    text = F.format_string("依第%d條及第%d條", F.col("p_size"), F.col("p_size") % 7 + 1)
    hits = R.top_k(a, ["law"], [F.desc("p_retailprice"), F.col("no")], 3)
    named = hits.select("law", "rank", F.posexplode(X.own_reference_list(text, F.col("no"))).alias("pos", "target"))
    first = named.groupBy("law", "target").agg(F.min(F.struct("rank", "pos")).alias("place"))
    there = a.select("law", F.col("no").alias("target"))
    new = first.join(there, ["law", "target"], "left_semi").join(hits.select("law", F.col("no").alias("target")), ["law", "target"], "left_anti")
    more = R.top_k(new, ["law"], [F.col("place")], 5, "i")
    return hits.select("law", "no", "rank", F.lit(None).cast("double").alias("score")).union(more.select("law", F.col("target"), F.col("i") + 3, F.lit(0.0)))


@query("semantic_groups", "R28", """
with m as (select label, i, avg(x) as x from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all),
v as (select label, list(x order by i) as v, sqrt(sum(x * x)) as n from m group by label),
s as (select item_id, label, round(list_dot_product(e.embedding::double[], v.v) / v.n, 6) as cosine from benchmark join embeddings e on vec_id = item_id, (select label as label, v, n from v) v where true),
k as (select *, label = item_id % 10 and item_id % 3 = 0 as excluded, count(*) filter (not (label = item_id % 10 and item_id % 3 = 0)) over (partition by item_id) as others from s where cosine >= 0.1)
select item_id, label, cosine from k where not excluded or others = 0""".replace("join embeddings e on vec_id = item_id, (select label as label, v, n from v) v where true", "join (select vec_id, embedding from embeddings) e on vec_id = item_id cross join v"))
def semantic_groups(t: Tables) -> DataFrame:
    """Groups whose mean vector is close to a query's; one that the query excludes goes unless nothing else is left."""
    centres = S.centroid(t.embeddings, ["label"], "embedding", "mean")
    q = t.benchmark.select("item_id").join(t.embeddings.select(F.col("vec_id").alias("item_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "y")), "item_id")
    near = q.join(centres, "pos").groupBy("item_id", "label").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("cosine")).filter("cosine >= 0.1")
    out = near.withColumn("excluded", (F.col("label") == F.col("item_id") % 10) & (F.col("item_id") % 3 == 0))
    others = F.count_if(~F.col("excluded")).over(Window.partitionBy("item_id"))
    return out.withColumn("others", others).filter("not excluded or others = 0").select("item_id", "label", "cosine")


@query("article_entries", "R29", "with f as (" + HYBRID.replace("{n}", "15") + """),
j as (select query_id, source, lang, min(rank) as first from f join documents using (doc_id) where lang in ('en', 'fr') group by all)
select query_id, source, lang, row_number() over (partition by query_id order by first)::int as place from j qualify place <= 6""")
def article_entries(t: Tables) -> DataFrame:
    """The first six different articles (source, lang) of the hybrid hits in the languages asked for."""
    hits = hybrid_hits(t, 15).join(t.documents.select("doc_id", "source", "lang"), "doc_id").filter(F.col("lang").isin("en", "fr"))
    first = hits.groupBy("query_id", "source", "lang").agg(F.min("rank").alias("first"))
    return R.top_k(first, ["query_id"], [F.col("first")], 6, "place").select("query_id", "source", "lang", "place")


@query("compare_brief", "R37", """
with c as (select lang, source, count(*) as n, max(n_chars) as longest from documents where lang in ('fr', 'de') group by all),
r as (select *, row_number() over (partition by lang order by n desc, source) as r from c qualify r <= 3)
select lang, sum(n)::bigint as clauses, string_agg(source || ' (' || n || ', ' || longest || ')', '; ' order by r) as brief from r group by lang""")
def compare_brief(t: Tables) -> DataFrame:
    c = t.documents.filter(F.col("lang").isin("fr", "de")).groupBy("lang", "source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))
    top = R.top_k(c, ["lang"], [F.desc("n"), F.col("source")], 3)
    said = F.struct("rank", F.format_string("%s (%d, %d)", "source", "n", "longest").alias("x"))
    return top.groupBy("lang").agg(F.sum("n").alias("clauses"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["x"]), "; ").alias("brief"))


@query("template_summary", "C33", """
with c as (select c_nationkey, c_mktsegment, count(*) as n from customer where c_acctbal > 0 group by all),
r as (select *, row_number() over (partition by c_nationkey order by n desc, c_mktsegment) as r from c),
s as (select c_nationkey, count(*) as laws, sum(n)::bigint as clauses, string_agg('《' || c_mktsegment || '》', '、' order by r) filter (r <= 3) as named from r group by c_nationkey)
select n_name, case when laws is null then n_name || ': nothing found' else n_name || ': ' || named || ', ' || laws || ' laws, ' || clauses || ' clauses' end as summary from nation left join s on c_nationkey = n_nationkey""")
def template_summary(t: Tables) -> DataFrame:
    c = t.customer.filter("c_acctbal > 0").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    g = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("laws"), F.sum("n").alias("clauses"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "c_mktsegment"))), lambda x: x["c_mktsegment"]).alias("titles"))
    none = F.coalesce("titles", F.array().cast("array<string>"))
    return t.nation.join(g, "n_nationkey", "left").select("n_name", X.summary_text(F.col("n_name"), F.coalesce("laws", F.lit(0)), F.coalesce("clauses", F.lit(0)), none).alias("summary"))


@query("grouped_context", "C34", """
with r as (select source, doc_id, text, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents qualify r <= 5)
select source, md5('=== ' || source || ' ===' || chr(10) || string_agg('[' || doc_id || ']' || case when length(text) > 400 then substr(text, 1, 400) || '...(cut)' else text end, chr(10) order by r)) as context_md5 from r group by source""")
def grouped_context(t: Tables) -> DataFrame:
    """The five longest documents of a source as context: a heading, then each text, marked where it is cut."""
    top = R.top_k(t.documents, ["source"], [F.desc("n_chars"), F.col("doc_id")], 5)
    line = F.concat(F.lit("["), _text("doc_id"), F.lit("]"), X.cut_text(F.col("text"), 400))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("x")))), lambda x: x["x"])
    return top.groupBy("source").agg(lines.alias("lines")).select("source", F.md5(F.concat(F.lit("=== "), F.col("source"), F.lit(" ===\n"), F.array_join("lines", "\n"))).alias("context_md5"))


@query("path_texts", "C35 G15", "with " + EDGES + """,
h as (select distinct head as x, tail as y, relation, confidence, true as forward from e where head = 'p7' and tail <> 'p7' union select distinct tail, head, relation, confidence, false from e where tail = 'p7' and head <> 'p7')
select y, relation, confidence, forward, case when forward then x || ' —' || relation || '→ ' || y else x || ' ←' || relation || '— ' || y end as said from h""")
def path_texts(t: Tables) -> DataFrame:
    e = kg_edges(t).filter("head != tail")
    side = lambda x, y, f: e.filter(F.col(x) == "p7").select(F.col(x).alias("x"), F.col(y).alias("y"), "relation", "confidence", F.lit(f).alias("forward"))
    return side("head", "tail", True).union(side("tail", "head", False)).distinct().select("y", "relation", "confidence", "forward", X.step_text(F.col("x"), F.col("relation"), F.col("y"), F.col("forward")).alias("said"))


@query("beam_paths", "G16", "with " + EDGES + """,
d as (select head as x, tail as y, greatest(confidence, 0.05) as s from e union all select tail, head, greatest(confidence, 0.05) * 0.6 from e),
m as (select x, y, max(s) as s from d where x <> y group by all),
h as (select * from m qualify row_number() over (partition by x order by round(s, 9) desc, y) <= 3),
z as (select distinct head as seed from e where head in ('p7', 'p14', 'p21')),
one as (select seed, [seed, y] as path, s as score from z join h on x = seed),
b as (select * from one qualify row_number() over (partition by seed order by round(score, 9) desc, path) <= 4),
two as (select seed, list_append(path, y) as path, score * s as score from b join h on x = path[2] where not list_contains(path, y))
select seed, array_to_string(path, '>') as path, round(score, 6) as score from (select * from one union all select * from two)""")
def beam_paths(t: Tables) -> DataFrame:
    e = kg_edges(t).select("head", "tail", "confidence")
    seeds = e.select(F.col("head").alias("node")).filter(F.col("node").isin("p7", "p14", "p21")).distinct()
    return G.beam_paths(e, seeds).select("seed", F.array_join("path", ">").alias("path"), F.round("score", 6).alias("score"))


@query("target_articles", "G22", """
with h as (select l_suppkey, l_partkey % 40 as article, 0 as src, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as pos from lineitem where l_returnflag = 'R' qualify pos <= 2),
s as (select l_suppkey, l_partkey % 40 as article, 1 as src, row_number() over (partition by l_suppkey order by l_discount desc, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as pos from lineitem where l_returnflag = 'A' qualify pos <= 5),
f as (select l_suppkey, article, min(src * 100 + pos) as first from (select * from h union all select * from s) group by all)
select l_suppkey, article, case when first < 100 then 'retrieval' else 'similar_law' end as matched_by, row_number() over (partition by l_suppkey order by first)::int as place from f qualify place <= 3""")
def target_articles(t: Tables) -> DataFrame:
    """Retrieval's articles come first, then those that made the law similar, each once, three in all."""
    tie = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    li = t.lineitem.withColumn("article", F.col("l_partkey") % 40)
    hits = R.top_k(li.filter("l_returnflag = 'R'"), ["l_suppkey"], [F.desc("l_extendedprice"), *tie], 2)
    similar = R.top_k(li.filter("l_returnflag = 'A'"), ["l_suppkey"], [F.desc("l_discount"), *tie, F.col("l_extendedprice")], 5)
    both = hits.select("l_suppkey", "article", F.lit(0).alias("src"), "rank").union(similar.select("l_suppkey", "article", F.lit(1), "rank"))
    first = both.groupBy("l_suppkey", "article").agg(F.min(F.struct("src", "rank")).alias("first"))
    return R.top_k(first, ["l_suppkey"], [F.col("first")], 3, "place").select("l_suppkey", "article", F.when(F.col("first.src") == 0, "retrieval").otherwise("similar_law").alias("matched_by"), "place")


@query("deep_hops_first", "E13", """
with f as (select user_id, event_type as item, max(event_id % 3) as hop from events group by all),
p as (select e.user_id, item, hop, min(event_id) as pos from f join events e on e.user_id = f.user_id and e.event_type = item and event_id % 3 = hop group by all)
select user_id, item, row_number() over (partition by user_id order by hop desc, pos)::int as rank from p""")
def deep_hops_first(t: Tables) -> DataFrame:
    """A run list from found items: the deepest hop first, then the order found; each item once."""
    first = t.events.groupBy("user_id", F.col("event_type").alias("item")).agg(F.min(F.struct((-(F.col("event_id") % 3)).alias("hop"), "event_id")).alias("first"))
    return R.ranked(first, ["user_id"], [F.col("first")]).select("user_id", "item", "rank")


@query("path_levels", "G19", """
select l_orderkey, max(case when l_discount >= 0.07 then 'L1' when l_discount >= 0.03 then 'L2' else 'L3' end) as level from lineitem group by l_orderkey""")
def path_levels(t: Tables) -> DataFrame:
    """A path's steps have levels; the weakest decides."""
    step = F.when(F.col("l_discount") >= 0.07, "L1").when(F.col("l_discount") >= 0.03, "L2").otherwise("L3")
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_set(step).alias("steps")).select("l_orderkey", G.path_level(F.col("steps")).alias("level"))


def _law_files(t: Tables, where: str, path: str) -> None:
    item = F.struct(F.concat(F.lit("D"), _text("doc_id"), F.lit("_ART_001")).alias("doc_id"), F.col("text").alias("text_en"), _text(F.col("doc_id") % 9).alias("article_number"))
    laws = t.documents.filter(where).groupBy(F.col("source").alias("law_id"), F.col("lang").alias("jurisdiction")).agg(F.collect_list(item).alias("articles"))
    laws.write.mode("append").option("maxRecordsPerFile", 1).partitionBy("jurisdiction").json(path)


@query("ingested_articles", "S1 S2", """
select 'D' || doc_id || '_ART_001' as doc_id, source as law_id, 'jurisdiction=' || lang as jurisdiction, (doc_id % 9)::varchar as article_number, md5(text) as text_md5 from documents where lang <> 'en'""")
@cleaned
def ingested_articles(t: Tables) -> DataFrame:
    """One JSON file for each law, written by the query and read back; a file without a jurisdiction has its folder's name."""
    path = fresh(t, "laws")
    _law_files(t, "lang != 'en'", path)
    return A.read_articles(t.spark, path).select("doc_id", "law_id", "jurisdiction", "article_number", F.md5("text_en").alias("text_md5"))


@query("changed_law_files", "S20", "select count(distinct source) as new_files, (select count(distinct source) from documents where lang = 'fr') as old_files from documents where lang = 'de'")
@cleaned
def changed_law_files(t: Tables) -> DataFrame:
    """A manifest of the files there are, then more files: only these are new."""
    path, manifest = fresh(t, "laws"), fresh(t, "manifest")
    _law_files(t, "lang = 'fr'", path)
    A.changed_files(t.spark, path, None).write.parquet(manifest)
    _law_files(t, "lang = 'de'", path)
    old = t.spark.read.parquet(manifest)
    return A.changed_files(t.spark, path, old).agg(F.count("*").alias("new_files")).join(old.agg(F.count("*").alias("old_files")))


@query("upserted_rows", "S9", """
with n as (select o_orderkey % 5000 as k, o_totalprice as v, o_orderkey as version from orders where o_orderkey % 2 = 0 qualify row_number() over (partition by o_orderkey % 5000 order by o_orderkey desc) = 1),
o as (select o_orderkey as k, o_totalprice as v, 0::bigint as version from orders where o_orderkey % 3 = 0)
select k, v, version from n union all select k, v, version from o where k not in (select k from n)""")
def upserted_rows(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    new = t.orders.filter(k % 2 == 0).select((k % 5000).alias("k"), F.col("o_totalprice").alias("v"), k.alias("version"))
    old = t.orders.filter(k % 3 == 0).select(k.alias("k"), F.col("o_totalprice").alias("v"), F.lit(0).cast("long").alias("version"))
    return U.upsert(old, new, ["k"], "version")


@query("replaced_partitions", "S12", "select o_orderkey, case when o_orderstatus = 'P' then o_totalprice + 1 else o_totalprice end as price, o_orderstatus as status from orders where o_orderstatus <> 'P' or o_orderkey % 2 = 0")
@cleaned
def replaced_partitions(t: Tables) -> DataFrame:
    """A table by status, of which one status is written again."""
    path = fresh(t, "parts")
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    U.replace_partitions(rows, path, ["status"])
    U.replace_partitions(rows.filter("status = 'P' and o_orderkey % 2 = 0").withColumn("price", F.col("price") + 1), path, ["status"])
    return t.spark.read.parquet(path)


@query("seen_counts", "S14", "select user_id, event_type, count(*) as seen_count, min(event_id) as first_seen, max(event_id) as last_seen from events group by all")
def seen_counts(t: Tables) -> DataFrame:
    return U.count_seen(t.events, ["user_id", "event_type"], "event_id")


def _ledger_files(t: Tables, where: str, path: str) -> None:
    rows = t.events.filter(where).select(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("model"), F.lit("p").alias("purpose"), (F.col("event_id") % 100).cast("int").alias("total_tokens"), F.lit(True).alias("ok"))
    rows.write.mode("append").json(path)


@query("ledger_from_lines", "S18 A29", "select strftime(ts, '%Y-%m-%d') as day, event_type as model, count(*) as calls, sum(event_id % 100)::bigint as tokens from events group by all")
@cleaned
def ledger_from_lines(t: Tables) -> DataFrame:
    """Daily totals of JSON lines that the query writes; a line that can't be read is passed over."""
    path = fresh(t, "ledger")
    _ledger_files(t, "true", path)
    t.spark.createDataFrame([("not json",)], "value string").write.mode("append").option("compression", "none").text(path)
    got = L.ledger_table(t.spark, path)
    return got.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "model").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"))


@query("ledger_tail", "S42", "select event_type as model, count(*) as calls, count(*) filter (event_id % 2 = 1) as later from events group by all")
@cleaned
def ledger_tail(t: Tables) -> DataFrame:
    """A stream reads what is there, stops, and later reads only what has come since."""
    path, out, mark = fresh(t, "ledger"), fresh(t, "tail"), fresh(t, "mark")
    _ledger_files(t, "event_id % 2 = 0", path)
    stream = lambda: L.ledger_stream(t.spark, path).filter("ts is not null")
    first = L.append_new(stream(), out, mark).groupBy("model").agg(F.count("*").alias("n"))
    first = G.settled(first)
    _ledger_files(t, "event_id % 2 = 1", path)
    every = L.append_new(stream(), out, mark).groupBy("model").agg(F.count("*").alias("calls"))
    return every.join(first, "model", "left").select("model", "calls", (F.col("calls") - F.coalesce("n", F.lit(0))).alias("later"))


@query("merged_short_lines", "C6", r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
b as (select *, length(trim(line)) <= 1 as short, min(case when line <> '' then i end) over (partition by doc_id) as head from l),
g as (select *, i > head and short and lag(short) over (partition by doc_id order by i) as glue from b)
select doc_id, md5(coalesce(string_agg(case when i = head then line when glue then trim(line) else chr(10) || line end, '' order by i) filter (i >= head), '')) as text_md5 from g group by doc_id""")
def merged_short_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.merged_lines(F.col("text"))).alias("text_md5"))


@query("years_in_effect", "C14", """
select o_orderkey, round(date_diff('day', o_orderdate::date, (o_orderdate + to_days((o_custkey % 3000)::int))::date) / 365.25, 2) as years from orders""")
def years_in_effect(t: Tables) -> DataFrame:
    """Dates in three formats."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    begin = F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "yyyyMMdd"))
    end = F.date_format(F.date_add(day, (F.col("o_custkey") % 3000).cast("int")), "yyyy-MM-dd")
    return t.orders.select("o_orderkey", X.years_in_effect(begin, end).alias("years"))


@query("entity_slugs", "C16", r"select p_partkey, trim(regexp_replace(lower(trim(p_name || ' & ' || p_type || '!')), '[^a-z0-9_]+', '_', 'g'), '_') as slug from part")
def entity_slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.entity_slug(F.concat_ws(" & ", "p_name", F.concat("p_type", F.lit("!")))).alias("slug"))


@query("midpoint_halves", "C26", """
with p as (select doc_id, list_filter(string_split(replace(text, '.', '。'), '。'), lambda x: trim(x) <> '') as p from documents),
h as (select doc_id, p, ((len(p) + 1) // 2)::bigint as h from p)
select doc_id, md5(coalesce(array_to_string(list_transform(p[1:h], lambda x: x || '。'), ''), '')) as first_md5, md5(coalesce(array_to_string(list_transform(p[h + 1:len(p)], lambda x: x || '。'), ''), '')) as second_md5 from h""")
def midpoint_halves(t: Tables) -> DataFrame:
    halves = X.midpoint_split(F.replace("text", F.lit("."), F.lit("。")))
    return t.documents.select("doc_id", halves.alias("h")).select("doc_id", F.md5("h.first").alias("first_md5"), F.md5("h.second").alias("second_md5"))


@query("script_forms", "R12", "select p_partkey, array_to_string(list_distinct(list_sort([p_name, translate(p_name, 'xy', 'ae'), translate(p_name, 'ae', 'xy')])), '|') as n from part".replace("array_to_string(list_distinct(list_sort(", "array_to_string(list_sort(list_distinct("))
def script_forms(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.array_sort(X.script_variants(F.col("p_name"), "ae", "xy")), "|").alias("n"))


@query("named_laws", "R13", """
select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then p_type when 2 then 'Fair Trade Act' end as law from part""")
def named_laws(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("依《"), F.col("p_name"), F.lit("》第三條"))).when(k == 1, F.concat(F.lit('under "'), F.col("p_type"), F.lit('"'))).when(k == 2, F.lit("what of the Fair Trade Act")).otherwise(F.lit("no name here"))
    return t.part.select("p_partkey", X.named_law(text).alias("law"))


@query("region_routes", "R8", """
with q as (select s_suppkey, case when s_suppkey % 3 = 0 then 'laws of ' || lower(r_name) when s_suppkey % 3 = 1 then 'from region_0 to REGION_1' else 'none' end as q from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey)
select s_suppkey, coalesce(nullif(concat_ws(',', case when contains(lower(q), 'region_0') then 'a,b' end, case when contains(lower(q), 'region_1') then case when contains(lower(q), 'region_0') then 'c' else 'b,c' end end), ''), '') as groups from q""")
def region_routes(t: Tables) -> DataFrame:
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey") % 3
    q = F.when(k == 0, F.concat(F.lit("laws of "), F.lower("r_name"))).when(k == 1, "from region_0 to REGION_1").otherwise("none")
    return s.select("s_suppkey", F.array_join(X.routed_regions(q, {"REGION_0": ["a", "b"], "REGION_1": ["b", "c"]}), ",").alias("groups"))


@query("canonical_groups", "C30 A6", """
with r as (select case lower(trim(lang)) when 'fr' then 'French' when 'de' then 'German' else upper(trim(lang)) end as g, min(doc_id) as first from documents group by all) select g, row_number() over (order by first)::int as place from r""")
def canonical_groups(t: Tables) -> DataFrame:
    first = t.documents.groupBy(X.canonical_group(F.col("lang"), {"fr": "French", "de": "German"}).alias("g")).agg(F.min("doc_id").alias("first"))
    return R.ranked(first.withColumn("one", F.lit(1)), ["one"], [F.col("first")], "place").select("g", "place")


@query("topic_labels", "C29", """
with x as (select c_custkey, unnest([c_mktsegment, 'T' || c_nationkey]) as topic from customer), m as (select c_mktsegment as label, 'S' || row_number() over (order by c_mktsegment) as id from (select distinct c_mktsegment from customer))
select c_custkey, array_to_string(list_sort(list(distinct coalesce(id, topic))), ',') as ids from x left join m on label = topic group by c_custkey""")
def topic_labels(t: Tables) -> DataFrame:
    """Labels become ids by a map; what is an id already stays."""
    labels = R.ranked(t.customer.select(F.col("c_mktsegment").alias("topic"), F.lit(1).alias("one")).distinct(), ["one"], [F.col("topic")], "i").select("topic", F.concat(F.lit("S"), _text("i")).alias("id"))
    x = t.customer.select("c_custkey", F.explode(F.array(F.col("c_mktsegment"), F.concat(F.lit("T"), _text("c_nationkey")))).alias("topic"))
    return x.join(labels, "topic", "left").groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("id", "topic"))), ",").alias("ids"))


@query("clean_triples", "C23", """
with r as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, l_discount * 20 - 0.3 as c, case when l_partkey % 11 = 0 then ' ' else 'p' || l_partkey end as head, substr('s' || l_suppkey || repeat('x', (l_partkey % 50)::int), 1, 40) as tail from lineitem)
select l_orderkey, l_linenumber, l_partkey, head, tail, case when l_returnflag in ('A', 'R') then l_returnflag else 'related' end as relation, round(greatest(0.0, least(1.0, c)), 6) as confidence from r where trim(head) <> '' and trim(tail) <> ''""")
def clean_triples(t: Tables) -> DataFrame:
    """Relations off the list become the default, confidences are clipped, long names cut, triples without an end dropped."""
    from ..operators.entities import clean_triples as clean

    k = F.col("l_partkey")
    raw = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("p"), _text(k))).alias("head"), F.concat(F.lit("s"), _text("l_suppkey"), F.repeat(F.lit("x"), (k % 50).cast("int"))).alias("tail"), F.col("l_returnflag").alias("relation"), (F.col("l_discount") * 20 - 0.3).alias("confidence"))
    return clean(raw, ["A", "R"], "related", 40).withColumn("confidence", F.round("confidence", 6))


@query("score_gaps", "T7", """
with a as (select doc_id as a, n_chars as x, row_number() over (order by n_chars desc, doc_id) as i from documents where lang = 'fr' qualify i <= 20), b as (select doc_id as b, n_chars as y, row_number() over (order by n_chars desc, doc_id) as i from documents where lang = 'de' qualify i <= 20)
select a, b, abs(x - y) as gap, row_number() over (order by abs(x - y) desc, a)::int as place from a join b using (i) qualify place <= 5""")
def score_gaps(t: Tables) -> DataFrame:
    side = lambda lang, n, v: R.top_k(t.documents.filter(F.col("lang") == lang), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 20, "i").select("i", F.col("doc_id").alias(n), F.col("n_chars").alias(v))
    j = side("fr", "a", "x").join(side("de", "b", "y"), "i").select("a", "b", F.abs(F.col("x") - F.col("y")).alias("gap"), F.lit(1).alias("one"))
    return R.top_k(j, ["one"], [F.desc("gap"), F.col("a")], 5, "place").drop("one")


@query("vector_only_search", "R26 W2 W22 W21", "with " + knn_sql(15, "x.vec_id < y.vec_id or x.vec_id > y.vec_id", "(select * from embeddings where vec_id in (select item_id from benchmark))") + """,
d as (select a, b, lb, cosine, rank, row_number() over (partition by a, lb order by rank) as in_group from k),
g as (select a, b, cosine, row_number() over (partition by a order by rank)::int as rank from d where in_group = 1),
p as (select *, row_number() over (partition by a order by (b % 7 = 3)::int desc, rank)::int as pinned from g),
s as (select *, case when pinned > 5 then 2 else 0 end as stage, (b * 37 % 101)::double as fresh from p)
select a, b, cosine, pinned, row_number() over (partition by a order by stage, case when stage = 0 then fresh end desc nulls last, pinned)::int as new_rank from s""")
def vector_only_search(t: Tables) -> DataFrame:
    """Nearest vectors, the best of each label, an exact hit pinned, the first five scored again (here by a stand-in for a model)."""
    q = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = S.knn(q, t.embeddings, "vec_id", "embedding", 15).join(t.embeddings.select(F.col("vec_id").alias("b"), "label"), "b")
    best = R.ranked(R.keep_best(near, ["a", "label"], [F.col("rank")]).drop("label").withColumnRenamed("rank", "old"), ["a"], [F.col("old")])
    pinned = R.pinned(best, ["a"], F.col("b") % 7 == 3).drop("rank").withColumnRenamed("new_rank", "rank")
    out = R.two_stage(pinned, ["a"], (F.col("b") * 37 % 101).cast("double"), 5, F.lit(False))
    return out.select("a", "b", F.round("cosine", 6).alias("cosine"), F.col("rank").alias("pinned"), "new_rank")


@query("finalised_evidence", "R33 T6", """
with r as (select user_id, event_id, value, event_type = 'purchase' as p, row_number() over (partition by user_id, event_type = 'purchase' order by value desc, event_id) as i from events),
c as (select *, row_number() over (partition by user_id order by (case when p and i <= 3 then 0 else 1 end), value desc, event_id)::int as place from r qualify place <= 8)
select user_id, event_id, place, coalesce(c_name, 'user ' || user_id) as title, o_orderstatus as status from c left join customer on c_custkey = user_id join orders on o_orderkey = event_id where o_orderstatus <> 'P'""")
def finalised_evidence(t: Tables) -> DataFrame:
    """Converge to eight, fill in what is missing from the tables, drop rows that stay without content."""
    c = R.converge(t.events, ["user_id"], F.col("event_type") == "purchase", 3, 8, [F.desc("value"), F.col("event_id")]).select("user_id", "event_id", "place")
    title = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    status = t.orders.filter("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("status"))
    return c.join(title, "user_id", "left").join(status, "event_id").select("user_id", "event_id", "place", F.coalesce("c_name", F.concat(F.lit("user "), _text("user_id"))).alias("title"), "status")


@query("cascade_of_modes", "R36", """
with x as (select c_custkey as q, 0 as mode, o_orderkey as item from customer join orders on o_custkey = c_custkey where o_orderstatus = 'P' union all
  select c_custkey, 1, o_orderkey from customer join orders on o_custkey = c_custkey where o_orderstatus = 'F' union all select c_custkey, 2, -1 from customer)
select q, mode, count(*) as n, min(item) as first from x qualify mode = min(mode) over (partition by q) group by all""".replace("select q, mode, count(*) as n, min(item) as first from x qualify mode = min(mode) over (partition by q) group by all", "select q, mode, count(*) as n, min(item) as first from (select *, min(mode) over (partition by q) as m from x) where mode = m group by all"))
def cascade_of_modes(t: Tables) -> DataFrame:
    """The first of three ways that finds anything: cross, entity, flat."""
    orders = t.customer.select(F.col("c_custkey").alias("q")).join(t.orders, F.col("q") == F.col("o_custkey"))
    of = lambda s, m: orders.filter(F.col("o_orderstatus") == s).groupBy("q").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first")).withColumn("mode", F.lit(m))
    flat = t.customer.select(F.col("c_custkey").alias("q"), F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("first"), F.lit(2).alias("mode"))
    ways = of("P", 0).unionByName(of("F", 1)).unionByName(flat)
    return R.keep_best(ways, ["q"], [F.col("mode")]).select("q", "mode", "n", "first")


@query("law_status", "R35", """
with s as (select o_custkey, max(o_orderstatus) as live, count(*) as n from orders group by all)
select c_custkey, case coalesce(case when c_custkey % 5 = 0 then null else c_mktsegment end, live) when 'F' then 'repealed' when 'O' then 'in force' when 'P' then 'pending' else 'unknown' end as status, coalesce(n, 0)::bigint as n from customer left join s on o_custkey = c_custkey""")
def law_status(t: Tables) -> DataFrame:
    """The catalog's status, else the index's, by a map of names."""
    live = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("live"), F.count("*").alias("n"))
    status = F.coalesce(F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")), "live")
    said = F.coalesce(*(F.when(status == k, v) for k, v in (("F", "repealed"), ("O", "in force"), ("P", "pending"))), F.lit("unknown"))
    return t.customer.join(live, "c_custkey", "left").select("c_custkey", said.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


@query("linked_entities", "G17", "with n as (select x.vec_id as a, y.vec_id as b, " + COS + """ as c from embeddings x join benchmark on item_id = x.vec_id, embeddings y where y.label <> 9 and x.vec_id <> y.vec_id),
k as (select a, b, row_number() over (partition by a order by round(c, 9) desc, b)::int as rank from n qualify rank <= 3),
w as (select distinct p_name, p_partkey as entity from part qualify row_number() over (partition by p_name order by p_partkey) = 1),
l as (select item_id as a, entity as b from benchmark join w on contains(lower(text), split_part(p_name, ' ', 1))),
u as (select a, b, 0 as src, 0 as rank from l union all select a, b, 1, rank from k),
f as (select a, b, min(src * 100 + rank) as first from u group by all)
select a, b, case when first < 100 then 'alias' else 'vector' end as source, row_number() over (partition by a order by first, b)::int as place from f qualify place <= 5""")
def linked_entities(t: Tables) -> DataFrame:
    """Entities whose alias a query has, then those whose vectors are near, each once, five in all."""
    q = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = S.knn(q, t.embeddings.filter("label != 9"), "vec_id", "embedding", 3).select("a", "b", F.lit(1).alias("src"), "rank")
    names = R.keep_best(t.part, ["p_name"], [F.col("p_partkey")]).select(F.split("p_name", " ")[0].alias("alias"), F.col("p_partkey").alias("b"))
    texts = t.benchmark.select(F.col("item_id").alias("a"), F.lower("text").alias("text"))
    met = O.containing(texts.select("text").distinct(), "text", names.select("alias").distinct(), "alias")
    alias = texts.join(met, "text").join(names, "alias").select("a", "b", F.lit(0).alias("src"), F.lit(0).alias("rank"))
    first = alias.union(near).groupBy("a", "b").agg(F.min(F.struct("src", "rank")).alias("first"))
    return R.top_k(first, ["a"], [F.col("first"), F.col("b")], 5, "place").select("a", "b", F.when(F.col("first.src") == 0, "alias").otherwise("vector").alias("source"), "place")


@query("centroid_table", "S26", """
with c as (select label, count(*) as n from embeddings group by label), o as (select label, count(*) as n from embeddings where label % 3 <> 0 or vec_id % 2 = 0 group by label)
select label, c.n, case when o.n is null then 'new' when o.n <> c.n then 'rebuilt' else 'kept' end as how from c left join o using (label) where label <> 9""")
@cleaned
def centroid_table(t: Tables) -> DataFrame:
    """A table of centroids is written, its source grows: only labels whose count has changed are built anew; one is deleted."""
    path = fresh(t, "centroids")

    def built(v: DataFrame) -> DataFrame:
        c = S.centroid(v, ["label"], "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda x: x["x"]).alias("vector"))
        return v.groupBy("label").agg(F.count("*").alias("n")).join(c, "label").select("vector", "n", "label")

    U.replace_partitions(built(t.embeddings.filter("label % 3 != 0 or vec_id % 2 = 0")), path, ["label"])
    old = G.settled(t.spark.read.parquet(path).select(F.col("label").cast("int").alias("label"), F.col("n").alias("old")))
    now = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    stale = now.join(old, "label", "left").filter("old is null or old != n").select("label")
    U.replace_partitions(built(t.embeddings.join(stale, "label", "left_semi")), path, ["label"])
    table = t.spark.read.parquet(path).select(F.col("label").cast("int").alias("label"), "n").filter("label != 9")
    return table.join(old, "label", "left").select("label", "n", F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("n"), "rebuilt").otherwise("kept").alias("how"))


@query("summary_cache", "S28", """
with c as (select c_custkey as id, c_acctbal as body, case when c_custkey % 4 = 0 then 'old' else 'v2' end as version from customer where c_custkey % 2 = 0),
n as (select c_custkey as id, c_acctbal + 1 as body, 'v2' as version from customer where c_custkey % 6 = 0),
m as (select * from n union all select * from c where id not in (select id from n))
select id, body, version from m where version <> 'old' and id % 10 <> 0""")
def summary_cache(t: Tables) -> DataFrame:
    """Put, replace, purge of another version, delete."""
    rows = lambda where, add: t.customer.filter(where).select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") + add).alias("body"))
    cache = rows("c_custkey % 2 = 0", 0).withColumn("version", F.when(F.col("id") % 4 == 0, "old").otherwise("v2"))
    merged = U.upsert(cache, rows("c_custkey % 6 = 0", 1).withColumn("version", F.lit("v2")), ["id"])
    return U.delete(merged, U.stale(merged, "version", "v2").unionByName(merged.filter("id % 10 = 0")), ["id"])


@query("catalog_upsert", "S33", """
with o as (select source, 1::bigint as chunks from documents where source in ('src1', 'src2') group by source), n as (select source, count(*) as chunks, count(distinct case when trim(lang) <> '' then lang end) as articles from documents where source <> 'src2' group by source)
select source, chunks, articles from n union all select source, chunks, 0 from o where source not in (select source from n)""")
def catalog_upsert(t: Tables) -> DataFrame:
    old = t.documents.filter(F.col("source").isin("src1", "src2")).select("source").distinct().select("source", F.lit(1).cast("long").alias("chunks"), F.lit(0).cast("long").alias("articles"))
    chunks = t.documents.filter("source != 'src2'").select(F.col("source").alias("law_id"), F.lit("j").alias("jurisdiction"), F.col("lang").alias("article_number"), F.array("lang").alias("topics"))
    new = A.catalog(chunks).select(F.col("law_id").alias("source"), F.col("total_chunks").alias("chunks"), F.col("total_articles").alias("articles"))
    return U.upsert(old, new, ["source"])


@query("law_writeback", "S21", """
with r as (select p_brand as law, p_partkey as n, p_name as title from part where p_brand in (select min(p_brand) from part)),
u as (select law, n, case when n % 5 = 0 then title || ' (amended)' else title end as title from r where n % 3 <> 0)
select law || '_' || n as id, title from u union all select min(law) || '_' || (max(n) + 1), 'new law' from r""")
def law_writeback(t: Tables) -> DataFrame:
    """Create (the highest number plus one), update and delete rows of a law table as one batch."""
    first = t.part.agg(F.min("p_brand").alias("p_brand"))
    rows = t.part.join(first, "p_brand", "left_semi").select(F.concat_ws("_", "p_brand", _text("p_partkey")).alias("id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("n"), F.col("p_brand").alias("law"))
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    new = rows.groupBy("law").agg((F.max(number) + 1).alias("n")).select(F.concat_ws("_", "law", _text("n")).alias("id"), F.lit("new law").alias("title"))
    amended = rows.filter("n % 5 = 0").select("id", F.concat("title", F.lit(" (amended)")).alias("title"))
    left = U.delete(U.upsert(rows.select("id", "title"), amended, ["id"]), rows.filter("n % 3 = 0"), ["id"])
    return left.unionByName(new)


@query("laws_written_back", "S21", """
with r as (select p_partkey // 40 as law, 'j' || (p_partkey // 40 % 3) as j, p_partkey as n, p_name as title, p_size as size from part),
k as (select j, law, n, case when law % 7 = 0 then title || ' (amended)' else title end as title from r where law % 5 <> 0 and (law % 7 <> 0 or size >= 10)),
m as (select j, max(law) as top from r group by j),
d as (select distinct 'j' || (s_suppkey % 3) as j, 'd' || (s_suppkey % 2) as draft from supplier),
c as (select d.j, draft, coalesce(top, 0) + row_number() over (partition by d.j order by draft) as law from d left join m using (j))
select j as jurisdiction, j || '_' || law as law_id, n::varchar as doc_id, title from k union all select j, j || '_' || law, draft, 'new law' from c""")
@cleaned
def laws_written_back(t: Tables) -> DataFrame:
    """Laws are written to files; some are replaced, some deleted, some created under the next number; the files are read again."""
    path, law = fresh(t, "laws"), F.floor(F.col("p_partkey") / 40)
    j = F.concat(F.lit("j"), _text(law % 3))
    rows = t.part.select(j.alias("jurisdiction"), F.concat_ws("_", j, _text(law)).alias("law_id"), _text("p_partkey").alias("doc_id"), F.col("p_name").alias("article_title"), law.alias("law"), "p_size")
    drafts = t.supplier.select(F.concat(F.lit("j"), _text(F.col("s_suppkey") % 3)).alias("jurisdiction"), F.concat(F.lit("d"), _text(F.col("s_suppkey") % 2)).alias("draft")).distinct()
    W.write_laws(rows, path)
    created = W.with_new_ids(drafts.withColumns({"doc_id": F.col("draft"), "article_title": F.lit("new law")}), W.read_laws(t.spark, path).select("jurisdiction", "law_id").distinct())
    W.write_laws(G.settled(created), path)
    W.write_laws(rows.filter("law % 7 = 0 and p_size >= 10").withColumn("article_title", F.concat("article_title", F.lit(" (amended)"))), path)
    W.delete_laws(rows.filter("law % 5 = 0"), path)
    return W.read_laws(t.spark, path).select("jurisdiction", "law_id", "doc_id", F.col("article_title").alias("title"))
