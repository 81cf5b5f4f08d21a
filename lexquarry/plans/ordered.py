"""Window, join and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import ranking as R
from .registry import Tables, query

LI = "l_extendedprice, l_partkey, l_suppkey"


@query("collapse_first_row", "W1 S25", f"""
select l_orderkey, l_linenumber, l_partkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by l_linenumber, {LI}) as r from lineitem) where r = 1""")
def collapse_first_row(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")]
    return R.keep_best(t.lineitem, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("dedupe_keep_best_cut", "W2 E3", """
with d as (select l_orderkey % 100 as q, l_partkey as law, max(l_extendedprice) as score from lineitem group by all)
select q, law, score, row_number() over (partition by q order by score desc, law)::int as rank from d qualify rank <= 10""")
def dedupe_keep_best_cut(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy((F.col("l_orderkey") % 100).alias("q"), F.col("l_partkey").alias("law")).agg(F.max("l_extendedprice").alias("score"))
    return R.top_k(d, ["q"], [F.desc("score"), F.col("law")], 10)


@query("dedupe_keep_longest", "W14", "select source, lang, doc_id, n_chars from documents qualify row_number() over (partition by source, lang order by n_chars desc, doc_id) = 1")
def dedupe_keep_longest(t: Tables) -> DataFrame:
    return R.keep_best(t.documents, ["source", "lang"], [F.desc("n_chars"), F.col("doc_id")]).select("source", "lang", "doc_id", "n_chars")


@query("keep_first", "W15", "select md5(text) as id, min(doc_id) as doc_id from documents group by id")
def keep_first(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("id")).agg(F.min("doc_id").alias("doc_id"))


@query("dedupe_keep_max_conf", "W16", """
select l_partkey, l_returnflag, l_suppkey, l_discount, l_orderkey from (select *, row_number() over (partition by l_partkey, l_returnflag, l_suppkey order by l_discount desc, l_orderkey) as r from lineitem) where r = 1""")
def dedupe_keep_max_conf(t: Tables) -> DataFrame:
    return R.keep_best(t.lineitem, ["l_partkey", "l_returnflag", "l_suppkey"], [F.desc("l_discount"), F.col("l_orderkey")]).select("l_partkey", "l_returnflag", "l_suppkey", "l_discount", "l_orderkey")


@query("consecutive_pairs", "W8", """
select * from (select user_id, event_id, lead(event_id) over (partition by user_id order by ts, event_id) as next from events) where next is not null""")
def consecutive_pairs(t: Tables) -> DataFrame:
    return O.next_pairs(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_id").select("user_id", "event_id", "next")


@query("backfill_first_non_null", "W9", """
with b as (select user_id, event_id, ts, case when event_id % 3 = 0 then null when event_id % 5 = 0 then ' ' else event_type end as d from events)
select user_id, event_id, coalesce(case when trim(d) <> '' then d end, first_value(case when trim(d) <> '' then d end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)) as d from b""")
def backfill_first_non_null(t: Tables) -> DataFrame:
    d = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_type"))
    return O.backfilled(t.events.withColumn("d", d), ["user_id"], [F.col("ts"), F.col("event_id")], ["d"]).select("user_id", "event_id", "d")


@query("overlap_trim", "W10 S23", """
with c as (select doc_id, text, unnest(range(0, greatest(1, ((length(text) - 81) // 220 + 1)::bigint))) as i from documents),
p as (select doc_id, i, substr(text, 220 * i + 1, 300) as b, case when i = 0 then '' else substr(text, 220 * (i - 1) + 1, 300) end as a from c),
k as (select *, coalesce(list_max(list_filter(range(30, 171), lambda k: k <= length(a) and k <= length(b) and substr(b, 1, k) = right(a, k))), 0) as cut from p)
select doc_id, md5(string_agg(substr(b, cut + 1), '' order by i)) as joined_md5 from k group by doc_id""")
def overlap_trim(t: Tables) -> DataFrame:
    """Whole texts in pieces of 300 that overlap by 80, joined again without what repeats."""
    last = F.greatest(F.lit(0), F.floor((F.length("text") - 81) / 220))
    pieces = t.documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    pieces = pieces.select("doc_id", "i", F.substr("text", (220 * F.col("i") + 1).cast("int"), F.lit(300)).alias("text"))
    return O.joined_text(pieces, ["doc_id"], "i", "text").select("doc_id", F.md5("text").alias("joined_md5"))


@query("islands", "W11", """
with m as (select user_id, event_id, event_type, ts, case when row_number() over w = 1 or event_type is distinct from lag(event_type) over w then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id))
select user_id, event_id, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as island from m""")
def islands(t: Tables) -> DataFrame:
    return O.islands(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("user_id", "event_id", "island")


@query("change_sequence", "W12", """
select user_id, event_id, event_type from events window w as (partition by user_id order by ts, event_id) qualify row_number() over w = 1 or event_type is distinct from lag(event_type) over w""")
def change_sequence(t: Tables) -> DataFrame:
    return O.changes(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("user_id", "event_id", "event_type")


@query("last_attr_from_history", "W17", """
select conv_id, turn, last_value(case when role = 'user' then md5(text) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as last_user from conversations""")
def last_attr_from_history(t: Tables) -> DataFrame:
    return O.carried(t.conversations, ["conv_id"], [F.col("turn")], F.when(F.col("role") == "user", F.md5("text")), "last_user").select("conv_id", "turn", "last_user")


@query("greedy_quota", "W18 E9", """
with recursive c as materialized (select lang, source, doc_id, md5(text) as h, row_number() over (partition by lang order by n_chars desc, doc_id) as i from documents),
r as (select distinct lang, 0::bigint as i, []::struct(g varchar, k bigint, h varchar)[] as kept from c union all
  select r.lang, c.i, case when len(kept) >= 12 or len(list_filter(kept, lambda x: x.g = c.source)) >= 2 or len(list_filter(kept, lambda x: x.h = c.h)) > 0 then kept else list_append(kept, {'g': c.source, 'k': c.doc_id, 'h': c.h}) end from r join c on c.lang = r.lang and c.i = r.i + 1),
f as (select lang, kept from r qualify row_number() over (partition by lang order by i desc) = 1),
u as (select lang, unnest(kept) as x, generate_subscripts(kept, 1) - 1 as place from f)
select lang, place::int as place, x.k as doc_id, x.g as source from u""")
def greedy_quota(t: Tables) -> DataFrame:
    """Per language, in order of length: at most 2 of a source, 12 in all, no text twice."""
    cand = O.quota_candidates(t.documents.select("lang", "source", "doc_id", "n_chars", F.md5("text").alias("h")), "lang", "source", "doc_id", "n_chars", "h", 2, 12)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", "source", "doc_id", "h"))), lambda x: F.struct(x["source"].alias("g"), x["doc_id"].alias("k"), x["h"].alias("h")))
    folded = cand.groupBy("lang").agg(rows.alias("rows")).select("lang", F.posexplode(O.greedy_quota(F.col("rows"), 2, 12)).alias("place", "x"))
    return folded.select("lang", "place", F.col("x.k").alias("doc_id"), F.col("x.g").alias("source"))


@query("greedy_topics", "A31", """
with recursive c as materialized (select p_name, list_distinct(string_split(p_name, '')) as chars, row_number() over (order by count(*) desc, p_name) as i from part group by p_name),
r as (select 0::bigint as i, []::varchar[] as kept union all
  select c.i, case when len(list_filter(kept, lambda k: len(list_intersect(list_distinct(string_split(k, '')), chars))::double / len(list_distinct(list_concat(string_split(k, ''), chars))) >= 0.7)) > 0 then kept else list_append(kept, c.p_name) end from r join c on c.i = r.i + 1),
f as (select kept from r order by i desc limit 1)
select unnest(kept) as p_name, (generate_subscripts(kept, 1) - 1)::int as place from f""")
def greedy_topics(t: Tables) -> DataFrame:
    """Of the most frequent part names, those whose characters differ enough from the names before."""
    named = t.part.groupBy("p_name").agg(F.count("*").alias("n"))
    # Names of the same characters are alike to the same names: all but the first of them go in any case.
    top = R.keep_best(named.withColumn("chars", F.array_sort(F.array_distinct(F.split("p_name", "")))), ["chars"], [F.desc("n"), F.col("p_name")])
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "p_name"))), lambda x: x["p_name"])
    return top.agg(names.alias("names")).select(F.posexplode(O.greedy_distinct(F.col("names"), 0.7)).alias("place", "p_name"))


@query("degree_capped_edges", "W20", """
with recursive e as (select l_returnflag, (l_partkey % 40)::varchar as a, (l_suppkey % 40)::varchar as b, count(*) as n from lineitem where l_partkey % 40 <> l_suppkey % 40 group by all),
c as materialized (select *, row_number() over (partition by l_returnflag order by n desc, a, b) as i from e),
r as (select distinct l_returnflag, 0::bigint as i, []::struct(a varchar, b varchar)[] as kept from c union all
  select r.l_returnflag, c.i, case when len(list_filter(kept, lambda x: x.a = c.a or x.b = c.a)) >= 8 and len(list_filter(kept, lambda x: x.a = c.b or x.b = c.b)) >= 8 then kept else list_append(kept, {'a': c.a, 'b': c.b}) end from r join c on c.l_returnflag = r.l_returnflag and c.i = r.i + 1),
f as (select l_returnflag, kept from r qualify row_number() over (partition by l_returnflag order by i desc) = 1),
u as (select l_returnflag, unnest(kept) as x, generate_subscripts(kept, 1) - 1 as place from f)
select l_returnflag, place::int as place, x.a as a, x.b as b from u""")
def degree_capped_edges(t: Tables) -> DataFrame:
    """Edges of each return flag in order of weight, until both ends have eight."""
    e = t.lineitem.filter("l_partkey % 40 != l_suppkey % 40").groupBy("l_returnflag", (F.col("l_partkey") % 40).cast("string").alias("a"), (F.col("l_suppkey") % 40).cast("string").alias("b")).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.col("a"), F.col("b")]
    kept = R.ranked(O.degree_capped(e, ["l_returnflag"], order, 8), ["l_returnflag"], order)
    return kept.select("l_returnflag", (F.col("rank") - 1).alias("place"), "a", "b")


@query("locf_chapter", "J10", """
with a as (select user_id, event_id, ts, case when event_type = 'view' then event_id end as anchor from events)
select user_id, event_id, coalesce(last_value(anchor ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), -1) as chapter from a""")
def locf_chapter(t: Tables) -> DataFrame:
    got = O.carried(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "view", F.col("event_id")), "chapter")
    return got.select("user_id", "event_id", F.coalesce("chapter", F.lit(-1).cast("long")).alias("chapter"))


@query("asof_last_search", "J17", """
with c as (select user_id, event_id, ts, event_type, value from events where event_type in ('click', 'view')),
s as (select *, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as seen from c)
select user_id, event_id, seen, coalesce(event_id - seen, 0) as gap from s where event_type = 'click'""")
def asof_last_search(t: Tables) -> DataFrame:
    c = t.events.filter(F.col("event_type").isin("click", "view"))
    s = O.carried(c, ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "view", F.col("event_id")), "seen")
    return s.filter("event_type = 'click'").select("user_id", "event_id", "seen", F.coalesce(F.col("event_id") - F.col("seen"), F.lit(0).cast("long")).alias("gap"))


@query("catalog_left_join", "J2 J13", """
with s as (select o_custkey, count(*) as n from orders group by all) select c_custkey, c_mktsegment, coalesce(n, 0)::bigint as n from customer left join s on o_custkey = c_custkey""")
def catalog_left_join(t: Tables) -> DataFrame:
    s = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(s, "c_custkey", "left").select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"))


@query("edges_touching_set", "J3 G13", """
with s as (select distinct p_partkey % 200 as id from part where p_brand = (select min(p_brand) from part)), e as (select distinct l_partkey % 200 as head, l_suppkey % 200 as tail, l_returnflag from lineitem)
select head, tail, l_returnflag from e where head in (select id from s) or tail in (select id from s)""")
def edges_touching_set(t: Tables) -> DataFrame:
    first = t.part.agg(F.min("p_brand").alias("p_brand"))
    wanted = t.part.join(first, "p_brand", "left_semi").select((F.col("p_partkey") % 200).alias("id")).distinct()
    e = t.lineitem.select((F.col("l_partkey") % 200).alias("head"), (F.col("l_suppkey") % 200).alias("tail"), "l_returnflag").distinct()
    side = lambda c: e.join(wanted, F.col(c) == F.col("id"), "left_semi")
    return side("head").union(side("tail")).distinct()


@query("pairs_top_confidence", "J4 S6 S29", """
with p as (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag = 'R')
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, row_number() over (partition by l_orderkey order by l_discount desc, l_linenumber, l_partkey, l_suppkey, l_extendedprice)::int as rank
from lineitem join p using (l_orderkey, l_linenumber) qualify rank <= 3""")
def pairs_top_confidence(t: Tables) -> DataFrame:
    pairs = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber").distinct()
    got = t.lineitem.join(pairs, ["l_orderkey", "l_linenumber"], "left_semi")
    return R.top_k(got, ["l_orderkey"], [F.desc("l_discount"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "rank")


@query("shared_concepts", "J6 G23", """
with c as (select distinct l_orderkey % 50 as law, l_partkey % 300 as concept from lineitem)
select a.law as a, b.law as b, count(*) as shared, min(a.concept) as first_concept from c a join c b using (concept) where a.law < b.law group by all""")
def shared_concepts(t: Tables) -> DataFrame:
    c = t.lineitem.select((F.col("l_orderkey") % 50).alias("law"), (F.col("l_partkey") % 300).alias("concept")).distinct()
    b = c.withColumnRenamed("law", "b")
    return c.withColumnRenamed("law", "a").join(b, "concept").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("concept").alias("first_concept"))


@query("title_contains_match", "J9 C31 S22", """
with k as (select distinct p_name as name from part), x as (select p_partkey, p_name || ' ' || p_brand as title from part),
m as (select p_partkey, name, row_number() over (partition by p_partkey order by length(name) desc, name) as r from x join k on contains(title, name) or contains(name, title))
select p_partkey, name from m where r = 1""")
def title_contains_match(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    x = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    titles = x.select("title").distinct()
    pairs = O.containing(titles, "title", names, "name").union(O.containing(names, "name", titles, "title").select("title", "name")).distinct()
    m = x.join(pairs, "title")
    return R.keep_best(m, ["p_partkey"], [F.desc(F.length("name")), F.col("name")]).select("p_partkey", "name")


@query("ordinal_pairing", "J14", """
with a as (select doc_id as a, row_number() over (order by n_chars desc, doc_id) as i from documents where lang = 'fr'), b as (select doc_id as b, row_number() over (order by n_chars desc, doc_id) as i from documents where lang = 'de')
select i::int as i, a, b from a join b using (i) where i <= 5""")
def ordinal_pairing(t: Tables) -> DataFrame:
    side = lambda lang, n: R.top_k(t.documents.filter(F.col("lang") == lang), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 5, "i").select("i", F.col("doc_id").alias(n))
    return side("fr", "a").join(side("de", "b"), "i")


@query("label_drift", "J15", """
select d.source, array_to_string(list_sort(list(distinct d.lang)), ',') as langs, array_to_string(list_sort(list(distinct l.quality)), ',') as labels from documents d join labels l using (doc_id) group by d.source""")
def label_drift(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id")
    said = lambda c: F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ",")
    return j.groupBy("source").agg(said("lang").alias("langs"), said("quality").alias("labels"))


@query("anti_orphans", "J16 X5 F4", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_totalprice > 100000)")
def anti_orphans(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'F' and o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("semi_refs", "S15 J11", "select p_partkey, p_brand from part where p_partkey in (select l_partkey from lineitem where l_returnflag = 'R')")
def semi_refs(t: Tables) -> DataFrame:
    refs = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(refs, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("set_diff_keywords", "X6 X4", """
with a as (select distinct unnest(string_split(p_name, ' ')) as w from part where p_size < 25), b as (select distinct unnest(string_split(p_name, ' ')) as w from part where p_size >= 25)
select coalesce(a.w, b.w) as word, case when a.w is null then 'only_b' when b.w is null then 'only_a' else 'common' end as side from a full join b on a.w = b.w""")
def set_diff_keywords(t: Tables) -> DataFrame:
    words = lambda df, n: df.select(F.explode(F.split("p_name", " ")).alias("word")).distinct().withColumn(n, F.lit(True))
    a, b = words(t.part.filter("p_size < 25"), "a"), words(t.part.filter("p_size >= 25"), "b")
    return a.join(b, "word", "full").select("word", F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("common").alias("side"))


@query("set_operations", "X4 X5 S41", """
select (select count(*) from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O')) as both_sides,
  (select count(*) from (select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O')) as only_first""")
def set_operations(t: Tables) -> DataFrame:
    side = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select("o_custkey")
    return side("F").intersect(side("O")).agg(F.count("*").alias("both_sides")).crossJoin(side("F").exceptAll(side("O")).distinct().join(side("O"), "o_custkey", "left_anti").agg(F.count("*").alias("only_first")))


@query("ordered_union", "X7", """
select c_nationkey, array_to_string(list(c_mktsegment order by first), ',') as segments from (select c_nationkey, c_mktsegment, min(c_custkey) as first from customer group by all) group by c_nationkey""")
def ordered_union(t: Tables) -> DataFrame:
    first = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first"))
    return first.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "c_mktsegment"))), lambda x: x["c_mktsegment"]), ",").alias("segments"))


@query("subsumed_queries", "X9 O14", """
with n as (select distinct split_part(p_name, ' ', 1) as q from part union select distinct p_name from part)
select q from n where not exists (select 1 from n m where m.q <> n.q and contains(m.q, n.q))""")
def subsumed_queries(t: Tables) -> DataFrame:
    n = t.part.select(F.split("p_name", " ")[0].alias("q")).union(t.part.select("p_name")).distinct()
    inside = O.containing(n.withColumnRenamed("q", "m"), "m", n, "q").filter("m != q").select("q")
    return n.join(inside, "q", "left_anti")


@query("stratified_round_robin", "W19 E16", """
with r as (select lang, doc_id, row_number() over (partition by lang order by md5(doc_id::varchar), doc_id)::int as depth from documents)
select lang, doc_id, depth, row_number() over (order by depth, lang)::int as place from r qualify place <= 30""")
def stratified_round_robin(t: Tables) -> DataFrame:
    r = R.top_k(t.documents.select("lang", "doc_id", F.lit(1).alias("q")), ["lang"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 30, "depth")
    return R.top_k(r, ["q"], [F.col("depth"), F.col("lang")], 30, "place").drop("q")


@query("paged_rows", "S7 F8 S5", "select doc_id, source, n_chars, count(*) over () as total from documents where source = 'src1' order by doc_id limit 10 offset 5")
def paged_rows(t: Tables) -> DataFrame:
    mine = t.documents.filter("source = 'src1'")
    total = mine.agg(F.count("*").alias("total"))
    return mine.orderBy("doc_id").offset(5).limit(10).select("doc_id", "source", "n_chars").crossJoin(total)


@query("universal_filter", "F1 F2 F3 F6", """
select doc_id from documents where lang in ('fr', 'de') and (source = 'src1' or source = 'src2' or source = 'src5') and n_chars between 100 and 9000""")
def universal_filter(t: Tables) -> DataFrame:
    alias = {"french": "fr", "german": "de"}  # resolved before planning, so that the predicate reaches the scan
    wanted = sorted({alias.get(x, x) for x in ("french", "de")})
    return t.documents.filter(F.col("lang").isin(*wanted) & F.col("source").isin("src1", "src2", "src5") & F.col("n_chars").between(100, 9000)).select("doc_id")


@query("membership_filters", "F3 F5 F7", """
select user_id, list_contains(list(event_type), 'purchase') as any_of, list_contains(list(event_type), 'purchase') and list_contains(list(event_type), 'view') as all_of, bool_or(contains(props, '7')) as named from events group by user_id""")
def membership_filters(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.bool_or(F.col("props").contains("7")).alias("named"))
    has = lambda *x: F.arrays_overlap("kinds", F.array(*map(F.lit, x)))
    return g.select("user_id", has("purchase").alias("any_of"), (has("purchase") & has("view")).alias("all_of"), "named")


@query("latest_wins_upsert", "S14", """
select user_id, event_type, count(*) as seen_count, min(event_id) as first_seen, max(event_id) as last_seen, arg_max(value, event_id) as value from events group by all""")
def latest_wins_upsert(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("seen_count"), F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.max_by("value", "event_id").alias("value"))


@query("version_merge_prefer_new", "S39 E12", """
with o as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 3 <> 0), n as (select o_orderkey as k, o_totalprice + 1 as v from orders where o_orderkey % 2 = 0)
select coalesce(n.k, o.k) as k, coalesce(n.v, o.v) as v, case when o.k is null then 'added' when n.k is null then 'kept' else 'replaced' end as how from o full join n on o.k = n.k""")
def version_merge_prefer_new(t: Tables) -> DataFrame:
    from ..sources.upserts import version_merge

    o = t.orders.filter("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    n = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("v"))
    return version_merge(o, n, ["k"])


@query("entity_alias_merge", "S13 G5", """
select p_brand, array_to_string(list_sort(list(distinct p_name)), '|') as aliases, array_to_string(list_sort(list(distinct p_type)), '|') as types from part group by p_brand""")
def entity_alias_merge(t: Tables) -> DataFrame:
    from ..sources.upserts import merge_sets

    cols = lambda df: df.groupBy("p_brand").agg(F.collect_set("p_name").alias("aliases"), F.collect_set("p_type").alias("types"))
    merged = merge_sets(cols(t.part.filter("p_size < 25")), cols(t.part.filter("p_size >= 25")), "p_brand", ["aliases", "types"])
    return merged.select("p_brand", F.array_join("aliases", "|").alias("aliases"), F.array_join("types", "|").alias("types"))


@query("batched_groups", "S36 S35", """
with r as (select user_id, event_id, ((row_number() over (partition by user_id order by event_id) - 1) // 5)::bigint as batch from events)
select user_id, batch, count(*) as n, min(event_id) as first_event from r group by all""")
def batched_groups(t: Tables) -> DataFrame:
    r = R.ranked(t.events, ["user_id"], [F.col("event_id")], "i").withColumn("batch", F.floor((F.col("i") - 1) / 5))
    return r.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
