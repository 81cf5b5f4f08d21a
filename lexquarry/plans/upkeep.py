"""Maintenance, evidence and composite queries."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ordered as O
from ..operators import ranking as R
from ..operators import search as S
from ..operators.graph import settled
from ..sources import articles as A
from ..sources import upserts as U
from ..sources.folders import new_path, removed
from .aggregates import EDGES, kg_edges
from .registry import Tables, query
from .search import COS


def fresh(t: Tables, what: str) -> str:
    """A new path in the shared folder, for a plan that is cleaned()."""
    path = new_path(t.spark, what)
    t.__dict__.setdefault("made", []).append(path)
    return path


def cleaned(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """The plan, whose rows are settled so that the folders it made can go."""

    @functools.wraps(plan)
    def run(t: Tables) -> DataFrame:
        try:
            return settled(plan(t))
        finally:
            for path in t.__dict__.pop("made", []):
                removed(t.spark, path)

    return run


def _text(c: str | F.Column) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("prune_and_delete", "S10 S11", """
with k as (select doc_id, source from documents where doc_id % 3 = 0 and source <> 'src4'), p as (select * from documents where (doc_id in (select doc_id from k) or source not in (select source from k)))
select doc_id, source from p where lang <> 'es'""")
def prune_and_delete(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "lang")
    keep = rows.filter("doc_id % 3 = 0 and source != 'src4'")
    return U.delete(U.prune(rows, keep, ["doc_id"], ["source"]), rows.filter("lang = 'es'"), ["doc_id"]).select("doc_id", "source")


@query("batch_backfill", "S16 S17", """
select doc_id || '_sub_' || (n_chars % 3) as id, case when quality is null then 'none' when quality = 1 then 'good' else 'bad' end as kind from documents left join labels using (doc_id) where doc_id % 2 = 0""")
def batch_backfill(t: Tables) -> DataFrame:
    d = t.documents.withColumn("version", F.when(F.col("doc_id") % 2 == 1, "v2").when(F.col("doc_id") % 4 == 0, "v1"))
    rows = U.stale(d, "version", "v2").select(F.concat(_text("doc_id"), F.lit("_sub_"), _text(F.col("n_chars") % 3)).alias("id"))
    lookup = t.labels.select(_text("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("kind"))
    return U.backfill(rows, lookup, "id", "kind").withColumn("kind", F.coalesce("kind", F.lit("none")))


@query("next_law_ids", "S21", "select p_brand, p_brand || '_' || (max(p_partkey) + 1) as next_id from part group by p_brand")
def next_law_ids(t: Tables) -> DataFrame:
    ids = t.part.select("p_brand", F.concat_ws("_", "p_brand", _text("p_partkey")).alias("id"))
    return ids.groupBy("p_brand").agg((F.max(F.regexp_extract("id", r"(\d+)$", 1).try_cast("long")) + 1).alias("n")).select("p_brand", F.concat_ws("_", "p_brand", _text("n")).alias("next_id"))


@query("table_counts", "S3 S4 S24 S31", """
select (select count(*) from documents) as documents, (select count(distinct source) from documents) as sources, exists (select 1 from documents where lang = 'fr') as has_fr, exists (select 1 from documents where lang = 'xx') as has_xx""")
def table_counts(t: Tables) -> DataFrame:
    lang = lambda x: F.count_if(F.col("lang") == x) > 0
    return t.documents.agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), lang("fr").alias("has_fr"), lang("xx").alias("has_xx"))


@query("report_cache_listing", "S27 S28", """
with h as (select c_mktsegment || '::' || c_nationkey as id, c_acctbal, list_reduce(list_transform(string_split(substr(md5(c_custkey::varchar), 1, 8), ''), lambda c: (instr('0123456789abcdef', c) - 1)::bigint), lambda a, b: a * 16 + b) as x from customer),
c as (select id, md5(count(*) || ':' || sum(x)::bigint) as fingerprint, max(c_acctbal) as seen from h group by id)
select id, fingerprint, row_number() over (order by seen desc, id)::int as place from c qualify place <= 50""")
def report_cache_listing(t: Tables) -> DataFrame:
    # Order does not matter to a sum of hashes, so a group's rows are folded map-side and never gathered.
    keys = F.sum(F.conv(F.substring(F.md5(_text("c_custkey")), 1, 8), 16, 10).cast("long"))
    c = t.customer.groupBy(F.concat_ws("::", "c_mktsegment", _text("c_nationkey")).alias("id")).agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), keys.cast("string"))).alias("fingerprint"), F.max("c_acctbal").alias("at"), F.lit(1).alias("one"))
    return R.top_k(c, ["one"], [F.desc("at"), F.col("id")], 50, "place").select("id", "fingerprint", "place")


@query("extraction_meta", "S30 S35", """
select user_id, count(*) as rows, arg_max(md5(event_id::varchar), event_id) as newest, ceil(count(*) / 5.0)::bigint as calls from events group by user_id""")
def extraction_meta(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("rows"), F.max_by(F.md5(_text("event_id")), "event_id").alias("newest"), F.ceil(F.count("*") / 5).alias("calls"))


@query("update_abstracts", "S32 F5", """
with a as (select source, 'about ' || min(lang) as abstract from documents where n_chars > 3000 group by source) select doc_id, abstract from documents left join a using (source) where abstract is not null""")
def update_abstracts(t: Tables) -> DataFrame:
    a = t.documents.filter("n_chars > 3000").groupBy("source").agg(F.struct(F.concat(F.lit("about "), F.min("lang")).alias("text")).alias("abstract"))
    return t.documents.select("doc_id", "source").join(a, "source", "left").filter("abstract.text is not null").select("doc_id", F.col("abstract.text").alias("abstract"))


@query("catalog_soft_delete", "S34 F4", """
select o_orderstatus as status, case when o_orderkey % 10 = 0 then 'deleted' else 'active' end as state, count(*) as n from orders where case when o_orderkey % 10 = 0 then 'deleted' else 'active' end <> 'deleted' or o_orderstatus = 'F' group by all""")
def catalog_soft_delete(t: Tables) -> DataFrame:
    gone = t.orders.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("deleted").alias("new"))
    rows = t.orders.join(gone, "o_orderkey", "left").select(F.col("o_orderstatus").alias("status"), F.coalesce("new", F.lit("active")).alias("state"))
    return rows.filter("state != 'deleted' or status = 'F'").groupBy("status", "state").agg(F.count("*").alias("n"))


@query("renamed_law_ids", "S37", """
select p_partkey, case when p_brand = m.b then 'NEW' || substr(p_brand || '_' || p_partkey, length(p_brand) + 1) else p_brand || '_' || p_partkey end as id from part, (select min(p_brand) as b from part) m""")
def renamed_law_ids(t: Tables) -> DataFrame:
    mapping = t.part.agg(F.min("p_brand").alias("old")).withColumn("new", F.lit("NEW"))
    rows = t.part.select("p_partkey", F.concat_ws("_", "p_brand", _text("p_partkey")).alias("id"))
    return U.renamed_ids(rows, mapping, "id")


@query("id_collisions", "S38", """
with r as (select source as id, 'f' || (doc_id % 3) || '.json' as file, doc_id from documents), f as (select id, min(file) as first from r group by id)
select doc_id, case when file = first then id else id || '_' || regexp_extract(file, '\\d+') end as id from r join f using (id)""".replace("\\\\d", "\\d"))
def id_collisions(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("id"), F.concat(F.lit("f"), _text(F.col("doc_id") % 3), F.lit(".json")).alias("file"), "doc_id")
    return U.collisions_renamed(rows, "id", "file").select("doc_id", "id")


@query("drop_log", "S40", """
with r as (select source, case when n_chars < 100 then 'short' when lang = 'es' then 'role' end as reason from documents) select source, reason, count(*) as n from r where reason is not null group by all""")
def drop_log(t: Tables) -> DataFrame:
    reason = F.when(F.col("n_chars") < 100, "short").when(F.col("lang") == "es", "role")
    return t.documents.select("source", reason.alias("reason")).filter("reason is not null").groupBy("source", "reason").agg(F.count("*").alias("n"))


@query("gold_text_index", "S43", """
with k as (select doc_id, 'a' || doc_id as key, text from documents union all select doc_id, source || '#' || (doc_id % 10), text from documents), w(key) as (values ('a3'), ('a14'), ('src5#5'), ('src7#7'))
select key, md5(string_agg(text, '|' order by doc_id)) as text_md5 from k join w using (key) group by key""")
def gold_text_index(t: Tables) -> DataFrame:
    d = t.documents
    keys = F.explode(F.array(F.concat(F.lit("a"), _text("doc_id")), F.concat_ws("#", "source", _text(F.col("doc_id") % 10)))).alias("key")
    wanted = t.spark.createDataFrame([("a3",), ("a14",), ("src5#5",), ("src7#7",)], "key string")
    found = d.select("doc_id", "text", keys).join(wanted, "key", "left_semi")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "|")
    return found.groupBy("key").agg(F.md5(joined).alias("text_md5"))


@query("citation_references", "R14 R15 C12", """
select p_partkey, case when p_partkey % 51 = p_size then (p_size + 1)::varchar else case when p_partkey % 51 = p_size + 1 then p_size::varchar else p_size || ',' || (p_size + 1) end end as own,
  'MAC_LEI_' || p_size || '_2023::' || (p_size + 2) as others from part""")
def citation_references(t: Tables) -> DataFrame:
    n = lambda k: _text(F.col("p_size") + k)
    wide = F.translate(n(0), "0123456789", X.FULL_WIDTH)
    own = F.concat(F.lit("依第"), wide, F.lit("條及第"), n(1), F.lit("條、《某法》第九條"))
    other = F.concat(F.lit("第"), n(0), F.lit("/2023號法律第"), n(2), F.lit("條"))
    lists = t.part.select("p_partkey", X.own_reference_list(own, (F.col("p_partkey") % 51).cast("int")).alias("own"), X.cross_reference_list(other).alias("others"))
    return lists.select("p_partkey", F.array_join(F.col("own").cast("array<string>"), ",").alias("own"), F.array_join("others", ",").alias("others"))


@query("cited_sources_check", "R25 C37", r"""
with a as (select conv_id, turn, 'see 来源' || (turn % 5 + 1) || ' and 来源' || (conv_id % 9 + 1) as answer from conversations), r as (select conv_id, turn, list_transform(regexp_extract_all(answer, '来源(\d+)', 1), lambda x: x::int) as refs from a)
select conv_id, turn, len(list_filter(refs, lambda x: x > 5)) as outside, array_to_string(list_sort(list_distinct(list_filter(refs, lambda x: x <= 5))), ',') as cited from r""")
def cited_sources_check(t: Tables) -> DataFrame:
    answer = F.concat(F.lit("see 来源"), _text(F.col("turn") % 5 + 1), F.lit(" and 来源"), _text(F.col("conv_id") % 9 + 1))
    r = t.conversations.select("conv_id", "turn", F.regexp_extract_all(answer, F.lit(r"来源(\d+)"), F.lit(1)).cast("array<int>").alias("refs"))
    surfaced = F.sequence(F.lit(1), F.lit(5))
    return r.select("conv_id", "turn", F.size(F.filter("refs", lambda x: x > 5)).cast("long").alias("outside"), F.array_join(F.array_sort(F.array_intersect("refs", surfaced)).cast("array<string>"), ",").alias("cited"))


@query("chunk_prefixes", "C4 C5", """
select p_partkey, case when trim(t) <> '' then '【' || substr(t, 1, 100) || '】' else '' end || coalesce(case when trim(a) <> '' then a end, p_type) as content
from (select p_partkey, p_type, case when p_partkey % 4 = 0 then ' ' else p_name end as t, case when p_partkey % 3 = 0 then '' else p_brand end as a from part)""")
def chunk_prefixes(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", "p_type", F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_name")).alias("t"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("a"))
    return d.select("p_partkey", X.labelled(F.col("t"), X.first_text("a", "p_type")).alias("content"))


@query("referral_only", "C24", r"""select doc_id from documents where length(trim(regexp_replace(regexp_replace(lower(text), '(see|of|the|and|to|in)', '', 'g'), '[^a-z]+', '', 'g'))) < 20""")
def referral_only(t: Tables) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace(F.lower("text"), "(see|of|the|and|to|in)", ""), "[^a-z]+", "")
    return t.documents.filter(F.length(F.trim(bare)) < 20).select("doc_id")


@query("truncated_id_repair", "C27 E15", """
with x as (select distinct substr(c_name, 1, length(c_name) - 1) as cut from customer), m as (select cut, count(*) as n, min(c_name) as full_id from x join customer on starts_with(c_name, cut) group by cut)
select cut, case when n = 1 then full_id end as repaired, n from m""")
def truncated_id_repair(t: Tables) -> DataFrame:
    x = t.customer.select(F.expr("substr(c_name, 1, length(c_name) - 1)").alias("cut")).distinct()
    m = O.prefixed(t.customer.select("c_name"), "c_name", x, "cut").groupBy("cut").agg(F.count("*").alias("n"), F.min("c_name").alias("full_id"))
    return m.select("cut", F.when(F.col("n") == 1, F.col("full_id")).alias("repaired"), "n")


@query("cell_lists", "C28 C29 C38", """
with c as (select c_nationkey, c_mktsegment || ' (' || (c_custkey % 4) || '); ' || lower(c_mktsegment) as cell from customer), p as (select c_nationkey, unnest(string_split(cell, '; ')) as part from c)
select c_nationkey, array_to_string(list_sort(list(distinct lower(regexp_extract(part, '^[A-Za-z]+')))), ',') as topics from p group by c_nationkey""")
def cell_lists(t: Tables) -> DataFrame:
    cell = F.concat("c_mktsegment", F.lit(" ("), _text(F.col("c_custkey") % 4), F.lit("); "), F.lower("c_mktsegment"))
    ids = F.transform(F.split(cell, "; "), lambda x: F.lower(F.regexp_extract(x, "^[A-Za-z]+", 0)))
    g = t.customer.select("c_nationkey", F.explode(ids).alias("topic")).groupBy("c_nationkey").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    return g.select("c_nationkey", F.array_join("topics", ",").alias("topics"))


@query("entry_references", "R30", "with " + EDGES + """,
h as (select head, article, max(confidence) as c from e where jurisdiction in ('j1', 'j2', 'j3') group by all), r as (select *, row_number() over (partition by head order by c desc, article)::int as rank from h qualify rank <= 6)
select head, article, rank from r""")
def entry_references(t: Tables) -> DataFrame:
    h = kg_edges(t).filter(F.col("jurisdiction").isin("j1", "j2", "j3")).groupBy("head", "article").agg(F.max("confidence").alias("c"))
    return R.top_k(h, ["head"], [F.desc("c"), F.col("article")], 6).select("head", "article", "rank")


@query("evidence_table", "R31", "with " + EDGES + """,
s as (select distinct head, tail, relation, jurisdiction, article, confidence from e where head in ('p1', 'p5', 'p9') or tail in ('p1', 'p5', 'p9')),
c as (select *, row_number() over (partition by jurisdiction order by confidence desc, head, tail, relation, article) as r from s qualify r <= 12)
select jurisdiction, count(*) as n, array_to_string((list(head || '>' || tail order by r))[1:3], ';') as brief from c group by jurisdiction""")
def evidence_table(t: Tables) -> DataFrame:
    seeds = ("p1", "p5", "p9")
    s = kg_edges(t).filter(F.col("head").isin(*seeds) | F.col("tail").isin(*seeds)).select("head", "tail", "relation", "jurisdiction", "article", "confidence").distinct()
    c = R.top_k(s, ["jurisdiction"], [F.desc("confidence"), *(F.col(x) for x in ("head", "tail", "relation", "article"))], 12)
    brief = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(">", "head", "tail").alias("x")))), lambda x: x["x"]), 1, 3)
    return c.groupBy("jurisdiction").agg(F.count("*").alias("n"), F.array_join(brief, ";").alias("brief"))


@query("semantic_network", "G14 G20 W8", f"""
with p as (select x.vec_id as a, y.vec_id as b, {COS} as c from embeddings x, embeddings y where x.label = 2 and y.label = 3),
r as (select *, row_number() over (partition by a order by round(c, 9) desc, b) as ra, row_number() over (partition by b order by round(c, 9) desc, a) as rb from p),
e as (select a, b, round(c, 6) as weight, case when c >= 0.3 then 'strong' when c >= 0.2 then 'medium' else 'weak' end as tier from r where ra <= 2 or rb <= 2)
select a, b, weight, tier, (ct >= 3) as hub from e join (select a, count(*) as ct from e group by a) using (a)""")
def semantic_network(t: Tables) -> DataFrame:
    v = t.embeddings
    e = S.row_and_column_best(v.filter("label = 2"), v.filter("label = 3"), "vec_id", "embedding", 2)
    tier = F.when(F.col("cosine") >= 0.3, "strong").when(F.col("cosine") >= 0.2, "medium").otherwise("weak")
    degree = e.groupBy("a").agg((F.count("*") >= 3).alias("hub"))
    return e.select("a", "b", F.round("cosine", 6).alias("weight"), tier.alias("tier")).join(degree, "a")


@query("cross_group_chain", "J6", "with " + EDGES + """,
c as (select distinct jurisdiction as j, article, head as concept from e), a as (select concept, article from c where j = 'j1' and article in ('a1', 'a2', 'a7')),
x as (select a.article as source, c.j, c.article as target, count(distinct a.concept) as shared from a join c using (concept) where c.j <> 'j1' group by all),
r as (select *, row_number() over (partition by source, j order by shared desc, target) as r from x qualify r <= 3)
select source, j, target, shared, round(1 + shared / 10.0::double, 6) as score from r""")
def cross_group_chain(t: Tables) -> DataFrame:
    c = kg_edges(t).select(F.col("jurisdiction").alias("j"), "article", F.col("head").alias("concept")).distinct()
    a = c.filter((F.col("j") == "j1") & F.col("article").isin("a1", "a2", "a7")).select("concept", F.col("article").alias("source"))
    x = a.join(c.filter("j != 'j1'"), "concept").groupBy("source", "j", F.col("article").alias("target")).agg(F.countDistinct("concept").alias("shared"))
    top = R.top_k(x, ["source", "j"], [F.desc("shared"), F.col("target")], 3)
    return top.select("source", "j", "target", "shared", F.round(1 + F.col("shared") / 10, 6).alias("score"))


@query("strategy_results", "S19", "select source, (count(*) * case when lang = 'fr' then 10 else 1 end)::bigint as n, lang as strategy from documents group by source, lang")
@cleaned
def strategy_results(t: Tables) -> DataFrame:
    """Result rows written by strategy as CSV and one strategy replaced, then read with an explicit schema."""
    path = fresh(t, "results")
    rows = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumnRenamed("lang", "strategy")
    A.write_result_csv(rows, path)
    A.write_result_csv(rows.filter("strategy = 'fr'").withColumn("n", F.col("n") * 10), path)
    return A.read_result_csv(t.spark, path, "source string, n long, strategy string")
