"""Graph, entity and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities as N
from ..operators import evaluation as E
from ..operators import communities as M
from ..operators import graph as G
from ..operators import search as S
from .aggregates import EDGES, kg_edges
from .registry import Tables, query

NEAR = """n as (select x.vec_id as a, y.vec_id as b, list_dot_product(x.embedding::double[], y.embedding::double[]) as c from embeddings x, embeddings y where x.vec_id <> y.vec_id),
g as materialized (select a, b from n qualify row_number() over (partition by a order by round(c, 9) desc, b) <= 2),
u as materialized (select a, b from g union select b, a from g)"""


def near_graph(vectors: DataFrame, k: int = 2) -> DataFrame:
    """A sparse graph: each vector with its nearest ones. It is searched once, whatever reads it later."""
    return G.settled(S.knn(vectors, vectors, "vec_id", "embedding", k).select("a", "b"))


@query("edge_degree_importance", "G6 G10 G25", "with " + EDGES + """,
r as (select head, tail, relation, max(confidence) as c from e where head <> tail group by all),
d as (select node, count(*) as degree from (select head as node from r union all select tail from r) group by node)
select node, degree, round(degree::double / max(degree) over (), 6) as importance from d""")
def edge_degree_importance(t: Tables) -> DataFrame:
    return G.formatted(kg_edges(t))[0]


@query("connected_components", "G4", "with recursive " + NEAR + """,
r as (select a as node, a as other from u union select r.node, u.b from r join u on u.a = r.other)
select node, min(other) as root from r group by node""")
def connected_components(t: Tables) -> DataFrame:
    return G.components(near_graph(t.embeddings))


def _pagerank_sql(rounds: int) -> str:
    parts = [NEAR, "o as (select a as node, count(*) as out from u group by a)", "c as (select count(*) as n from o)", "r0 as (select node, 1.0::double / n as rank from o, c)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} as (select o.node, 0.15 / n + 0.85 * s.got as rank from o, c, (select u.b, sum(rank / o.out) as got from u join r{i} on u.a = r{i}.node join o on o.node = u.a group by u.b) s where s.b = o.node)")
    return "with " + ",\n".join(parts) + f" select node, round(rank, 9) as rank from r{rounds}"


@query("pagerank_fixed_rounds", "G7", _pagerank_sql(8))
def pagerank_fixed_rounds(t: Tables) -> DataFrame:
    return G.pagerank(near_graph(t.embeddings), 8).withColumn("rank", F.round("rank", 9))


@query("shortest_distances", "G11 G12", "with recursive " + NEAR + """,
r as (select 0::bigint as source, 0::bigint as node, 0 as hops union select r.source, u.b, r.hops + 1 from r join u on u.a = r.node where r.hops < 6)
select source, node, min(hops) as hops from r group by all""")
def shortest_distances(t: Tables) -> DataFrame:
    return G.distances(near_graph(t.embeddings), t.spark.sql("select 0L as node"), 6)


@query("shortest_paths", "G11 G12", "with recursive " + NEAR + """,
r as (select 0::bigint as source, 0::bigint as node, [0::bigint] as path union all select r.source, u.b, list_append(r.path, u.b) from r join u on u.a = r.node where len(r.path) <= 5 and not list_contains(r.path, u.b)),
b as (select *, row_number() over (partition by node order by len(path), path) as i from r)
select source, node as target, (len(path) - 1)::int as hops, array_to_string(path, '>') as path from b where i = 1""")
def shortest_paths(t: Tables) -> DataFrame:
    e = near_graph(t.embeddings)
    nodes = e.select(F.explode(F.array("a", "b")).alias("target")).distinct()
    got = G.shortest_paths(e, nodes.select(F.lit(0).cast("long").alias("source"), "target"), 5)
    return got.select("source", "target", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("ego_subgraph", "G13 J5", "with " + NEAR + """,
near as (select 3::bigint as n union select b from u where a = 3)
select distinct a, b from g where a in (select n from near) and b in (select n from near)""")
def ego_subgraph(t: Tables) -> DataFrame:
    return G.ego(near_graph(t.embeddings), F.lit(3))


@query("two_hop_paths", "G15 O13", "with " + EDGES + """,
w as (select head, tail, relation, greatest(confidence, 0.05) * case relation when 'R' then 1.15 when 'A' then 0.9 else 1.0 end as s from (select distinct head, tail, relation, confidence from e)),
d as (select head as x, tail as y, relation, s, 1 as forward from w union all select tail, head, relation, s * 0.6, 0 from w),
h as (select * from d where x <> y qualify row_number() over (partition by x order by round(s, 9) desc, y, relation, forward) <= 12),
one as (select 'p7' as seed, y as mid, null::varchar as "end", relation as via, s as score from h where x = 'p7'),
two as (select seed, mid, h.y as "end", via || '>' || relation as via, score * s as score from one join h on h.x = one.mid where h.y <> seed),
a as (select * from one union all select * from two)
select seed, mid, "end", via, round(score, 6) as score from a qualify row_number() over (partition by seed order by round(score, 9) desc, mid nulls first, "end" nulls first, via) <= 30""")
def two_hop_paths(t: Tables) -> DataFrame:
    e = kg_edges(t).select("head", "tail", "relation", "confidence").distinct()
    got = G.two_hop_paths(e, t.spark.sql("select 'p7' as node"), {"R": 1.15, "A": 0.9})
    return got.select("seed", "mid", "end", "via", F.round("score", 6).alias("score"))


@query("betweenness_exact", "G9", None)
def betweenness_exact(t: Tables) -> DataFrame:
    return G.betweenness(near_graph(t.embeddings))


def _communities_sql(rounds: int) -> str:
    parts = [NEAR.replace("<= 2)", "<= 3)"), "t as (select a as node, (instr('0123456789abcdef', right(md5(a::varchar), 1)) - 1) % 2 as turn from (select distinct a from u))", "r0 as (select node, node as community from t)"]
    for i in range(rounds):
        parts.append(f"b{i} as (select a, community from (select a, community, row_number() over (partition by a order by count(*) desc, community) as k from u join r{i} on u.b = node group by a, community) where k = 1)")
        parts.append(f"r{i + 1} as materialized (select t.node, case when turn = {i % 2} then b.community else r.community end as community from t join r{i} r on r.node = t.node join b{i} b on b.a = t.node)")
    return "with " + ",\n".join(parts) + f" select node, community from r{rounds}"


@query("label_communities", "G8 G10", _communities_sql(10))
def label_communities(t: Tables) -> DataFrame:
    return G.communities(near_graph(t.embeddings, 3))


@query("modular_communities", "G8", None)
def modular_communities(t: Tables) -> DataFrame:
    """Louvain's communities of the graph of nearest vectors."""
    return M.modular_communities(near_graph(t.embeddings, 3))


@query("alias_resolve", "G1", """
with a as (select p_type as kind, lower(p_name) as norm, min(lower(p_brand)) as canonical from part where p_size < 10 group by all), m as (select distinct p_type as kind, lower(p_name) as norm from part)
select m.kind, m.norm, coalesce(canonical, m.norm) as canonical, case when canonical is null then 'L4' when canonical = m.norm then 'L1' else 'L2' end as level from m left join a using (kind, norm)""")
def alias_resolve(t: Tables) -> DataFrame:
    norm = F.lower("p_name").alias("norm")
    aliases = t.part.filter("p_size < 10").groupBy(F.col("p_type").alias("kind"), norm).agg(F.min(F.lower("p_brand")).alias("canonical"))
    return N.resolved(t.part.select(F.col("p_type").alias("kind"), norm).distinct(), aliases).select("kind", "norm", "canonical", "level")


@query("levenshtein_pairs", "C11 G3", """
with n as (select distinct c_mktsegment as kind, replace(c_name, '#', '') || c_nationkey as name from customer)
select a.kind, a.name as a, b.name as b from n a join n b on a.kind = b.kind and a.name < b.name and levenshtein(a.name, b.name) <= 1""")
def levenshtein_pairs(t: Tables) -> DataFrame:
    n = t.customer.select(F.col("c_mktsegment").alias("kind"), F.concat(F.regexp_replace("c_name", "#", ""), F.col("c_nationkey").cast("string")).alias("name"))
    return N.name_pairs(n, "kind", "name")


@query("alignment_guard", "G2 G3", """
with n as (select distinct p_type as kind, p_name || ' ' || p_size as name from part),
p as (select a.kind, a.name as a, b.name as b, 0.9 + (length(a.name) % 10) / 100.0 as sim from n a join n b on a.kind = b.kind and a.name < b.name and levenshtein(a.name, b.name) <= 1),
s as (select *, array_to_string(list_sort(regexp_extract_all(a, '[0-9]+')), '|') as na, array_to_string(list_sort(regexp_extract_all(b, '[0-9]+')), '|') as nb from p)
select kind, a, b, case when sim < 0.95 then 'similarity' when na <> nb then 'numerals' when length(a) > 40 or length(b) > 40 then 'length' when levenshtein(a, b) > 1 then 'edits' end as reason from s""")
def alignment_guard(t: Tables) -> DataFrame:
    p = N.name_pairs(t.part.select(F.col("p_type").alias("kind"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name")), "kind", "name")
    sim = (F.lit("0.9").cast("decimal(4,2)") + (F.length("a") % 10).cast("decimal(4,2)") / F.lit(100).cast("decimal(4,0)")).cast("double")
    return p.select("kind", "a", "b", N.guard(F.col("a"), F.col("b"), F.round(sim, 4)).alias("reason"))


@query("canonical_triples", "G5 G26", "with " + EDGES + """,
x as (select case when head in ('p1', 'p2') then 'p0' else head end as head, case when tail in ('p1', 'p2') then 'p0' else tail end as tail, relation, confidence from e)
select head, relation, tail, max(confidence) as confidence from x where head <> tail group by all""")
def canonical_triples(t: Tables) -> DataFrame:
    canon = t.spark.createDataFrame([("p1", "p0"), ("p2", "p0")], "name string, canonical string")
    return N.canonical_triples(kg_edges(t), canon)


RUN = """l as (select source as query, doc_id, row_number() over (partition by source order by n_chars desc, doc_id)::int as rank from documents qualify rank <= 20),
q as (select d.source as query, doc_id, (l.quality + l.quality * (1 - l.toxic))::int as relevance from labels l join documents d using (doc_id))"""


def _run(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A run and its judgements, those of RUN."""
    from ..operators.ranking import top_k

    run = top_k(t.documents, ["source"], [F.desc("n_chars"), F.col("doc_id")], 20).select(F.col("source").alias("query"), "doc_id", "rank")
    rel = (F.col("quality") + F.col("quality") * (1 - F.col("toxic"))).cast("int").alias("relevance")
    qrels = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(F.col("source").alias("query"), "doc_id", rel)
    return run, qrels


@query("ir_metrics", "E2 E8 J13", "with " + RUN + """,
g as (select query, count(*) as gold from q where relevance > 0 group by query),
h as (select l.query, l.rank, gold from l join q using (query, doc_id) join g on g.query = l.query where relevance > 0),
s as (select query, min(rank) as first, count(*) filter (rank <= 5) as n5, count(*) filter (rank <= 10) as n10, count(*) filter (rank <= 20) as n20, count(*) filter (rank <= least(gold, 20)) as nr from h group by query)
select query, gold, round(coalesce(1.0::double / first, 0), 6) as mrr, (coalesce(first, 0) = 1)::int as rank1,
  (coalesce(n5, 0) > 0)::int as hit_5, round(coalesce(n5, 0)::double / gold, 6) as recall_5, round(coalesce(n5, 0) / 5.0::double, 6) as precision_5,
  (coalesce(n10, 0) > 0)::int as hit_10, round(coalesce(n10, 0)::double / gold, 6) as recall_10, round(coalesce(n10, 0) / 10.0::double, 6) as precision_10,
  (coalesce(n20, 0) > 0)::int as hit_20, round(coalesce(n20, 0)::double / gold, 6) as recall_20, round(coalesce(n20, 0) / 20.0::double, 6) as precision_20,
  round(coalesce(nr, 0)::double / least(gold, 20), 6) as r_precision from g left join s using (query)""")
def ir_metrics(t: Tables) -> DataFrame:
    return E.metrics(*_run(t), "query", "doc_id")


@query("ndcg_at_k", "E1", "with " + RUN + """,
d as (select l.query, sum(case when rank <= 10 then (2 ** coalesce(relevance, 0) - 1) / log2(rank + 1) end) as dcg from l left join q using (query, doc_id) group by l.query),
p as (select query, relevance, row_number() over (partition by query order by relevance desc, doc_id) as place from q where relevance > 0),
i as (select query, sum(case when place <= 10 then (2 ** relevance - 1) / log2(place + 1) end) as ideal from p group by query)
select a.query, round(case when ideal > 0 then coalesce(dcg, 0) / ideal end, 6) as ndcg from (select distinct query from q) a left join i using (query) left join d using (query)""")
def ndcg_at_k(t: Tables) -> DataFrame:
    return E.ndcg(*_run(t), "query", "doc_id", 10)


@query("law_level_run", "E3 W2", """
with r as (select source as query, lang, min(n) as item_rank from (select source, lang, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as n from documents qualify n <= 20) group by all)
select query, lang, row_number() over (partition by query order by item_rank, lang)::int as rank from r""")
def law_level_run(t: Tables) -> DataFrame:
    run, _ = _run(t)
    return E.by_group(run, t.documents, "query", "doc_id", "lang")


@query("valid_means", "E4 A19", "with " + RUN + ", v as (select query, case when rank % 4 = 0 then null else rank::double end as x from l) select query, round(avg(x), 6) as x_mean, count(x) as x_valid from v group by query")
def valid_means(t: Tables) -> DataFrame:
    run, _ = _run(t)
    return run.withColumn("x", F.when(F.col("rank") % 4 != 0, F.col("rank").cast("double"))).groupBy("query").agg(*E.valid_mean("x"))


@query("full_gold_found", "E5", "with " + RUN + """
select q.query, count(*) = count(l.doc_id) as complete, count(l.doc_id) as found, count(*) as gold from q left join (select * from l where rank <= 10) l using (query, doc_id) where relevance > 0 group by q.query""")
def full_gold_found(t: Tables) -> DataFrame:
    run, qrels = _run(t)
    j = qrels.filter("relevance > 0").join(run.filter("rank <= 10"), ["query", "doc_id"], "left")
    return j.groupBy("query").agg((F.count("*") == F.count("rank")).alias("complete"), F.count("rank").alias("found"), F.count("*").alias("gold"))


@query("bootstrap_interval", "E6", "with " + RUN + """,
g as (select query, count(*) as gold from q where relevance > 0 group by query),
h as (select l.query, count(*) filter (rank <= 5) as n5, count(*) as n20 from l join q using (query, doc_id) where relevance > 0 group by l.query),
d as (select round(coalesce(n20, 0)::double / gold, 6) - round(coalesce(n5, 0)::double / gold, 6) as v from g left join h using (query)),
o as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from d),
p as (select r, i, list_reduce(list_transform(string_split(substr(md5('42:' || r || ':' || i), 1, 8), ''), lambda c: (instr('0123456789abcdef', c) - 1)::bigint), lambda a, b: a * 16 + b) as x from (select unnest(range(1, 2001)) as r) cross join (select unnest(range(1, (select count(*) + 1 from d))) as i)),
m as (select r, sum(v) / max(n) as m from p join o on o.i = x % n group by r)
select round((select avg(v) from d), 6) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m""")
def bootstrap_interval(t: Tables) -> DataFrame:
    run, qrels = _run(t)
    m = E.metrics(run, qrels, "query", "doc_id").select((F.col("recall_20") - F.col("recall_5")).alias("delta"))
    got = E.bootstrap(m, "delta")
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query("sign_test", "E7", """
with s as (select d.source, count(*) filter (quality = 1) % 13 as plus, count(*) filter (quality = 0) + count(*) filter (toxic = 1) as minus from labels join documents d using (doc_id) group by d.source),
x as (select source, plus, minus, plus + minus as n, least(plus, minus) as k from s),
c as (select source, sum((factorial(n::int) / (factorial(i::int) * factorial((n - i)::int)))::double) as tail from x, range(0, 40) r(i) where i <= k group by source)
select source, plus::bigint as plus, minus::bigint as minus, round(least(1.0::double, 2 * tail / pow(2.0, n)), 6) as p from x join c using (source)""".replace("range(0, 40) r(i)", "(select unnest(range(0, 40)) as i)"))
def sign_test(t: Tables) -> DataFrame:
    s = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        (F.count_if(F.col("quality") == 1) % 13).alias("plus"), (F.count_if(F.col("quality") == 0) + F.count_if(F.col("toxic") == 1)).alias("minus"))
    return s.withColumn("p", F.round(E.sign_test_column(F.col("plus"), F.col("minus")), 6))


@query("label_agreement", "E10", """
with g as (select d.source, list(doc_id) filter (quality = 1) as a, list(doc_id) filter (toxic = 0) as b from labels join documents d using (doc_id) group by d.source)
select source, round(len(list_intersect(coalesce(a, []), coalesce(b, [])))::double / nullif(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), 0), 6) as jaccard from g""")
def label_agreement(t: Tables) -> DataFrame:
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return E.set_agreement(j, "source", "doc_id", F.col("quality") == 1, F.col("toxic") == 0)


@query("structural_validation", "E11 E17", """
select unnest(['missing text', 'missing lang', 'bounds n_chars', 'duplicate doc_id']) as problem,
  unnest([count(*) filter (text is null or trim(text) = ''), count(*) filter (lang is null or trim(lang) = ''), count(*) filter (not n_chars between 10 and 20000), count(doc_id) - count(distinct doc_id)]) as n from documents""")
def structural_validation(t: Tables) -> DataFrame:
    return E.validated(t.documents, "doc_id", ["text", "lang"], {"n_chars": (10, 20000)})


@query("count_reconciliation", "E12 E14 E17", """
with a as (select source, count(*) as n from documents group by source), b as (select source, count(*) as n from documents where n_chars > 20 group by source)
select coalesce(a.source, b.source) as source, a.n as "left", b.n as "right" from a full join b using (source) where a.n is distinct from b.n""")
def count_reconciliation(t: Tables) -> DataFrame:
    count = lambda df: df.groupBy("source").agg(F.count("*").alias("n"))
    return E.differing(count(t.documents), count(t.documents.filter("n_chars > 20")), ["source"], "n")
