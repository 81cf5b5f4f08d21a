"""Composite retrieval, graph and evaluation plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence_table as V
from ..operators import graph as G
from ..operators import ordered as O
from ..operators import planning as P
from ..operators import ranking as R
from ..operators import search as S
from .aggregates import EDGES, kg_edges
from .registry import Tables, query
from .search import COS, bm25_sql
from .upkeep import _text

OWNERS = """
w as materialized (select o_custkey % 40 as owner, l_partkey % 50 as key, count(*) as w from lineitem join orders on l_orderkey = o_orderkey group by all),
t as (select owner, sum(w)::bigint as total from w group by owner),
m as (select vec_id % 40 as owner, i, median(x) as x from (select vec_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all),
v as (select owner, list(x order by i) as v, sqrt(sum(x * x)) as n from m group by owner),
s as (select a.owner as a, b.owner as b, list_dot_product(a.v, b.v) / (a.n * b.n) as sim from v a, v b where a.owner <> b.owner),
k as materialized (select a, b, sim from s qualify row_number() over (partition by a order by round(sim, 9) desc, b) <= 12),
j as (select k.a, k.b, sim, coalesce((select sum(least(x.w, y.w))::bigint from w x join w y using (key) where x.owner = k.a and y.owner = k.b), 0) as shared from k),
c as (select a, b, sim, round(shared / (ta.total + tb.total - shared), 6) as jaccard from j join t ta on ta.owner = a join t tb on tb.owner = b),
f as (select a, b, round(0.6 * jaccard + 0.4 * greatest(0, least(1, ((1 + sim) / 2 - 0.2) / 0.8)), 6) as score, 'topics' as how from c where a % 9 <> 0 and jaccard >= 0.4),
z as (select * from f union all select a, b, round(0.4 * greatest(0, least(1, ((1 + sim) / 2 - 0.2) / 0.8)), 6), 'vector' from c where a not in (select a from f)),
r as (select *, row_number() over (partition by a, b % 4 order by score desc, b) = 1 as best from z),
x as (select *, case when not best then 3 when b % 4 = a % 4 then 2 when b % 4 in (1, 2) then 0 else 1 end as tier from r)"""


def _owner_vectors(t: Tables) -> DataFrame:
    c = S.centroid(t.embeddings.withColumn("owner", F.col("vec_id") % 40), ["owner"], "embedding")
    return c.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))


@query("similar_laws", "R18 A27 W4 R19", "with " + OWNERS.strip() + " select a, b, score, how, tier::int as tier, row_number() over (partition by a order by tier, score desc, b)::int as place from x qualify place <= 6")
def similar_laws(t: Tables) -> DataFrame:
    """Laws near a law's centroid whose topics overlap enough, scored by topics and vectors, the best of each group first; where no
    law is left, those near by vectors alone."""
    w = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy((F.col("o_custkey") % 40).alias("owner"), (F.col("l_partkey") % 50).alias("key")).agg(F.count("*").alias("w"))
    v = _owner_vectors(t)
    near = S.knn(v, v, "owner", "v", 12).select("a", "b", "cosine")
    c = G.settled(S.weighted_jaccard(w, "owner", "key", "w", near.select("a", "b")).join(near, ["a", "b"]))
    shown = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((1 + F.col("cosine")) / 2 - 0.2) / 0.8))
    topical = c.filter("a % 9 != 0 and jaccard >= 0.4").select("a", "b", F.round(0.6 * F.col("jaccard") + 0.4 * shown, 6).alias("score"), F.lit("topics").alias("how"))
    alone = c.join(topical.select("a").distinct(), "a", "left_anti").select("a", "b", F.round(0.4 * shown, 6).alias("score"), F.lit("vector").alias("how"))
    group = topical.union(alone).withColumn("group", F.col("b") % 4)
    out = R.diverse_fill(group, ["a"], "group", F.col("group") == F.col("a") % 4, F.col("group").isin(1, 2), 6, "score", "b")
    return out.select("a", "b", "score", "how", "tier", "place")


@query("qa_candidates", "R27 R3 J1 R16", "with " + bm25_sql("documents", "text", "s") + """,
r as (select query_id, lang, doc_id, row_number() over (partition by query_id, lang order by round(score, 6) desc, doc_id)::int as in_group from s join documents using (doc_id) qualify in_group <= 10),
d as (select r.*, source from r join documents using (doc_id) qualify row_number() over (partition by query_id, r.lang, source order by in_group) = 1),
c as (select *, row_number() over (partition by query_id order by 1.0 / (60 + in_group) desc, doc_id)::int as place from d qualify place <= 8),
n as (select c.query_id, y.doc_id, min(c.place) as via from c join documents x on x.doc_id = c.doc_id join documents y on y.doc_id = c.doc_id + 1 and y.lang = x.lang where c.place <= 3 group by all),
h as (select query_id, doc_id, row_number() over (partition by query_id order by via, doc_id)::int as i from n where (query_id, doc_id) not in (select query_id, doc_id from c) qualify i <= 5),
u as (select query_id, doc_id, place, round(1.0 / (60 + in_group), 9) as score from c union all select query_id, doc_id, 8 + i, 0.0 from h)
select query_id, doc_id, place, score, md5(text) as text_md5 from u join documents using (doc_id)""")
def qa_candidates(t: Tables) -> DataFrame:
    """Each language's list, interleaved by reciprocal rank, one document a source, whole texts, then what the first three refer to
    (here: the next document, if its language is the same) with score 0."""
    docs = t.documents.select("doc_id", "lang", "source", "text")
    lists = S.bm25_top(t.documents, t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 10, group="lang").drop("score").withColumnRenamed("rank", "in_group")
    once = R.keep_best(lists.join(docs.select("doc_id", "source"), "doc_id"), ["query_id", "lang", "source"], [F.col("in_group")])
    cut = G.settled(R.top_k(once.withColumn("score", 1.0 / (60 + F.col("in_group"))), ["query_id"], [F.desc("score"), F.col("doc_id")], 8, "place"))
    next_one = cut.filter("place <= 3").select("query_id", "lang", (F.col("doc_id") + 1).alias("doc_id"), "place")
    hops = next_one.join(docs.select("doc_id", "lang"), ["doc_id", "lang"]).groupBy("query_id", "doc_id").agg(F.min("place").alias("via"))
    hops = R.top_k(hops.join(cut.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"), ["query_id"], [F.col("via"), F.col("doc_id")], 5, "i")
    every = cut.select("query_id", "doc_id", "place", F.round("score", 9).alias("score")).union(hops.select("query_id", "doc_id", F.col("i") + 8, F.lit(0.0)))
    return every.join(docs, "doc_id").select("query_id", "doc_id", "place", "score", F.md5("text").alias("text_md5"))


@query("linked_evidence", "R31 J5", "with " + EDGES + """,
q as (select item_id, 'p' || (item_id * 7 % 300) as seed from benchmark),
b as (select distinct item_id, head, tail, relation, jurisdiction, article, confidence from q join (select * from e) e on head = seed or tail = seed),
c as (select *, row_number() over (partition by item_id order by confidence desc, head, tail, relation, jurisdiction, article)::int as place from b qualify place <= 12),
f as (select * from c where jurisdiction in ('j1', 'j2', 'j3', 'j4', 'j5', 'j6', 'j7', 'j8', 'j9')),
a as (select item_id, article, min(place) as first from f group by all),
s as (select item_id, article, first, row_number() over (partition by item_id order by first)::int as i from a qualify i <= 6)
select item_id, article, i, md5(case when length(text) > 400 then substr(text, 1, 400) || '...(cut)' else text end) as snippet_md5, (select count(*) from f where f.item_id = s.item_id) as edges from s join documents on doc_id = substr(article, 2)::bigint""")
def linked_evidence(t: Tables) -> DataFrame:
    """A query's entity, the edges around it (the surest twelve), those of the jurisdictions asked for, and snippets of six articles."""
    q = t.benchmark.select("item_id", F.concat(F.lit("p"), _text(F.col("item_id") * 7 % 300)).alias("seed"))
    e = kg_edges(t)
    touching = q.join(e, F.col("seed") == F.col("head")).union(q.join(e, F.col("seed") == F.col("tail"))).drop("seed").distinct()
    order = [F.desc("confidence"), *(F.col(c) for c in ("head", "tail", "relation", "jurisdiction", "article"))]
    f = G.settled(R.top_k(touching, ["item_id"], order, 12, "place").filter(F.col("jurisdiction").isin(*(f"j{i}" for i in range(1, 10)))))
    first = R.top_k(f.groupBy("item_id", "article").agg(F.min("place").alias("first")), ["item_id"], [F.col("first")], 6, "i")
    texts = t.documents.select(F.concat(F.lit("a"), _text("doc_id")).alias("article"), X.cut_text(F.col("text"), 400).alias("snippet"))
    edges = f.groupBy("item_id").agg(F.count("*").alias("edges"))
    return first.join(texts, "article").join(edges, "item_id").select("item_id", "article", "i", F.md5("snippet").alias("snippet_md5"), "edges")


@query("chain_paths", "G18 G24 J6 G21", "with " + EDGES + """,
c as (select jurisdiction as j, article, head as concept, max(confidence) as conf, max(relation) as scope from e group by all),
x as (select a.article as source, b.j, b.article as target, a.concept, round(case when b.scope = 'R' then 1 + b.conf else 0.5 + 0.5 * b.conf end, 6) as score, b.scope <> 'R' as wide from c a join c b using (concept) where a.j = 'j1' and b.j in ('j2', 'j3') and a.article in ('a1', 'a2', 'a7')),
k as (select *, row_number() over (partition by source, j, target, wide order by score desc, concept) as r from x qualify not wide or r = 1),
n as (select j, count(distinct concept) as n from c where j in ('j1', 'j2', 'j3') group by j),
s as (select b.j, count(distinct concept) as shared from c a join c b using (concept) where a.j = 'j1' and b.j in ('j2', 'j3') group by b.j),
l as (select article as source, s.j, '' as target, '' as concept, round(2 + shared::double / (na.n + nb.n - shared), 6) as score from s join n nb on nb.j = s.j join n na on na.j = 'j1', (select distinct article from c where j = 'j1' and article in ('a1', 'a2', 'a7')))
select source, j, target, concept, score, row_number() over (partition by source order by score desc, j, target, concept)::int as place from (select source, j, target, concept, score from k union all select * from l) qualify place <= 20""")
def chain_paths(t: Tables) -> DataFrame:
    """From source articles over shared concepts to articles of other jurisdictions, and over the likeness of whole laws: a law path
    scores 2 and its likeness, a concept 1 and its confidence in an article, half of both in a law (one such path a target)."""
    c = G.settled(kg_edges(t).groupBy(F.col("jurisdiction").alias("j"), "article", F.col("head").alias("concept")).agg(F.max("confidence").alias("conf"), F.max("relation").alias("scope")))
    mine, other = c.filter("j = 'j1'"), c.filter("j in ('j2', 'j3')")
    sources = mine.filter(F.col("article").isin("a1", "a2", "a7"))
    wide = F.col("scope") != "R"
    met = sources.select(F.col("article").alias("source"), "concept").join(other.withColumnRenamed("article", "target"), "concept")
    met = met.withColumn("wide", wide).withColumn("score", F.round(F.when(wide, 0.5 + 0.5 * F.col("conf")).otherwise(1 + F.col("conf")), 6))
    kept = R.ranked(met, ["source", "j", "target", "wide"], [F.desc("score"), F.col("concept")], "r").filter("not wide or r = 1").select("source", "j", "target", "concept", "score")
    number = lambda df: df.select("j", "concept").distinct()
    na = number(mine).agg(F.count("*").alias("na"))
    nb = number(other).groupBy("j").agg(F.count("*").alias("nb"))
    both = number(other).join(number(mine).select("concept"), "concept").groupBy("j").agg(F.count("*").alias("shared"))
    law = both.join(nb, "j").crossJoin(na).select("j", F.round(2 + F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("score"))
    laws = sources.select(F.col("article").alias("source")).distinct().crossJoin(law).select("source", "j", F.lit("").alias("target"), F.lit("").alias("concept"), "score")
    return R.top_k(kept.union(laws), ["source"], [F.desc("score"), *(F.col(x) for x in ("j", "target", "concept"))], 20, "place")


@query("network_graph", "G14 W8 T4 C21", f"""
with n as (select x.vec_id as a, y.vec_id as b, {COS} as c from embeddings x, embeddings y where x.label in (2, 3, 4) and y.label in (2, 3, 4) and x.label < y.label),
l as (select vec_id, label from embeddings),
r as (select n.*, la.label as la, lb.label as lb from n join l la on la.vec_id = a join l lb on lb.vec_id = b),
k as (select *, row_number() over (partition by a, lb order by round(c, 9) desc, b) as ra, row_number() over (partition by b, la order by round(c, 9) desc, a) as rb from r),
s as (select a, b, case when c >= 0.3 then 'equal' when c >= 0.2 then 'similar' else 'related' end as kind, round(c, 6) as weight from k where ra <= 2 or rb <= 2),
o as (select vec_id as a, lead(vec_id) over (partition by label order by vec_id) as b, 'next' as kind, 1.0::double as weight from embeddings where label in (2, 3, 4)),
g as (select * from s union all select * from o where b is not null),
d as (select node, count(*) as degree from (select a as node from g union all select b from g) group by node)
select a, b, kind, weight, da.degree as degree_a, db.degree as degree_b from g join d da on da.node = a join d db on db.node = b""")
def network_graph(t: Tables) -> DataFrame:
    """Articles of three laws: each follows the one before, and each pair of laws is aligned by the best of rows and columns."""
    v = t.embeddings
    best = [S.row_and_column_best(v.filter(f"label = {x}"), v.filter(f"label = {y}"), "vec_id", "embedding", 2) for x, y in ((2, 3), (2, 4), (3, 4))]
    kind = F.when(F.col("cosine") >= 0.3, "equal").when(F.col("cosine") >= 0.2, "similar").otherwise("related")
    aligned = best[0].union(best[1]).union(best[2]).select("a", "b", kind.alias("kind"), F.round("cosine", 6).alias("weight"))
    rows = v.filter("label in (2, 3, 4)").select("label", F.col("vec_id").alias("a"))
    follows = O.next_pairs(rows, ["label"], [F.col("a")], "a").select("a", F.col("next").alias("b"), F.lit("next").alias("kind"), F.lit(1.0).alias("weight"))
    g = G.settled(aligned.union(follows))
    degree = g.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    side = lambda c: degree.select(F.col("node").alias(c), F.col("degree").alias(f"degree_{c}"))
    return g.join(side("a"), "a").join(side("b"), "b").select("a", "b", "kind", "weight", "degree_a", "degree_b")


@query("lexical_network", "G14 C25", """
with w as (select p_brand as law, p_partkey as node, unnest(list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))) as word from part where p_brand in (select distinct p_brand from part order by p_brand limit 3)),
f as (select word, count(*) as n from w group by word), n as (select node, count(*) as n from w group by node),
m as (select x.node as a, y.node as b, count(*) as shared from w x join w y using (word) where x.law < y.law group by all),
j as (select a, b, round(shared::double / (na.n + nb.n - shared), 6) as jaccard from m join n na on na.node = a join n nb on nb.node = b)
select a, b, jaccard, row_number() over (partition by a order by jaccard desc, b)::int as place from j where jaccard >= 0.2 qualify place <= 3""")
def lexical_network(t: Tables) -> DataFrame:
    """Articles of three laws joined by the words they share, the best three of each."""
    laws = R.top_k(t.part.select("p_brand", F.lit(1).alias("one")).distinct(), ["one"], [F.col("p_brand")], 3).select("p_brand")
    words = F.explode(F.array_distinct(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " "))).alias("word")
    w = t.part.join(laws, "p_brand", "left_semi").select(F.col("p_brand").alias("law"), F.col("p_partkey").alias("node"), words)
    kept = w.filter("node is not null").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("law", "word"))).alias("words"))
    members = G.settled(kept.join(kept.groupBy("words").agg(F.min("node").alias("kind")), "words").select("kind", "node", "words"))
    # nodes with the same words in the same laws are one kind: kinds meet, and each kind's first three nodes stand for it
    kinds = members.filter("kind = node").select("kind", F.size("words").alias("n"), F.explode("words").alias("x")).select("kind", "n", "x.*")
    side = lambda s: kinds.select("word", F.col("law").alias(f"l{s}"), F.col("kind").alias(f"k{s}"), F.col("n").alias(f"n{s}"))
    j = side("a").hint("merge").join(side("b"), "word").filter("la < lb").groupBy("ka", "kb", "na", "nb").agg(F.count("*").alias("both"))
    j = j.select("ka", "kb", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("jaccard")).filter("jaccard >= 0.2")
    first = R.top_k(members.select("kind", "node"), ["kind"], [F.col("node")], 3).select(F.col("kind").alias("kb"), F.col("node").alias("b"))
    best = R.top_k(j.join(first, "kb"), ["ka"], [F.desc("jaccard"), F.col("b")], 3, "place")
    return best.join(members.select(F.col("kind").alias("ka"), F.col("node").alias("a")), "ka").select("a", "b", "jaccard", "place")


@query("gold_plan", "E9 W18", """
with c as (select source, lang, count(*) as n from documents group by all),
k as (select source, count(*) as langs, sum(n)::bigint as n, max(n) as most from c group by source),
t as (select source, langs, n, case when most >= 0.7 * n then 'core' when most >= 0.5 * n then 'mid' else 'rare' end as tier from k),
f as (select source, tier, case when langs = 1 then 'F1' when langs >= 4 then 'F3' else 'F2' end as family, n from t),
p as (select family, tier, source, row_number() over (partition by family, tier order by n desc, source)::int as place from f qualify place <= 4)
select family, tier, p.source, place, doc_id, row_number() over (partition by p.source order by n_chars desc, doc_id)::int as pick from p join documents d on d.source = p.source qualify pick <= 2""")
def gold_plan(t: Tables) -> DataFrame:
    """Cells of topic and language, tiers by the share of the leading one, families by the number of languages, and of each family
    and tier the topics with most documents, with two documents each."""
    cells = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    k = cells.groupBy("source").agg(F.count("*").alias("langs"), F.sum("n").alias("n"), F.max("n").alias("most"))
    share = F.col("most") / F.col("n")
    tier = F.when(F.col("most") >= F.lit("0.7").cast("decimal(2,1)") * F.col("n"), "core").when(F.col("most") >= F.lit("0.5").cast("decimal(2,1)") * F.col("n"), "mid").otherwise("rare")
    family = F.when(F.col("langs") == 1, "F1").when(F.col("langs") >= 4, "F3").otherwise("F2")
    plan = R.top_k(k.withColumn("share", share).select("source", tier.alias("tier"), family.alias("family"), "n"), ["family", "tier"], [F.desc("n"), F.col("source")], 4, "place").drop("n")
    docs = R.top_k(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 2, "pick").drop("n_chars")
    return plan.join(docs, "source").select("family", "tier", "source", "place", "doc_id", "pick")


@query("gold_plan_families", "E9 W18", None)
def gold_plan_families(t: Tables) -> DataFrame:
    """The three families over nations (regions, in order), kinds of parts (topics) and suppliers (documents)."""
    sold = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    rows = sold.select(F.format_string("n%02d", F.col("s_nationkey")).alias("region"), F.col("p_type").alias("topic"), F.col("s_suppkey").alias("document"))
    return P.planned(rows, [f"n{i:02d}" for i in range(25)], 3)


@query("model_rerank", "R17 W21", "with " + bm25_sql("documents", "text", "s") + """,
r as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id)::int as rank from s qualify rank <= 10),
w as (select r.*, case when rank > 6 then 2 when trim(d.text) = '' then 1 else 0 end as stage, (length(substr(d.text, 1, 500)) * 31 + length(b.text) * 17) % 97 as m from r join documents d using (doc_id) join benchmark b on b.item_id = r.query_id)
select query_id, doc_id, rank, case when stage = 0 then m::double end as new_score, row_number() over (partition by query_id order by stage, case when stage = 0 then m end desc nulls last, rank)::int as new_rank from w""")
def model_rerank(t: Tables) -> DataFrame:
    """Any function of batches of (query, text) may score the window's first 500 characters; this one stands in for a model."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = S.bm25_top(t.documents, q, 10).drop("score").join(t.documents.select("doc_id", "text"), "doc_id").join(q, "query_id")
    score = S.model_score(lambda queries, texts: [float((len(x) * 31 + len(y) * 17) % 97) for y, x in zip(queries, texts, strict=True)])
    return R.two_stage(hits, ["query_id"], score(F.col("query"), F.col("text")), 6, F.trim("text") == "").select("query_id", "doc_id", "rank", "new_score", "new_rank")


@query("complexity_routes", "R23", """
select conv_id, turn, case when length(text) > 400 or length(text) - length(replace(text, '?', '')) > 1 then 'complex' when contains(lower(text), 'compare') or contains(lower(text), ' versus ') or contains(lower(text), 'why') then 'complex' when length(text) < 40 then 'simple' else 'standard' end as mode from conversations""")
def complexity_routes(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.complexity(F.col("text"), ["compare", " versus ", "why"]).alias("mode"))


@query("triple_seeds", "R30", "with " + EDGES + """,
a as (select jurisdiction, article as node, 0 as src, -max(confidence) as x from e where relation = 'R' group by all),
n as (select jurisdiction, unnest([head, tail]) as node, confidence from e where relation = 'R'),
b as (select jurisdiction, node, 1 as src, -max(confidence) as x from n where length(node) <= 3 group by all),
c as (select * from a qualify row_number() over (partition by jurisdiction order by x, node) <= 6 union all select * from b qualify row_number() over (partition by jurisdiction order by x, node) <= 12)
select jurisdiction, node, row_number() over (partition by jurisdiction order by src, x, node)::int as place from c""")
def triple_seeds(t: Tables) -> DataFrame:
    """Articles come first, then twelve entities with short names."""
    e = kg_edges(t).filter("relation = 'R'")
    x = (-F.max("confidence")).alias("x")
    articles = e.groupBy("jurisdiction", F.col("article").alias("node")).agg(x).withColumn("src", F.lit(0))
    names = e.select("jurisdiction", F.explode(F.array("head", "tail")).alias("node"), "confidence").filter(F.length("node") <= 3).groupBy("jurisdiction", "node").agg(x).withColumn("src", F.lit(1))
    cut = lambda df, k: R.top_k(df, ["jurisdiction"], [F.col("x"), F.col("node")], k).drop("rank")
    return R.ranked(cut(articles, 6).unionByName(cut(names, 12)), ["jurisdiction"], [F.col("src"), F.col("x"), F.col("node")], "place").select("jurisdiction", "node", "place")


#: Edges of parts and suppliers, whose number grows with the tables; an article is named after its supplier.
PART_EDGES = """e as (select l_partkey as head, l_returnflag as relation, l_suppkey as tail, l_suppkey as article, max(round(0.5 + l_discount * 5, 2)) as confidence
  from lineitem where (l_partkey + l_suppkey) % 25 in (1, 2) group by all)"""


@query("evidence_of_linked", "R31 G17 J5", "with " + PART_EDGES + """,
n as (select x.vec_id as q, y.vec_id as entity, """ + COS + """ as c from embeddings x join benchmark on item_id = x.vec_id, embeddings y where y.label <> 9 and x.vec_id <> y.vec_id),
k as (select q, entity, row_number() over (partition by q order by round(c, 9) desc, entity)::int as rank from n qualify rank <= 5),
w as (select alias, min(p_partkey) as entity from (select lower(split_part(p_name, ' ', 1)) as alias, p_partkey from part) where length(alias) >= 2 group by alias),
l as (select item_id as q, entity from benchmark join w on contains(regexp_replace(lower(text), '\\s+', '', 'g'), alias)),
s as (select q, entity, min(o) as o from (select q, entity, 0 as o from l union all select q, entity, rank from k) group by all),
seeds as (select q, entity from s qualify row_number() over (partition by q order by o, entity) <= 5),
a as (select distinct q, e.* from seeds join e on head = entity or tail = entity),
a12 as (select *, row_number() over (partition by q order by confidence desc, head, tail, relation, article)::int as place from a qualify place <= 12),
h as (select q, count(*)::int as held from a12 group by q),
f as (select q, head as node from a12 join h using (q) where held < 12 union select q, tail from a12 join h using (q) where held < 12),
b as (select distinct q, e.* from f join e on head = node or tail = node),
b12 as (select b.*, held + row_number() over (partition by q order by confidence desc, head, tail, relation, article)::int as place from b join h using (q) anti join a12 using (q, head, relation, tail, article) qualify place <= 12),
u as (select q, article, place from a12 union all select q, article, place from b12),
t as (select q, article, row_number() over (partition by q order by first)::int as i from (select q, article, min(place) as first from u group by all) qualify i <= 6)
select q as item_id, article, i, md5(case when length(text) > 400 then substr(text, 1, 400) || '...(cut)' else text end) as snippet_md5, (select count(*) from u where u.q = t.q) as edges from t join documents on doc_id = article""")
def evidence_of_linked(t: Tables) -> DataFrame:
    """Entities linked from a question's text and vector, two hops of edges around them in the jurisdictions asked for, twelve edges,
    and snippets of six articles."""
    asked = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = S.knn(asked, t.embeddings.filter("label != 9"), "vec_id", "embedding", 5).select(F.col("a").alias("question"), F.col("b").alias("entity"), "rank")
    questions = t.benchmark.select(F.col("item_id").alias("question"), "text")
    seeds = V.linked(questions, t.part.select(F.split("p_name", " ")[0].alias("alias"), F.col("p_partkey").alias("entity")), near)
    edges = t.lineitem.select(F.col("l_partkey").alias("head"), F.col("l_returnflag").alias("relation"), F.col("l_suppkey").alias("tail"), F.col("l_suppkey").alias("article"), F.round(0.5 + F.col("l_discount") * 5, 2).alias("confidence"), ((F.col("l_partkey") + F.col("l_suppkey")) % 25).cast("string").alias("jurisdiction"))
    found = V.around(seeds, edges, allowed=("1", "2"))
    got = V.quoted(found, t.documents.select(F.col("doc_id").alias("article"), "text"))
    return got.select(F.col("question").alias("item_id"), "article", "i", F.md5("snippet").alias("snippet_md5"), "edges")
