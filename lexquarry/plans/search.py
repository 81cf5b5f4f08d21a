"""Search, fusion and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import ranking as R
from ..operators import search as S
from ..operators.graph import settled
from .registry import Tables, query

TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(docs: str, text: str, name: str) -> str:
    """CTEs that end in {name}(query_id, doc_id, score)."""
    return rf"""
{name}_t as (select doc_id, {TOK.format(f"coalesce({text}, '')")} as toks from {docs}),
{name}_n as (select count(*) as n, avg(len(toks)) as mean from {name}_t),
{name}_x as (select doc_id, len(toks) as dl, unnest(toks) as term from {name}_t),
{name}_tf as (select doc_id, dl, term, count(*) as tf from {name}_x group by all),
{name}_df as (select term, count(*) as df from {name}_tf group by term),
{name}_q as (select distinct query_id, term from (select item_id as query_id, unnest({TOK.format("text")}) as term from benchmark)),
{name} as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) as score
  from {name}_tf join {name}_df using (term) join {name}_q using (term), {name}_n group by query_id, doc_id)"""


def _queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25(t: Tables, k: int) -> DataFrame:
    return S.bm25_top(t.documents, _queries(t), k)


BM25_TOP = "with " + bm25_sql("documents", "text", "s") + """,
r as (select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from s)
select query_id, doc_id, score, rank::int as rank from r where rank <= {k}"""


@query("bm25_topk", "R1 W2 T5", BM25_TOP.replace("{k}", "10"))
def bm25_topk(t: Tables) -> DataFrame:
    return _bm25(t, 10)


TITLED = "(select doc_id, text, split_part(text, chr(10), 1) as title from documents)"


@query("bm25_multifield", "R1 F1", "with d as " + TITLED + "," + bm25_sql("d", "text", "a") + "," + bm25_sql("d", "title", "b") + """,
u as (select query_id, doc_id, 3 * score as score from a union all select query_id, doc_id, 5 * score from b),
m as (select query_id, doc_id, round(max(score), 6) as score from u group by all),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from m)
select query_id, doc_id, score, rank::int as rank from r where rank <= 10""")
def bm25_multifield(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title"))
    return S.bm25_top(docs, _queries(t), 10, {"text": 3.0, "title": 5.0})


COS = "list_dot_product(x.embedding::double[], y.embedding::double[])"


def knn_sql(k: int, where: str = "x.vec_id <> y.vec_id", left: str = "embeddings", right: str = "embeddings") -> str:
    return f"""
n as (select x.vec_id as a, y.vec_id as b, {COS} as cosine, x.label as la, y.label as lb from {left} x, {right} y where {where}),
k as (select a, b, la, lb, round(cosine, 6) as cosine, row_number() over (partition by a order by round(cosine, 9) desc, b)::int as rank from n qualify rank <= {k})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("cosine", F.round("cosine", 6))


@query("knn_topk_per_query", "T1 R2 J8 O1", "with " + knn_sql(5) + " select a, b, cosine, rank from k")
def knn_topk_per_query(t: Tables) -> DataFrame:
    return _rounded(S.knn(t.embeddings, t.embeddings, "vec_id", "embedding", 5))


@query("knn_inverted_file", "T1 O1", "with " + knn_sql(5, "x.vec_id % 20 = 0 and x.vec_id <> y.vec_id") + " select a, b, cosine, rank from k")
def knn_inverted_file(t: Tables) -> DataFrame:
    """The inverted file with every cell probed, where it is exact."""
    return _rounded(S.knn_probed(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 5, cells=16, probes=16))


@query("knn_excluding_own_label", "J12 T3 R20", "with " + knn_sql(5, "x.label <> y.label") + " select a, b, cosine, rank from k")
def knn_excluding_own_label(t: Tables) -> DataFrame:
    return _rounded(S.knn_within(t.embeddings, "label", "vec_id", "embedding", 5, same=False)).select("a", "b", "cosine", "rank")


@query("knn_type_excluded", "T2 S31", "with " + knn_sql(3, "x.vec_id <> y.vec_id and y.label not in (0, 9)") + " select a, b, cosine, rank from k")
def knn_type_excluded(t: Tables) -> DataFrame:
    return _rounded(S.knn(t.embeddings, t.embeddings.filter("label not in (0, 9)"), "vec_id", "embedding", 3))


@query("knn_prefiltered_queries", "R4 O5", "with " + knn_sql(3, "x.label = 1 and y.label in (2, 3)") + " select a, b, cosine, rank from k")
def knn_prefiltered_queries(t: Tables) -> DataFrame:
    return _rounded(S.knn(t.embeddings.filter("label = 1"), t.embeddings.filter("label in (2, 3)"), "vec_id", "embedding", 3))


@query("mapping_best_target", "J8 A25", "with " + knn_sql(1, "x.label < 5 and y.label >= 5") + """
select la as label, count(*) filter (cosine >= 0.4) as high, count(*) filter (cosine >= 0.3 and cosine < 0.4) as medium,
  count(*) filter (cosine < 0.3) as none, round(avg(case when cosine > 0 then cosine end), 6) as mean_positive from k group by la""")
def mapping_best_target(t: Tables) -> DataFrame:
    best = _rounded(S.knn(t.embeddings.filter("label < 5"), t.embeddings.filter("label >= 5"), "vec_id", "embedding", 1))
    labelled = best.join(t.embeddings.select(F.col("vec_id").alias("a"), "label"), "a")
    return labelled.groupBy("label").agg(
        F.count_if(F.col("cosine") >= 0.4).alias("high"), F.count_if((F.col("cosine") >= 0.3) & (F.col("cosine") < 0.4)).alias("medium"),
        F.count_if(F.col("cosine") < 0.3).alias("none"), F.round(F.avg(F.when(F.col("cosine") > 0, F.col("cosine"))), 6).alias("mean_positive"),
    )


@query("mutual_best_matrix", "A26 T4", "with " + knn_sql(1) + """,
m as (select p.la, p.lb, p.a, p.b from k p join k q on p.b = q.a and q.b = p.a)
select la, lb, count(*) as pairs from m group by la, lb""")
def mutual_best_matrix(t: Tables) -> DataFrame:
    best = settled(S.knn(t.embeddings, t.embeddings, "vec_id", "embedding", 1).select("a", "b"))
    mutual = best.join(best.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    label = lambda s: t.embeddings.select(F.col("vec_id").alias(s), F.col("label").alias(f"l{s}"))
    return mutual.join(label("a"), "a").join(label("b"), "b").groupBy("la", "lb").agg(F.count("*").alias("pairs"))


@query("rowcol_topk_union", "T4 J7 O12", "with n as (select x.vec_id as a, y.vec_id as b, " + COS + """ as c from embeddings x, embeddings y where x.label = 0 and y.label = 1),
r as (select *, row_number() over (partition by a order by round(c, 9) desc, b) as ra, row_number() over (partition by b order by round(c, 9) desc, a) as rb from n)
select a, b, round(c, 6) as cosine from r where (ra <= 2 or rb <= 2) and c >= 0.1""")
def rowcol_topk_union(t: Tables) -> DataFrame:
    e = t.embeddings
    return _rounded(S.row_and_column_best(e.filter("label = 0"), e.filter("label = 1"), "vec_id", "embedding", 2).filter("cosine >= 0.1"))


RUNS = """
with l as (select vec_id % 20 as q, vec_id as item, row_number() over (partition by vec_id % 20 order by label, vec_id)::int as rank from embeddings),
m as (select vec_id % 20 as q, vec_id as item, row_number() over (partition by vec_id % 20 order by label desc, vec_id)::int as rank from embeddings),
a as (select *, 0 as list from l where rank <= 15), b as (select *, 1 as list from m where rank <= 15)"""


def _runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.embeddings.select((F.col("vec_id") % 20).alias("q"), F.col("vec_id").alias("item"), "label")
    cut = lambda *order: R.top_k(e, ["q"], [*order, F.col("item")], 15).select("q", "item", "rank")
    return cut(F.col("label")), cut(F.desc("label"))


@query("rrf_fusion", "X1 X2", RUNS + """,
u as (select * from a union all select * from b),
g as (select q, item, sum(1.0::double / (60.0::double + rank)) as score, min(list * 1000 + rank) as first from u group by all)
select q, item, round(score, 9) as score, (first // 1000)::int as first_list, (first % 1000)::int as first_rank,
  row_number() over (partition by q order by round(score, 12) desc, first, item)::int as rank from g""")
def rrf_fusion(t: Tables) -> DataFrame:
    return R.rrf(_runs(t), ["q"], "item").withColumn("score", F.round("score", 9))


#: Ends in query_id, doc_id, score, rank, cosine of the first {n}.
HYBRID = "with " + bm25_sql("documents", "text", "s") + """,
lex as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id)::int as rank from s qualify rank <= 3 * {n}),""" + knn_sql(100, "true", "(select * from embeddings where vec_id in (select item_id from benchmark))") + """,
sem as (select a as query_id, b as doc_id, rank, cosine from k where rank <= 3 * {n}),
u as (select query_id, doc_id, rank, 0 as list from sem union all select query_id, doc_id, rank, 1 from lex),
g as (select query_id, doc_id, sum(1.0::double / (60.0::double + rank)) as score, min(list * 1000 + rank) as first from u group by all),
f as (select *, row_number() over (partition by query_id order by round(score, 12) desc, first, doc_id)::int as rank from g qualify rank <= {n})
select f.query_id, f.doc_id, round(f.score, 9) as score, f.rank, sem.cosine from f left join sem using (query_id, doc_id)"""


def hybrid_hits(t: Tables, n: int) -> DataFrame:
    q = _queries(t)
    vectors = t.embeddings.join(q.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    semantic = S.knn(vectors, t.embeddings, "vec_id", "embedding", 3 * n, skip_self=False).select(F.col("a").alias("query_id"), F.col("b").alias("doc_id"), "rank", F.round("cosine", 6).alias("cosine"))
    fused = S.hybrid(_bm25(t, 3 * n), semantic, "query_id", "doc_id", n)
    return fused.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank", "cosine")


@query("hybrid_search", "R3", HYBRID.replace("{n}", "10"))
def hybrid_search(t: Tables) -> DataFrame:
    return hybrid_hits(t, 10)


@query("bm25_four_fields", "R1 R12", "with d as (select doc_id, text, split_part(text, chr(10), 1) as title, translate(text, 'ae', 'xy') as other, source from documents)," + ",".join(bm25_sql("d", c, n).replace(TOK.format("text") + ") as term from benchmark", TOK.format("text || ' ' || translate(text, 'ae', 'xy')") + ") as term from benchmark") for n, c in (("a", "text"), ("b", "other"), ("c", "title"), ("e", "source"))) + """,
u as (select query_id, doc_id, 3 * score as score from a union all select query_id, doc_id, 3 * score from b union all select query_id, doc_id, 5 * score from c union all select query_id, doc_id, 2 * score from e),
m as (select query_id, doc_id, round(max(score), 6) as score from u group by all),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from m)
select query_id, doc_id, score, rank::int as rank from r where rank <= 10""")
def four_fields(t: Tables) -> DataFrame:
    """Four boosted fields, one of them the text in the other script (here a stand-in map), and queries in both scripts."""
    docs = t.documents.select("doc_id", "text", F.substring_index("text", "\n", 1).alias("title"), F.translate("text", "ae", "xy").alias("other"), "source")
    both = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "text", F.translate("text", "ae", "xy")).alias("query"))
    return S.bm25_top(docs, both, 10, {"text": 3.0, "other": 3.0, "title": 5.0, "source": 2.0})


def _longest(t: Tables, each: int) -> DataFrame:
    """Of each language as many documents as a list of that length can take."""
    return R.top_k(t.documents.select("doc_id", "lang", "n_chars", F.lit(1).alias("q")), ["lang"], [F.desc("n_chars"), F.col("doc_id")], each)


@query("round_robin_diversify", "W3 W19 R9", """
with d as (select doc_id, lang, row_number() over (order by n_chars desc, doc_id)::int as rank from documents),
r as (select *, row_number() over (partition by lang order by rank)::int as depth, min(rank) over (partition by lang) as lead from d)
select doc_id, lang, depth, row_number() over (order by depth, lead)::int as place from r qualify place <= 20""")
def round_robin_diversify(t: Tables) -> DataFrame:
    d = _longest(t, 20).withColumn("rank", F.struct((-F.col("n_chars")).alias("less"), "doc_id"))
    return R.round_robin(d, ["q"], "lang", 20).select("doc_id", "lang", "depth", "place")


@query("diverse_select_fill", "W4 G21", """
with r as (select *, row_number() over (partition by lang order by n_chars desc, doc_id) = 1 as best from documents),
s as (select *, case when not best then 3 when lang = 'en' then 2 when lang in ('fr', 'de') then 0 else 1 end as tier from r)
select doc_id, lang, tier::int as tier, row_number() over (order by tier, n_chars desc, doc_id)::int as place from s qualify place <= 12""")
def diverse_select_fill(t: Tables) -> DataFrame:
    out = R.diverse_fill(_longest(t, 12), ["q"], "lang", F.col("lang") == "en", F.col("lang").isin("fr", "de"), 12, "n_chars", "doc_id")
    return out.select("doc_id", "lang", "tier", "place")


@query("two_stage_rerank", "W21 R17 O10", "with " + bm25_sql("documents", "text", "s") + """,
r as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id)::int as rank from s qualify rank <= 10),
w as (select r.*, case when rank > 6 then 2 when trim(d.text) = '' then 1 else 0 end as stage,
  list_distinct(""" + TOK.format("b.text") + """) as qt, """ + TOK.format("substr(d.text, 1, 500)") + """ as dt
  from r join documents d using (doc_id) join benchmark b on b.item_id = r.query_id),
x as (select *, case when stage = 0 then round(len(list_intersect(qt, list_distinct(dt)))::double / greatest(len(qt), 1), 6) end as new_score from w)
select query_id, doc_id, rank, new_score, row_number() over (partition by query_id order by stage, new_score desc nulls last, rank)::int as new_rank from x""")
def two_stage_rerank(t: Tables) -> DataFrame:
    hits = _bm25(t, 10).drop("score").join(t.documents.select("doc_id", F.substring("text", 1, 500).alias("text")), "doc_id").join(_queries(t), "query_id")
    score = F.round(S.overlap_score(F.col("query"), F.col("text")), 6)
    return R.two_stage(hits, ["query_id"], score, 6, F.trim("text") == "").select("query_id", "doc_id", "rank", "new_score", "new_rank")


@query("pin_exact_match", "W22", RUNS + """ select q, item, rank, row_number() over (partition by q order by (item % 7 = 3)::int desc, rank)::int as new_rank from a""")
def pin_exact_match(t: Tables) -> DataFrame:
    return R.pinned(_runs(t)[0], ["q"], F.col("item") % 7 == 3).select("q", "item", "rank", "new_rank")


@query("display_similarity", "W23 R24", "with " + knn_sql(3) + """
select a, b, round(greatest(0, least(1, cosine)), 4) as shown, round(2 / (3 - cosine), 6) as display from k""")
def display_similarity(t: Tables) -> DataFrame:
    near = _rounded(S.knn(t.embeddings, t.embeddings, "vec_id", "embedding", 3))
    return near.select("a", "b", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "cosine")), 4).alias("shown"), F.round(2 / (3 - F.col("cosine")), 6).alias("display"))


@query("quota_over_seeds", "W5 W6", """
with r as (select l_suppkey % 10 as q, l_suppkey as seed, l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem),
p as (select *, row_number() over (partition by q, seed order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey)::int as depth from r qualify depth <= 6)
select q, seed, l_orderkey, l_extendedprice, depth, row_number() over (partition by q order by depth, seed)::int as place from p qualify place <= 36""")
def quota_over_seeds(t: Tables) -> DataFrame:
    r = t.lineitem.withColumn("q", F.col("l_suppkey") % 10).withColumn("seed", F.col("l_suppkey"))
    out = R.quota_round_robin(r, ["q"], "seed", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 6, 36)
    return out.select("q", "seed", "l_orderkey", "l_extendedprice", "depth", "place")


@query("candidate_convergence", "T6", """
with r as (select *, event_type = 'purchase' as p, row_number() over (partition by user_id, event_type = 'purchase' order by value desc, event_id) as i from events)
select user_id, event_id, row_number() over (partition by user_id order by (case when p and i <= 3 then 0 else 1 end), value desc, event_id)::int as place from r qualify place <= 8""")
def candidate_convergence(t: Tables) -> DataFrame:
    return R.converge(t.events, ["user_id"], F.col("event_type") == "purchase", 3, 8, [F.desc("value"), F.col("event_id")]).select("user_id", "event_id", "place")


@query("merge_keep_max", "X3 X8 R32 R34", RUNS + """,
u as (select q, item, 100 - rank as score from a union all select q, item, 90 - rank from b)
select q, item, max(score)::int as score from u group by q, item""")
def merge_keep_max(t: Tables) -> DataFrame:
    a, b = _runs(t)
    score = lambda df, x: df.select("q", "item", (F.lit(x) - F.col("rank")).alias("score"))
    return R.merge_keep_max([score(a, 100), score(b, 90)], ["q", "item"], "score", "item")


@query("seeded_sample", "S8 E16", """
select lang, doc_id, row_number() over (partition by lang order by md5('42' || doc_id::varchar), doc_id)::int as draw from documents qualify draw <= 15""")
def seeded_sample(t: Tables) -> DataFrame:
    return R.sampled(t.documents.select("lang", "doc_id"), ["lang"], "doc_id", 15)


@query("routed_search", "R9", "with " + bm25_sql("documents", "text", "s") + """,
r as (select query_id, lang, doc_id, row_number() over (partition by query_id, lang order by round(score, 6) desc, doc_id)::int as in_group from s join documents using (doc_id) qualify in_group <= 10),
f as (select *, row_number() over (partition by query_id order by in_group, doc_id)::int as rank from r),
g as (select *, row_number() over (partition by query_id, lang order by rank)::int as depth, min(rank) over (partition by query_id, lang) as lead from f)
select query_id, lang, doc_id, in_group, row_number() over (partition by query_id order by depth, lead)::int as place from g qualify place <= 12""")
def routed_search(t: Tables) -> DataFrame:
    scored = S.bm25_top(t.documents, _queries(t), 10, group="lang").drop("rank")
    fused = R.ranked(S.route(scored, "query_id", "lang", "doc_id", 10), ["query_id"], [F.desc("rrf"), F.col("doc_id")])
    return R.round_robin(fused, ["query_id"], "lang", 12).select("query_id", "lang", "doc_id", "in_group", "place")


TOPIC_MAP = """
w as (select o_custkey % 40 as owner, l_partkey % 50 as key, count(*) as w from lineitem join orders on l_orderkey = o_orderkey group by all),
p as (select distinct a.owner as a, b.owner as b from w a join w b using (key) where a.owner < b.owner),
t as (select owner, sum(w)::bigint as total from w group by owner),
c as (select p.a, p.b, sum(least(x.w, y.w))::bigint as shared from p join w x on x.owner = p.a join w y on y.owner = p.b and x.key = y.key group by all),
j as (select p.a, p.b, round(coalesce(shared, 0) / (ta.total + tb.total - coalesce(shared, 0)), 6) as jaccard
  from p left join c using (a, b) join t ta on ta.owner = p.a join t tb on tb.owner = p.b)"""


def _jaccard(t: Tables) -> DataFrame:
    w = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy((F.col("o_custkey") % 40).alias("owner"), (F.col("l_partkey") % 50).alias("key")).agg(F.count("*").alias("w"))
    return S.weighted_jaccard(w, "owner", "key", "w")


@query("weighted_jaccard", "R19 A4 X4", "with " + TOPIC_MAP.strip() + " select a, b, jaccard from j")
def weighted_jaccard(t: Tables) -> DataFrame:
    return _jaccard(t)


@query("similar_owners", "R18 J11", "with " + TOPIC_MAP.strip() + """,
m as (select label, i, avg(x) as x from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all),
v as (select label, list(x order by i) as v, sqrt(sum(x * x)) as n from m group by label),
s as (select j.a, j.b, jaccard, list_dot_product(x.v, y.v) / (x.n * y.n) as cosine from j join v x on x.label = j.a % 10 join v y on y.label = j.b % 10)
select a, b, round(0.6 * jaccard + 0.4 * greatest(0, least(1, ((1 + cosine) / 2 - 0.2) / 0.8)), 6) as composite from s""")
def similar_owners(t: Tables) -> DataFrame:
    c = S.centroid(t.embeddings, ["label"], "embedding", "mean")
    x, y = (c.select(F.col("label").alias(f"l{s}"), "pos", F.col("x").alias(f"x{s}")) for s in ("a", "b"))
    cos = x.join(y, "pos").groupBy("la", "lb").agg(F.sum(F.col("xa") * F.col("xb")).alias("cosine"))
    j = _jaccard(t).withColumn("la", (F.col("a") % 10).cast("int")).withColumn("lb", (F.col("b") % 10).cast("int"))
    shown = ((1 + F.col("cosine")) / 2 - 0.2) / 0.8
    composite = 0.6 * F.col("jaccard") + 0.4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), shown))
    return j.join(cos, ["la", "lb"]).select("a", "b", F.round(composite, 6).alias("composite"))


@query("median_centroid", "A27", """
with m as (select label, i, median(x) as x from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all),
n as (select label, sqrt(sum(x * x)) as n from m group by label)
select label, (i - 1)::int as pos, round(x / n, 6) as x from m join n using (label)""")
def median_centroid(t: Tables) -> DataFrame:
    return S.centroid(t.embeddings, ["label"], "embedding").withColumn("x", F.round("x", 6))


@query("mean_centroid", "A28", """
with m as (select label, i, avg(x) as x from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all),
n as (select label, sqrt(sum(x * x)) as n from m group by label)
select label, (i - 1)::int as pos, round(x / n, 6) as x from m join n using (label)""")
def mean_centroid(t: Tables) -> DataFrame:
    return S.centroid(t.embeddings, ["label"], "embedding", "mean").withColumn("x", F.round("x", 6))


@query("evenly_spaced_sample", "W13", """
with r as (select lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as n from documents),
s as (select distinct lang, floor(k * (n - 1) / 19)::bigint as i from (select distinct lang, n from r), range(0, 20) t(k))
select lang, doc_id, i from r join s using (lang, i)""")
def evenly_spaced_sample(t: Tables) -> DataFrame:
    r = O.numbered_rows(t.documents.select("lang", "doc_id"), "lang", ["doc_id"], "i")
    n = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.floor(k * (F.col("n") - 1) / 19))
    places = n.select("lang", F.explode(F.array_distinct(wanted)).alias("i"))
    return r.join(places, ["lang", "i"]).select("lang", "doc_id", "i")


@query("score_softmax", "R21", """
with s as (select conv_id, role, sum(length(text))::double / 1000 as s from conversations group by all),
m as (select *, max(s) over (partition by conv_id) as m from s), e as (select *, exp(s - m) as e from m)
select conv_id, role, round(e / sum(e) over (partition by conv_id), 6) as p from e""")
def score_softmax(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id")
    s = t.conversations.groupBy("conv_id", "role").agg((F.sum(F.length("text")).cast("double") / 1000).alias("s"))
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select("conv_id", "role", F.round(F.col("e") / F.sum("e").over(w), 6).alias("p"))


@query("adaptive_fallback", "R22", RUNS + """,
f as (select q, item, rank from a where item % 3 = 0), n as (select q, count(*) as c from f group by q)
select q, item, rank, 0 as stage from f union all
select a.q, a.item, a.rank, 1 from a left join n using (q) where coalesce(c, 0) < 6""")
def adaptive_fallback(t: Tables) -> DataFrame:
    a, _ = _runs(t)
    narrow = a.filter(F.col("item") % 3 == 0)
    poor = a.select("q").distinct().join(narrow.groupBy("q").agg(F.count("*").alias("c")), "q", "left").filter(F.coalesce("c", F.lit(0)) < 6)
    return narrow.withColumn("stage", F.lit(0)).unionByName(a.join(poor.select("q"), "q", "left_semi").withColumn("stage", F.lit(1)))


@query("query_expansion", "R10 C32", """
with s(term, extra) as (values ('the', 'extra one'), ('and', 'extra two'), ('of', 'extra one')),
h as (select item_id, text, extra from benchmark left join s on contains(lower(text), term))
select item_id as query_id, md5(concat_ws(' ', text, array_to_string(list_sort(list(distinct extra) filter (extra is not null)), ' '))) as expanded_md5 from h group by item_id, text""")
def query_expansion(t: Tables) -> DataFrame:
    groups = t.spark.createDataFrame([("the", "extra one"), ("and", "extra two"), ("of", "extra one")], "term string, extra string")
    return S.expand_queries(_queries(t), groups).select("query_id", F.md5("expanded").alias("expanded_md5"))
