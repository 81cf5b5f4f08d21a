"""Text preparation and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .registry import Tables, query

TAXONOMY = [("night", "the", "weak"), ("night", "and", "weak"), ("night", "of", "weak"), ("night", "was", "weak"), ("sea", "el", "strong"), ("sea", "ñ", "exclude"), ("road", "und", "strong"), ("road", "der", "weak"), ("code", "http", "strong"), ("code", "www", "weak")]


@query("topic_classify", "C1 F9", """
with k(topic, keyword, kind) as (values ('night','the','weak'),('night','and','weak'),('night','of','weak'),('night','was','weak'),('sea','el','strong'),('sea','ñ','exclude'),('road','und','strong'),('road','der','weak'),('code','http','strong'),('code','www','weak')),
h as (select doc_id, topic, keyword, kind from documents join k on contains(lower(text), keyword)),
g as (select doc_id, topic, round(sum(case kind when 'strong' then 1.0::double when 'weak' then 0.3::double else 0.0::double end), 2) as score,
  array_to_string(list_sort(list(distinct keyword) filter (kind <> 'exclude')), ',') as matched, bool_or(kind = 'exclude') as veto from h group by all)
select doc_id, topic, score, matched from g where not veto and score >= 1.0""")
def topic_classify(t: Tables) -> DataFrame:
    taxonomy = t.spark.createDataFrame(TAXONOMY, "topic string, keyword string, kind string")
    return X.classified(t.documents, taxonomy, "doc_id", "text").withColumn("matched", F.array_join("matched", ","))


@query("keyword_top_n", "C15 C39", r"""
with w as (select source, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) as word from documents), c as (select source, word, count(*) as n from w where word not in ('with', 'that') group by all)
select source, word, n, row_number() over (partition by source order by n desc, word)::int as rank from c qualify rank <= 5""")
def keyword_top_n(t: Tables) -> DataFrame:
    return X.keywords(t.documents, ["source"], F.col("text"), 5, ["with", "that"], 4)


@query("exclusion_cascade", "F9 A32", r"""
with c as (select case when length(trim(text)) < 50 then 'short' when regexp_matches(text, '^[^a-z]*$') then 'capitals' when contains(text, '@') then 'personal' when lang <> 'en' then 'language' else 'kept' end as reason from documents)
select reason, count(*) as n from c group by reason""")
def exclusion_cascade(t: Tables) -> DataFrame:
    reason = F.when(F.length(F.trim("text")) < 50, "short").when(F.col("text").rlike("^[^a-z]*$"), "capitals").when(F.col("text").contains("@"), "personal").when(F.col("lang") != "en", "language").otherwise("kept")
    return t.documents.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("substantive_filter", "F10 F12", r"select doc_id from documents where length(text) >= 50 and not regexp_matches(text, '^[A-Z][a-z]* [A-Z]')")
def substantive_filter(t: Tables) -> DataFrame:
    return t.documents.filter((F.length("text") >= 50) & ~F.col("text").rlike("^[A-Z][a-z]* [A-Z]")).select("doc_id")


@query("fingerprints", "C17 C18 S27", r"""
select doc_id, md5(text) as m, sha1(text) as s1, sha256(text) as s2, md5(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')))) as cache_key from documents""")
def fingerprints(t: Tables) -> DataFrame:
    key = F.md5(F.lower(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))))
    return t.documents.select("doc_id", F.md5("text").alias("m"), F.sha1("text").alias("s1"), F.sha2("text", 256).alias("s2"), key.alias("cache_key"))


@query("id_guard", "C40", """
select url as id, case when octet_length(encode(repeat(url, 20))) > 512 then 'h_' || md5(repeat(url, 20)) else repeat(url, 20) end as safe from pages""")
def id_guard(t: Tables) -> DataFrame:
    many = F.repeat("url", 20)
    return t.pages.select(F.col("url").alias("id"), F.when(F.octet_length(many) > 512, F.concat(F.lit("h_"), F.md5(many))).otherwise(many).alias("safe"))


@query("article_padding", "C7 C41", r"""
with a as (select p_partkey, case when p_partkey % 3 = 0 then 'End' || p_size else p_partkey % 1500 || case when p_partkey % 2 = 0 then 'BA' else '' end end as a from part)
select p_partkey, case when regexp_matches(a, '^\d+[A-Za-z]*$') then case when length(regexp_extract(a, '^\d+')) < 3 then lpad(regexp_extract(a, '^\d+'), 3, '0') else regexp_extract(a, '^\d+') end || regexp_extract(a, '[A-Za-z]*$') else a end as padded from a""")
def article_padding(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("End"), F.col("p_size").cast("string"))).otherwise(F.concat((F.col("p_partkey") % 1500).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "BA").otherwise("")))
    return t.part.select("p_partkey", X.padded_article(raw).alias("padded"))


@query("best_date", "C13", r"""
with d as (select o_orderkey, case when o_orderkey % 4 = 0 then '0000-00-00' when o_orderkey % 4 = 1 then null else '2019' end as a, case when o_orderkey % 3 = 0 then '' else strftime(o_orderdate, '%Y-%m-%dT%H:%M') end as b from orders)
select o_orderkey, coalesce(case when a = '2019' then '2019-01-01' end, case when b <> '' then substr(b, 1, 10) end) as best from d""")
def best_date(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    d = t.orders.select(k, F.when(k % 4 == 0, "0000-00-00").when(k % 4 == 1, None).otherwise("2019").alias("a"), F.when(k % 3 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).alias("b"))
    return d.select("o_orderkey", X.best_date("a", "b").alias("best"))


@query("numeral_signatures", "C10 C9", r"select p_partkey, array_to_string(list_sort(regexp_extract_all(p_brand || ' ' || p_size || ' x ' || p_partkey % 7, '[0-9]+')), '|') as signature from part")
def numeral_signatures(t: Tables) -> DataFrame:
    name = F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"), F.lit(" x "), (F.col("p_partkey") % 7).cast("string"))
    return t.part.select("p_partkey", X.numeral_signature(name).alias("signature"))


@query("json_props_extract", "C19 C42", """
select event_id, coalesce((props->>'$.k')::bigint, 0) as k, coalesce(props->>'$.none', 'default') as missing from events""")
def json_props_extract(t: Tables) -> DataFrame:
    wrapped = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    read = X.tolerant_json(wrapped, "k long, none string")
    return t.events.select("event_id", F.coalesce(read["k"], F.lit(0).cast("long")).alias("k"), F.coalesce(read["none"], F.lit("default")).alias("missing"))


@query("query_normalise", "R11 C18", r"""
with b as (select item_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)whether|from|the', ' ', 'g'), '[\p{P}\p{S}]+', ' ', 'g'), '\s+', ' ', 'g')) as bare, text from benchmark)
select item_id, md5(case when bare = '' then text else bare end) as bare_md5 from b""")
def query_normalise(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.md5(X.normalised_query(F.col("text"), ["from", "the"], ["whether"])).alias("bare_md5"))


@query("detected_group", "R7", r"""
with h as (select doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])une($|[^a-z0-9])') as fr, regexp_matches(lower(text), '(^|[^a-z0-9])und($|[^a-z0-9])') as de, regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])') as en from documents)
select doc_id, case when fr::int + de::int + en::int = 1 then case when fr then 'fr' when de then 'de' else 'en' end end as detected from h""")
def detected_group(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.detected_one(F.col("text"), {"fr": ["une"], "de": ["und"], "en": ["the"]}).alias("detected"))


@query("retrieval_plan", "R5 R6 R23", r"""
with b as (select item_id, lower(text) as t from benchmark)
select item_id, case when contains(t, 'the')::int + contains(t, 'here')::int > 1 then 'route' when contains(t, ' and ') then 'decompose' when contains(t, 'the')::int + contains(t, 'here')::int = 1 then 'detected' else 'global' end as mode,
  len(list_filter(string_split(t, ' and '), lambda x: trim(x) <> '')) as parts from b""")
def retrieval_plan(t: Tables) -> DataFrame:
    text = F.lower("text")
    return t.benchmark.select("item_id", X.retrieval_mode(text, {"a": ["the"], "b": ["here"]}, [" and "]).alias("mode"), F.size(X.decomposed(text, [" and "])).cast("long").alias("parts"))


@query("protection_scores", "C21 C22", """
with s as (select doc_id, lower(text) as t from documents), k as (select doc_id, contains(t, 'the')::int + contains(t, 'was')::int as a, contains(t, 'und')::int + contains(t, 'der')::int + contains(t, 'die')::int as b from s)
select doc_id, greatest(20, least(100, 50 + 15 * a - 10 * b)) as score, case when a >= 2 then 'A' when b >= 2 then 'B' when a >= b and a > 0 then 'A' when b > 0 then 'B' end as kind from k""")
def protection_scores(t: Tables) -> DataFrame:
    a, b = ["the", "was"], ["und", "der", "die"]
    return t.documents.select("doc_id", X.protection_score(F.col("text"), a, b).alias("score"), X.kind_by_keywords(F.col("text"), {"A": a, "B": b}).alias("kind"))


@query("name_overlaps", "C25", """
with s as (select p_partkey, list_distinct(string_split(p_name, '')) as x, list_distinct(string_split(lower(p_type), '')) as y,
  list_distinct(list_transform(range(1, greatest(length(p_name), 2)), lambda i: substr(p_name, i, 2))) as u, list_distinct(list_transform(range(1, greatest(length(p_type), 2)), lambda i: substr(lower(p_type), i, 2))) as v from part)
select p_partkey, round(len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))), 6) as chars, round(len(list_intersect(u, v))::double / len(list_distinct(list_concat(u, v))), 6) as bigrams from s""")
def name_overlaps(t: Tables) -> DataFrame:
    a, b = F.col("p_name"), F.lower("p_type")
    return t.part.select("p_partkey", X.char_overlap(a, b).alias("chars"), X.bigram_overlap(a, b).alias("bigrams"))


@query("first_sentences", "C20", r"""
with s as (select doc_id, list_filter(regexp_extract_all(text, '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$'), lambda x: trim(x) <> '') as parts from documents)
select doc_id, md5(trim(array_to_string(parts[1:2], ''))) as head_md5 from s""")
def first_sentences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.first_sentences(F.col("text"))).alias("head_md5"))


@query("windowed_chunks", "C2", r"""
with recursive d as materialized (select doc_id, text, length(text) as len from documents where length(text) > 0),
r as (select doc_id, 0::bigint as n, 0::bigint as pos, least(800, len) as e from d where false union all select 0, 0, 0, 0 where false),
w as (select doc_id, len, -1::bigint as n, 0::bigint as pos, 150::bigint as e from d union all
  select w.doc_id, w.len, w.n + 1, w.e - 150, case when w.e + 650 >= w.len then w.len else
    case when length(regexp_extract(reverse(substr(d.text, (w.e + 251)::bigint, 400)), '^[^。！？；\n.!?]*')) = 400 then w.e + 650 else w.e + 650 - length(regexp_extract(reverse(substr(d.text, (w.e + 251)::bigint, 400)), '^[^。！？；\n.!?]*')) end end
  from w join d using (doc_id) where w.n = -1 or w.e < w.len)
select doc_id || '_sub_' || n as id, doc_id, n::int as n, (e - pos)::int as n_chars from w where n >= 0""".replace("""r as (select doc_id, 0::bigint as n, 0::bigint as pos, least(800, len) as e from d where false union all select 0, 0, 0, 0 where false),
""", "").replace("\\\\n", "\\n"))
def windowed_chunks(t: Tables) -> DataFrame:
    parts = t.documents.select("doc_id", F.posexplode(X.chunker()(F.col("text"))).alias("n", "content"))
    return parts.select(F.concat(F.col("doc_id").cast("string"), F.lit("_sub_"), F.col("n").cast("string")).alias("id"), "doc_id", "n", F.length("content").alias("n_chars"))


@query("section_chunks", "C3", r"""
with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i, length(text) as len from documents where length(text) > 0),
o as (select *, sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1 as pos from l),
c as (select doc_id, pos, len from o where regexp_matches(line, '^[^\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') or i = 1),
s as materialized (select doc_id, (coalesce(lead(pos) over (partition by doc_id order by pos), len) - pos)::bigint as size, row_number() over (partition by doc_id order by pos) as i from c where pos < len),
r as (select doc_id, i, [size] as p from s where i = 1 union all
  select r.doc_id, s.i, case when p[-1] + size <= 800 then list_append(p[1:-2], p[-1] + size) else list_append(p, size) end from r join s on s.doc_id = r.doc_id and s.i = r.i + 1),
f as (select doc_id, p from r qualify row_number() over (partition by doc_id order by i desc) = 1),
t as (select doc_id, case when len(p) > 1 and p[-1] < 300 then list_append(p[1:-3], p[-2] + p[-1]) else p end as p from f)
select doc_id, (generate_subscripts(p, 1) - 1)::int as n, unnest(p)::int as n_chars from t""")
def section_chunks(t: Tables) -> DataFrame:
    parts = t.documents.select("doc_id", F.posexplode(X.section_packer(r"(?m)^(?=\S)")(F.col("text"))).alias("n", "content"))
    return parts.select("doc_id", "n", F.length("content").alias("n_chars"))


@query("entity_names", "C9 C8", """select p_partkey, lower(replace(p_name || p_brand, ' ', '')) as norm from part""".replace("lower(replace(p_name || p_brand, ' ', ''))", r"regexp_replace(lower(p_name || p_brand), '[^a-z0-9]+', '', 'g')"))
def entity_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.entity_name(F.concat("p_name", "p_brand")).alias("norm"))


@query("query_variants", "C36", """
with b as (select item_id, split_part(text, ' ', 1) as w from benchmark), v(variant, template) as (values ('A', '%s'), ('B', 'what is %s'), ('C', '%s (%s)'), ('D', 'the %s'))
select item_id || '_' || variant as id, replace(template, '%s', w) as query from b, v""")
def query_variants(t: Tables) -> DataFrame:
    w = F.split("text", " ")[0]
    forms = [("A", w), ("B", F.concat(F.lit("what is "), w)), ("C", F.concat(w, F.lit(" ("), w, F.lit(")"))), ("D", F.concat(F.lit("the "), w))]
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("v"), q.alias("q")) for v, q in forms))).alias("x")
    return t.benchmark.select("item_id", rows).select(F.concat_ws("_", F.col("item_id").cast("string"), "x.v").alias("id"), F.col("x.q").alias("query"))
