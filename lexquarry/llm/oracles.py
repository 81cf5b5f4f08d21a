"""DuckDB SQL for those queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op9_exact_dedup"] = r"""
with t as (select doc_id, length(coalesce(text, '')) as points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as bare from documents),
g as (select doc_id, sha256(bare) as text_sha256,
             first_value(doc_id) over (partition by bare order by points desc, doc_id) as keep_id,
             count(*) over (partition by bare) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""

ORACLES["op4_warc"] = r"""
with p as (select page_id, encode(coalesce(html, '')) as data from pages),
d as (select page_id, octet_length(data)::bigint as payload_bytes, sha256(data) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first_id <> page_id then first_id end as refers_to
from f
"""

_WORDS = r"w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, coalesce(text, '') as text from documents)"

ORACLES["op8_quality"] = rf"""
with {_WORDS},
g as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) as i from w)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct i + k) as n from r, (select unnest(range(0, 8)) as k) group by doc_id),
l as (select distinct doc_id from (select doc_id, md5(array_to_string(ws[i:i + 200], ' ')) as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 199, 1))) as i from w)) group by doc_id, g having count(*) > 1),
d as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
m as (select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(n, 0)::bigint as n_repeat_words, l.doc_id is not null as far from w join d using (doc_id) left join c using (doc_id) left join l using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not far as kept from m
"""

ORACLES["op5_substring_dedup"] = rf"""
with {_WORDS},
g as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) as i from w)),
h as (select doc_id, i from g qualify min(doc_id) over (partition by g) < doc_id),
gone as (select distinct doc_id, i + k as i from h, (select unnest(range(0, 50)) as k)),
kept as (select x.doc_id, string_agg(x.word, ' ' order by x.i) as text from (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w) x left join gone using (doc_id, i) where gone.i is null group by x.doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join n using (doc_id) left join kept using (doc_id)
"""

ORACLES["op3_ngram_join"] = rf"""
with recursive {_WORDS},
g as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
s as (select doc_id, md5(string_agg(g, chr(10) order by g)) as key, count(*) as n from g group by doc_id),
c as (select key, min(doc_id) as copy_id, count(*) as n_copies, any_value(n) as n from s group by key),
x as (select c.copy_id as id, c.n, g.g from c join g on g.doc_id = c.copy_id),
p as (select a.id as a, b.id as b from x a join x b using (g) where a.id < b.id group by a.id, b.id, a.n, b.n having 5 * count(*) >= 4 * (a.n + b.n - count(*))),
u as (select a, b from p union all select b, a from p),
r as (select id, id as other from (select copy_id as id from c) union select r.id, u.b from r join u on u.a = r.other),
f as (select r.id, min(other) as class_id from r group by r.id),
k as (select a as id, count(*) as n_links from u group by a)
select w.doc_id, coalesce(class_id, w.doc_id) as class_id, coalesce(n_links, 0)::bigint as n_links, coalesce(copy_id, w.doc_id) as copy_id, coalesce(n_copies, 1)::bigint as n_copies
from w left join s using (doc_id) left join c using (key) left join f on f.id = copy_id left join k on k.id = copy_id
"""


def _part(no: int, pattern: str, group: int, good: str) -> str:
    p = pattern.replace("'", "''")
    found = f"regexp_extract_all(x, '{p}', 0)"
    return f"select rid, doc_id, {no} as no, unnest({found}) as m, unnest(regexp_extract_all(x, '{p}', {group})) as v, unnest((string_split_regex(x, '{p}'))[1:len({found})]) as g, unnest(range(0, len({found}))) as i, '{good}' as rule from t"


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_PARTS = "\nunion all ".join(
    _part(*x)
    for x in (
        (0, r"((?i:password|passwd|secret|token|api_?key))" + _VALUE + r"([A-Za-z0-9+/_.=-]+)", 2, "6"),
        (1, r"AKIA[A-Z0-9]+", 0, "20"),
        (2, r"[0-9a-f]{24,}", 0, "24"),
        (3, r"((?i:user(?:name)?|login|client_?id|account_?id))" + _VALUE + r"([A-Za-z0-9@._-]+)", 2, "3"),
        (4, r"[A-Za-z0-9+/]{20,}", 0, "mixed"),
        (5, r"[a-z][a-z0-9+]{0,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 0, "8"),
    )
)

ORACLES["op1_secret_scan"] = f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as x from documents),
f as ({_PARTS}),
p as (select *, sum(length(g) + length(m)) over (partition by rid, no order by i rows unbounded preceding)::bigint as e from f),
q as (select rid, no, e - length(m) as s, e from p where case when rule = 'mixed' then regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') else length(v) >= rule::int end),
d as (select *, coalesce(max(case when no < 3 then e end) over a > s, false) or coalesce(min(case when no < 3 then s end) over b < e, false) as over_base,
  coalesce(max(case when no = 3 then e end) over a > s, false) or coalesce(min(case when no = 3 then s end) over b < e, false) as over_id,
  coalesce(max(case when no = 5 then e end) over a > s, false) or coalesce(min(case when no = 5 then s end) over b < e, false) as over_url
  from q window a as (partition by rid order by s, no rows between unbounded preceding and 1 preceding), b as (partition by rid order by s desc, no desc rows between unbounded preceding and 1 preceding)),
n as (select *, no < 3 as base,
  coalesce(max(case when no in (1, 3) then e end) over a >= s - 200, false) or coalesce(min(case when no in (1, 3) then s end) over b <= e + 200, false) as near_ident,
  coalesce(max(case when no in (0, 2, 4) then e end) over a >= s - 200, false) or coalesce(min(case when no in (0, 2, 4) then s end) over b <= e + 200, false) as near_secret
  from (select * from d where no < 3 or not (over_base or (no >= 4 and over_id) or (no = 4 and over_url))) window a as (partition by rid order by s, no rows between unbounded preceding and 1 preceding), b as (partition by rid order by s desc, no desc rows between unbounded preceding and 1 preceding)),
k as (select rid, no, s, (['assign', 'access', 'hex', 'ident', 'opaque', 'endpoint'])[no + 1] || ':' || s || ':' || e as said from n
  where base or (case no when 3 then near_secret when 4 then near_ident else near_ident and near_secret end)),
a as (select rid, count(*) filter (no = 0) as n_assign, count(*) filter (no = 1) as n_access, count(*) filter (no = 2) as n_hex, count(*) filter (no > 2) as n_linked,
  string_agg(said, ',' order by s, no) filter (no < 3) as base, string_agg(said, ',' order by s, no) as spans from k group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_linked, 0)::bigint as n_linked from t left join a using (rid)
"""

ORACLES["op11_hard_negatives"] = """
with q as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from q a join q b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
s as (select anchor_id, other as positive_id, score as positive_score from p where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other)::int as rank, other as negative_id, positive_score, score as negative_score
from s join p using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score qualify rank <= 10
"""

ORACLES["op12_filter_audit"] = rf"""
with {_WORDS},
f as (select d.doc_id, coalesce(lang, '') as part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text),
    regexp_matches(w.text, '[#$%&*|]'), d.doc_id > min(d.doc_id) over (partition by w.text)] as fails,
    coalesce(quality = 1, false)::int as good, coalesce(toxic = 1, false)::int as bad
  from documents d join w using (doc_id) left join labels using (doc_id)),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest(range(1, 6)) as i),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order, [a.i, b.i, c.i, d.i, e.i] as seq from l a, l b, l c, l d, l e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
c as (select part, fails, count(*) as n, sum(good) as good, sum(bad) as bad, len(list_filter(fails, lambda y: y)) as n_fails from f group by all),
s as (select part, filter_order, k as step, seq[k] as i, fails[seq[k]] as now, list_bool_or(list_transform(seq[1:k - 1], lambda j: fails[j])) as before, n, good, bad, n_fails from c, o, (select unnest(range(1, 6)) as k)),
r as (select part, filter_order, step, i, sum(n) filter (not now and not coalesce(before, false)) as kept, sum(n) filter (now and not coalesce(before, false)) as removed, sum(n) filter (now and before) as redundant,
    sum(n) filter (now and n_fails = 1) as unique_fails, sum(good) filter (now and not coalesce(before, false)) as good_lost, sum(bad) filter (now and not coalesce(before, false)) as toxic_lost from s group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, i))::bigint as shapley from r
"""
