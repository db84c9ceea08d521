"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

# Words split at the separators; windows of an item by position; an occurrence is a run of equal words.
ORACLE["op4_decontamination"] = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark),
wins as (
  select distinct item_id, least(len(w), 10) k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') win
  from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from items where len(w) > 0)),
pos as (
  select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') win
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from words, (select distinct k from wins) where len(w) >= k)),
hits as (select doc_id, pos.k, i, item_id from pos join wins using (k, win)),
hit_words as (
  select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from hits) group by doc_id),
hit_items as (
  select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids
  from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from words left join hit_words using (doc_id) left join hit_items using (doc_id)
"""

# The formatted length is the sum over examples of their turns' marks and escaped texts.
ORACLE["op9_chat_format"] = r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, row_number() over (partition by conv_id order by turn, role, text) n, count(*) over (partition by conv_id) k,
    length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|\[SYS\]|\[ROLE '))
      + case role when 'user' then 13 when 'assistant' then 14 else 12 end size
  from t),
r as (select *, sum(size) over (partition by conv_id order by n) upto from e)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) loss_sha256,
  sum(upto) filter (role = 'assistant' or n = k)::bigint formatted_chars
from r group by conv_id
"""

# Windows by position; those that start twice anywhere are repeated, and the words they cover go.
ORACLE["op6_substring_dedup"] = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') w from documents),
win as (select r, i, array_to_string(w[i:i + 34], ' ') s from (select r, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)),
rep as (select s from win group by s having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) p from win join rep using (s)),
word as (select r, doc_id, unnest(w) v, unnest(range(1, len(w) + 1)) p from d),
kept as (select r, string_agg(v, ' ' order by p) t, count(*) n from word anti join gone using (r, p) group by r)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (r)
"""

# Sets of shingles; pairs that share one, counted; the least id over links, by a recursive walk.
ORACLE["op10_ngram_jaccard"] = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') w from documents),
g as (
  select distinct doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') s
  from (select *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from g group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) k from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
walk as (select doc_id id, doc_id r from d union select e.b, walk.r from walk join e on e.a = walk.id)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, (select min(r) from walk where walk.id = d.doc_id) component_id
from d left join n using (doc_id)
"""

# Sets of words of each line; a line goes if an earlier one shares four fifths of their union.
ORACLE["op3_line_dedup"] = r"""
with l as (
  select doc_id, i - 1 i, list_distinct(regexp_extract_all(x[i], '[^ \t-\r]+')) s
  from (select doc_id, string_split(text, chr(10)) x, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents)),
c as (select row_number() over (order by min((doc_id, i))) c, s, len(s) n, min((doc_id, i)) f from (select doc_id, i, list_sort(s) s from l where len(s) > 0) group by s),
t as (select c, n, unnest(s) w from c),
freq as (select w, count(*) f from t group by w),
pre as (select c, n, w from (select c, n, w, row_number() over (partition by c order by f, w) p from t join freq using (w)) where p <= n - ceil(n * 4 / 5.0) + 1),
cand as (select distinct a.c a, b.c b from pre a join pre b on a.w = b.w and a.c < b.c and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
gone as (
  select distinct b from cand join c x on x.c = a join c y on y.c = b
  where 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n)),
kept as (select f[1] doc_id, f[2] i from c where c not in (select b from gone) union all select doc_id, i from l where len(s) = 0)
select d.doc_id, coalesce(n.n, 0)::bigint n_lines, (coalesce(n.n, 0) - coalesce(k.n, 0))::bigint n_removed, coalesce(k.x, '') kept_lines
from documents d left join (select doc_id, count(*) n from l group by doc_id) n using (doc_id)
left join (select doc_id, count(*) n, string_agg(i::varchar, ',' order by i) x from kept group by doc_id) k using (doc_id)
"""

# A count for each part and set of failed filters; orders by a recursive walk; each step sums the sets it removes.
ORACLE["op11_filter_audit"] = r"""
with recursive d as (
  select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') w from documents),
v as (select doc_id, max(quality = 1) good, max(toxic = 1) toxic from labels group by doc_id),
f as (
  select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
    (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::int
      + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int m
  from d left join v using (doc_id)),
c as (select part, m, count(*) n, count(*) filter (good) g, count(*) filter (toxic) x from f group by part, m),
walk as (
  select '' o, 0 step, 0 ahead, 0 own
  union all
  select o || chr((65 + b)::int), (step + 1)::int, (ahead | own)::int, (1 << b)::int from walk, (select range::int b from range(5)) where (ahead | own) & (1 << b) = 0),
orders as (select o filter_order from walk where step = 5),
steps as (select filter_order, step, ahead, own from orders join walk on starts_with(filter_order, o) where step > 0)
select part, filter_order, step, coalesce(sum(n) filter (m & (own | ahead) = 0), 0)::bigint kept,
  coalesce(sum(n) filter (m & own <> 0 and m & ahead = 0), 0)::bigint removed,
  coalesce(sum(n) filter (m & own <> 0 and m & ahead <> 0), 0)::bigint redundant,
  coalesce(sum(n) filter (m = own), 0)::bigint unique_fails,
  coalesce(sum(g) filter (m & own <> 0 and m & ahead = 0), 0)::bigint good_lost,
  coalesce(sum(x) filter (m & own <> 0 and m & ahead = 0), 0)::bigint toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(m), 1)) filter (m & own <> 0), 0)::bigint shapley
from c, steps group by part, filter_order, step
"""

# Distinct features with their counts; a checksum byte by byte over the UTF-8 bytes; noise from the key's digest.
ORACLE["op12_importance_resampling"] = r"""
with tab as (select list(list_reduce([n::bigint] || [0,0,0,0,0,0,0,0]::bigint[], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) t from range(256) r(n)),
d as (
  select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
df as (select r, array_to_string(w[i:i + k - 1], ' ') f from (select r, w, k, unnest(range(1, len(w) - k + 2)) i from d, range(1, 4) x(k) where len(w) >= k)),
bf as (select array_to_string(w[i:i + k - 1], ' ') f from (select w, k, unnest(range(1, len(w) - k + 2)) i from b, range(1, 4) x(k) where len(w) >= k)),
known as (
  select f, xor(list_reduce([4294967295::bigint] || list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::bigint),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 h
  from (select f from df union select f from bf), tab),
s as (select h, count(*) s from df join known using (f) group by h),
t as (select h, count(*) t from bf join known using (f) group by h),
gain as (
  select h, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + 10000)::double
    / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from t) + 10000)::double)))::bigint g
  from s full join t using (h)),
wt as (select r, count(*) n, sum(g) weight from df join known using (f) join gain using (h) group by r),
sc as (
  select r, doc_id, len(w) words, coalesce(n, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296)))::bigint score
  from d left join wt using (r)),
ranked as (select r, row_number() over (order by score desc, doc_id nulls first, n_features, weight) k, count(*) over () n from sc where words >= 20)
select doc_id, n_features, weight, score, case when k <= 5 * n // 100 then k end::bigint as rank from sc left join ranked using (r)
"""

# Whole numbers; every query against every other row.
ORACLE["op13_exact_search"] = r"""
with v as (
  select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e
  from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.r qr, q.vec_id query_id, v.vec_id, v.r, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::bigint score
  from v q, v where q.vec_id % 50 = 0 and q.r <> v.r),
k as (select *, row_number() over (partition by qr order by score desc, vec_id, r) as rank from s)
select query_id, rank::int as rank, vec_id, score from k where rank <= 5
"""
