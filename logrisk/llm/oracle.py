"""SQL for the queries that SQL can express whole, written from the definitions.

Not expressed: learnt models (op4, op8), a tokenizer (op5), random rounding
(op6), linked spans (op7), edit distances of all lines (op9), the pipeline.
Their tests compare with plain Python.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base 32 of a SHA-1: 32 groups of five bits, each within three hexadecimal digits.
_BASE32 = """list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((cast('0x' || substr(sha, least(cast(i * 5 // 4 as bigint), 37) + 1, 3) as bigint)
    >> cast(12 - (i * 5 - 4 * least(cast(i * 5 // 4 as bigint), 37)) - 5 as bigint)) & 31) + 1, 1)), 'string_agg', '')"""

SQL: dict[str, str] = {
    "op1_warc_index": f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as sha from p),
m as (select *, max(page_id) over (partition by sha) as last from h)
select page_id, payload_bytes, {_BASE32} as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id <> last then last end as refers_to from m""",
    "op2_exact_hash": r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)""",
    "op3_vector_codes": """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from v),
l as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) >= 0.93),
reach as (select vec_id as x, vec_id as y from embeddings union select r.x, l.y from reach r join l on r.y = l.x),
c as (select x, min(y) as component_id from reach group by x),
n as (select x, count(*) as n from l group by x)
select c.x as vec_id, coalesce(n.n, 0) as n_links, component_id, c.x = component_id as kept from c left join n on c.x = n.x""",
    "op10_minhash": rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, shingle from (
  select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * common >= 85 * (nx.n + ny.n - common)),
e as (select x, y from l union all select y, x from l),
reach as (select doc_id as x, doc_id as y from documents union select r.x, e.y from reach r join e on r.y = e.x),
c as (select x, min(y) as component_id from reach group by x)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id = component_id as kept
from documents join c on c.x = doc_id left join n using (doc_id)""",
    "op11_hard_negatives": """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(cast(embedding as double[]), lambda x: cast(floor(256 * x) as double)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.e, b.e) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
pos as (select anchor_id, vec_id as positive_id, score as positive_score from p where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select pos.anchor_id, positive_id, cast(row_number() over w as int) as rank, p.vec_id as negative_id, positive_score, p.score as negative_score
from pos join p on p.anchor_id = pos.anchor_id and not p.same
  and 50 * positive_score <= 100 * p.score and 100 * p.score <= 95 * positive_score
window w as (partition by pos.anchor_id, positive_id order by p.score desc, p.vec_id)
qualify row_number() over w <= 3""",
    "op12_mask_search": rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') as t from documents),
c as (select count(*) as n_docs, cast(sum(len(t)) as bigint) as n_terms from d where len(t) > 0),
o as (select doc_id, n, term, count(*) as tf from (select doc_id, len(t) as n, unnest(t) as term from d) group by all),
f as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as w from (select term, count(*) as df from o group by term), c),
i as (select item_id, term, count(*) as times from (
  select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) as term from benchmark) group by all),
s as (select item_id, doc_id, cast(sum(times * cast(w as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) as bigint) as score
  from i join o using (term) join f using (term), c group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from s where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10""",
    "op13_term_scores": """
with v as (select vec_id, list_transform(cast(embedding as double[]), lambda x: cast(floor(256 * x) as double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.e, b.e) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from p qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5""",
}
