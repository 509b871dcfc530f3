"""DuckDB SQL with the rows of those queries that SQL can express, over the whole tables."""

from __future__ import annotations

_OP5 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
    else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as g from w
), n as (
  select w.doc_id, count(g) as n from w left join s using (doc_id) group by all
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as x from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select a, b from common join n p on p.doc_id = a join n q on q.doc_id = b where 100 * x >= 80 * (p.n + q.n - x)
), edges as (
  select a, b from links union all select b, a from links
), reach(a, b) as (
  select doc_id, doc_id from documents union select reach.a, edges.b from reach join edges on reach.b = edges.a
), root as (select a as doc_id, min(b) as component_id from reach group by all)
select doc_id, n as n_shingles, component_id, component_id = doc_id as kept from n join root using (doc_id)
"""

_OP6 = r"""
with recursive_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), windows as (
  select distinct item_id, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i : i + 9], ' '))) as g,
    least(len(ws), 10) as size from b where len(ws) > 0
), places as (
  select doc_id, k, size, array_to_string(ws[k : k + size - 1], ' ') as g from (
    select doc_id, ws, size, unnest(range(1, greatest(len(ws) - size + 1, 0) + 1)) as k from recursive_words cross join (select distinct size from windows))
), found as (
  select doc_id, k, p.size, item_id from places p join windows w on p.g = w.g and p.size = w.size
), hit as (
  select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + size)) as pos from found) group by all
), items as (
  select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from found group by all
)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from recursive_words left join hit using (doc_id) left join items using (doc_id)
"""

_OP10 = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), places as (
  select doc_id, k, array_to_string(ws[k : k + 12], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 12, 0) + 1)) as k from w)
), first as (select g, min(doc_id) as d from places group by all),
gone as (
  select distinct doc_id, unnest(range(k, k + 13)) as pos from places join first using (g) where d < doc_id
), words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as text from words anti join gone using (doc_id, pos) group by all
)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)
"""

_OP7 = r"""
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), d as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as hex, min(page_id) over (partition by payload) as first_id from p
)
select page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id = first_id then null else first_id end as refers_to
from d
"""

SQL = {"op5_near_duplicates": _OP5, "op6_benchmark_decontamination": _OP6.replace("recursive_words", "words"), "op7_warc": _OP7, "op10_substring_dedup": _OP10}
