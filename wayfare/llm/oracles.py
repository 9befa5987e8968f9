"""DuckDB counterparts of the queries that SQL can express."""

ORACLES = {
    "op1_line_dedup": r"""
with l as (
  select doc_id, coalesce('id ' || doc_id, 'text ' || text) as document, t.i, t.line,
    translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (
    select doc_id, text, unnest(list_zip(parts, range(len(parts)))) as z, z[1] as line, z[2] as i
    from (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as parts from documents)
  ) t
), f as (
  select key from l where length(key) >= 1 group by key having count(distinct document) >= 10
)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (f.key is null), '')) as kept_sha256
from l left join f using (key) group by doc_id
""",
    "op3_de_bruijn_spans": r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') as ws from documents
), g as (
  select doc_id, unnest(range(1, len(ws) - 18)) as i, ws from w where len(ws) >= 20
), h as (
  select doc_id, i, row_number() over (
    partition by array_to_string(ws[i:i + 19], ' ') order by doc_id, i) as n from g
), gone as (
  select distinct doc_id, i + j as p from h, range(20) r(j) where n > 1
), p as (
  select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as word from w
), k as (
  select p.doc_id, count(*) as n_words, count(gone.p) as n_removed,
    coalesce(string_agg(word, ' ' order by p.p) filter (gone.p is null), '') as kept
  from p left join gone on gone.doc_id = p.doc_id and gone.p = p.p group by 1
)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from documents left join k using (doc_id)
""",
    "op6_prefix_join_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), bw as (
  select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as w
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)
), dw as (
  select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as w
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i
    from d, (select distinct n from bw) where len(ws) >= n)
), h as (select doc_id, item_id, i, n from dw join bw using (n, w)
), p as (select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from h) group by 1
), t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from h) group by 1
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (doc_id) left join t using (doc_id)
""",
    "op11_bit_sliced_resampling": r"""
with crc as (
  select list_transform(range(256), lambda b: list_reduce(range(9), lambda c, i:
    case when i = 0 then b when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as steps
), t as (
  select true as target, null::bigint as doc_id, row_number() over () as r, text from benchmark
  union all select false, doc_id, row_number() over (), text from documents
), w as (
  select target, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from t
), g as (
  select target, r, unnest(list_concat(ws,
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) as f from w
), n as (select target, r, f, count(*) as n from g group by all
), u as (select distinct f from n
), y as (
  select f, list_transform(range(1, octet_length(encode(f)) + 1), lambda i:
    ('0x' || substr(hex(encode(f)), (2 * i - 1)::bigint, 2))::bigint) as bytes from u
), b as (
  select f, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295),
    4294967295) % 10000 as bucket from y, crc
), sums as (
  select bucket, coalesce(sum(n) filter (target), 0)::double as t, coalesce(sum(n) filter (not target), 0)::double as s
  from n join b using (f) group by 1
), totals as (select coalesce(sum(t), 0) as tt, coalesce(sum(s), 0) as ss from sums
), gain as (
  select bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::bigint as gain from sums, totals
), own as (
  select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight
  from n join b using (f) join gain using (bucket) where not target group by 1
), scored as (
  select doc_id, len(ws) as words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::bigint + 0.5::double)
      / 4294967296))))::bigint as score
  from w left join own using (r) where not target
), placed as (
  select *, row_number() over (partition by words >= 20 order by score desc, doc_id) as place,
    count(*) over (partition by words >= 20) as n from scored
)
select doc_id, n_features, weight, score,
  case when words >= 20 and place <= 5 * n // 100 then place end as rank
from placed
""",
}
