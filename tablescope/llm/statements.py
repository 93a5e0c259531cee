"""DuckDB statements with the same rows as the queries of this package."""
from __future__ import annotations

OP1 = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
  win as (select doc_id, i, array_to_string(w[i:i+34], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from w)),
  hit as (select doc_id, i from win where s in (select s from win group by s having count(*) > 1)),
  gone as (select doc_id, list(distinct p) as gone, count(distinct p) as n from (select doc_id, unnest(range(i, i + 35)) as p from hit) group by doc_id),
  kept as (select w.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed,
    case when n is null then array_to_string(w, ' ') else coalesce((select string_agg(x, ' ' order by p) from
      (select unnest(w) as x, unnest(range(1, len(w) + 1)) as p) where not list_contains(gone, p)), '') end as kept
    from w left join gone using (doc_id))
select doc_id, n_words, n_removed, sha256(kept) as kept_sha256 from kept
"""

OP3 = r"""
with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
  win as (select doc_id, i, substring(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from h)),
  hit as (select win.doc_id, i from win join (select s, min(doc_id) as least from win group by s having count(*) > 1) using (s) where doc_id > least),
  gaps as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new from hit),
  runs as (select doc_id, a, max(i) + 50 as b from (select doc_id, i, first_value(i) over (partition by doc_id, g order by i) as a from
    (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from gaps)) group by doc_id, a),
  keep as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as prev, row_number() over (partition by doc_id order by a desc) as back from runs),
  cut as (select doc_id, sum(b - a) as gone, count(*) as n, string_agg(substring(h, 2 * prev + 1, 2 * (a - prev)), '' order by a)
      || max(case when back = 1 then substring(h, 2 * b + 1) else '' end) as rest from keep join h using (doc_id) group by doc_id)
select doc_id, len(h) // 2 as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0) as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256
from h left join cut using (doc_id)
"""

OP4 = r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
  s as (select distinct doc_id, array_to_string(w[i:i+4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
  n as (select doc_id, count(*) as n from s group by doc_id),
  both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (s) where a.doc_id <> b.doc_id group by 1, 2),
  link as (select a, b from both_ join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 85 * (x.n + y.n - k)),
  reach as (select doc_id as a, doc_id as c from documents union select reach.a, link.b as c from reach join link on link.a = reach.c),
  low as (select a as doc_id, min(c) as component_id from reach group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from low left join n using (doc_id)
"""

OP6 = r"""
with folded as (select 'd' as kind, doc_id::varchar as id, text from documents union all select 'b', item_id::varchar, text from benchmark),
  w as (select kind, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from folded),
  asked as (select distinct id as item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s
    from (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from w where kind = 'b' and len(w) > 0)),
  sizes as (select distinct n from asked),
  win as (select id, i, n, array_to_string(w[i:i + n - 1], ' ') as s from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from w, sizes where kind = 'd' and len(w) >= n)),
  hit as (select id, i, win.n, item_id from win join asked using (s) where win.n = asked.n),
  items as (select id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from hit group by id),
  cover as (select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + n)) as p from hit) group by id)
select w.id::bigint as doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from w left join items using (id) left join cover using (id) where kind = 'd'
"""

OP7 = r"""
with cut as (select page_id, coalesce(case when position('://' in url) > 0 then substring(url, position('://' in url) + 3) end, '') as after from pages),
  p as (select page_id, regexp_extract(after, '^[^/?#]*') as raw, regexp_extract(substring(after, length(regexp_extract(after, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut),
  h as (select page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from p),
  u as (select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') as url from h),
  r as (select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) as t(kind, rh, rp)),
  best as (select page_id, host, path, url, max_by(rh || rp, length(rh || rp)) as rule, max_by(kind, length(rh || rp)) as kind
    from u left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id, host, path, url)
select page_id, host, path, rule, coalesce(kind, case when url in (select url from u where url <> '' and regexp_matches(host, 'casino|bets|pills|loans|porn')) then 'block' else 'allow' end) as verdict
from best
"""

OP9 = r"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
  n as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as len from v),
  ok as (select * from n where len > 0 and isfinite(len)),
  link as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id where list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.93),
  reach as (select vec_id as a, vec_id as c from embeddings union select reach.a, link.b from reach join link on link.a = reach.c),
  low as (select a as vec_id, min(c) as component_id from reach group by 1),
  degree as (select a as vec_id, count(*) as n from link group by 1)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from low left join degree using (vec_id)
"""



def _leaf(text: str) -> str:
    values = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"case when {v} is null then '-' else strlen({v}::varchar) || ':' || {v}::varchar end" for v in values) + ")"


OP13 = rf"""
with recursive d as (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint) as crc from documents),
  l as (select doc_id, source, {_leaf('text')} as leaf, case when crc % 5 = 0 then {_leaf('low')} else {_leaf('text')} end as now from d),
  p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as k, count(*) over (partition by source) as n from l),
  up as (select source, 0 as lvl, k, n, leaf as h from p
    union all select source, lvl + 1, k // 16, (n + 15) // 16, sha256(string_agg(h, '' order by k)) from up where n > 1 group by source, lvl, k // 16, n),
  sib as (select u.source, u.lvl, u.k, coalesce(string_agg(v.h, '' order by v.k) filter (where v.k < u.k), '') as a, coalesce(string_agg(v.h, '' order by v.k) filter (where v.k > u.k), '') as b
    from up u left join up v on u.source is not distinct from v.source and u.lvl = v.lvl and u.k // 16 = v.k // 16 and u.k <> v.k where u.n > 1 group by u.source, u.lvl, u.k),
  walk as (select doc_id, leaf, source, 0 as lvl, k, n, now as h, '' as proof from p
    union all select doc_id, leaf, w.source, w.lvl + 1, w.k // 16, (n + 15) // 16, sha256(a || h || b), proof || a || b
    from walk w join sib s on w.source is not distinct from s.source and w.lvl = s.lvl and w.k = s.k where n > 1),
  s as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as k, count(*) over () as n from up where n = 1),
  over_ as (select 0 as lvl, k, n, subroot as h from s
    union all select lvl + 1, k // 16, (n + 15) // 16, sha256(string_agg(h, '' order by k)) from over_ where n > 1 group by lvl, k // 16, n),
  sib2 as (select u.lvl, u.k, coalesce(string_agg(v.h, '' order by v.k) filter (where v.k < u.k), '') as a, coalesce(string_agg(v.h, '' order by v.k) filter (where v.k > u.k), '') as b
    from over_ u left join over_ v on u.lvl = v.lvl and u.k // 16 = v.k // 16 and u.k <> v.k where u.n > 1 group by u.lvl, u.k),
  on_ as (select doc_id, leaf, subroot, 0 as lvl, s.k, s.n, h, proof from walk join s on walk.source is not distinct from s.source where walk.n = 1
    union all select doc_id, leaf, subroot, w.lvl + 1, w.k // 16, (n + 15) // 16, sha256(a || h || b), proof || a || b from on_ w join sib2 t on w.lvl = t.lvl and w.k = t.k where n > 1)
select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, on_.h as folded_root, on_.h = r.h as verified from on_, (select h from over_ where n = 1) r where on_.n = 1
"""

SQL = {"op1_substring_dedup": OP1, "op3_suffix_dedup": OP3, "op4_minhash_dedup": OP4, "op6_decontamination": OP6, "op7_url_filter": OP7, "op9_vector_dedup": OP9,
       "op13_merkle_manifest": OP13}
