"""DuckDB SQL of the queries that SQL can express."""

_OP1 = r"""
with recursive w as (
  select row_number() over () as r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x20\x09-\x0D]+'), []) as ws
  from documents),
s as (
  select r, doc_id, list_distinct(case when len(ws) = 0 then []
      when len(ws) < 3 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as g
  from w),
e as (select r, len(g) as n, unnest(g) as x from s),
p as (
  select a.r as ra, b.r as rb, count(*) as i, any_value(a.n) as na, any_value(b.n) as nb
  from e a join e b on a.x = b.x and a.r <> b.r and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n
  group by all),
link as (select ra, rb from p where 100 * i >= 90 * (na + nb - i)),
reach(r, t) as (select r, r from s union select reach.r, link.rb from reach join link on reach.t = link.ra)
select s.doc_id, any_value(len(s.g)) as n_shingles, min(z.doc_id) as component_id
from s join reach on reach.r = s.r join s z on z.r = reach.t
group by s.r, s.doc_id
"""

_OP6 = r"""
with recursive k as (
  select row_number() over () as r, doc_id, coalesce(strlen(text), 0) + 1 as size, md5(coalesce(doc_id::varchar, '')) as h,
         hex(encode(coalesce(text, ''))) as bytes
  from documents),
jump(r, key, pos, shard, grown) as (
  select r, ('0x' || substr(h, 1, 8))::bigint::hugeint * 4294967296 + ('0x' || substr(h, 9, 8))::bigint, 0::bigint, 0::bigint, 0::bigint
  from k
  union all
  select r, n, floor((pos + 1) * (2147483648.0::double / ((n // 8589934592)::bigint + 1)))::bigint,
         case when pos < 16 then pos else shard end, pos
  from (select *, (key * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint as n from jump where pos <= 16)),
last as (select r, arg_max(shard, pos) as shard, arg_max(grown, pos) as grown from jump group by r),
crc as (
  select r, xor(4294967295::ubigint, list_reduce(
      list_transform(range(0, strlen(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::ubigint),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[],
                               lambda a, z: xor(a >> 1, 3988292384::ubigint * (a & 1))),
      4294967295::ubigint))::bigint as crc
  from k)
select doc_id, size::bigint as size, crc as text_crc32, 'key' as law, shard::int as shard,
       row_number() over (partition by shard order by doc_id nulls first, crc, size) - 1 as slot, grown::int as grown_shard
from k join last using (r) join crc using (r)
"""

_OP9 = r"""
with p as (
  select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
g as (select d, max(page_id) as top from p where n >= 1000 group by d having count(*) > 1)
select page_id, n::bigint as payload_bytes, p.d as payload_digest,
       case when g.top is null or g.top is not distinct from page_id then 'response' else 'revisit' end as record_type,
       case when g.top is not null and g.top is distinct from page_id then g.top end as refers_to
from p left join g on p.d = g.d and p.n >= 1000
"""

_OP11 = r"""
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id, a.label = b.label as same,
         coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.r <> b.r),
p as (
  select ar, anchor_id, br, vec_id as positive_id, score as positive_score
  from s where same qualify row_number() over (partition by ar order by score desc, vec_id nulls last) <= 5),
n as (
  select p.anchor_id, positive_id, s.vec_id as negative_id, positive_score, s.score as negative_score,
         row_number() over (partition by p.ar, p.br order by s.score desc, s.vec_id nulls last) as rank
  from p join s on s.ar = p.ar and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

_OP13 = r"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as bytes
  from conversations),
kinds as (
  select *, xor(4294967295::ubigint, list_reduce(
      list_transform(range(0, strlen(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::ubigint),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[],
                               lambda a, z: xor(a >> 1, 3988292384::ubigint * (a & 1))),
      4294967295::ubigint)) % 20 as kind
  from given),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(range(case when kind = 3 then 2 else 1 end)) as copy from kinds where kind <> 0)),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, left(role, 1) as initial
  from damaged),
turns as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
                 when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' end as fault,
         lag(initial) over (partition by conv_id order by i) as before
  from numbered),
sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) as n,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from turns group by conv_id),
grown(q, m, to_q, roles) as (values
  (0, 0, 0, []::varchar[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']),
  (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
  (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']),
  (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])),
state(conv_id, i, q, best) as (
  select conv_id, 0::bigint, 0, {'cost': 0, 'audit': '', 'turns': []::varchar[]} from sums
  union all
  select s.conv_id, s.i + 1, e.q, min({'cost': s.best.cost + 5 * g.m + e.cost, 'audit': s.best.audit || repeat('I', g.m) || e.edit,
                                       'turns': s.best.turns || g.roles || e.kept})
  from state s join turns t on t.conv_id is not distinct from s.conv_id and t.i = s.i + 1 join grown g on g.q = s.q,
  lateral (
    select g.to_q as q, 2 as cost, 'D' as edit, []::varchar[] as kept
    union all
    select case g.to_q when 2 then 3 else 2 end, 1 + case when t.fault = 'truncated' then 5 else 0 end, 'R',
           [case g.to_q when 2 then 'assistant:' else 'user:' end || t.text]
    where t.fault is null or t.fault = 'truncated'
    union all
    select case t.initial when 's' then 1 when 'u' then 2 else 3 end, case when t.fault = 'truncated' then 5 else 0 end, 'K',
           [t.role || ':' || t.text]
    where (t.fault is null or t.fault = 'truncated')
      and ((t.initial = 's' and g.to_q = 0) or (t.initial = 'u' and g.to_q <> 2) or (t.initial = 'a' and g.to_q = 2))) e
  group by s.conv_id, s.i, e.q),
ended as (
  select s.conv_id, min({'cost': s.best.cost + 5 * g.m, 'audit': s.best.audit || repeat('I', g.m), 'turns': s.best.turns || g.roles}) as best
  from state s join sums n on n.conv_id is not distinct from s.conv_id and n.n = s.i join grown g on g.q = s.q and g.to_q in (0, 3)
  group by s.conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.cost, 0)::bigint as cost,
       coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.turns, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join sums s on s.conv_id is not distinct from c.conv_id
left join ended e on e.conv_id is not distinct from c.conv_id
"""

ORACLE = {
    "op1_ngram_jaccard_join": _OP1,
    "op6_sharding": _OP6,
    "op9_warc": _OP9,
    "op11_hard_negatives": _OP11,
    "op13_conversation_repair": _OP13,
}
