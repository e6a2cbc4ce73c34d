"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, needs, template_lengths, template_sets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHINGLES = f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 4], chr(1)) as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as materialized (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
p as materialized (select o.a, o.b from o join n x on o.a = x.doc_id join n y on o.b = y.doc_id where 100 * o.o >= 80 * (x.n + y.n - o.o)),
r(doc_id, c) as (select doc_id, doc_id from documents union select r.doc_id, p.b from r join p on r.c = p.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id from documents d left join n on d.doc_id = n.doc_id join (select doc_id, min(c) as c from r group by doc_id) m on d.doc_id = m.doc_id"""

EMBEDDINGS = """with recursive e as materialized (select vec_id, cast(embedding as double[]) as v from embeddings),
g as (select * from e where len(v) > 0 and list_aggregate(v, 'count') = len(v) and list_bool_and(list_transform(v, lambda x: isfinite(x))) and list_dot_product(v, v) > 0),
p as materialized (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.9),
r(vec_id, c) as (select vec_id, vec_id from e union select r.vec_id, p.b from r join p on r.c = p.a)
select e.vec_id, coalesce(k.n, 0) as n_links, m.c as component_id, e.vec_id = m.c as kept from e left join (select a, count(*) as n from p group by a) k on e.vec_id = k.a join (select vec_id, min(c) as c from r group by vec_id) m on e.vec_id = m.vec_id"""


#: CRC-32 of a short string, bit by bit.
_CRC = """(select xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda y, k: xor(y >> 1, (y & 1) * 3988292384::bigint))), 4294967295::bigint))"""

_FIELD = "case when {0} is null then '-' else concat(strlen(cast({0} as varchar)), ':', {0}) end"
_LEAF = lambda chars: "sha256(concat(" + ", ".join(_FIELD.replace("{0}", c) for c in ("doc_id", "source", "lang", chars, "text")) + "))"

MERKLE = f"""with recursive l as materialized (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from (
    select doc_id, lang, {_LEAF("n_chars")} as leaf, case when {_CRC.replace("{0}", "cast(doc_id as varchar)")} % 7 = 0 then {_LEAF("(n_chars + 1)")} end as changed from documents)),
t(lang, level, i, n, d) as (select lang, 0, i, n, leaf from l
  union all select lang, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(d, '' order by i)) from t where n > 1 group by lang, level, i // 2),
s as materialized (select *, row_number() over (order by lang is not null, lang) - 1 as g, count(*) over () as m from (select lang, level, d from t where n = 1)),
u(level, i, n, d) as (select 0, g, m, d from s union all select level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(d, '' order by i)) from u where n > 1 group by level, i // 2),
root as (select d from u where n = 1),
-- A leaf's way up: what it is folded to, untampered and as presented, and the siblings so far.
w(doc_id, lang, leaf, part, level, i, n, g, m, acc, proof) as (
  select l.doc_id, l.lang, l.leaf, 0, 0, l.i, l.n, s.g, s.m, coalesce(l.changed, l.leaf), '' from l join s on l.lang is not distinct from s.lang
  union all select w.doc_id, w.lang, w.leaf,
    case when w.part = 0 and w.n = 1 then 1 else w.part end, case when w.n = 1 then 0 else w.level + 1 end,
    case when w.n = 1 then w.g else w.i // 2 end, case when w.n = 1 then w.m else (w.n + 1) // 2 end, w.g, w.m,
    case when w.n = 1 then w.acc when w.i % 2 = 0 then sha256(concat(w.acc, coalesce(t.d, u.d, ''))) else sha256(concat(coalesce(t.d, u.d), w.acc)) end,
    case when w.n = 1 then w.proof else concat(w.proof, coalesce(t.d, u.d, '')) end
  from w left join t on w.part = 0 and w.n > 1 and t.lang is not distinct from w.lang and t.level = w.level and t.i = xor(w.i, 1)
    left join u on w.part = 1 and w.n > 1 and u.level = w.level and u.i = xor(w.i, 1)
  where w.part = 0 or w.n > 1)
select w.doc_id, w.leaf, s.d as subroot, root.d as root, sha256(w.proof) as proof_sha256, w.acc as folded_root, w.acc = root.d as verified
from w join s on w.lang is not distinct from s.lang cross join root where w.part = 1 and w.n = 1"""

TRIE = f"""with o as materialized (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(concat(strlen(coalesce(role, '')), ':', role, text))) - 1 as k,
    concat(strlen(coalesce(role, '')), ':', role, text) as s, length(coalesce(text, '')) as chars from conversations where conv_id is not null),
h as materialized (select conv_id, conv_id - conv_id % 100 as base, {_CRC.replace("{0}", "cast(conv_id as varchar)")} % 6 as h from (select distinct conv_id from o)),
r as materialized (select conv_id, row_number() over (partition by conv_id order by own, k) as d, s, chars from (
  select h.conv_id, 0 as own, o.k, o.s, o.chars from h join o on o.conv_id = h.base and o.k < h.h union all select h.conv_id, 1, o.k, o.s, o.chars from h join o on o.conv_id = h.conv_id and o.k >= h.h)),
q as materialized (select h.conv_id, 0 as d, [] :: varchar[] as p, 0 as chars from h
  union all select conv_id, d, list(sha256(s)) over (partition by conv_id order by d), chars from r),
e as materialized (select conv_id, d, p, chars, d = max(d) over (partition by conv_id) as ended from q),
n as materialized (select p, d, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars,
  sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ended), '')) as ends_sha256 from e group by p, d),
c as materialized (select n.p, count(k.p) as n_children from n left join n k on k.d = n.d + 1 and k.p[1 : n.d] = n.p group by n.p)
select n.conv_id, n.d as depth, a.conv_id as parent_conv_id, n.n_convs, c.n_children, x.n_leaves, x.saved_tokens, n.ends_sha256
from n join c on n.p = c.p left join n a on n.d > 0 and a.d = n.d - 1 and a.p = n.p[1 : n.d - 1]
join (select v.p, count(*) filter (b.n_children = 0) as n_leaves, cast(sum((y.n_convs - 1) * y.chars) as bigint) as saved_tokens
  from n v join n y on y.d >= v.d and y.p[1 : v.d] = v.p join c b on b.p = y.p group by v.p) x on x.p = n.p"""

TOP = """with v as materialized (select row_number() over () as r, vec_id, list_transform(cast(embedding as double[]), lambda x: cast(floor(256 * x) as bigint)) as w from embeddings
  where embedding is not null and len(list_filter(cast(embedding as double[]), lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda z: coalesce(z[1] * z[2], 0))) as bigint) as score from v q join v c on q.r <> c.r where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from s) where rank <= 5"""


def _words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def licenses(threshold: float = 0.8) -> str:
    phrases = ", ".join(f"('{label}', {_words(phrase.split())})" for label, phrase in PHRASES.items())
    sets = template_sets(TEMPLATES)
    asked = needs(sets, template_lengths(TEMPLATES), threshold)
    listed = lambda pairs: f"cast({_words(sorted(b' '.join(p).decode() for p in pairs))} as varchar[])"
    known = ", ".join(f"('{label}', {listed(words)}, {need}, {width}, {listed(decisive)})" for (label, words), (need, width, decisive) in zip(sets, asked, strict=True))
    split = "list_filter(string_split_regex({0}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""with d as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
w as materialized (select doc_id, t, {split.format("t")} as ws from d),
f as (select * from (values {phrases}) as f(label, ps)),
i as (select doc_id, label, i from (select w.doc_id, w.ws, f.label, f.ps, unnest(range(1, len(w.ws) + 1)) as i from w join f on list_has_all(w.ws, f.ps)) where ws[i : i + len(ps) - 1] = ps),
b as (select doc_id, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word, string_agg(distinct label, ',' order by label) as base_labels from i group by doc_id),
k as (select * from (values {known}) as k(label, ts, need, width, ds)),
p as materialized (select doc_id, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])) as ps from w),
c as (select p.doc_id, p.ps, k.* from p join k on len(list_intersect(k.ts, p.ps)) >= k.need),
l as (select doc_id, label, ts, need, ds, ps[i : i + width - 1] as bs from (select *, unnest(range(1, len(ps) + 1)) as i from c)),
h as (select doc_id, label, max(cast(len(list_intersect(ts, bs)) as double) / len(ts)) as c from l where len(list_intersect(ts, bs)) >= need and list_has_all(bs, ds) group by 1, 2),
a as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from h union all select doc_id, label from i) group by doc_id)
select w.doc_id, len(w.ws) as n_words, coalesce(b.n_base, 0) as n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') as base_labels, coalesce(a.labels, '') as labels,
  greatest(case when b.n_base > 0 then cast(1 as double) else cast(0 as double) end, coalesce((select max(c) from h where h.doc_id = w.doc_id), cast(0 as double))) as score
from w left join b on w.doc_id = b.doc_id left join a on w.doc_id = a.doc_id"""
