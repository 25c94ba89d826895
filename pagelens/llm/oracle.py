"""DuckDB SQL for the corpus queries that SQL can express.

Not here: PII spans (sanitisation terms), language, page text, quality and secrets, which learn
models or follow procedures; tests hold these against brute force and held-out rows.
"""

from __future__ import annotations

from pagelens.llm.decontam import SLOP

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

OP1 = """
with t as (select *, conv_id::varchar || ':' || turn as id, conv_id::varchar || ':' || (turn - 1) as before from conversations),
calls as (select distinct id from t where role = 'user'), results as (select distinct before as id from t where role = 'assistant'),
u as (select t.*, exists (select 1 from results r where r.id = t.conv_id::varchar || ':' || (t.turn - 2)) and exists (select 1 from calls c where c.id = t.conv_id::varchar || ':' || (t.turn - 2)) as follows
  from t where role = 'user'),
g as (select *, sum(case when follows then 0 else 1 end) over (partition by conv_id order by turn) as island from u),
said as (select *, '{"role":' || to_json(role)::varchar || ',"text":' || to_json(text)::varchar || ',"turn":' || turn || '}' as json from t)
select s.conv_id, s.turn, case role when 'user' then 'call' when 'assistant' then 'result' else 'note' end as kind,
  case role when 'user' then s.id when 'assistant' then s.before end as call_id,
  case role when 'user' then s.id in (select id from results) when 'assistant' then s.before in (select id from calls) else false end as linked,
  case role when 'user' then l.level end as level, case role when 'user' then length(text) > 0 end as valid,
  case role when 'user' then '{"arguments":' || json || ',"name":"reply"}' else json end as json
from said s left join (select id, row_number() over (partition by conv_id, island order by turn) - 1 as level from g) l on l.id = s.id
"""

OP3 = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
win as (select distinct item_id, n, w[s : s + n - 1] as k from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s from i where len(w) > 0)),
pts as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
hit as (select pts.r, pts.p, win.n, win.item_id from pts join win on pts.word = win.k[1] join d on d.r = pts.r where d.w[pts.p : pts.p + win.n - 1] = win.k),
cov as (select r, count(distinct q) as n from (select r, unnest(range(p, p + n)) as q from hit) group by r),
its as (select r, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct r, item_id::varchar as id from hit) group by r),
cf as (select word, count(*) as c from pts group by word),
rare as (select item_id, n, k, arg_min(t, struct_pack(c := coalesce(c, 0), t := t)) as word, min(coalesce(c, 0)) as least from (select item_id, n, k, unnest(k) as t from win) left join cf on word = t group by item_id, n, k),
close as (select distinct r, item_id::varchar as id from (select pts.r, rare.item_id, rare.k, rare.n + {SLOP} as reach, d.w, unnest(range(greatest(1, pts.p - rare.n - {SLOP} + 1), pts.p + 1)) as o
  from rare join pts on pts.word = rare.word join d on d.r = pts.r where least > 0 and list_has_all(d.w[greatest(1, pts.p - rare.n - {SLOP} + 1) : pts.p + rare.n + {SLOP} - 1], rare.k)) where list_has_all(w[o : o + reach - 1], k)),
nr as (select r, count(*) as n, string_agg(id, ',' order by id) as ids from close group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(cov.n, 0)::bigint as n_hit, coalesce(its.n, 0)::bigint as n_items, sha256(coalesce(its.ids, '')) as items_sha256,
  coalesce(cov.n, 0) > 0 and 20 * coalesce(cov.n, 0) >= len(d.w) as contaminated, coalesce(nr.n, 0)::bigint as n_near, coalesce(nr.ids, '') as near_items
from d left join cov using (r) left join its using (r) left join nr using (r)
"""

OP6 = """
with v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and list_sum(list_transform(embedding, lambda x: x::double * x)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
n as (select a, count(*) as n from links group by a),
reach as (with recursive reach(x, y) as (select vec_id, vec_id from embeddings union select x, b from reach join links on y = a) select x, min(y) as least from reach group by x)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, reach.least as component_id, e.vec_id = reach.least as kept
from embeddings e left join n on n.a = e.vec_id join reach on reach.x = e.vec_id
"""

OP9 = f"""
with d as (select doc_id, {_SPACED} as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[k : k + 4], ' ') end as g, len(w) < 5 as short from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.short = b.short and a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
reach as (with recursive reach(x, y) as (select doc_id, doc_id from documents union select x, b from reach join links on y = a) select x, min(y) as least from reach group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, reach.least as component_id from d left join n using (doc_id) join reach on reach.x = d.doc_id
"""


def _apportion(name: str, claims: str, group: str, claim: str, order: str, room: str = "") -> str:
    """Tables {name}_c, {name}_r and {name} (claims with quota) for seats dealt by highest claim / (2 k + 1)."""
    part = f"partition by {group}" if group else ""
    key = f"{group}, {order}" if group else order
    held = (lambda x: f"least({x}, {room})") if room else (lambda x: x)
    spread = "2.5" if room else "0.5"
    return f"""{name}_c as (select *, case when sum({claim}) over ({part}) > 0 then {claim} / sum({claim}) over ({part}) else 0 end as part, count(*) over ({part}) as m from {claims}),
{name}_s as (select *, {held(f"greatest(0, floor(part * seats - part * m / 2 - 1))")}::bigint as sure, {held(f"(case when {claim} > 0 then ceil(part * seats + part * m * {spread} + 1) else 0 end)")}::bigint as most from {name}_c),
{name}_l as (select *, seats - sum(sure) over ({part}) as spare from {name}_s),
{name}_r as (select {key}, count(*) as got from (select {key}, spare, row_number() over ({part} order by {claim} / (2 * k + 1) desc, {order}, k) as n
  from (select {key}, {claim}, spare, unnest(range(sure, most)) as k from {name}_l)) where n <= spare group by {key}),
{name} as (select l.*, sure + coalesce(got, 0) as quota from {name}_l l left join {name}_r using ({key}))"""


OP7 = rf"""
with sizes as (select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5('mix-1:' || doc_id::varchar) as dug from documents),
src as (select source, sum(size)::bigint as source_size, count(*) as docs, row_number() over (order by source asc nulls last) as pos from sizes group by source),
wts as (select *, 1 + (pos - 1) % 3 as weight, 3 * source_size as most, sum(source_size) over () as total from src),
fill as (select *, total - coalesce(sum(most) over (order by most / weight, pos rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(weight) over (order by most / weight, pos rows between current row and unbounded following) as heavy from wts),
judged as (select *, most::double * heavy <= rest::double * weight as "full" from fill),
tgt as (select j.*, case when "full" then most::double else l.rest::double * weight / l.heavy end as target from judged j left join (select rest, heavy from judged where not "full" order by most / weight, pos limit 1) l on true),
seated as (select *, floor(sum(target) over () / 32 + 0.5)::bigint as seats from tgt),
{_apportion("level", "seated", "", "target", "pos")},
shard_rows as (select z.*, v.pos, v."full", v.source_size, v.target, v.quota as blocks, ('0x' || substr(z.dug, 1, 8))::bigint % ceil(v.docs / 512.0)::bigint as shard, ceil(ceil(v.docs / 512.0) / 4096)::bigint as grps from sizes z join level v on z.source is not distinct from v.source),
parts as (select pos, shard % grps as grp, shard, sum(size)::double as words, any_value("full") as "full", any_value(blocks) as blocks, floor(3 * sum(size) / 32)::bigint as room from shard_rows group by all),
grouped as (select pos, grp, sum(words)::double as words, sum(room)::bigint as room, any_value(blocks) as seats from parts group by pos, grp),
{_apportion("lot", "grouped", "pos", "words", "grp", "room")},
shards as (select p.*, l.quota as seats from parts p join lot l using (pos, grp)),
{_apportion("dealt", "shards", "pos, grp", "words", "shard", "room")},
taken as (select pos, shard, words::bigint as words, (case when "full" then 3 * words else quota * 32 end)::bigint as want,
  (('0x' || substr(md5('mix-1:' || pos || ':' || shard), 1, 8))::bigint % greatest(1, ceil(words / 32)::bigint) * 32)::bigint as start from dealt where words > 0),
runs as (select s.*, sum(size) over (partition by pos, shard order by dug, doc_id, size rows between unbounded preceding and current row)::bigint as stop from shard_rows s),
cut as (select u.*, t.words, t.start, t.want // t.words as passes, t.start + t.want % t.words as until from runs u left join taken t using (pos, shard))
select doc_id, size, source_size, target, coalesce(passes * size + greatest(0, least(stop, least(until, words)) - greatest(stop - size, start)) + greatest(0, least(stop, until - words) - (stop - size)), 0)::bigint as taken from cut
"""

ORACLE: dict[str, str] = {
    "op1_chat_formatting": OP1,
    "op3_decontamination": OP3,
    "op6_embedding_dedup": OP6,
    "op7_mixing": OP7,
    "op9_ngram_join": OP9,
}
