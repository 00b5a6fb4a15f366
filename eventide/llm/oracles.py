"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || md5(coalesce(doc_id::varchar, chr(1) || coalesce(text, '')))[1:15])::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, 3.0::double * source_size as cap,
    [5.0::double, 2.0, 1.0][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as w,
    (sum(source_size) over ())::double as total from s),
q as (select *, cap / w as ratio from r),
k as (select *, row_number() over (order by ratio, source asc nulls last) as no, total - coalesce(sum(cap) over (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over () - coalesce(sum(w) over (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as open from q),
t as (select source, source_size, least(cap, (select arg_min(rest / open, no) from k where ratio * open >= rest) * w) as target from k),
b as (select *, least(3, coalesce(floor(target / nullif(source_size, 0)), 0))::bigint as copies from t),
c as (select d.*, b.source_size, b.target, b.copies,
    case when b.copies >= 3 then 0 else greatest(0, b.target - b.copies * b.source_size) end as budget
    from d join b on d.source is not distinct from b.source),
u as (select *, (sum(size) over (partition by source order by h range between unbounded preceding and current row))::double as upto,
    (sum(size) over (partition by source, h))::double as own from c),
v as (select *, upto - own as below from u),
m as (select *, max(case when below <= budget then h end) over (partition by source) as edge from v)
select doc_id, source, size, source_size, target,
    size * (copies + case when h < edge or (h = edge and own > 0 and upto - budget <= budget - below) then 1 else 0 end)::bigint as taken
from m
"""

OP7 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sh as (select distinct doc_id, hash(array_to_string(ws[i:i+4], ' ')) as g
    from (select doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
fp as (select doc_id, n, md5(string_agg(g::varchar, ',' order by g)) as f from sh join n using (doc_id) group by doc_id, n),
cl as (select f, min(doc_id) as rep from fp group by f),
rs as (select sh.doc_id, g, n.n from sh join cl on sh.doc_id = cl.rep join n on n.doc_id = sh.doc_id),
e as (select a.doc_id as a, b.doc_id as b from rs a join rs b on a.g = b.g and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
u as (select a, b from e union all select b, a from e),
reach as (select rep as node, rep as root from cl union select u.b, r.root from reach r join u on u.a = r.node),
comp as (select node, min(root) as component_id from reach group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(comp.component_id, d.doc_id) as component_id,
    d.doc_id = coalesce(comp.component_id, d.doc_id) as kept
from documents d left join fp using (doc_id) left join n using (doc_id) left join cl on cl.f = fp.f
left join comp on comp.node = cl.rep
"""

OP9 = r"""
with iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (select distinct item_id, array_to_string(ws[i:i+9], ' ') as g, least(10, len(ws)) as l
    from (select item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) as i from iw where len(ws) > 0)),
lens as (select distinct l from win),
dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
pos as (select doc_id, l, i, array_to_string(ws[i:i+l-1], ' ') as g
    from (select doc_id, ws, l, unnest(generate_series(1, len(ws) - l + 1)) as i from dw, lens where len(ws) >= l)),
hit as (select pos.doc_id, pos.i, pos.l, win.item_id from pos join win on pos.g = win.g and pos.l = win.l),
hw as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + l - 1)) as p from hit) group by doc_id),
ow as (select doc_id, i - 1 as i, len(w) as l, sum(len(gap) + len(w)) over (partition by doc_id order by i rows unbounded preceding) as e
    from (select doc_id, unnest(ws) as w, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')[1:len(ws)]) as gap,
        unnest(generate_series(1, len(ws))) as i from dw join documents using (doc_id) where doc_id in (select doc_id from hit))),
st as (select doc_id, min(e - l)::bigint as a, max(e)::bigint as b from (select ow.*, ow.i - row_number() over (partition by doc_id order by ow.i) as run from ow
    where (doc_id, ow.i + 1) in (select doc_id, unnest(generate_series(i, i + l - 1)) from hit)) group by doc_id, run),
sp as (select doc_id, string_agg(a || ':' || b, ',' order by a) as spans from st group by doc_id),
hi as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items
    from (select distinct doc_id, item_id::varchar as s from hit) group by doc_id)
select dw.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
    coalesce(spans, '') as spans
from dw left join sp using (doc_id) left join hw using (doc_id) left join hi using (doc_id)
"""

OP11 = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t, length(coalesce(text, '')) as c from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t)::bigint as group_size,
    row_number() over w = 1 as kept, sha256(t) as text_sha256
from d window w as (partition by t order by c desc, doc_id asc nulls last)
"""

OP12 = r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, ('0x' || h[1:8])::bigint % (n + 1) as x, ('0x' || h[9:16])::bigint % (n + 1) as y,
    ('0x' || h[17:24])::bigint % 100 as plain, ('0x' || h[25:32])::bigint % 100 as turned from d),
c as (select *, least(x, y) as a, greatest(x, y) as b, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>')
    or plain >= 90 then 'plain' when turned < 20 then 'spm' else 'psm' end as form from u),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c),
o as (select *, case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end as output from p),
r as (select *, split_part(output, '<M>', 1) as head, split_part(output, '<M>', 2) as m from o)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
    sha256(output) as output_sha256,
    sha256(case form when 'plain' then output when 'psm' then substr(split_part(head, '<S>', 1), 4) || m || split_part(head, '<S>', 2)
        else split_part(head, '<P>', 2) || m || substr(split_part(head, '<P>', 1), 4) end) as restored_sha256
from r
"""
