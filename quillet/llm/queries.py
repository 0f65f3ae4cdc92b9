"""Queries of the training-data operators, and the SQL of those that SQL can express over whole tables."""

from __future__ import annotations

from quillet.llm import copies, encoding, leaks, mix, overlap, pairs, pieces, splits, tokens

QUERIES = {
    f.__name__: f
    for f in (
        splits.p1_found, splits.p1_splits, mix.p2_chosen, mix.p2_shares, overlap.p3_found, overlap.p3_classes, overlap.p3_report,
        copies.p4_found, copies.p4_collapsed, pairs.p5_found, pieces.p6_found, pieces.p6_pieces, tokens.p7_ids, tokens.p7_offsets,
        leaks.p8_found, leaks.p8_passages, encoding.p9_found, encoding.p9_restored,
    )
}

# words of problem 3: a point between digits becomes a private character for a while
_W = r"""w as (select item_id, source, lower(trim(split)) as split, lower(trim(split)) = 'train' as train,
   list_distinct([replace(x, chr(57344), '.') for x in regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(replace(lower(upper(question)), chr(223), 'ss'), '[\p{Cf}\x{fe00}-\x{fe0f}]+', '', 'g'),
     '(\p{Nd})\.(\p{Nd})', '\1' || chr(57344) || '\2', 'g'), '(\p{Nd})\.(\p{Nd})', '\1' || chr(57344) || '\2', 'g'), '[\p{L}\p{M}\p{N}\x{e000}]+')]) as ws
   from build_qa_choice where lower(trim(split)) in ('train', 'validation', 'dev', 'test', 'eval') and question is not null),
 e as (select item_id, train, len(ws) as n, unnest(ws) as x from w),
 j as (select a.item_id as a, b.item_id as b, any_value(a.n) as n1, any_value(b.n) as n2, count(*) as k from e a join e b on a.x = b.x and a.train and not b.train group by 1, 2),
 f as (select a, b from j where k >= 0.6 * (n1 + n2 - k) - 1e-9)"""

_SIGN = r"(^|[^\p{L}\p{N}\p{Pe}%\x{b0}])"


def _canonical(x: str) -> str:
    """SQL of copies.canonical; twice where matches may touch."""
    t = rf"regexp_replace(upper({x}), '[\p{{Cf}}\x{{34f}}\x{{115f}}\x{{1160}}\x{{17b4}}\x{{17b5}}\x{{180b}}-\x{{180f}}\x{{3164}}\x{{fe00}}-\x{{fe0f}}\x{{ffa0}}\x{{2800}}\x{{e0100}}-\x{{e01ef}}]+', '', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(57344) || '\2', 'g')"
    for mark, code in ((r"[-\x{2212}\x{2010}\x{2011}\x{ff0d}]", 57345), (r"[+]", 57346)):
        for _ in range(2):
            t = rf"regexp_replace({t}, '{_SIGN}{mark}(\p{{Nd}}|\.\p{{Nd}})', '\1' || chr({code}) || '\2', 'g')"
    t = rf"regexp_replace({t}, '[\p{{P}}\p{{Z}}\p{{Cc}}\s`^~|\x{{b4}}\x{{2bc}}]+', '', 'g')"
    return f"replace(lower({t}), chr(223), 'ss')"


_COPIES = f"""q as (select 'build_qa_choice' as tab, item_id as id, {_canonical("question")} as k1, [coalesce('=' || {_canonical("o")}, '0') for o in options] as os, {_canonical("case when gold >= 0 and gold < len(options) then options[gold + 1] end")} as k3 from build_qa_choice),
 s as (select 'build_sci_decisions' as tab, rec_id as id, {_canonical("passage")} as k1, {_canonical("q")} as k2, {_canonical("a")} as k3 from build_sci_decisions),
 u as (select tab, id, k1, array_to_string(list_sort(list_distinct(os)), chr(2)) as k2, k3 from q union all select tab, id, k1, k2, k3 from s),
 c as (select tab, id, min(id) over (partition by tab, k1, k2, k3) as first_id, count(*) over (partition by tab, k1, k2, k3) as copies from u)"""

# groups of problem 1: label(tab, rec_id, root)
_GROUPS = r"""
with recursive
sci as (
  select rec_id, coalesce(source, '') || '|' || pid as name, coalesce('0' || coalesce(source, '') || '|' || pid, '1' || lpad(rec_id::varchar, 20, '0')) as node,
    case when regexp_replace(document_id, '[\s\x{b}\x{85}\p{Z}\x{1c}-\x{1f}]+', '', 'g') <> '' then 'd' || document_id end as k1,
    'p' || regexp_replace(passage, '[\s\x{b}\x{85}\p{Z}\x{1c}-\x{1f}]+', '', 'g') as k2
  from build_sci_decisions),
qa as (
  select item_id as rec_id, coalesce('0' || split_group, '1' || lpad(item_id::varchar, 20, '0')) as node,
    case when source is not null and source_id is not null then 's' || length(source) || ':' || source || source_id end as k1, null::varchar as k2
  from build_qa_choice),
rec as (select 'build_sci_decisions' as tab, rec_id, node, k1, k2 from sci union all select 'build_qa_choice', rec_id, node, k1, k2 from qa),
span as (select distinct tab, node, md5(k) as k from (select tab, node, k1 as k from rec union all select tab, node, k2 from rec) where k is not null),
star as (select s.tab, s.node as a, m.b from span s join (select tab, k, min(node) as b from span group by all having count(*) > 1) m using (tab, k) where s.node <> m.b),
edge as (select tab, a, b from star union select tab, b, a from star),
walk(tab, node, seen) as (
  select tab, a, a from edge
  union select w.tab, w.node, e.b from walk w join edge e on e.tab = w.tab and e.a = w.seen),
root as (select tab, node, min(seen) as root from walk group by all),
label as (select r.tab, r.rec_id, coalesce(t.root, r.node) as root from rec r left join root t on t.tab = r.tab and t.node = r.node)"""

SQL = {
    "p3_found": f"with {_W} select least(a, b) as item_a, greatest(a, b) as item_b from f",
    "p3_classes": f"""with {_W}, k as (select item_id, train, md5(array_to_string(list_sort(ws), chr(2))) as k from w where len(ws) > 0), c as (select k, min(item_id) as cid, sum(train::int)::bigint as train, sum((not train)::int)::bigint as held from k group by 1)
 select distinct x.cid as train_cid, y.cid as heldout_cid, x.train as train_items, y.held as heldout_items from f join k a on a.item_id = f.a join k b on b.item_id = f.b join c x on x.k = a.k join c y on y.k = b.k""",
    "p3_report": f"with {_W} select split, source, count(*)::bigint as items, count(h.b)::bigint as leaked from w left join (select distinct b from f) h on h.b = w.item_id where not train and len(ws) > 0 group by 1, 2",
    "p4_found": f"with {_COPIES} select tab, first_id, id as copy_id from c where id <> first_id",
    "p4_collapsed": f"with {_COPIES} select tab, first_id, copies::bigint as copies from c where id = first_id",
    "p1_found": f"""{_GROUPS}
select tab, rec_id, case when root[1] = '0' then root[2:] end as group_key
from (select *, count(*) over (partition by tab, root) as n from label) where n >= 2""",
    "p1_splits": f"""{_GROUPS},
size as (select tab, root, root[1] || case tab when 'build_sci_decisions' then '0' else '1' end || root[2:] as g, count(*) as n from label group by all), tot as (select tab, sum(n)::double as t from size group by 1),
big as (select tab, root, n, row_number() over (partition by tab order by n desc, g) as r from size join tot using (tab) where n > 0.005 * t),
deal(tab, r, a, b, c, root, split) as (
  select tab, 0::bigint, 0.65::double * t, 0.15::double * t, 0.2::double * t, null::varchar, null::varchar from tot
  union all select d.tab, x.r, d.a - case when d.a >= d.b and d.a >= d.c then x.n else 0 end, d.b - case when d.b > d.a and d.b > d.c then x.n else 0 end, d.c - case when d.c > d.a and d.c >= d.b then x.n else 0 end, x.root,
    case when d.a >= d.b and d.a >= d.c then 'train' when d.c >= d.b then 'eval' else 'dev' end from deal d join big x on x.tab = d.tab and x.r = d.r + 1),
rest as (select tab, greatest(0, arg_max(a, r)) as a, greatest(0, arg_max(b, r)) as b, greatest(0, arg_max(c, r)) as c from deal group by 1),
spot as (select tab, root, n, ('0x' || substr(sha256('quillet|' || g), 1, 8))::bigint / 4294967296.0::double as s from size)
select l.tab, l.rec_id, l.root as group_id, p.n::bigint as group_size, coalesce(d.split, case when s < r.a / (r.a + r.b + r.c) then 'train' when s < r.a / (r.a + r.b + r.c) + r.b / (r.a + r.b + r.c) then 'dev' else 'eval' end) as split
from label l join spot p using (tab, root) join rest r using (tab) left join deal d on d.tab = l.tab and d.root = l.root""",
    "p6_found": """
select 'build_sci_decisions' as tab, rec_id as item_id from build_sci_decisions where length(passage) > 2400
union all select 'articles', row_id from articles where length(abstract) > 2400""",
}
