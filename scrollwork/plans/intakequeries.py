"""Queries of what comes into the ledger, and their SQL twins."""

from __future__ import annotations

from scrollwork.functions.text import strip_ws_sql
from scrollwork.operators import intake as i
from scrollwork.plans.ledgerqueries import _EV, _FP, _LATEST, _LIVE, CUR, _last
from scrollwork.plans.textqueries import _CH, _words
from scrollwork.sources.tables import table


def _q(f, *names):  # noqa: ANN001, ANN002, ANN202
    return lambda spark, d: f(*(table(spark, d, n) for n in names))


QUERIES = {
    "JN-03_unknown_relations": _q(i.unknown_relations, "analysis", "characters"),
    "JN-22_matched_plants": _q(i.matched_plants, "analysis", "foreshadows"),
    "LG-07_operation_faults": _q(i.operation_faults, "analysis", "foreshadows"),
    "LG-01_verdicts": _q(i.verdicts, "analysis", "characters", "foreshadows", "books"),
    "AG-13_duplicate_terms": _q(i.duplicate_terms, "analysis"),
    "JN-23_main_payoffs": _q(i.main_payoffs, "analysis", "foreshadows", "books"),
    "PF-01_scope": _q(i.scope, "books", "documents"),
    "LG-13_snapshots": _q(lambda a, c: i.snapshot(a, c, a.where("chapter % 20 = 0").select("book", "chapter").distinct()), "analysis", "characters"),
    "LG-17_first_snapshot": _q(lambda a, c, b: i.snapshot(a, c, i.before_current(b)), "analysis", "characters", "books"),
    "LG-16_written_back": _q(i.written_back, "analysis", "characters"),
    "LG-18_locks": _q(i.locks, "books", "documents"),
    "SC-18_versions": _q(i.versions, "documents"),
}

_KNOWN = "kn as (select book, name from characters where name is not null union select book, unnest(aliases) from characters)"
_REL = CUR + f""", {_KNOWN}, rl as (select book, chapter, unnest(relationships) as r from cur), rs as (select distinct * from (select book, chapter, 'a' as side, r.a as name from rl union all select book, chapter, 'b', r.b from rl) where name is not null),
nw as (select book, chapter, unnest(characters).name as name from cur), ur as (select * from rs where not exists (select 1 from kn where kn.book = rs.book and kn.name = rs.name) and not exists (select 1 from nw where nw.book = rs.book and nw.chapter = rs.chapter and nw.name = rs.name))"""
_OPS = f"op as (select book, chapter, u.i::int - 1 as pos, u.x.action as action, {strip_ws_sql(chr(39) * 2 + ' || coalesce(u.x.id, ' + chr(39) * 2 + ')')} as raw, {strip_ws_sql(chr(39) * 2 + ' || coalesce(u.x.new_item.title, ' + chr(39) * 2 + ')')} as title from (select book, chapter, unnest(list_transform(foreshadow_ops, lambda x, i: struct_pack(x := x, i := i))) as u from cur))"
_FAULT = f"{_OPS}, of as (select book, chapter, pos, case when action is null or action not in ('plant', 'advance', 'setback', 'payoff', 'abandon') then 'op_bad_action' when raw <> '' and not exists (select 1 from foreshadows f where f.book = op.book and f.id = upper(raw)) then 'op_unknown_id' when raw = '' and action <> 'plant' then 'op_without_id' when raw = '' and title = '' then 'plant_without_title' end as code from op)"
_SHA = f"case when {_FP} = '' then '' else substring(sha1({_FP}), 1, 10) end"

ORACLE = {
    "JN-03_unknown_relations": _REL + " select * from ur",
    "LG-07_operation_faults": CUR + f", {_FAULT} select * from of where code is not null",
    "JN-22_matched_plants": CUR + f""", {_OPS}, p as (select book, chapter, pos, title, {_SHA} as fp from op where action = 'plant' and raw = '' and title <> ''),
f as (select book, id, status, {strip_ws_sql("coalesce(title, '')")} as title, {_SHA} as own, coalesce(fp, '') as stored from foreshadows where deleted_at is null),
m as (select p.*, (select min(id) from f where f.book = p.book and status = 'planned' and p.fp <> '' and p.fp in (own, stored)) as i1, (select min(id) from f where f.book = p.book and status = 'planned' and f.title = p.title) as i2, (select min(id) from f where f.book = p.book and f.title = p.title) as i3 from p)
select book, chapter, pos, title, coalesce(i1, i2, i3) as thread, case when i1 is not null then 1 when i2 is not null then 2 when i3 is not null then 3 end as step from m""",
    "LG-01_verdicts": _REL + f""", {_FAULT}, fa as (select book, chapter, count(*) as n from (select book, chapter from of where code is not null union all select book, chapter from ur) group by all),
fi as (select distinct book, unnest(finalized_chapters) as chapter from books), fr as (select book, chapter, min(analysis_id) as first_id from analysis group by all)
select cur.book, cur.chapter, analysis_id, case when fi.chapter is not null and analysis_id <> first_id then 'locked' when n > 0 then 'refused' else 'applied' end as verdict, coalesce(n, 0)::bigint as n_faults
from cur left join fi on cur.book = fi.book and cur.chapter = fi.chapter join fr on cur.book = fr.book and cur.chapter = fr.chapter left join fa on cur.book = fa.book and cur.chapter = fa.chapter""",
    "AG-13_duplicate_terms": CUR + f" select book, {strip_ws_sql('x.term')} as term, count(*) as n, min(chapter) as first_chapter from (select book, chapter, unnest(terms) as x from cur) where {strip_ws_sql('x.term')} <> '' group by all having count(*) > 1",
    "JN-23_main_payoffs": _LIVE + f", {CUR[5:]}, e as (select distinct book, chapter, upper({strip_ws_sql('o.id')}) as thread from (select book, chapter, unnest(foreshadow_ops) as o from cur where type = '过渡') where o.action = 'payoff') select e.* from e join live on e.book = live.book and e.thread = live.id where tier = 1",
    "PF-01_scope": _CH + ", dn as (select distinct book, unnest(completed_chapters) as chapter from books) select book, chapter, 'done' as why from (select *, row_number() over (partition by book order by chapter desc) as r from dn) where r <= 2 union all select book, chapter, 'pending' from ch where exists (select 1 from books b where b.book = ch.book) and not exists (select 1 from dn where dn.book = ch.book and dn.chapter = ch.chapter)",
    "LG-13_snapshots": _EV + ", pt as (select distinct book, chapter as upto from analysis where chapter % 20 = 0), x as (select ev.book, upto, character_id, state_key, value, row_number() over (partition by ev.book, upto, character_id, state_key order by chapter desc, pos desc) as k from ev join pt on ev.book = pt.book and chapter <= upto) select book, upto as chapter, character_id, state_key, value from x where k = 1",
    "LG-17_first_snapshot": _EV + ", pt as (select book, max(current_chapter) - 1 as upto from books group by book having max(current_chapter) - 1 >= 1), x as (select ev.book, upto, character_id, state_key, value, row_number() over (partition by ev.book, upto, character_id, state_key order by chapter desc, pos desc) as k from ev join pt on ev.book = pt.book and chapter <= upto) select book, upto as chapter, character_id, state_key, value from x where k = 1",
    "LG-16_written_back": _EV + f", {_LATEST}, e as (select book, character_id, state_key, value, true as e from {_last()}), a as (select book, id as character_id, kv.key as state_key, kv.value as value from (select book, id, unnest(map_entries(state)) as kv from lat)) select coalesce(e.book, a.book) as book, coalesce(e.character_id, a.character_id) as character_id, coalesce(e.state_key, a.state_key) as state_key, case when e then e.value else a.value end as value, case when e then 'replay' else 'ledger' end as source from e full join a on e.book = a.book and e.character_id = a.character_id and e.state_key = a.state_key",
    "LG-18_locks": _CH + f", fi as (select distinct book, unnest(finalized_chapters) as chapter from books), dn as (select distinct book, unnest(completed_chapters) as chapter from books) select fi.book, fi.chapter, dn.chapter is not null as completed, sha256(t) as sha, {_words('t')} as words from fi left join dn on fi.book = dn.book and fi.chapter = dn.chapter left join ch on fi.book = ch.book and fi.chapter = ch.chapter",
    "SC-18_versions": "with d as (select distinct book, chapter, doc_id from documents where doc_kind = 'chapter' and book is not null and chapter is not null and text is not null) select book, chapter, (row_number() over w)::int as version, doc_id, lag(doc_id) over w as before_id from d window w as (partition by book, chapter order by doc_id)",
}
