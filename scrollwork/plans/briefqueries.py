"""Queries of plans, cards and lookups, and their SQL twins."""

from __future__ import annotations

from scrollwork.functions import packs
from scrollwork.functions.text import strip_ws_sql
from scrollwork.operators import brief as b
from scrollwork.plans.checkqueries import _NOW, _field
from scrollwork.plans.checkqueries import ORACLE as _CHECK
from scrollwork.plans.corpusqueries import _CHUNKS, _TOK
from scrollwork.plans.ledgerqueries import _DNA, _LATEST, _LIVE, _OWN, CUR
from scrollwork.plans.ledgerqueries import ORACLE as _LEDGER
from scrollwork.plans.textqueries import _CH
from scrollwork.sources.tables import table


def _q(f, *names):  # noqa: ANN001, ANN002, ANN202
    return lambda spark, d: f(*(table(spark, d, n) for n in names))


_ABD = ("analysis", "books", "documents")
QUERIES = {
    "JN-14_plan_threads": _q(b.plan_threads, "foreshadows", "books", "documents"),
    "JN-15_plan_items": _q(b.plan_items, "analysis", "characters", "books", "documents"),
    "JN-17_plan_terms": _q(b.plan_terms, *_ABD),
    "JN-17_plan_facts": _q(b.plan_facts, *_ABD),
    "JN-18_open_setups": _q(b.open_setups, "analysis", "books"),
    "JN-06_relations_named": _q(b.relations_named, "characters"),
    "CP-06_organizations": _q(b.active_organizations, "organizations", "characters", "books", "documents"),
    "CP-08_recent_events": _q(b.recent_events, "analysis", "books"),
    "CP-09_type_cards": _q(b.type_cards, *_ABD),
    "TK-05_urgent": _q(b.urgent_threads, "foreshadows", "books"),
    "TK-02_recall": _q(b.recall, "documents", "books"),
    "LK-01_card": _q(lambda c: b.character_cards(c, "亓远"), "characters"),
    "LK-02_thread_chapters": _q(lambda a: b.thread_chapters(a, "payoff"), "analysis"),
    "LK-02_thread_cards": _q(lambda f: b.thread_cards(f, "plant"), "foreshadows"),
    "SK-08_state": _q(b.state_report, "characters", "organizations", "foreshadows", "analysis", "books"),
    "LK-03_item": _q(lambda a, c: b.item(a, c, "铜钥匙"), "analysis", "characters"),
    "LK-05_term": _q(lambda a: b.term(a, "铜"), "analysis"),
    "LK-06_fact": _q(lambda a: b.fact(a, "金额"), "analysis"),
}

_NW = f"nw as (select * from {_NOW} where now is not null)"
_PLAN = f"{_NW}, pl as (select book, chapter as now, doc_id, text from (select d.*, row_number() over (partition by d.book order by d.chapter desc, doc_id desc) as rn from documents d join nw on d.book = nw.book and d.chapter <= nw.now where doc_kind = 'plan' and text is not null) where rn = 1)"
_REV = ", rv as (select book, term, min(chapter) as revealed_chapter from (select book, chapter, unnest(revealed_terms) as term from cur) group by all)"
_POS = "(select book, chapter, u.i as pos, u.x as x from (select book, chapter, unnest(list_transform({}, lambda x, i: struct_pack(x := x, i := i))) as u from cur))"
_TERMS = f", te as (select *, row_number() over (partition by book, x.term order by chapter, pos) as k from {_POS.format('terms')} where x.term <> ''){_REV}, tc as (select te.book, x.term as term, x.brief as brief, x.truth as truth, chapter as first_chapter, x.reveal_chapter as reveal_chapter, revealed_chapter from te left join rv on te.book = rv.book and te.x.term = rv.term where k = 1)"
_FACTS = f", fe as (select *, row_number() over w as k, lag(x.value) over v as before, min(chapter) over (partition by book, x.name) as first_chapter from {_POS.format('facts')} where x.name <> '' and x.value is not null window w as (partition by book, x.name order by chapter desc, pos desc), v as (partition by book, x.name order by chapter, pos)), fu as (select book, x.name as name, max(chapter) as updated_chapter from fe where before is not null and before <> x.value group by all), fc as (select fe.book, x.name as name, x.value as value, x.category as category, x.note as note, first_chapter, updated_chapter from fe left join fu on fe.book = fu.book and fe.x.name = fu.name where k = 1)"


def _some(cards: str, key: str, most: int) -> str:
    return f", nm as (select c.*, (contains(text, {key}) or contains(text, substring({key}, 1, 2))) as named from {cards} c join pl using (book)), so as (select * from nm where named or book not in (select book from nm where named)), rk as (select *, row_number() over (partition by book order by first_chapter, {key})::int as rank from so)"


_CASE = lambda k: "case type " + " ".join(f"when '{t}' then '{v[k]}'" for t, v in packs.GUIDE.items()) + " end"
_TYPES = ", ".join(f"'{x}'" for x in packs.CHAPTER_TYPES)
_J = "case when len(d1) > 0 and len(d2) > 0 then len(list_intersect(d1, d2))::double / len(list_distinct(list_concat(d1, d2))) else 0.0 end"

ORACLE = {
    "JN-14_plan_threads": _LIVE + f", {_PLAN} select live.book, id, case when planted_chapter <> 0 then planted_chapter else planned_chapter end as chapter from live join pl using (book) where contains(text, id) or coalesce(title <> '' and contains(text, title), false)",
    "JN-15_plan_items": CUR + f", {_LATEST}, {_PLAN}, po as (select distinct book, unnest(from_json(state['possessions'], '[\"VARCHAR\"]')) as item from lat where deleted_at is null), he as (select po.book, item, row_number() over (partition by po.book order by item) as r from po join pl using (book) where length(item) >= 2 and contains(text, item)), ev as (select cur.book, chapter, unnest(plot_points) as e from cur join nw using (book) where chapter < now - 8) select he.book, item, max(chapter) as chapter from he join ev on he.book = ev.book and contains(e, item) where r <= 4 group by all",
    "JN-17_plan_terms": CUR + f", {_PLAN}{_TERMS}, un as (select * from tc where revealed_chapter is null){_some('un', 'term', 8)} select book, term, first_chapter, reveal_chapter, named, rank from rk where rank <= 8",
    "JN-17_plan_facts": CUR + f", {_PLAN}{_FACTS}{_some('fc', 'name', 12)} select book, name, value, first_chapter, updated_chapter, named, rank from rk where rank <= 12",
    "JN-18_open_setups": CUR + f", {_NW}, a as (select cur.*, now from cur join nw using (book) where chapter < now), ow as (select distinct book, chapter, s as setup from (select book, chapter, unnest(sets_up) as s from a where now - chapter >= 12) where s <> ''), tk as (select book, wh, substring(trim(regexp_replace(string_split_regex(d, '->')[1], '^\\s*第?\\s*[0-9]+\\s*章?\\s*[:：]', '')), 1, 12) as core from (select book, chapter as wh, unnest(depends_on) as d from a)) select * from ow where not exists (select 1 from tk where tk.book = ow.book and core <> '' and wh >= chapter and starts_with(setup, core))",
    "JN-06_relations_named": f"with {_LATEST}, r as (select book, id, u.i::int - 1 as pos, u.x.with_id as w, u.x.type as type from (select book, id, unnest(list_transform(relationships, lambda x, i: struct_pack(x := x, i := i))) as u from lat)) select r.book, r.id, pos, coalesce(lat.name, w) as with_name, type from r left join lat on r.book = lat.book and r.w = lat.id",
    "CP-06_organizations": f"with {_PLAN}, {_LATEST}, ca as (select book, {strip_ws_sql('regexp_replace(n, ' + chr(39) + '[（(].*$' + chr(39) + ', ' + chr(39) * 2 + ')')} as name from (select book, unnest(string_split_regex(coalesce({_field('出场角色')}, ''), '[,，、;；]')) as n from pl)), o as (select * from (select *, row_number() over (partition by book, id order by updated_at desc) as rn from organizations) where rn = 1), ac as (select o.* from o join nw using (book) where coalesce(last_chapter, 0) >= now - 15 or exists (select 1 from ca where ca.book = o.book and ca.name <> '' and contains(coalesce(o.status, '') || coalesce(to_json(o.members)::varchar, ''), ca.name))), m as (select book, id, u.i as pos, u.x.character_id as cid from (select book, id, unnest(list_transform(members, lambda x, i: struct_pack(x := x, i := i))) as u from ac) where u.x.character_id is not null), mm as (select m.book, m.id, string_agg(coalesce(lat.name, cid), ', ' order by pos) as members from m left join lat on m.book = lat.book and m.cid = lat.id group by all) select ac.book, ac.id, ac.name, ac.status, coalesce(mm.members, '') as members from ac left join mm on ac.book = mm.book and ac.id = mm.id",
    "CP-08_recent_events": CUR + f", {_NW}, e as (select cur.book, chapter, u.i::int - 1 as pos, u.x as event from (select cur.book, chapter, unnest(list_transform(plot_points, lambda x, i: struct_pack(x := x, i := i))) as u from cur join nw using (book) where chapter >= now - 2) cur where u.x is not null), r as (select *, row_number() over (partition by book order by chapter desc, pos desc)::int as rank from e) select * from r where rank <= 10",
    "CP-09_type_cards": CUR + f", {_PLAN}, p as (select book, now, trim({_field('章节类型')}) as type, trim({_field('钩子DNA')}) as hook_dna from pl), q as (select book, now, type, {_DNA} as d1 from p), l as (select book, chapter + 1 as now, {_DNA} as d2 from cur), x as (select q.*, l.d2 from q left join l using (book, now)) select book, type, {_CASE(0)} as needs, {_CASE(1)} as avoids, case when type is null then 'no_type' when type not in ({_TYPES}) then 'unknown_type' when {_J} > 0.8 then 'hook_repeats' end as warning from x",
    "TK-05_urgent": _LIVE + ", u as (select book, id, tier, deadline_chapter, deadline_chapter - now as \"left\" from live where status in ('planted', 'advanced') and deadline_chapter - now <= 3) select book, id, \"left\", row_number() over (partition by book order by coalesce(tier, 9), deadline_chapter, id)::int as rank from u",
    "TK-02_recall": _CH + f""", documents2 as (select doc_id, book, chapter, t as text, 'chapter' as doc_kind from ch), {_PLAN}, {_CHUNKS.replace('from documents where', 'from documents2 where')},
tk as (select c.book, c.chapter, chunk, length(body) as chars, {_TOK.replace('X', 'body')} as toks from ck join documents2 c using (doc_id)), st as (select book, count(*) as n, sum(len(toks)) as total from tk group by book),
q as (select book, now, unnest(list_distinct({_TOK.replace('X', 'text')})) as t from pl), e as (select book, chapter, chunk, chars, len(toks) as dl, unnest(toks) as t from tk),
tf as (select e.book, now, chapter, chunk, chars, dl, e.t, count(*) as tf from e join q on e.book = q.book and e.t = q.t group by all), df as (select book, t, count(*) as df from tf group by all),
s as (select tf.book, now, chapter, chunk, chars, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / greatest(1.0::double, total::double / n)))), 6) as score from tf join df on tf.book = df.book and tf.t = df.t join st on tf.book = st.book group by all),
k as (select *, row_number() over (partition by book order by score desc, chapter desc, chunk desc) as r from s),
f as (select *, row_number() over (partition by book order by r)::int as rank from k where r <= 20 and score >= 4 and chapter < now - 1 and chars >= 40) select book, chapter, chunk, score, rank from f where rank <= 5""",
    "LK-01_card": f"with {_LATEST}, {_OWN}, who as (select distinct book, character_id as id from own where name = '亓远'), r as (select book, id, u.i as pos, u.x.with_id as w, u.x.type as type from (select book, id, unnest(list_transform(relationships, lambda x, i: struct_pack(x := x, i := i))) as u from lat)), rr as (select r.book, r.id, string_agg(coalesce(lat.name, w) || '(' || coalesce(type, '') || ')', ';' order by pos) as relations from r left join lat on r.book = lat.book and r.w = lat.id group by all) select lat.book, lat.id, name, role, first_chapter, last_chapter, coalesce(array_to_string(list_transform(list_sort(list_filter(map_entries(state), lambda e: coalesce(e.value, '') <> '')), lambda e: e.key || ':' || e.value), ' / '), '') as state, coalesce(relations, '') as relations from lat join who on lat.book = who.book and lat.id = who.id left join rr on lat.book = rr.book and lat.id = rr.id",
    "LK-02_thread_chapters": CUR + f", e as (select *, row_number() over (partition by book, chapter order by pos) as k from {_POS.format('foreshadow_ops')} where contains(concat_ws(chr(10), x.id, x.action, x.note, x.new_item.title, x.new_item.description, x.new_item.payoff_plan), 'payoff')) select book, chapter, x.id as id, x.action as action from e where k = 1",
    "LK-03_item": CUR + f", {_LATEST}, ev as (select distinct book, chapter, e from (select book, chapter, unnest(plot_points) as e from cur) where contains(e, '铜钥匙')) select book, 'holder' as kind, null::int as chapter, id as entity from lat where len(list_filter(map_values(state), lambda v: contains(v, '铜钥匙'))) > 0 union all select book, 'event', chapter, e from ev union all select book, 'chapter', chapter, null from cur where contains(concat_ws(chr(10), summary, hook, array_to_string(plot_points, chr(10))), '铜钥匙')",
    "LK-05_term": CUR + _TERMS + " select book, term, first_chapter, case when revealed_chapter is not null then 'revealed ' || revealed_chapter when reveal_chapter is not null then 'planned ' || reveal_chapter else 'open' end as state from tc where contains(concat_ws('', term, brief, truth), '铜')",
    "LK-06_fact": CUR + _FACTS + " select book, name, value, category, first_chapter, updated_chapter from fc where contains(concat_ws(chr(10), name, value, category, note), '金额')",
}
ORACLE["LK-02_thread_cards"] = "with f as (select *, row_number() over (partition by book, id order by created_at desc) as rn from foreshadows where contains(to_json({'book': book, 'id': id, 'title': title, 'description': description, 'status': status, 'payoff_plan': payoff_plan, 'beats': beats})::varchar, 'plant')) select book, id, title, status, coalesce(array_to_string(list_transform(beats, lambda x: '第' || coalesce(x.chapter::varchar, '?') || '章' || coalesce(x.action, '') || '(' || coalesce(x.note, '') || ')'), ' → '), '') as beats from f where rn = 1"
_EVENTS = ORACLE["CP-08_recent_events"].replace("chapter >= now - 2", "true").replace("rank <= 10", "rank <= 15")
_NUM = "try_cast(regexp_extract(id, '([0-9]+)$', 1) as bigint)"
ORACLE["SK-08_state"] = f"""with {_LATEST}, og as (select * from (select *, row_number() over (partition by book, id order by updated_at desc) as rn from organizations) where rn = 1)
select book, 'characters' as section, {_NUM} as ord, concat_ws(' ', id, name, coalesce(array_to_string(list_transform(list_sort(list_filter(map_entries(state), lambda e: coalesce(e.value, '') <> '')), lambda e: e.key || ':' || e.value), ' / '), '')) as text from lat where deleted_at is null and role in ('protagonist', 'major')
union all select book, 'organizations', {_NUM}, concat_ws(' ', id, name, status) from og
union all select book, 'threads ' || bucket, rank, concat_ws(' ', id, tier, deadline_chapter) from ({_LEDGER['TK-03_thread_buckets']})
union all select book, 'rules', first_chapter, key from ({_LEDGER['LG-09_world_rules']})
union all select book, 'events', rank, concat_ws(' ', chapter, event) from ({_EVENTS})"""


def _sub(name: str) -> str:
    return f"({ORACLE[name]})"


ORACLE["CP-04_related"] = CUR + f""", {_PLAN}, {_LATEST}, {_OWN},
ca as (select distinct c.book, c.now, own.character_id as id from (select book, now, {strip_ws_sql("regexp_replace(n, '[（(].*$', '')")} as name from (select book, now, unnest(string_split_regex(coalesce({_field('出场角色')}, ''), '[,，、;；]')) as n from pl)) c join own on c.book = own.book and c.name = own.name),
h as (select book, chapter, 'thread:' || id as reason from {_sub('JN-14_plan_threads')}
  union all select ca.book, lat.last_chapter, 'absent:' || ca.id from ca join lat on ca.book = lat.book and ca.id = lat.id where deleted_at is null and ca.now - lat.last_chapter >= 12
  union all select book, chapter, 'item:' || item from {_sub('JN-15_plan_items')}
  union all select book, chapter, 'setup:' || setup from {_sub('JN-18_open_setups')}),
g as (select h.book, h.chapter, string_agg(distinct reason, ';' order by reason) as reasons from h join nw on h.book = nw.book and h.chapter < nw.now - 8 where exists (select 1 from cur where cur.book = h.book and cur.chapter = h.chapter) group by all),
k as (select *, row_number() over (partition by book order by chapter desc)::int as rank from g) select book, chapter, reasons, rank from k where rank <= 6"""
ORACLE["CP-01_pack"] = f"""with m as (
select book, 'type' as section, 0::bigint as ord, concat_ws(' | ', type, needs, avoids, warning) as text from {_sub('CP-09_type_cards')}
union all select book, 'organizations', coalesce(try_cast(regexp_extract(id, '([0-9]+)$', 1) as bigint), null), concat_ws(' ', id, name, status, members) from {_sub('CP-06_organizations')}
union all select book, 'terms', rank, concat_ws(' ', term, first_chapter) from {_sub('JN-17_plan_terms')}
union all select book, 'related', rank, concat_ws(' ', chapter, reasons) from {_sub('CP-04_related')}
union all select book, 'setups', rank, concat_ws(' ', chapter, setup) from (select *, row_number() over (partition by book order by chapter desc, setup) as rank from {_sub('JN-18_open_setups')}) where rank <= 8
union all select book, 'recall', rank, concat_ws('/', chapter, chunk) from {_sub('TK-02_recall')}
union all select book, 'events', rank, concat_ws(' ', chapter, event) from {_sub('CP-08_recent_events')})
select *, sum(length(text)) over (partition by book, section order by ord rows unbounded preceding)::bigint as used from m where text <> ''
union all select * from ({_CHECK['CP-01_context']})"""
