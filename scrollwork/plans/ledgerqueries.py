"""Queries of the ledger and their SQL twins."""

from __future__ import annotations

from scrollwork.functions.text import DNA_SPLIT_RE2, FP_DROP, strip_ws_sql
from scrollwork.operators import ledger as l
from scrollwork.sources.tables import table


def _q(f, *names):  # noqa: ANN001, ANN002, ANN202
    return lambda spark, d: f(*(table(spark, d, n) for n in names))


_A, _AC, _FB = ("analysis",), ("analysis", "characters"), ("foreshadows", "books")
QUERIES = {
    "LG-03_state_events": _q(l.state_events, *_AC),
    "LG-15_replay": _q(l.replay, *_AC),
    "LG-15_replay_at_20": _q(lambda a, c: l.replay(a, c, 20), *_AC),
    "LG-15_replay_from_snapshot": _q(lambda a, c, s: l.replay(a, c, base=l.snapshot_state(s)), "analysis", "characters", "snapshots"),
    "JN-13_snapshot_at": _q(l.snapshot_at, "snapshots", "books"),
    "JN-05_drift": _q(l.drift, *_AC),
    "LG-04_relations": _q(l.relations, *_AC),
    "LG-05_memberships": _q(l.memberships, *_A),
    "LG-06_thread_status": _q(l.thread_status, *_A),
    "LG-08_thread_faults": _q(l.thread_faults, *_A),
    "TK-03_thread_buckets": _q(l.thread_buckets, *_FB),
    "AG-11_tiers": _q(l.tier_counts, *_FB),
    "AG-12_duplicates": _q(l.duplicate_fingerprints, "foreshadows"),
    "LG-09_world_rules": _q(lambda a: l.first_of(a, "world_facts", "rule"), *_A),
    "LG-10_terms": _q(l.terms, *_A),
    "LG-11_fact_revisions": _q(l.fact_revisions, *_A),
    "LG-12_gains": _q(lambda a: l.items(a, "gains"), *_A),
    "JN-11_unpaid_gains": _q(l.unpaid_gains, *_A),
    "AG-16_last_mentions": _q(l.last_mentions, *_AC),
    "next_id": _q(l.next_ids, "characters"),
    "WN-10_type_streaks": _q(l.type_streaks, *_A),
    "WN-11_no_climax": _q(l.no_climax, *_A),
    "WN-12_conflict_runs": _q(l.conflict_runs, *_A),
    "WN-13_gain_only": _q(l.gain_only_streaks, *_A),
    "WN-14_gaps": _q(l.gaps, *_A),
    "WN-14_snapshot_gaps": _q(l.gaps, "snapshots"),
    "WN-18_tension": _q(l.tension_lines, *_A),
    "JN-08_hook_overlap": _q(l.hook_overlap, *_A),
    "AG-15_types": _q(l.type_counts, *_A),
    "AG-18_digest": _q(l.digest, *_A),
    "AG-17_progress": _q(l.progress, "books"),
}

CUR = "with cur as (select * from (select *, row_number() over (partition by book, chapter order by submitted_at desc, analysis_id desc) as rn from analysis where book is not null and chapter is not null) where rn = 1)"
_OWN = "own as (select book, name, min(id) as character_id from (select book, id, name from characters union select book, id, unnest(aliases) from characters) where name is not null group by book, name having count(distinct id) = 1)"
_EV = CUR + f", {_OWN}, ce as (select book, chapter, u.i::int - 1 as pos, u.x as c from (select book, chapter, unnest(list_transform(characters, lambda x, i: struct_pack(x := x, i := i))) as u from cur)), ev as (select book, character_id, chapter, pos, kv.key as state_key, kv.value as value from (select book, c.name as name, chapter, pos, unnest(map_entries(c.updates)) as kv from ce) join own using (book, name))"


def _last(where: str = "true", src: str = "ev") -> str:
    return f"(select book, character_id, state_key, value, chapter from (select *, row_number() over (partition by book, character_id, state_key order by chapter desc, pos desc) as k from {src} where {where}) where k = 1)"


_BEATS = CUR + f", beats as (select book, upper({strip_ws_sql('u.x.id')}) as thread, chapter, u.i::int - 1 as pos, u.x.action as action from (select book, chapter, unnest(list_transform(foreshadow_ops, lambda x, i: struct_pack(x := x, i := i))) as u from cur) where upper({strip_ws_sql('u.x.id')}) <> '')"
_LIVE = "with f as (select * from (select *, row_number() over (partition by book, id order by created_at desc) as rn from foreshadows where deleted_at is null) where rn = 1), live as (select f.*, b.now from f join (select book, max(current_chapter) as now from books group by book) b using (book))"
_LATEST = "lat as (select * from (select *, row_number() over (partition by book, id order by updated_at desc) as rn from characters) where rn = 1)"


def _items(kind: str) -> str:
    return f"""(select book, chapter, u.i::int - 1 as pos, case when starts_with(u.x, '{{') then coalesce(u.x::json ->> 'name', u.x::json ->> 'event') else u.x end as name, case when starts_with(u.x, '{{') then u.x::json ->> 'type' end as type,
case when starts_with(u.x, '{{') then coalesce((u.x::json ->> 'major')::boolean, (u.x::json ->> 'type') in ('breakthrough', 'power', 'treasure'), false) else false end as major
from (select book, chapter, unnest(list_transform({kind}, lambda x, i: struct_pack(x := x, i := i))) as u from cur) where u.x is not null)"""


_DNA = f"(case when len(list_distinct(list_filter(string_split_regex(coalesce(hook_dna, ''), '{DNA_SPLIT_RE2}'), lambda x: length(x) >= 2))) = 0 and length({strip_ws_sql(chr(39) * 2 + ' || coalesce(hook_dna, ' + chr(39) * 2 + ')')}) >= 2 then [{strip_ws_sql(chr(39) * 2 + ' || coalesce(hook_dna, ' + chr(39) * 2 + ')')}] else list_distinct(list_filter(string_split_regex(coalesce(hook_dna, ''), '{DNA_SPLIT_RE2}'), lambda x: length(x) >= 2)) end)"
_FP = "regexp_replace(lower(" + strip_ws_sql("coalesce(title, '')") + "), '" + FP_DROP.replace("'", "''") + "', '', 'g')"

ORACLE = {
    "LG-03_state_events": _EV + " select * from ev",
    "LG-15_replay": _EV + f" select * from {_last()}",
    "LG-15_replay_at_20": _EV + f" select * from {_last('chapter <= 20')}",
    "LG-15_replay_from_snapshot": _EV + f""", sn as (select book, chapter, c.id as character_id, c.state as st from (select book, chapter, unnest(characters) as c from (select *, row_number() over (partition by book order by chapter desc, taken_at desc) as rn from snapshots) where rn = 1)),
bs as (select book, character_id, chapter, -1 as pos, kv.key as state_key, kv.value as value from (select book, character_id, chapter, unnest(map_entries(st)) as kv from sn)), mx as (select book, max(chapter) as m from bs group by book),
al as (select ev.* from ev left join mx using (book) where m is null or chapter > m union all select * from bs) select * from {_last(src='al')}""",
    "JN-13_snapshot_at": "select book, chapter, snapshot_id, coalesce(len(characters), 0) as n_characters from (select s.*, row_number() over (partition by s.book order by chapter desc, taken_at desc) as rn from snapshots s join (select distinct book, current_chapter from books) b using (book) where chapter <= coalesce(current_chapter, chapter)) where rn = 1",
    "JN-05_drift": _EV + f", {_LATEST}, e as (select book, character_id, state_key, value as expected, true as e from {_last()}), a as (select book, id as character_id, kv.key as state_key, kv.value as actual, true as a from (select book, id, unnest(map_entries(state)) as kv from lat)) select book, character_id, state_key, expected, actual, case when a is null then 'only_replay' when e is null then 'only_ledger' else 'differs' end as kind from e full outer join a using (book, character_id, state_key) where expected is distinct from actual",
    "LG-04_relations": CUR + f", {_OWN}, r as (select book, chapter, u.i as pos, u.x.a as a, u.x.b as b, u.x.type as type, u.x.note as note from (select book, chapter, unnest(list_transform(relationships, lambda x, i: struct_pack(x := x, i := i))) as u from cur)), e as (select r.*, o.character_id as ida, p.character_id as idb from r join own o on r.book = o.book and r.a = o.name join own p on r.book = p.book and r.b = p.name where o.character_id <> p.character_id), bo as (select book, ida as character_id, idb as with_id, chapter, pos, type, note from e union all select book, idb, ida, chapter, pos, type, note from e) select book, character_id, with_id, arg_max(type, (chapter, pos)) filter (where type is not null) as type, arg_max(note, (chapter, pos)) filter (where note is not null) as note, max(chapter) as as_of_chapter from bo group by all",
    "LG-05_memberships": CUR + ", o as (select book, chapter, u.i as i, u.x as o from (select book, chapter, unnest(list_transform(organizations, lambda x, i: struct_pack(x := x, i := i))) as u from cur)), m as (select book, o.name as organization, chapter, i, u.i as j, u.x.character as character, u.x.role as role, u.x.action as action from (select book, o, chapter, i, unnest(list_transform(o.members, lambda x, i: struct_pack(x := x, i := i))) as u from o)), g as (select book, organization, character, arg_max(coalesce(action, 'join'), (chapter, i, j)) as action, arg_max(role, (chapter, i, j)) filter (where role is not null) as role, min(chapter) as since_chapter from m where character is not null and organization is not null group by all) select book, organization, character, role, since_chapter from g where action not in ('leave', '离开', '退出')",
    "LG-06_thread_status": _BEATS + " select book, thread, case when bool_or(action = 'payoff') then 'resolved' when bool_or(action = 'abandon') then 'abandoned' when bool_or(action in ('advance', 'setback')) then 'advanced' when bool_or(action = 'plant') then 'planted' else 'planned' end as status, min(case when action = 'plant' then chapter end) as planted_chapter, max(chapter) as last_touched, count(*) as n_beats from beats group by all",
    "LG-08_thread_faults": _BEATS + ", s as (select *, coalesce(max((action = 'payoff')::int) over w, 0) as paid, coalesce(max((action = 'plant')::int) over w, 0) as planted, coalesce(max((action in ('payoff', 'abandon'))::int) over w, 0) as closed from beats window w as (partition by book, thread order by chapter, pos rows between unbounded preceding and 1 preceding)), c as (select *, case when action is null or action not in ('plant', 'advance', 'setback', 'payoff', 'abandon') then 'beat_bad_action' when action = 'payoff' and paid = 1 then 'double_payoff' when action <> 'plant' and planted = 0 then 'beat_before_plant' when action in ('advance', 'setback') and closed = 1 then 'beat_after_close' end as code from s) select book, thread, chapter, pos, code from c where code is not null",
    "TK-03_thread_buckets": _LIVE + ", b as (select *, case when status = 'planned' and planned_chapter < now then 'missed' when status = 'planned' and planned_chapter = now then 'plant_now' when deadline_chapter - now <= 3 then 'must' when deadline_chapter - now <= 10 then 'soon' else 'later' end as bucket from live where status in ('planned', 'planted', 'advanced') and now is not null) select book, bucket, row_number() over (partition by book, bucket order by coalesce(tier, 9), coalesce(deadline_chapter, 9999), id) as rank, id, tier, deadline_chapter from b",
    "AG-11_tiers": _LIVE + " select book, count(*) filter (where tier = 1) as t1, count(*) filter (where tier = 2) as t2, count(*) filter (where tier = 3) as t3, count(*) filter (where tier is null) as untiered, count(*) filter (where tier = 1 and status in ('planted', 'advanced')) as active_t1 from live group by book",
    "AG-12_duplicates": f"with f as (select distinct book, id, case when {_FP} = '' then '' else substring(sha1({_FP}), 1, 10) end as fp from foreshadows where deleted_at is null) select book, fp, string_agg(id, ',' order by id) as ids, count(*) as n from f where fp <> '' group by book, fp having count(*) > 1",
    "LG-09_world_rules": CUR + f" select book, {strip_ws_sql('x.rule')} as key, min(chapter) as first_chapter, count(*) as n from (select book, chapter, unnest(world_facts) as x from cur) where {strip_ws_sql('x.rule')} <> '' group by all",
    "LG-10_terms": CUR + ", t as (select book, x.term as term, min(chapter) as first_chapter, arg_min(struct_pack(r := x.reveal_chapter), chapter).r as reveal_chapter from (select book, chapter, unnest(terms) as x from cur) where x.term <> '' group by all), r as (select book, term, min(chapter) as revealed_chapter from (select book, chapter, unnest(revealed_terms) as term from cur) group by all) select * from t left join r using (book, term)",
    "LG-11_fact_revisions": CUR + ", e as (select book, chapter, u.i as pos, u.x.name as name, u.x.value as value from (select book, chapter, unnest(list_transform(facts, lambda x, i: struct_pack(x := x, i := i))) as u from cur) where u.x.name <> '' and u.x.value is not null), g as (select *, lag(value) over (partition by book, name order by chapter, pos) as before from e) select book, name, chapter, before, value from g where before is null or before <> value",
    "LG-12_gains": CUR + f" select * from {_items('gains')}",
    "JN-11_unpaid_gains": CUR + f" select book, chapter, pos, name from {_items('gains')} g where major and not exists (select 1 from {_items('costs')} c where c.book = g.book and c.chapter between g.chapter and g.chapter + 5)",
    "AG-16_last_mentions": CUR + f", {_OWN}, n as (select book, chapter, unnest(list_concat(list_transform(coalesce(characters, []), lambda x: x.name), list_concat(list_transform(coalesce(relationships, []), lambda x: x.a), list_transform(coalesce(relationships, []), lambda x: x.b)))) as name from cur) select book, character_id, max(chapter) as last_chapter from n join own using (book, name) group by all",
    "next_id": "select book, printf('C-%03d', coalesce(max(try_cast(regexp_extract(id, '^C-([0-9]+)$', 1) as int)), 0) + 1) as next_id from characters group by book",
    "WN-10_type_streaks": CUR + ", s as (select *, lead(chapter, 2) over w as n2, lead(type, 1) over w as t1, lead(type, 2) over w as t2 from cur window w as (partition by book order by chapter)) select book, min(chapter) as chapter, arg_min(type, chapter) as type from s where type in ('过渡', '关系', '线索') and t1 = type and t2 = type and n2 = chapter + 2 group by book",
    "WN-11_no_climax": CUR + ", s as (select book, chapter, count(*) over w as n, count(*) filter (where type = '高潮') over w as k, row_number() over (partition by book order by chapter desc) as r from cur window w as (partition by book order by chapter range between 9 preceding and current row)) select book, chapter from s where r = 1 and n = 10 and k = 0",
    "WN-12_conflict_runs": CUR + ", c as (select * from cur where conflict between 1 and 5), s as (select book, chapter, count(*) over h as n3, min(conflict) over h as m3, count(*) over l as n5, max(conflict) over l as m5 from c window h as (partition by book order by chapter range between current row and 2 following), l as (partition by book order by chapter range between current row and 4 following)) select book, min(chapter) as chapter, 'conflict_fatigue' as code from s where n3 = 3 and m3 >= 4 group by book union all select book, min(chapter), 'conflict_slump' from s where n5 = 5 and m5 <= 2 group by book",
    "WN-13_gain_only": CUR + ", g as (select book, chapter, lag(chapter) over (partition by book order by chapter) as b from cur where len(gains) > 0 and coalesce(len(costs), 0) = 0) select book, chapter from g where chapter = b + 1",
    "WN-14_gaps": "with c as (select distinct book, chapter from analysis where chapter is not null), n as (select *, lead(chapter) over (partition by book order by chapter) as n from c) select book, chapter + 1 as from_chapter, n - 1 as to_chapter from n where n > chapter + 1",
    "WN-14_snapshot_gaps": "with c as (select distinct book, chapter from snapshots where chapter is not null), n as (select *, lead(chapter) over (partition by book order by chapter) as n from c) select book, chapter + 1 as from_chapter, n - 1 as to_chapter from n where n > chapter + 1",
    "WN-18_tension": CUR + ", c as (select book, chapter, substring('▁▂▃▄▅', conflict, 1) as b, row_number() over (partition by book order by chapter desc) as r from cur where conflict between 1 and 5) select book, string_agg(b, '' order by chapter) as line from c where r <= 10 group by book",
    "JN-08_hook_overlap": CUR + f", d as (select book, chapter, {_DNA} as d from cur), p as (select *, lag(d) over w as p, lag(chapter) over w as pc from d window w as (partition by book order by chapter)) select book, chapter, case when len(d) > 0 and len(p) > 0 then len(list_intersect(d, p))::double / len(list_distinct(list_concat(d, p))) else 0.0::double end as overlap from p where pc = chapter - 1",
    "AG-15_types": CUR + " select book, type, count(*) as n from cur group by all",
    "AG-18_digest": CUR + " select book, ((chapter - 1) // 50)::int as bucket, substring(string_agg(substring(summary, 1, 24), '、' order by chapter), 1, 150) as digest from cur where summary <> '' group by all",
    "AG-17_progress": "select book, coalesce(len(completed_chapters), 0) as n_completed, coalesce(list_sum(map_values(chapter_word_counts)), 0)::bigint as words, case when len(map_keys(chapter_word_counts)) > 0 then (list_sum(map_values(chapter_word_counts)) // len(map_keys(chapter_word_counts)))::bigint else 0 end as mean_words from books",
}
