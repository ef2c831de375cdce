"""Queries of the checks, lookups and context packs, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import LINE_END_RE2, strip_ws_sql
from scrollwork.operators import checks, intake, lookup
from scrollwork.plans.ledgerqueries import _DNA, _LATEST, _LIVE, CUR
from scrollwork.plans.ledgerqueries import ORACLE as _L
from scrollwork.plans.problems import ORACLE as _P
from scrollwork.plans.textqueries import _CH, _words
from scrollwork.plans.textqueries import ORACLE as _T
from scrollwork.sources.tables import table

_NAMES = ("books", "analysis", "characters", "organizations", "foreshadows", "documents")


def _group(name: str):  # noqa: ANN202
    return lambda spark, d: checks.violations({t: table(spark, d, t) for t in _NAMES}, name)


def _q(f, *names):  # noqa: ANN001, ANN002, ANN202
    return lambda spark, d: f(*(table(spark, d, n) for n in names))


def edit_guard(spark: SparkSession, d: str) -> DataFrame:
    """Every version of each chapter against the one before it."""
    docs = table(spark, d, "documents")
    v = intake.versions(docs).where("before_id is not null")
    texts = docs.where("text is not null").select("doc_id", "text")
    before = v.select(F.col("doc_id").alias("after"), F.col("before_id").alias("doc_id")).join(texts, "doc_id").select(F.col("after").alias("doc_id"), "text")
    return checks.edit_guard(before, texts.join(v.select("doc_id"), "doc_id", "left_semi"))


def tampered(spark: SparkSession, d: str) -> DataFrame:
    """Chapters whose last version differs from the first, as if that had been final: (doc_id, code), doc_id being the first's."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    v = intake.versions(table(spark, d, "documents")).groupBy("book", "chapter").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("doc_id")).where("first <> doc_id")
    locked = docs.join(v.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("sha"))
    return checks.tampered(locked, docs.join(v, "doc_id").select(F.col("first").alias("doc_id"), "text"))


QUERIES = {f"CHK_{g}": _group(g) for g in checks.GROUPS} | {
    "PF-15_edit_guard": edit_guard,
    "JN-21_tampered": tampered,
    "LK-07_keyword": _q(lambda a: lookup.keyword(a, "旧账本"), "analysis"),
    "LK-04_location": _q(lambda a: lookup.location(a, "寒鸦渡"), "analysis"),
    "LK-01_character": _q(lambda a, c: lookup.character(a, c, "亓远"), "analysis", "characters"),
    "LK-02_threads": _q(lambda f: lookup.serialized(f.select("book", "id", "title", "status"), "abandoned", "book", "id"), "foreshadows"),
    "LK-08_recent": _q(lookup.recent, "analysis"),
    "CP-04_related": _q(lookup.related, "analysis", "foreshadows", "books", "documents", "characters"),
    "CP-01_context": _q(lookup.context, "analysis", "characters", "foreshadows", "books"),
    "CP-01_pack": _q(lookup.pack, "analysis", "characters", "foreshadows", "books", "organizations", "documents"),
    "LG-20_next_action": _q(lookup.next_action, "books", "documents", "analysis"),
    "CP-02_budget": _q(lambda b: b.where("current_chapter is not null").select("book", lookup.budget(F.col("current_chapter")).alias("budget")), "books"),
}


def _sql(text: str, name: str) -> str:
    return f"{name} as ({text})"


def _tests(src: str, severity: str, tests: list[tuple[str, str]], entity: str = "null", chapter: str = "chapter") -> str:
    codes = ", ".join(f"case when {c} then '{k}' end" for k, c in tests)
    return f"select '{severity}' as severity, unnest(list_filter([{codes}], lambda z: z is not null)) as code, book, cast({entity} as varchar) as entity, cast({chapter} as int) as chapter from {src}"


def _row(src: str, severity: str, code: str, entity: str = "null", chapter: str = "chapter") -> str:
    return f"select '{severity}' as severity, {code} as code, book, cast({entity} as varchar) as entity, cast({chapter} as int) as chapter from {src}"


_TYPES = ", ".join(f"'{x}'" for x in packs.CHAPTER_TYPES)
_NOW = "(select book, max(current_chapter) as now from books group by book)"
_EMPTY = "coalesce(len({}), 0) = 0"
_BAN = " or ".join([f"contains(t, '{p}')" for p in packs.BANNED] + [f"regexp_matches(t, '{p}')" for p in packs.BANNED_PATTERNS])


def _field(name: str) -> str:
    return f"nullif(regexp_extract(text, '(?m)^[ \\t]*(?:[-*+][ \\t]+)?\\*{{0,2}}{name}\\*{{0,2}}[ \\t]*[:：][ \\t]*([^\\n\\r]*)', 1), '')"


ORACLE = {
    "CHK_reconcile": _CH + f""", dn as (select distinct book, unnest(completed_chapters) as chapter from books), an as (select distinct book, chapter from analysis where chapter is not null),
pe as (select book, chapter from ch where exists (select 1 from books b where b.book = ch.book) and not exists (select 1 from dn where dn.book = ch.book and dn.chapter = ch.chapter)),
gp as (select book, chapter + 1 as f, n - 1 as t from (select *, lead(chapter) over (partition by book order by chapter) as n from dn) where n > chapter + 1)
{_row('dn', 'E', "'completed_without_text'")} where not exists (select 1 from ch where ch.book = dn.book and ch.chapter = dn.chapter)
union all {_row('dn', 'E', "'completed_without_analysis'")} where not exists (select 1 from an where an.book = dn.book and an.chapter = dn.chapter)
union all {_row('pe', 'W', "'pending_unapplied'")} where not exists (select 1 from an where an.book = pe.book and an.chapter = pe.chapter)
union all {_row('pe', 'W', "'pending_rewrite'")} where exists (select 1 from an where an.book = pe.book and an.chapter = pe.chapter)
union all {_row('gp', 'W', "'chapter_gap'", "f || '-' || t", 'f')}""",
    "CHK_chapter_texts": _CH + f", b as (select book, max(words_per_chapter.min) as lo, max(words_per_chapter.max) as hi from books group by book), x as (select ch.*, lo, hi, {_words('t')} as n, string_split_regex(t, '{LINE_END_RE2}')[1] as f from ch left join b using (book)) {_tests('x', 'E', [('bad_title_line', 'not starts_with(f, chr(35))'), ('too_short', 'n < lo * 0.85')])} union all {_tests('x', 'W', [('too_long', 'n > hi * 1.5'), ('blacklist_hit', _BAN)])}",
    "CHK_analyses": CUR + f", c2 as (select *, {_DNA} as d from cur) " + _tests("c2", "E", [("no_summary", "coalesce(trim(summary), '') = ''"), ("bad_type", f"type not in ({_TYPES})"), ("bad_conflict", "conflict not between 1 and 5"), ("bad_dna", "hook_dna is not null and len(d) < 2")]) + " union all " + _tests("c2", "W", [("missing_type", "type is null"), ("contract_clue", f"type = '线索' and {_EMPTY.format('foreshadow_ops')} and {_EMPTY.format('terms')}"), ("contract_relation", f"type = '关系' and {_EMPTY.format('relationships')}"), ("contract_cost", f"type = '代价' and {_EMPTY.format('costs')}"), ("contract_climax", "type = '高潮' and coalesce(conflict, 0) < 4"), ("contract_advance", f"type = '推进' and {_EMPTY.format('plot_points')}")]),
    "CHK_plans": CUR + f", p as (select book, chapter, arg_max(text, doc_id) as text from documents where doc_kind = 'plan' and book is not null and chapter is not null and text is not null group by all), x as (select p.book, p.chapter, trim({_field('章节类型')}) as pt, regexp_extract(coalesce({_field('冲突值')}, ''), '(?:^|[^0-9])([1-5])(?:[^0-9]|$)', 1) as pc, type, conflict from p join cur using (book, chapter)) " + _tests("x", "W", [("plan_type_unknown", f"pt not in ({_TYPES})"), ("plan_type_diff", "pt <> type"), ("plan_conflict_diff", "pc <> '' and pc <> conflict::varchar")]),
    "CHK_threads": _LIVE + ", " + _sql(_L["LG-08_thread_faults"], "ft") + ", " + _sql(_L["AG-12_duplicates"], "dup") + ", " + _sql(_L["AG-11_tiers"], "tr") + f", tn as (select tr.*, now from tr join {_NOW} using (book)) "
    + _tests("live", "E", [("thread_bad_tier", "tier not between 1 and 3"), ("thread_bad_scope", "scope is not null and scope not in ('book', 'arc', 'chapter')"), ("thread_bad_spacing", "min_payoff_spacing < 1")], "id", "null")
    + " union all " + _tests("live", "W", [("plan_missed", "status = 'planned' and planned_chapter < now"), ("overdue", "status in ('planted', 'advanced') and deadline_chapter < now"), ("due_soon", "status in ('planted', 'advanced') and deadline_chapter - now between 0 and 3"), ("stale", "status in ('planted', 'advanced') and now - last_touched > case tier when 1 then 35 when 2 then 12 when 3 then 4 else 15 end"), ("cross_volume_tier", "cross_volume and coalesce(tier, 0) <> 1"), ("missing_fp", "coalesce(fp, '') = ''")], "id", "null")
    + " union all " + _row("ft", "E", "code", "thread") + " where code <> 'beat_after_close' union all " + _row("ft", "W", "code", "thread") + " where code = 'beat_after_close' union all " + _row("dup", "E", "'duplicate_fp'", "ids", "null")
    + " union all " + _tests("tn", "W", [("too_many_t1", "active_t1 > 5"), ("no_t1", "now > 10 and active_t1 = 0")], "null", "null"),
    "CHK_people": "with " + _sql(_P["p4_found"], "fd") + f", m as (select distinct table_name, book, holder_id, ref_id from fd where status = 'missing'), {_LATEST}, ah as (select lat.* from lat join {_NOW} using (book) where last_chapter > now) " + _row("m", "E", "case table_name when 'characters' then 'relation_orphan' when 'organizations' then 'member_orphan' else 'thread_orphan' end", "holder_id || '>' || ref_id", "null") + " union all " + _row("ah", "W", "'last_chapter_ahead'", "id", "last_chapter"),
    "CHK_terms": "with " + _sql(_L["LG-10_terms"], "tm") + f", x as (select tm.*, now from tm left join {_NOW} using (book)) " + _row("x", "E", "'term_reveal_before_first'", "term", "first_chapter") + " where reveal_chapter < first_chapter union all " + _row("x", "W", "'term_overdue'", "term", "reveal_chapter") + " where reveal_chapter <= now and revealed_chapter is null",
    "CHK_term_entries": CUR + f", x as (select book, chapter, unnest(terms) as x from cur), n as (select book, {strip_ws_sql('x.term')} as key, min(chapter) as fc from x where {strip_ws_sql('x.term')} <> '' group by all having count(*) > 1) " + _row("x", "E", "'term_missing'") + " where trim(coalesce(x.term, '')) = '' union all " + _row("n", "E", "'term_duplicate'", "key", "fc"),
    "PF-15_edit_guard": f"""with d as (select distinct book, chapter, doc_id, text as t from documents where doc_kind = 'chapter' and book is not null and chapter is not null and text is not null),
l as (select doc_id, {_words('t')} as n, list_filter(string_split_regex(t, '{LINE_END_RE2}'), lambda x: trim(x) <> '') as ls from d),
m as (select doc_id, n, len(list_filter(ls, lambda x: regexp_matches(x, '[“「"]'))) as d, len(ls) as p, starts_with(coalesce(ls[1], ''), '#') as h from l),
v as (select doc_id, lag(doc_id) over (partition by book, chapter order by doc_id) as before_id from d),
x as (select v.doc_id, list_filter([case when a.n = 0 then 'empty' end, case when a.n between 1 and 79 then 'under_80' end, case when b.h and not a.h then 'title_lost' end, case when b.n >= 400 and a.n < b.n * 0.6 then 'text_lost' end, case when b.d >= 4 and a.d < b.d * 0.4 then 'dialogue_lost' end, case when b.p >= 6 and a.p < b.p * 0.5 then 'paragraphs_lost' end], lambda z: z is not null) as c
  from v join m a on v.doc_id = a.doc_id join m b on v.before_id = b.doc_id) select doc_id, unnest(c) as code from x""",
    "JN-21_tampered": "with v as (select book, chapter, min(doc_id) as a, max(doc_id) as b from documents where doc_kind = 'chapter' and book is not null and chapter is not null and text is not null group by all having min(doc_id) <> max(doc_id)), t as (select distinct doc_id, text from documents) select a as doc_id, 'final_tampered' as code from v join t x on x.doc_id = a join t y on y.doc_id = b where x.text <> y.text",
    "CHK_pacing": "with " + ", ".join(_sql(s, n) for n, s in (("ug", _L["JN-11_unpaid_gains"]), ("gs", _L["WN-13_gain_only"]), ("ts", _L["WN-10_type_streaks"]), ("nc", _L["WN-11_no_climax"]), ("cr", _L["WN-12_conflict_runs"]), ("sf", _T["WN-15_side_flips"]))) + " " + " union all ".join([_row("ug", "W", "'gain_without_cost'", "name"), _row("gs", "W", "'free_ride'"), _row("ts", "W", "'type_streak'", "type"), _row("nc", "W", "'no_climax_10'"), _row("cr", "W", "code"), _row("sf", "W", "'side_flip'", "part")]),
    "CHK_reviews": "with x as (select book, doc_id, chapter, text, len(regexp_extract_all(text, '\\[必须修改\\]')) as must, try_cast(nullif(regexp_extract(text, '得分[ \\t]*[:：][ \\t]*([0-9]{1,3})', 1), '') as int) as score, len(regexp_extract_all(text, '[「“]([^」”]{12,})[」”]')) as quotes from documents where doc_kind = 'review' and book is not null and text is not null) " + _tests("x", "W", [("review_few_must", "must < 2"), ("review_98", "score >= 98"), ("review_quotes", "must > 0 and quotes < must"), ("review_hollow", "regexp_matches(text, '写得(很)?棒|完全符合要求|无可挑剔')")], "doc_id") + " union all " + _tests("x", "E", [("review_anchor", "score > 90 and must < 2")], "doc_id"),
    "LK-07_keyword": CUR + ", h as (select book, chapter, 'summary' as reason from cur where contains(summary, '旧账本') union select book, chapter, 'hook' from cur where contains(hook, '旧账本') union select book, chapter, 'title' from cur where contains(title, '旧账本') union select book, chapter, 'fact' from cur where len(list_filter(facts, lambda x: coalesce(contains(x.name, '旧账本'), false) or coalesce(contains(x.value, '旧账本'), false))) > 0) select book, chapter, string_agg(reason, ',' order by reason) as reasons from h group by all",
    "LK-04_location": CUR + " select book, chapter, 'location' as reason from cur where contains(location, '寒鸦渡') or (location is null and contains(summary, '寒鸦渡'))",
    "LK-01_character": CUR + ", own as (select book, name, min(id) as character_id from (select book, id, name from characters union select book, id, unnest(aliases) from characters) where name is not null group by book, name having count(distinct id) = 1), nm as (select book, name from own where (book, character_id) in (select (book, character_id) from own where name = '亓远')) select distinct book, chapter, 'character' as reason from (select book, chapter, unnest(characters) as c from cur) x where exists (select 1 from nm where nm.book = x.book and nm.name = x.c.name)",
    "LK-02_threads": "select book, id from foreshadows where contains(to_json({'book': book, 'id': id, 'title': title, 'status': status})::varchar, 'abandoned')",
    "LK-08_recent": CUR + ", r as (select *, row_number() over (partition by book order by chapter desc) as k from cur) select book, chapter, title from r where k <= 3",
    "LG-20_next_action": _CH + ", b as (select book, max(current_chapter) as chapter from books group by book having max(current_chapter) is not null), x as (select b.*, exists (select 1 from documents p where p.doc_kind = 'plan' and p.text is not null and p.book = b.book and p.chapter = b.chapter) as pl, exists (select 1 from ch where ch.book = b.book and ch.chapter = b.chapter) as wr, exists (select 1 from documents p where p.doc_kind = 'review' and p.text is not null and p.book = b.book and p.chapter = b.chapter) as rv, exists (select 1 from analysis a where a.book = b.book and a.chapter = b.chapter) as an from b) select book, chapter, case when not pl and not wr then 'plan' when not wr then 'write' when not an then 'analyse' when not rv then 'review' else 'go_on' end as action from x",
    "CP-02_budget": "select book, least(16000, 8000 + greatest(0, current_chapter - 80) * 50) as budget from books where current_chapter is not null",
    "CP-01_context": CUR + f""", nw as (select * from {_NOW} where now is not null), a as (select cur.*, now from cur join nw using (book) where chapter < now), {_LATEST},
sk as (select book, chapter, title, substring(coalesce(summary, ''), 1, 120) as s, greatest(0.3::double, least(16000, 8000 + greatest(0, now - 80) * 50) / 8000.0::double) as scale from a where chapter % 10 = 0 and chapter > 0),
sl as (select *, '第 ' || chapter || ' 章《' || coalesce(title, '') || '》:' || s || '…' as line from sk),
sr as (select *, sum({_words('line')}) over (partition by book) > floor(scale * 1600) and row_number() over (partition by book order by chapter desc) > greatest(5, least(10, floor(scale * 5))) as far from sl),
sg as (select book, (chapter - 1) // 50 as g, max(chapter) as top, string_agg({strip_ws_sql("case when s <> '' then substring(s, 1, 24) else coalesce(title, '') end")} || case when length(s) > 24 then '…' else '' end, '、' order by chapter) as told, string_agg(chapter, ',' order by chapter) as nos from sr where far group by all),
s as (select book, 'recent' as section, (-chapter)::bigint as ord, summary as text from a where summary <> '' and chapter >= now - 3
  union all select book, 'skeleton', (-chapter)::bigint, line from sr where not far
  union all select book, 'skeleton', (-top)::bigint, '第 ' || (g * 50 + 1)::bigint || '-' || ((g + 1) * 50)::bigint || ' 章:' || case when {_words('told')} > 150 then substring(told, 1, 150) || '…' else told end || '(章号 ' || nos || ')' from sg
  union all select lat.book, 'cast', regexp_extract(id, '([0-9]+)$', 1)::bigint, concat_ws(' ', id, name, role) from lat join nw using (book) where deleted_at is null and (role in ('protagonist', 'major') or last_chapter >= now - 5)
  union all select book, 'rules', (chapter * 100 + u.i - 1)::bigint, u.x.rule from (select book, chapter, unnest(list_transform(world_facts, lambda x, i: struct_pack(x := x, i := i))) as u from a)
  union all select book, 'facts', (-(chapter * 100 + u.i - 1))::bigint, concat_ws('=', u.x.name, u.x.value) from (select book, chapter, unnest(list_transform(facts, lambda x, i: struct_pack(x := x, i := i))) as u from a)
  union all select book, 'threads', row_number() over (partition by book order by bucket, rank), concat_ws(' ', bucket, id) from ({_L['TK-03_thread_buckets']}) where bucket <> 'later'),
f as (select s.book, section, ord, text, sum(length(text)) over (partition by s.book, section order by ord rows unbounded preceding) as used, floor(case section when 'cast' then 2200 when 'rules' then 1200 when 'facts' then 700 when 'threads' then 1800 end * greatest(0.3::double, least(16000, 8000 + greatest(0, now - 80) * 50) / 8000.0::double)) as cap from s join nw using (book) where text <> '')
select book, section, ord, text, used::bigint as used from f where used <= cap or cap is null or used = length(text)""",
}
