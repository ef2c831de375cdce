"""The queries of the general problems and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrollwork.functions.text import strip_ws_sql
from scrollwork.operators import history, knowntime, references
from scrollwork.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    v = history.versions(table(spark, d, "snapshots"), table(spark, d, "characters"))
    return v.select("book", "character_id", "state_key", "from_chapter", "to_chapter")


def p2_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Location and condition side by side, split at the union of their boundaries."""
    v = history.versions(table(spark, d, "snapshots"), table(spark, d, "characters"))
    return history.combined(v, ["book", "character_id"], ["location", "condition"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return references.found(*(table(spark, d, t) for t in ("analysis", "characters", "organizations", "foreshadows")))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(*(table(spark, d, t) for t in ("analysis", "characters", "organizations", "foreshadows")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return knowntime.snapshots_as_known(table(spark, d, "analysis"), table(spark, d, "characters"), table(spark, d, "snapshots"))


_P2 = """
with latest as (
  select book, chapter, arg_max(characters, taken_at) as cs from snapshots where chapter is not null group by book, chapter),
seen as (
  select book, chapter, c.id as character_id, c.state as state
  from (select book, chapter, unnest(cs) as c from latest) where c.id is not null),
ledger as (
  select book, id as character_id, arg_max(struct_pack(lc := last_chapter, st := state), updated_at) as r
  from characters where id is not null group by book, id),
last_seen as (select book, character_id, max(chapter) as m from seen group by book, character_id),
obs as (
  select book, character_id, chapter, state from seen
  union all
  select l.book, l.character_id, l.r.lc, l.r.st from ledger l left join last_seen s using (book, character_id)
  where l.r.lc is not null and (s.m is null or l.r.lc > s.m)),
ordered as (
  select *, row_number() over w as rn, lead(chapter) over w as nxt from obs
  window w as (partition by book, character_id order by chapter)),
kv as (
  select book, character_id, chapter, nxt, rn, e.key as state_key, e.value as v
  from (select book, character_id, chapter, nxt, rn, unnest(map_entries(state)) as e from ordered) where e.value is not null),
marked as (
  select *, case when lag(rn) over w = rn - 1 and lag(v) over w = v then 0 else 1 end as fresh from kv
  window w as (partition by book, character_id, state_key order by chapter)),
island as (
  select *, sum(fresh) over (partition by book, character_id, state_key order by chapter) as g from marked),
vs as (
  select book, character_id, state_key, any_value(v) as value, cast(min(chapter) as int) as from_chapter,
         cast(coalesce(arg_max(coalesce(nxt, 0), chapter), 0) as int) as to_chapter
  from island group by book, character_id, state_key, g)
"""

ORACLE = {
    "p2_found": _P2 + "select book, character_id, state_key, from_chapter, to_chapter from vs",
    "p2_timeline": _P2 + """,
cut as (
  select distinct book, character_id, f as from_chapter from (
    select book, character_id, unnest([from_chapter, to_chapter]) as f from vs where state_key in ('location', 'condition')) where f > 0),
seg as (
  select *, coalesce(lead(from_chapter) over (partition by book, character_id order by from_chapter), 0) as to_chapter from cut)
select s.book, s.character_id, s.from_chapter, s.to_chapter,
  '{' || string_agg(to_json(v.state_key)::varchar || ':' || to_json(v.value)::varchar, ',' order by v.state_key) || '}' as state
from seg s join vs v on s.book = v.book and s.character_id = v.character_id and v.state_key in ('location', 'condition')
  and v.from_chapter <= s.from_chapter and (v.to_chapter = 0 or v.to_chapter > s.from_chapter)
group by all""",
}

_P4 = f"""
with refs as (
  select 'analysis' as table_name, 'f' as target, book, cast(analysis_id as varchar) as holder_id, x.id as raw, submitted_at as tm
  from (select book, analysis_id, submitted_at, unnest(foreshadow_ops) as x from analysis)
  union all
  select 'characters', 'c', book, id, x.with_id, updated_at from (select book, id, updated_at, unnest(relationships) as x from characters)
  union all
  select 'organizations', 'c', book, id, x.character_id, updated_at from (select book, id, updated_at, unnest(members) as x from organizations)),
clean as (select *, upper({strip_ws_sql('raw')}) as ref_id from refs where raw is not null),
parents as (
  select 'c' as target, book, id as ref_id, arg_max(struct_pack(c := created_at, d := deleted_at), updated_at) as r from characters group by book, id
  union all
  select 'f', book, id, arg_max(struct_pack(c := created_at, d := deleted_at), created_at) from foreshadows group by book, id),
found as (
  select distinct table_name, book, holder_id, ref_id,
    case when p.r is null then 'missing' when p.r.c > tm then 'late' when p.r.d <= tm then 'deleted' end as status,
    strftime(tm, '%Y-%m') as period
  from clean left join parents p using (target, book, ref_id) where ref_id <> '')
"""
ORACLE["p4_found"] = _P4 + "select * from found where status is not null"
ORACLE["p4_report"] = _P4 + "select table_name, status, period, count(*) as n_refs, count(distinct (book, ref_id)) as n_keys from found where status is not null group by all"
ORACLE["p5_found"] = """
with names as (
  select book, id, name from characters where name is not null
  union select book, id, unnest(aliases) from characters),
owner as (select book, name, min(id) as character_id from names where name is not null group by book, name having count(distinct id) = 1),
said as (
  select distinct analysis_id, book, chapter, submitted_at, x.name as name
  from (select analysis_id, book, chapter, submitted_at, unnest(characters) as x from analysis)),
m as (select distinct analysis_id, book, chapter, submitted_at, character_id from said join owner using (book, name)),
held as (select distinct book, chapter, taken_at, snapshot_id, x.id as character_id from (select book, chapter, taken_at, snapshot_id, unnest(characters) as x from snapshots))
select analysis_id, character_id, snapshot_id from (
  select m.analysis_id, m.character_id, h.snapshot_id,
    row_number() over (partition by m.analysis_id, m.character_id order by h.chapter desc, h.taken_at desc, h.snapshot_id desc) as rn
  from m join held h on m.book = h.book and m.character_id = h.character_id and h.chapter < m.chapter and h.taken_at <= m.submitted_at)
where rn = 1"""

QUERIES = {"p2_found": p2_found, "p2_timeline": p2_timeline, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found}
