"""Queries of the text statistics and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import LINE_END_RE2, WS_CLASS_RE2
from scrollwork.operators import metrics as m
from scrollwork.sources.tables import table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS_CLASS_RE2}+|{WS_CLASS_RE2}+$', '', 'g')"


def _words(c: str) -> str:
    return f"length(regexp_replace({c}, '{WS_CLASS_RE2}+', '', 'g'))"


def _n(c: str, p: str) -> str:
    return f"len(regexp_extract_all({c}, {_q(p)}))"


_NARR = f"regexp_replace(regexp_replace(t, {_q(packs.SPEECH)}, '', 'g'), '(?m)^#.*$', '', 'g')"


def _sents(c: str, least: int = 2) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, {_q(packs.SENTENCE_END)}), lambda x: {_strip('x')}), lambda x: length(x) >= {least})"


_D = "with d as (select doc_id, coalesce(text, '') as t from documents)"
_CH = """with ch as (
  select book, chapter, arg_max(text, doc_id) as t, max(doc_id) as doc_id from documents
  where doc_kind = 'chapter' and book is not null and chapter is not null and text is not null group by book, chapter)"""
_LINES = f"""(select doc_id, u.i as no, {_strip("u.x")} as line from (
  select doc_id, unnest(list_transform(string_split_regex(t, '{LINE_END_RE2}'), lambda x, i: struct_pack(x := x, i := i))) as u from d))"""
_P = f"{_D}, p as (select doc_id, cast(no as int) as no, line, row_number() over (partition by doc_id order by no) as pos from {_LINES} where line <> '' and not starts_with(line, '#'))"


def _ends(p: str) -> str:
    return f"len(list_filter(list_transform(regexp_extract_all(t, {_q(p)}, 1), lambda b: {_strip('b')}), lambda b: length(b) >= 3 and not regexp_matches(replace(b, '、', ''), {_q(packs.NOISE)})))"


_COUNTS = (
    f"{_D}, dn as (select *, {_NARR} as narr from d), c as (select doc_id, {_words('t')} as words, {_words('narr')} as narr_words, "
    + ", ".join(f"{_n('t', p)} as n_{k}" for k, p in packs.COUNTS.items())
    + ", "
    + ", ".join(f"{_n('narr', p)} as n_{k}" for k, p in packs.NARRATION_COUNTS.items())
    + f", {_ends(packs.DASH_END)} as n_cut_off, {_ends(packs.ELLIPSIS_END)} as n_trailing from dn)"
)
_FLAGS = ", ".join(
    [f"case when n_{k} * 1000 > {v} * words then '{k}' end" for k, v in packs.DENSITY_LIMITS.items()]
    + [f"case when n_{k} > {v} then '{k}' end" for k, v in packs.COUNT_LIMITS.items()]
    + [f"case when n_{k} * 1000 > {v} * words then '{k}' end" for k, v in packs.NARRATION_LIMITS.items()]
    + ["case when n_punct_repeat > 0 then 'punct_repeat' end", "case when n_halfwidth > 0 then 'halfwidth' end", "case when n_mechanism > 0 then 'mechanism' end", "case when (n_hearing + n_smell + n_taste + n_touch) * 1000 < words then 'few_senses' end"]
)
_FRAME = f"""select *, case when f is null then 'empty' when regexp_matches(f, '^[“「『]') or regexp_matches(substring(f, 1, 6), '[“「"]') then 'speech'
    when regexp_matches(f, {_q(packs.OPEN_TIME)}) then 'time' else 'other' end as opening,
  case when e is null then 'empty' when regexp_matches(e, '[”」』"]$') then 'speech' when regexp_matches(e, '[？?]$') then 'question' when e like '%…' then 'ellipsis'
    when regexp_matches(e, {_q(packs.COUNTS['theme'])}) or regexp_matches(e, {_q(packs.COUNTS['emotion'])}) then 'summary' else 'other' end as closing"""
_ACT, _TENSE = packs.NARRATION_COUNTS["action"], packs.NARRATION_COUNTS["tension"]
_BODY = f"regexp_replace(regexp_replace(line, {_q(packs.SPEECH)}, '', 'g'), '[\\s\\x{{0b}}\\x{{3000}}]', '', 'g')"
_BEATS = f"""{_P}, b0 as (select doc_id, no, regexp_replace(line, {_q(packs.SPEECH)}, '', 'g') as narr from p),
b1 as (select doc_id, no, narr, {_words('narr')} as chars, {_sents('narr')} as s from b0),
b2 as (select *, list_transform(s, lambda x: {_words('x')} < {packs.SHORT}) as sh from b1 where len(s) >= 3),
b3 as (select *, list_max(list_transform(string_split(array_to_string(list_transform(sh, lambda x: case when x then '1' else '0' end), ''), '0'), lambda x: length(x))) as best,
  array_to_string(list_transform(sh, lambda x: case when x then '1' else '0' end), '') as bits,
  regexp_extract_all(narr, {_q(_ACT)}) as acts, len(list_distinct(regexp_extract_all(narr, {_q(_TENSE)}))) as n_tension from b2),
b4 as (select *, len(list_filter(sh, lambda x: x)) as n_short, len(list_filter(acts, lambda w: len(list_filter(acts, lambda v: v = w)) >= 2)) as n_action,
  case when best > 0 then list_slice(s, instr(bits, repeat('1', best)), instr(bits, repeat('1', best)) + best - 1) else [] end as win from b3),
b5 as (select *, case when n_action >= 3 then 'action' when n_tension >= 3 then 'tension' else 'plain' end as scene,
  list_filter([case when len(list_filter(win, lambda x: regexp_matches(x, {_q(_ACT + '|' + _TENSE)}))) > 0 then 'act' end, case when len(list_filter(win, lambda x: regexp_matches(x, {_q(packs.FEEL)}))) > 0 then 'feel' end,
    case when len(list_filter(win, lambda x: regexp_matches(x, {_q(packs.JUDGE)}))) > 0 then 'judge' end, case when len(list_filter(win, lambda x: regexp_matches(x, {_q(packs.SUM_UP)}))) > 0 then 'sum' end], lambda x: x is not null) as functions from b4),
pile as (select * from b5 where chars >= 20 and len(s) >= 5 and best >= 5 and n_short * 4 >= len(s) * 3),
pm as (select *, case when no - lag(no) over w <= 2 and scene = lag(scene) over w then 0 else 1 end as fresh from pile window w as (partition by doc_id order by no)),
pg as (select *, sum(fresh) over (partition by doc_id order by no) as g from pm),
runs as (select doc_id, min(no) as first_line, max(no) as last_line, any_value(scene) as scene, sum(len(s)) as n_sent, sum(n_short) as n_short, sum(n_action) as n_action, max(n_tension) as n_tension from pg group by doc_id, g)"""
_PARTS = ("手", "臂", "肩", "腿", "眼")

ORACLE = {
    "TX-01": f"{_D} select doc_id, {_words('t')} as words from d",
    "TX-02_densities": _COUNTS + " select doc_id, words, " + ", ".join([f"case when words > 0 then n_{k} * 1000 / words else 0.0 end::double as {k}" for k in packs.DENSITY_LIMITS] + [f"case when narr_words > 0 then n_{k} * 1000 / narr_words else 0.0 end::double as {k}" for k in (*packs.NARRATION_LIMITS, "action", "tension")]) + " from c",
    "TX-03_counts": _COUNTS + " select * from c",
    "AG-21_flags": _COUNTS + f" select doc_id, unnest(list_filter([{_FLAGS}], lambda x: x is not null)) as flag from c where words > 0",
    "AG-05_sentences": f"""{_D}, s as (select doc_id, {_sents(_NARR)} as s from d),
n as (select doc_id, list_transform(s, lambda x: {_words('x')}) as n, list_transform(s, lambda x: {_n('x', '[，,]')}) as c from s where len(s) > 0),
a as (select doc_id, len(n) as k, list_sum(n)::bigint as total, list_sum(list_transform(n, lambda x: x * x))::bigint as sq, n, c from n)
select doc_id, k as n_sent, total, list_sort(n)[k // 2 + 1] as median, sqrt((k * sq - total * total)::double / (k * k)) as deviation, len(list_filter(n, lambda x: x < {packs.SHORT})) as n_short, list_max(n) as longest, list_max(c) as comma_max from a""",
    "WN-02_rhythm": f"""{_P}, o as (select *, len({_sents('line')}) <= 1 as one from p),
i as (select *, pos - row_number() over (partition by doc_id, one order by pos) as g from o),
r as (select doc_id, count(*) as n, min(no) as no from i where one group by doc_id, g),
best as (select doc_id, max(n) as longest_run, arg_min(no, (-n, no)) as run_line from r group by doc_id),
a as (select doc_id, count(*) as n_para, count(*) filter (where one) as n_one, count(*) filter (where length(line) <= 20) as n_short20 from o group by doc_id)
select doc_id, n_para, n_one, coalesce(longest_run, 0) as longest_run, coalesce(run_line, 0) as run_line, n_short20, {_words('t')} as words from a join d using (doc_id) left join best using (doc_id)""",
    "WN-01_starts": f"""{_D}, h as (select doc_id, no, substring(line, 1, 2) as head from {_LINES} where line <> ''),
m as (select *, row_number() over (partition by doc_id order by no) - row_number() over (partition by doc_id, head order by no) as g from h),
r as (select doc_id, head, count(*) as run, min(no) as no from m group by doc_id, head, g)
select doc_id, max(run) as run, arg_min(head, (-run, no)) as head from r group by doc_id""",
    "WN-03_exposition": f"""{_P}, h as (select *, {_BODY} as body from p),
x as (select *, pos - row_number() over (partition by doc_id order by pos) as g from h where length(body) >= 12 and not regexp_matches(body, {_q(packs.EXPO_ACTION)}) and (regexp_matches(body, {_q(packs.EXPO_TERM)}) or {_n('body', packs.EXPO_CONNECTOR)} >= 2))
select doc_id, min(no) as first_line, max(no) as last_line, count(*) as n_para, substring(arg_min(line, no), 1, 34) as sample from x group by doc_id, g having count(*) >= 2""",
    "WN-04_short_runs": _BEATS + " select * from runs",
    "WN-05_emphasis": _BEATS + " select doc_id, no as line, best as run, array_to_string(functions, ',') as functions, scene from b5 where chars >= 12 and best >= 3 and len(functions) >= 3 and not exists (select 1 from runs r where r.doc_id = b5.doc_id and r.scene = 'plain' and b5.no between r.first_line and r.last_line)",
    "WN-07_frames": f"{_P}, e as (select d.doc_id, arg_min(line, no) as f, arg_max(line, no) as e from d left join p using (doc_id) group by d.doc_id) select doc_id, opening, closing from ({_FRAME} from e)",
    "WN-07_frame_runs": _CH + f""", d as (select doc_id, t from ch), p as (select doc_id, no, line from {_LINES} where line <> '' and not starts_with(line, '#')),
e as (select book, chapter, arg_min(line, no) as f, arg_max(line, no) as e from ch left join p using (doc_id) group by book, chapter),
k as ({_FRAME} from e), x as (select book, chapter, 'opening' as side, opening as kind from k union all select book, chapter, 'closing', closing from k),
g as (select *, row_number() over (partition by book, side order by chapter) - row_number() over (partition by book, side, kind order by chapter) as g from x)
select book, side, kind, min(chapter) as first_chapter, max(chapter) as last_chapter, count(*) as n_chapters from g where kind not in ('other', 'empty') group by book, side, kind, g having count(*) >= 3""",
    "WN-08_quota": _CH + f""", q as (select book, chapter, {_ends(packs.DASH_END)} + {_n('t', packs.COUNTS['interrupt'])} as b, {_n('t', packs.COUNTS['setback'])} as s from ch),
w as (select book, chapter, count(*) over w as n, sum(b) over w as b, sum(s) over w as s from q window w as (partition by book order by chapter rows between 2 preceding and current row))
select book, chapter from w where n = 3 and b = 0 and s = 0""",
    "WN-15_side_flips": _CH + ", x as (" + " union all ".join(f"select book, chapter, '{p}' as part, {_n('t', f'左.{{0,1}}{p}')} as l, {_n('t', f'右.{{0,1}}{p}')} as r from ch" for p in _PARTS) + """),
s as (select book, part, chapter, case when l > r then 'left' else 'right' end as side from x where l <> r),
b as (select *, lag(side) over (partition by book, part order by chapter) as before from s) select book, part, chapter, before, side from b where before <> side""",
    "AG-14_duplicates": f"""{_D}, s as (select doc_id, unnest({_sents("regexp_replace(t, '(?m)^#.*$', '', 'g')", 12)}) as sentence from d)
select doc_id, sentence, count(*) as n from s group by all having count(*) >= 2""",
    "WN-16_gap": f"""{_D}, s as (select doc_id, {_words('t')} as words, list_transform(string_split_regex(t, '[“「"『]'), lambda x: length(x)) as l from d)
select doc_id, len(l) - 1 as n_quotes, case when len(l) >= 3 then list_max(list_slice(l, 2, len(l) - 1)) + 1 else words end as gap from s""",
    "TX-23_endings": f"""{_P}, e as (select doc_id, {_strip(f"regexp_replace(arg_max(line, no), {_q(packs.SPEECH)}, '', 'g')")} as ending from p group by doc_id)
select * from e where length(ending) between 4 and 40 and regexp_matches(ending, {_q(packs.APHORISM)})""",
    "AG-10_voices": f"""with d as (select doc_id, book, regexp_extract_all(text, {_q('([^”」]{0,20})' + packs.QUOTE)}, 1) as a, regexp_extract_all(text, {_q('([^”」]{0,20})' + packs.QUOTE)}, 2) as b from documents where book is not null and text is not null),
q as (select doc_id, book, unnest(range(1, len(a) + 1)) as pos, unnest(a) as pre, unnest(b) as said from d),
nm as (select distinct book, name from (select book, name from characters union all select book, unnest(aliases) from characters) where length(name) between 2 and 4),
h as (select doc_id, q.book, pos, said, min(name) as speaker, count(*) as n from q join nm on q.book = nm.book and contains(pre, name) group by all having count(*) = 1)
select book, speaker, count(*) as n_lines, sum(length(said)) as n_chars, sum({_n('said', '[！!]')}) as n_excl, sum({_n('said', packs.LITERARY)}) as n_literary, sum({_n('said', packs.COLLOQUIAL)}) as n_colloquial from h group by all having count(*) >= 8""",
}


ORACLE["TX-24_scenes"] = f"{_D}, s as (select doc_id, string_split(t, '没有人应声') as p from d), n as (select doc_id, p, unnest(range(1, len(p))) as no from s) select doc_id, no::int as no, '没有人应声' as hit, right(array_to_string(p[1:no], '没有人应声'), 12) || '没有人应声' || left(array_to_string(p[no + 1:], '没有人应声'), 16) as excerpt from n"
ORACLE["WN-07_frame_pairs"] = ORACLE["WN-07_frame_runs"].replace("count(*) >= 3", "count(*) >= 1")


def _docs(f):  # noqa: ANN001, ANN202
    return lambda spark, d: f(table(spark, d, "documents"))


def voices(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "characters")
    names = c.select("book", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return m.voices(table(spark, d, "documents"), names)


QUERIES = {
    "TX-01": _docs(lambda x: m.counts(x).select("doc_id", "words")),
    "TX-02_densities": _docs(m.densities),
    "TX-03_counts": _docs(m.counts),
    "AG-21_flags": _docs(m.flags),
    "AG-05_sentences": _docs(m.sentence_stats),
    "WN-02_rhythm": _docs(m.paragraph_rhythm),
    "WN-01_starts": _docs(m.start_runs),
    "WN-03_exposition": _docs(m.exposition_runs),
    "WN-04_short_runs": _docs(m.short_runs),
    "WN-05_emphasis": _docs(m.emphasis_runs),
    "WN-07_frames": _docs(m.frames),
    "WN-07_frame_runs": _docs(m.frame_runs),
    "WN-07_frame_pairs": _docs(lambda x: m.frame_runs(x, 1)),
    "WN-08_quota": _docs(m.quota_windows),
    "WN-15_side_flips": _docs(m.side_flips),
    "AG-14_duplicates": _docs(m.duplicate_sentences),
    "WN-16_gap": _docs(m.dialogue_gap),
    "TX-23_endings": _docs(m.endings),
    "TX-24_scenes": _docs(lambda x: m.scenes(x, "没有人应声")),
    "TX-24_care": _docs(lambda x: m.scenes(x, packs.CARE)),
    "AG-10_voices": voices,
}
