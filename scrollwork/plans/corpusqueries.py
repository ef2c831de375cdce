"""Queries of repetition, phrases, rules and retrieval, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import LINE_END_RE2, WS_CLASS_RE2
from scrollwork.operators import retrieval, rules, similarity
from scrollwork.plans.textqueries import _CH, _COUNTS, _n, _q, _sents, _strip, _words
from scrollwork.plans.textqueries import ORACLE as _TEXT
from scrollwork.sources.tables import table


def _two(f):  # noqa: ANN001, ANN202
    return lambda spark, d: f(table(spark, d, "documents"), table(spark, d, "characters"))


def _one(f):  # noqa: ANN001, ANN202
    return lambda spark, d: f(table(spark, d, "documents"))


def bm25_plans(spark: SparkSession, d: str, every: int = 20) -> DataFrame:
    """The chunks of all chapters for the whole texts of plans; a search's queries are the rows whose id is divisible by `every`."""
    docs = table(spark, d, "documents")
    queries = docs.where(f"doc_kind = 'plan' and text is not null and doc_id % {every} = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(retrieval.chunks(docs.where("doc_kind = 'chapter'")), queries)


#: Rules that the test tables break, so that a scan has something to find.
LIVELY = (("L001", "core", "ban", "word", "没有人应声", "-"), ("L002", "core", "ban", "word", "压低了嗓子", "-"), ("L003", "core", "ban", "regex", "(?:道|说)：“", "-"), ("L004", "core", "ban", "regex", "\\bthe \\w+ed\\b", "-"))

#: Repairs that rules may bring along, for texts of the test tables.
OPS = (("压低了嗓子", "放低了声音"), ("(?:退了)(半步)", "后退$1"))

QUERIES = {
    "AG-01_shingles": _one(lambda x: similarity.shingles(x).groupBy("book", "chapter").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("n_grams"))),
    "JN-09_repeats": _one(similarity.repeats),
    "WN-09_peaks": _one(similarity.repeat_peaks),
    "JN-09_baseline": _one(similarity.repeat_baseline),
    "JN-10_sentences": _one(similarity.repeated_sentences),
    "AG-02_catchphrases": _two(similarity.catchphrases),
    "AG-03_gestures": _two(similarity.gestures),
    "AG-04_phrases": _one(similarity.corpus_phrases),
    "TX-26_table": _one(similarity.corpus_table),
    "AG-06_baseline": _one(similarity.corpus_baseline),
    "PF-05_rule_counts": _one(rules.counts),
    "PF-06_rule_scan": _one(rules.scan),
    "PF-07_hottest": _one(rules.hottest),
    "AG-07_rule_totals": _one(rules.book_totals),
    "AG-09_calibration": _one(rules.calibration),
    "TK-06_evasions": _one(lambda x: rules.evasions(x, [*packs.BANNED, "没有人应声", "第三日清晨"])),
    "TX-27_repairs": _one(rules.repairs),
    "TX-27_repairs_with_ops": _one(lambda x: rules.repairs(x, OPS)),
    "TX-28_signature": _one(lambda x: x.where("text is not null").select("doc_id", F.md5(rules.signature(F.col("text"))).alias("signature"))),
    "SC-17_rules": lambda spark, d: rules.library(spark, "standard").select("id", "level", "mode", "kind", "pattern"),
    "WN-19_chunks": _one(lambda x: retrieval.chunks(x.where("doc_kind = 'chapter'")).select("doc_id", "chunk", F.length("body").alias("n_chars"))),
    "PF-05_library_counts": _one(lambda x: rules.counts(x, packs.LIBRARY)),
    "PF-06_scan_words": _one(lambda x: rules.scan(x, LIVELY)),
    "PF-07_hottest_words": _one(lambda x: rules.hottest(x, LIVELY)),
    "TX-20_snippets": _one(lambda x: retrieval.snippets(retrieval.chunks(x.where("doc_kind = 'chapter'")))),
    "BM25_plans": bm25_plans,
}

_GRAMS = _CH + f""", s as (select book, chapter, regexp_replace(t, '{WS_CLASS_RE2}+', '', 'g') as t from ch),
g0 as (select book, chapter, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) as gram from s where length(t) >= 3),
g as (select book, chapter, gram, count(*) as c from g0 group by all)"""
_REPEATS = _GRAMS + """, place as (select book, chapter, row_number() over (partition by book order by chapter) as place from ch),
gp as (select * from g join place using (book, chapter)), tot as (select book, chapter, place, sum(c)::bigint as total from gp group by all),
pairs as (select a.book, a.chapter, a.total, b.chapter as other from tot a join place b on a.book = b.book and b.place between a.place - 5 and a.place - 1),
inter as (select a.book, a.chapter, b.chapter as other, sum(least(a.c, b.c)) as shared from gp a join gp b on a.book = b.book and a.gram = b.gram and b.place between a.place - 5 and a.place - 1 group by all),
r as (select book, chapter, other, coalesce(shared, 0)::bigint as shared, total from pairs left join inter using (book, chapter, other))"""
_NOUN = "(select distinct book, noun from (select book, name as noun from characters union all select book, unnest(aliases) from characters) where length(noun) >= 2)"
_RUN4 = f", rn as (select book, chapter, unnest(regexp_extract_all(t, '[{packs.HAN}]+')) as run from ch), g0 as (select book, chapter, unnest(list_transform(range(1, length(run) - 2), lambda i: substring(run, i, 4))) as gram from rn where length(run) >= 4), per as (select book, chapter, gram, count(*) as c from g0 group by all), ph as (select book, gram, count(*) as df, sum(c)::bigint as total from per group by all)"
_FREE = f"not exists (select 1 from {_NOUN} nn where nn.book = ph.book and contains(ph.gram, nn.noun))"


def _occ(c: str, r: rules.Rule) -> str:
    return f"((length({c}) - length(replace({c}, {_q(r[4])}, ''))) // {len(r[4])})" if r[3] == "word" else _n(c, r[4])


def _cells(c: str, library=packs.RULES) -> str:  # noqa: ANN001
    return "[" + ", ".join(f"struct_pack(rule := {_q(r[0])}, n := {_occ(c, r)})" for r in library) + "]"


_RC = f"rc as (select doc_id, x.rule as rule, x.n::int as n from (select doc_id, unnest({_cells('text')}) as x from documents where text is not null) where x.n > 0)"
def _hits(library) -> str:  # noqa: ANN001
    return "[" + ", ".join(f"struct_pack(rule := {_q(r[0])}, hit := " + (f"case when contains(line, {_q(r[4])}) then {_q(r[4])} end" if r[3] == "word" else f"case when regexp_matches(line, {_q(r[4])}) then regexp_extract(line, {_q(r[4])}) end") + ")" for r in library if r[2] == "ban") + "]"


def _scan(library) -> str:  # noqa: ANN001
    return f"""ln as (select doc_id, u.i::int as line_no, u.x as line from (select doc_id, unnest(list_transform(string_split_regex(text, '{LINE_END_RE2}'), lambda x, i: struct_pack(x := x, i := i))) as u from documents where text is not null)),
sc as (select doc_id, line_no as line, x.rule as rule, x.hit as hit from (select doc_id, line_no, unnest({_hits(library)}) as x from ln) where x.hit is not null)"""


_SCAN = _scan(packs.RULES)
_EV = [p for p in [*packs.BANNED, "没有人应声", "第三日清晨"] if len(p) >= 3]


def _cnt(p: str) -> str:
    return f"((length(text) - length(replace(text, {_q(p)}, ''))) // {len(p)})"


def _repaired(c: str) -> str:
    """The repairs in RE2: what look-around would leave in place is put back, twice, as neighbours may be shared."""
    for half, full in packs.HALFWIDTH.items():
        for _ in range(2):
            c = f"regexp_replace({c}, '([{packs.HAN}])[{half}]([{packs.HAN}])', '\\1{full}\\2', 'g')"
    for mark in "！？。，、；":
        c = f"regexp_replace({c}, '{mark}{mark}+', '{mark}', 'g')"
    return c


_FIXED = f"regexp_replace(replace({_repaired('text')}, '压低了嗓子', '放低了声音'), '(?:退了)(半步)', '后退\\1', 'g')"
_SIG = f"regexp_replace({{}}, '[^{packs.HAN} A-Za-z0-9]', '', 'g')"
_TABLE = (
    _COUNTS + ", st as (select * from (" + _TEXT["AG-05_sentences"] + ") where n_sent >= 20), rh as (select * from (" + _TEXT["WN-02_rhythm"] + """) where n_para >= 20),
j as (select dd.source, c.*, st.median, rh.n_para, rh.n_one, rh.n_short20 from documents dd join c using (doc_id) left join st using (doc_id) left join rh using (doc_id) where dd.source is not null),
a as (select source, sum(words)::double as words, median(median)::double as sentence_median, sum(n_one)::double / sum(n_para) as one_ratio, sum(n_short20)::double / sum(n_para) as short20_ratio, (sum(n_ellipsis) * 1000)::double / sum(words) as ellipsis, (sum(n_excl) * 1000)::double / sum(words) as excl from j group by source),
tb as (select source, measure, value from (unpivot a on words, sentence_median, one_ratio, short20_ratio, ellipsis, excl into name measure value value) where value is not null)"""
)
_TOK = f"list_concat(list_transform(regexp_extract_all(X, '[A-Za-z0-9]+'), lambda w: lower(w)), flatten(list_transform(regexp_extract_all(X, '[{packs.HAN}]+'), lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)), list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))))"
_CHUNKS = f"""pa as (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\\A[ \\t]*#[^\\n]*(?:\\n|\\z)', ''), '\\n[\\s\\x{{0b}}]*\\n'), lambda p: {_strip('p')}), lambda p: p <> '') as ps from documents where doc_kind = 'chapter' and text is not null),
fold as (select doc_id, list_reduce(list_transform(ps, lambda p: struct_pack(done := []::varchar[], buf := p)), lambda a, p: case when length(a.buf) + length(p.buf) > 300 then struct_pack(done := list_append(a.done, a.buf), buf := p.buf) else struct_pack(done := a.done, buf := a.buf || chr(10) || p.buf) end) as f from pa where len(ps) > 0),
ck as (select doc_id, u.i::int - 1 as chunk, u.x as body from (select doc_id, unnest(list_transform(list_append(f.done, f.buf), lambda x, i: struct_pack(x := x, i := i))) as u from fold))"""

ORACLE = {
    "AG-01_shingles": _GRAMS + " select book, chapter, count(*) as n_distinct, sum(c)::bigint as n_grams from g group by all",
    "JN-09_repeats": _REPEATS + " select * from r",
    "WN-09_peaks": _REPEATS + ", m as (select *, shared::double / total as share from r) select book, chapter, arg_max(other, (share, other)) as other, max(share) as share from m group by all",
    "JN-09_baseline": _REPEATS + ", m as (select *, shared::double / total as share from r), k as (select *, row_number() over (partition by book order by share, chapter, other) as i, count(*) over (partition by book) as n from m) select book, n as n_pairs, share as median, greatest(0.15::double, 1.8::double * share) as threshold from k where i = n // 2 + 1",
    "JN-10_sentences": _CH + f""", s as (select book, chapter, unnest(list_distinct({_sents("regexp_replace(t, '(?m)^#.*$', '', 'g')", 12)})) as sentence from ch),
l as (select *, lag(chapter) over (partition by book, sentence order by chapter) as latest from s) select * from l where latest is not null""",
    "AG-02_catchphrases": _CH + _RUN4 + f", n as (select book, count(*) as n from ch group by book), k as (select ph.book, gram, df, row_number() over (partition by ph.book order by df desc, gram) as rank from ph join n using (book) where df >= greatest(3, n // 3) and {_FREE}) select * from k where rank <= 12",
    "AG-03_gestures": _CH + _RUN4 + f" select book, gram, df, total, total > 8 as over from ph where regexp_matches(gram, {_q(packs.GESTURE)}) and df >= 3 and total >= 6 and {_FREE}",
    "AG-04_phrases": f"with rn as (select source, unnest(regexp_extract_all(text, '[{packs.HAN}]+')) as run from documents where source is not null), g0 as (select source, unnest(list_transform(range(1, length(run) - 2), lambda i: substring(run, i, 4))) as gram from rn where length(run) >= 4), g as (select source, gram, count(*) as n from g0 group by all having count(*) >= 3), k as (select *, row_number() over (partition by source order by n desc, gram) as rank from g) select * from k where rank <= 20",
    "TX-26_table": _TABLE + " select * from tb",
    "AG-06_baseline": _TABLE + " select measure, case when count(*) >= greatest(1, (select count(distinct source) from documents) // 2) then median(value) end as median from tb group by measure",
    "PF-05_rule_counts": f"with {_RC} select * from rc",
    "PF-06_rule_scan": f"with {_SCAN} select * from sc",
    "PF-07_hottest": f"with {_SCAN} select rule, count(*) as n from sc group by rule order by n desc, rule limit 8",
    "PF-05_library_counts": f"select doc_id, x.rule as rule, x.n::int as n from (select doc_id, unnest({_cells('text', packs.LIBRARY)}) as x from documents where text is not null) where x.n > 0",
    "PF-06_scan_words": f"with {_scan(LIVELY)} select * from sc",
    "PF-07_hottest_words": f"with {_scan(LIVELY)} select rule, count(*) as n from sc group by rule order by n desc, rule limit 8",
    "TX-20_snippets": f"with {_CHUNKS} select doc_id, chunk, substring({_strip("regexp_replace(body, '[\\s\\x{0b}]+', ' ', 'g')")}, 1, 150) as snippet from ck",
    "AG-07_rule_totals": f"with {_RC} select book, rule, sum(n)::bigint as total, count(*) as n_docs, max(n) as most from rc join documents using (doc_id) where book is not null group by book, rule",
    "AG-09_calibration": f"""with {_RC}, t as (select doc_id, text, case doc_kind when 'chapter' then 'own' else 'ref' end as side from documents where text is not null and doc_kind in ('chapter', 'sample')),
sz as (select side, count(*) as docs, sum({_words('text')}) as words from t group by side), h as (select rule, side, count(*) as hd, sum(n) as tot from rc join t using (doc_id) group by all),
grid as (select * from sz, (select unnest([{', '.join(_q(r[0]) for r in packs.RULES)}]) as rule)),
x as (select rule, max(docs) filter (where side = 'own') as od, max(words) filter (where side = 'own') as ow, max(words) filter (where side = 'ref') as rw, max(coalesce(hd, 0)) filter (where side = 'own') as oh, max(coalesce(tot, 0)) filter (where side = 'own') as ot, max(coalesce(tot, 0)) filter (where side = 'ref') as rt from grid left join h using (rule, side) group by rule),
y as (select *, (ot * 1000)::double / ow as density, (rt * 1000)::double / rw as ref_density from x)
select rule, oh as hit_docs, od as n_docs, ot::bigint as total, density, ref_density, case when coalesce(od, 0) < 3 then 'too_few' when ot = 0 then 'silent' when coalesce(rw, 0) >= 3000 and ref_density >= density then 'habit_of_the_genre' when oh * 2 >= od then 'everywhere' when oh * 10 < od then 'rare' else 'useful' end as verdict from y""",
    "TK-06_evasions": "with c as (" + " union all ".join(f"select doc_id, {_q(p)} as phrase, {_cnt(p)} as own, list_max([" + ", ".join(f"struct_pack(n := {_cnt(p[i:i + 2])}, o := {-i}, pair := {_q(p[i:i + 2])})" for i in range(len(p) - 1)) + "]) as best from documents where text is not null" for p in _EV) + ") select doc_id, phrase, best.pair as pair, best.n::int as n from c where best.n >= 3 and best.n > own * 3",
    "TX-28_signature": f"select doc_id, md5(regexp_replace(text, '[^{packs.HAN} A-Za-z0-9]', '', 'g')) as signature from documents where text is not null",
    "TX-27_repairs": f"select doc_id, new as text, {_SIG.format('old')} = {_SIG.format('new')} as same_prose from (select doc_id, {_repaired('text')} as new, text as old from documents where text is not null) where old <> new",
    "TX-27_repairs_with_ops": f"select doc_id, new as text, {_SIG.format('old')} = {_SIG.format('new')} as same_prose from (select doc_id, {_FIXED} as new, text as old from documents where text is not null) where old <> new",
    "SC-17_rules": "select * from (values " + ", ".join("(" + ", ".join(_q(x) for x in r[:5]) + ")" for r in packs.LIBRARY if packs.LEVELS[r[1]] <= 2) + ") t(id, level, mode, kind, pattern)",
    "WN-19_chunks": f"with {_CHUNKS} select doc_id, chunk, length(body) as n_chars from ck",
    "BM25_plans": f"""with {_CHUNKS}, tk as (select doc_id, chunk, {_TOK.replace('X', 'body')} as toks from ck), st as (select count(*) as n, sum(len(toks)) as sum_dl from tk),
q as (select doc_id as query_id, unnest(list_distinct({_TOK.replace('X', 'text')})) as t from documents where doc_kind = 'plan' and text is not null and doc_id % 20 = 0),
e as (select doc_id, chunk, len(toks) as dl, unnest(toks) as t from tk), tf as (select t, doc_id, chunk, dl, count(*) as tf from e group by all), df as (select t, count(*) as df from tf group by t),
s as (select query_id, doc_id, chunk, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / greatest(1.0::double, sum_dl::double / n)))), 6) as score from q join df using (t) join tf using (t), st group by all),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id desc, chunk desc) as rank from s) select * from k where rank <= 8""",
}
