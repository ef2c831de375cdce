"""Queries of corpus measures, rankings and roll-ups, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import LINE_END_RE2
from scrollwork.operators import corpus as c
from scrollwork.operators import ledger, rules, similarity
from scrollwork.plans.corpusqueries import _GRAMS
from scrollwork.plans.corpusqueries import ORACLE as _C
from scrollwork.plans.ledgerqueries import CUR
from scrollwork.plans.textqueries import _CH, _COUNTS, _D, _FLAGS, _q, _strip, _words
from scrollwork.plans.textqueries import ORACLE as _T
from scrollwork.sources.tables import table


def _one(f):  # noqa: ANN001, ANN202
    return lambda spark, d: f(table(spark, d, "documents"))


def missing_types(spark: SparkSession, d: str) -> DataFrame:
    """Chapters without a type, a row per book with the first six: (book, n, chapters)."""
    a = ledger.current(table(spark, d, "analysis"), "type").where("type is null")
    n = a.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    first = a.withColumn("r", F.row_number().over(Window.partitionBy("book").orderBy("chapter"))).where("r <= 6")
    first = first.groupBy("book").agg(F.array_join(F.array_sort(F.collect_list("chapter")).cast("array<string>"), ",").alias("chapters"))
    return n.join(first, "book")


def nouns(spark: SparkSession, d: str) -> DataFrame:
    """Proper nouns of a book, of two or more characters: names and aliases of characters, names of organizations, terms."""
    ch = table(spark, d, "characters").select("book", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("noun"))
    org = table(spark, d, "organizations").select("book", F.col("name").alias("noun"))
    terms = table(spark, d, "analysis").select("book", F.explode("terms.term").alias("noun"))
    return ch.unionByName(org).unionByName(terms).where(F.length("noun") >= 2).distinct()


def rule_groups(spark: SparkSession, d: str) -> DataFrame:
    """The rule library as a manual: per level and mode the number of rules and their ids."""
    return rules.library(spark).groupBy("level", "mode").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


def ranks(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's orders by price: rank, dense rank, quartile and percent rank."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return o.select("o_custkey", "o_orderkey", F.rank().over(p).alias("rank"), F.dense_rank().over(p).alias("dense"), F.ntile(4).over(w).alias("quartile"), F.percent_rank().over(p).alias("percent"))


def cube(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status and priority with all subtotals; `level` tells which columns a row sums over."""
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status and by priority, each alone, in one pass."""
    o = table(spark, d, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))


def approximate(spark: SparkSession, d: str) -> DataFrame:
    """Users per event type by a sketch, and whether it is within a tenth of the exact number."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("n"))
    return g.select("event_type", "n", (F.abs(F.col("a") - F.col("n")) <= F.col("n") * 0.1).alias("near"))


QUERIES = {
    "TX-21_chapters": _one(lambda x: c.split_chapters(x).select("doc_id", "no", "title", F.length("body").alias("n_chars"))),
    "TX-25_speech": _one(c.speech_and_ending),
    "TX-26_measures": _one(c.measures),
    "SC-20_anchors": _one(lambda x: c.anchors(similarity.corpus_baseline(x))),
    "AG-08_extremes": _one(c.extremes),
    "TX-32_verdicts": _one(c.verdicts),
    "TX-29_samples": _one(c.shared_samples),
    "SC-15_sections": _one(lambda x: c.section_lines(x.where("doc_kind = 'plan'"))),
    "AG-19_missing_types": missing_types,
    "SC-16_nouns": nouns,
    "RU-02_rule_groups": rule_groups,
    "WN-20_ranks": ranks,
    "AG-22_cube": cube,
    "AG-22_grouping_sets": grouping_sets,
    "AG-22_approximate": approximate,
}

_HEAD = packs.CHAPTER_HEAD
_LAST = f"coalesce(list_filter(list_transform(string_split_regex(t, '{LINE_END_RE2}'), lambda x: {_strip('x')}), lambda x: x <> '')[-1], '')"
_SPEECH = f"{_D}, sp as (select doc_id, {_words('t')} as words, coalesce(list_sum(list_transform(regexp_extract_all(t, {_q(packs.SPEECH)}), lambda x: length(x))), 0)::int as speech, regexp_matches({_LAST}, '[」”]') as ends_in_speech, length({_LAST}) between 1 and 20 as ends_short from d)"
_N = "count(*) filter (where doc_kind = 'chapter')"

ORACLE = {
    "TX-21_chapters": f"""with h as (select doc_id, regexp_extract_all(text, {_q('(?m)' + _HEAD)}) as heads, string_split_regex(text, {_q('(?m)' + _HEAD)}) as parts from documents where text is not null),
x as (select doc_id, unnest(range(1, len(heads) + 1)) as no, heads, parts from h where len(heads) >= 2) select doc_id, no::int as no, {_strip("regexp_replace(" + _strip('heads[no]') + ", '^#+', '')")} as title, length(parts[no + 1]) as n_chars from x""",
    "TX-25_speech": _SPEECH + " select * from sp",
    "TX-26_measures": _SPEECH.replace(_D, _COUNTS) + ", st as (select * from (" + _T["AG-05_sentences"] + ") where n_sent >= 20), rh as (select * from (" + _T["WN-02_rhythm"] + f""") where n_para >= 20),
j as (select dd.source, dd.doc_kind, c.* exclude (words), sp.words, speech, ends_in_speech, ends_short, st.n_sent, st.deviation, st.n_short, rh.n_para, rh.words as p_words from documents dd join c using (doc_id) join sp using (doc_id) left join st using (doc_id) left join rh using (doc_id) where dd.source is not null),
a as (select source, {_N}::double as chapters, median(words) filter (where doc_kind = 'chapter')::double as chapter_words, median(deviation)::double as sentence_deviation, sum(n_short)::double / nullif(sum(n_sent), 0) as short_ratio, sum(speech)::double / nullif(sum(words), 0) as dialogue_ratio, (sum(n_para) * 1000)::double / nullif(sum(p_words), 0) as paragraph_density,
  count(*) filter (where doc_kind = 'chapter' and ends_in_speech)::double / nullif({_N}, 0) as ends_in_speech, count(*) filter (where doc_kind = 'chapter' and ends_short)::double / nullif({_N}, 0) as ends_short, """ + ", ".join(f"(({' + '.join(f'sum(n_{k})' for k in ks)}) * 1000)::double / nullif(sum(words), 0) as {m}" for m, ks in c.DENSITIES.items()) + f" from j group by source) select source, measure, value from (unpivot a on {', '.join(c.MEASURES)} into name measure value value) where value is not null",
    "SC-20_anchors": f"with b as (select max(median) filter (where measure = 'sentence_median') as m, max(median) filter (where measure = 'short20_ratio') as s, max(median) filter (where measure = 'ellipsis') as e from ({_C['AG-06_baseline']})), f as (select *, coalesce(m between 5 and 120 and s between 0 and 1 and e between 0 and 20, false) as fit from b) select case when fit then round(m, 1) else 38.9 end::double as sentence_median, case when fit then round(s, 3) else 0.19 end::double as short20_ratio, case when fit then round(e, 2) else 1.1 end::double as ellipsis, case when fit then 'corpus' else 'builtin' end as origin from f",
    "AG-08_extremes": f"with d as ({_T['TX-02_densities']}), u as (unpivot (select * exclude (words) from d) on columns(* exclude (doc_id)) into name measure value value) select measure, arg_max(doc_id, (value, -doc_id)) as doc_id, max(value) as value from u where value > 0 group by measure",
    "TX-32_verdicts": _CH + ", " + _COUNTS.replace(_D, "d as (select doc_id, t from ch)") + f", fl as (select doc_id, list_sort(list_distinct(list_filter([{_FLAGS}], lambda x: x is not null))) as f from c where words > 0) select book, chapter, coalesce(len(f), 0)::int as n_flags, coalesce(array_to_string(f, ','), '') as flags, case when coalesce(len(f), 0) = 0 then 'ok' when len(f) <= 3 then 'look' else 'mend' end as verdict from ch left join fl using (doc_id)",
    "TX-29_samples": _GRAMS + f", pk as (select * from ({_C['WN-09_peaks']}) where share >= 0.05), k as (select pk.book, pk.chapter, pk.other, a.gram, row_number() over (partition by pk.book, pk.chapter order by a.gram) as r from pk join g a on a.book = pk.book and a.chapter = pk.chapter where exists (select 1 from g b where b.book = pk.book and b.chapter = pk.other and b.gram = a.gram)) select book, chapter, other, string_agg(gram, ' ' order by gram) as samples from k where r <= 3 group by all",
    "SC-15_sections": f"""with l as (select doc_id, u.i::int as pos, {_strip('u.x')} as line from (select doc_id, unnest(list_transform(string_split_regex(text, '{LINE_END_RE2}'), lambda x, i: struct_pack(x := x, i := i))) as u from documents where doc_kind = 'plan' and text is not null)),
s as (select *, last_value(case when starts_with(line, '#') then pos end ignore nulls) over (partition by doc_id order by pos) as section from l where line <> ''),
n as (select *, row_number() over (partition by doc_id, section order by pos)::int as no from s where section is not null and not starts_with(line, '#')) select doc_id, section, no, line from n where no <= 2""",
    "AG-19_missing_types": CUR + ", m as (select *, row_number() over (partition by book order by chapter) as r from (select book, chapter from cur where type is null)) select book, count(*) as n, string_agg(chapter, ',' order by chapter) filter (where r <= 6) as chapters from m group by book",
    "SC-16_nouns": "select distinct * from (select book, name as noun from characters union all select book, unnest(aliases) from characters union all select book, name from organizations union all select book, unnest(terms).term from analysis) where length(noun) >= 2",
    "RU-02_rule_groups": "with r as (select * from (values " + ", ".join(f"({_q(r[0])}, {_q(r[1])}, {_q(r[2])})" for r in packs.LIBRARY) + ") t(id, level, mode)) select level, mode, count(*) as n, string_agg(id, ',' order by id) as ids from r group by all",
    "WN-20_ranks": "select o_custkey, o_orderkey, (rank() over p)::int as rank, (dense_rank() over p)::int as dense, (ntile(4) over w)::int as quartile, percent_rank() over p as percent from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey), p as (partition by o_custkey order by o_totalprice desc)",
    "AG-22_cube": "select o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::int as level, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
    "AG-22_grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n, max(o_totalprice) as most from orders group by grouping sets ((o_orderstatus), (o_orderpriority))",
    "AG-22_approximate": "select event_type, count(distinct user_id) as n, true as near from events group by event_type",
}
