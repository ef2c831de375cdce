"""Integrity checks as rows (severity, code, book, entity, chapter): E must be mended, W should be looked at."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import count_words, dna, jaccard, lines, plan_field
from scrollwork.operators import ledger, metrics, references

Tables = dict[str, DataFrame]


def _rows(df: DataFrame, severity: str, code: str | Column, entity: str | Column | None = None, chapter: str | None = "chapter") -> DataFrame:
    e = F.lit(None).cast("string") if entity is None else (F.col(entity) if isinstance(entity, str) else entity).cast("string")
    c = F.lit(None).cast("int") if chapter is None else F.col(chapter).cast("int")
    return df.select(F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), "book", e.alias("entity"), c.alias("chapter"))


def _first_failing(df: DataFrame, severity: str, tests: list[tuple[str, Column]], entity: str | None = None, chapter: str | None = "chapter") -> list[DataFrame]:
    """All failing tests of each row, in one pass over the table."""
    codes = F.array_compact(F.array(*[F.when(test, code) for code, test in tests]))
    x = df.withColumn("_code", F.explode(codes))
    return [_rows(x, severity, F.col("_code"), entity, chapter)]


def reconcile(t: Tables) -> list[DataFrame]:
    """Completed chapters, texts and analyses against each other, and holes in what is completed."""
    done = t["books"].select("book", F.explode("completed_chapters").alias("chapter")).distinct()
    text = metrics.chapters(t["documents"]).select("book", "chapter")
    an = t["analysis"].select("book", "chapter").where("chapter is not null").distinct()
    on = ["book", "chapter"]
    holes = ledger.gaps(done)
    known = text.join(t["books"].select("book").distinct(), "book", "left_semi")
    pending = known.join(done, on, "left_anti")
    return [
        _rows(done.join(text, on, "left_anti"), "E", "completed_without_text"),
        _rows(done.join(an, on, "left_anti"), "E", "completed_without_analysis"),
        _rows(pending.join(an, on, "left_anti"), "W", "pending_unapplied"),
        _rows(pending.join(an, on, "left_semi"), "W", "pending_rewrite"),
        _rows(holes, "W", "chapter_gap", F.concat_ws("-", "from_chapter", "to_chapter"), "from_chapter"),
    ]


def banned(c: Column, bans: DataFrame | None = None) -> Column:
    """Whether a text has a banned phrase: those of a list (pattern, regex) as `files.ban_list` parses it, or the default ones.

    A list is written by hand, so it becomes literals of the plan, and each text is read once; a pattern that isn't one is left out.
    """
    if bans is None:
        plain, patterns = list(packs.BANNED), list(packs.BANNED_PATTERNS)
    else:
        rows = bans.select("pattern", "regex").distinct().collect()
        plain, patterns = [r[0] for r in rows if not r[1]], [r[0] for r in rows if r[1] and _compiles(r[0])]
    return reduce(lambda p, q: p | q, [c.contains(r) for r in plain] + [c.rlike(r) for r in patterns], F.lit(False))


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def chapter_texts(t: Tables) -> list[DataFrame]:
    """First line, length against the book's range, banned phrases (of the table `bans` if there is one)."""
    b = t["books"].groupBy("book").agg(F.max("words_per_chapter.min").alias("lo"), F.max("words_per_chapter.max").alias("hi"))
    c = metrics.chapters(t["documents"]).withColumn("n", count_words(F.col("text"))).withColumn("first", F.try_element_at(lines(F.col("text")), F.lit(1)))
    x = c.join(b, "book", "left")
    return [
        *_first_failing(x, "E", [("bad_title_line", ~F.coalesce(F.col("first"), F.lit("")).startswith("#")), ("too_short", F.col("n") < F.col("lo") * 0.85)]),
        *_first_failing(x, "W", [("too_long", F.col("n") > F.col("hi") * 1.5), ("blacklist_hit", banned(F.col("text"), t.get("bans")))]),
    ]


def analyses(t: Tables) -> list[DataFrame]:
    """Fields of the current analyses and what each type of chapter must bring."""
    a = ledger.current(t["analysis"], "summary", "type", "conflict", "hook_dna", "foreshadow_ops", "terms", "relationships", "costs", "plot_points")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    ty = lambda k: F.col("type") == k
    return [
        *_first_failing(a, "E", [
            ("no_summary", F.coalesce(F.trim("summary"), F.lit("")) == ""),
            ("bad_type", ~F.col("type").isin(*packs.CHAPTER_TYPES)),
            ("bad_conflict", ~F.col("conflict").between(1, 5)),
            ("bad_dna", F.col("hook_dna").isNotNull() & (F.size(dna(F.col("hook_dna"))) < 2)),
        ]),
        *_first_failing(a, "W", [
            ("missing_type", F.col("type").isNull()),
            ("contract_clue", ty("线索") & n("foreshadow_ops") & n("terms")),
            ("contract_relation", ty("关系") & n("relationships")),
            ("contract_cost", ty("代价") & n("costs")),
            ("contract_climax", ty("高潮") & (F.coalesce("conflict", F.lit(0)) < 4)),
            ("contract_advance", ty("推进") & n("plot_points")),
        ]),
    ]


def plans(t: Tables) -> list[DataFrame]:
    """Plans against analyses: type, conflict and hook."""
    p = t["documents"].where("doc_kind = 'plan' and book is not null and chapter is not null and text is not null")
    p = p.groupBy("book", "chapter").agg(F.max_by("text", "doc_id").alias("text"))
    p = p.select("book", "chapter", plan_field(F.col("text"), "章节类型").alias("ptype"), F.regexp_extract(F.coalesce(plan_field(F.col("text"), "冲突值"), F.lit("")), "(?<![0-9])([1-5])(?![0-9])", 1).alias("pconf"), plan_field(F.col("text"), "钩子DNA").alias("pdna"))
    x = p.join(ledger.current(t["analysis"], "type", "conflict", "hook_dna"), ["book", "chapter"])
    return _first_failing(x, "W", [
        ("plan_type_unknown", ~F.col("ptype").isin(*packs.CHAPTER_TYPES)),
        ("plan_type_diff", F.col("ptype") != F.col("type")),
        ("plan_conflict_diff", (F.col("pconf") != "") & (F.col("pconf") != F.col("conflict").cast("string"))),
        ("dna_drift", F.col("pdna").isNotNull() & F.col("hook_dna").isNotNull() & (jaccard(dna(F.col("pdna")), dna(F.col("hook_dna"))) < 0.3)),
    ])


def threads(t: Tables) -> list[DataFrame]:
    """Fields and deadlines of threads, the legality of their beats, and the spread over tiers."""
    f = ledger.live_threads(t["foreshadows"], t["books"])
    is_open = F.col("status").isin("planted", "advanced")
    faults = ledger.thread_faults(t["analysis"])
    tiers = ledger.tier_counts(t["foreshadows"], t["books"]).join(t["books"].groupBy("book").agg(F.max("current_chapter").alias("now")), "book")
    return [
        *_first_failing(f, "E", [
            ("thread_bad_tier", ~F.col("tier").between(1, 3)),
            ("thread_bad_scope", F.col("scope").isNotNull() & ~F.col("scope").isin(*packs.SCOPE.values())),
            ("thread_bad_spacing", F.col("min_payoff_spacing") < 1),
        ], "id", None),
        *_first_failing(f, "W", [
            ("plan_missed", (F.col("status") == "planned") & (F.col("planned_chapter") < F.col("now"))),
            ("overdue", is_open & (F.col("deadline_chapter") < F.col("now"))),
            ("due_soon", is_open & (F.col("deadline_chapter") - F.col("now")).between(0, 3)),
            ("stale", is_open & (F.col("now") - F.col("last_touched") > ledger.stale_limit(F.col("tier")))),
            ("cross_volume_tier", F.col("cross_volume") & (F.coalesce("tier", F.lit(0)) != 1)),
            ("missing_fp", F.coalesce("fp", F.lit("")) == ""),
        ], "id", None),
        _rows(faults.where("code <> 'beat_after_close'"), "E", F.col("code"), "thread"),
        _rows(faults.where("code = 'beat_after_close'"), "W", F.col("code"), "thread"),
        _rows(ledger.duplicate_fingerprints(t["foreshadows"]), "E", "duplicate_fp", "ids", None),
        *_first_failing(tiers, "W", [("too_many_t1", F.col("active_t1") > 5), ("no_t1", (F.col("now") > 10) & (F.col("active_t1") == 0))], None, None),
    ]


def people(t: Tables) -> list[DataFrame]:
    """References to nobody and last chapters that lie ahead of the book."""
    found = references.found(t["analysis"], t["characters"], t["organizations"], t["foreshadows"]).where("status = 'missing'")
    ahead = ledger.latest_characters(t["characters"]).join(t["books"].groupBy("book").agg(F.max("current_chapter").alias("now")), "book").where("last_chapter > now")
    code = F.when(F.col("table_name") == "characters", "relation_orphan").when(F.col("table_name") == "organizations", "member_orphan").otherwise("thread_orphan")
    return [
        _rows(found.select("table_name", "book", "holder_id", "ref_id").distinct(), "E", code, F.concat_ws(">", "holder_id", "ref_id"), None),
        _rows(ahead, "W", "last_chapter_ahead", "id", "last_chapter"),
    ]


def terms(t: Tables) -> list[DataFrame]:
    x = ledger.terms(t["analysis"]).join(t["books"].groupBy("book").agg(F.max("current_chapter").alias("now")), "book", "left")
    return [
        _rows(x.where("reveal_chapter < first_chapter"), "E", "term_reveal_before_first", "term", "first_chapter"),
        _rows(x.where("reveal_chapter <= now and revealed_chapter is null"), "W", "term_overdue", "term", "reveal_chapter"),
    ]


def term_entries(t: Tables) -> list[DataFrame]:
    """Terms as they were registered: without a name, or more than once."""
    x = ledger.current(t["analysis"], "terms").select("book", "chapter", F.explode("terms").alias("x"))
    n = ledger.first_of(t["analysis"], "terms", "term").where("n > 1")
    return [_rows(x.where(F.trim(F.coalesce("x.term", F.lit(""))) == ""), "E", "term_missing"), _rows(n, "E", "term_duplicate", "key", "first_chapter")]


def pacing(t: Tables) -> list[DataFrame]:
    a = t["analysis"]
    return [
        _rows(ledger.unpaid_gains(a), "W", "gain_without_cost", "name"),
        _rows(ledger.gain_only_streaks(a), "W", "free_ride"),
        _rows(ledger.type_streaks(a), "W", "type_streak", "type"),
        _rows(ledger.no_climax(a), "W", "no_climax_10"),
        _rows(ledger.conflict_runs(a), "W", F.col("code")),
        _rows(metrics.side_flips(t["documents"]), "W", "side_flip", "part"),
    ]


def reviews(t: Tables) -> list[DataFrame]:
    """Scores and evidence of reviews, one row per review text."""
    r = t["documents"].where("doc_kind = 'review' and book is not null and text is not null")
    x = r.select("book", "doc_id", "chapter", "text", F.regexp_count("text", F.lit("\\[必须修改\\]")).alias("must"), F.expr("try_cast(nullif(regexp_extract(text, '得分[ \\t]*[:：][ \\t]*([0-9]{1,3})', 1), '') as int)").alias("score"), F.regexp_count("text", F.lit("[「“]([^」”]{12,})[」”]")).alias("quotes"))
    return [
        *_first_failing(x, "W", [("review_few_must", F.col("must") < 2), ("review_98", F.col("score") >= 98), ("review_quotes", (F.col("must") > 0) & (F.col("quotes") < F.col("must"))), ("review_hollow", F.col("text").rlike("写得(很)?棒|完全符合要求|无可挑剔"))], "doc_id"),
        *_first_failing(x, "E", [("review_anchor", (F.col("score") > 90) & (F.col("must") < 2))], "doc_id"),
    ]


GROUPS = {"reconcile": reconcile, "chapter_texts": chapter_texts, "analyses": analyses, "plans": plans, "threads": threads, "people": people, "terms": terms, "term_entries": term_entries, "pacing": pacing, "reviews": reviews}


def violations(t: Tables, *groups: str) -> DataFrame:
    """All rows of some groups of checks (of all by default)."""
    parts = [df for g in groups or GROUPS for df in GROUPS[g](t)]
    return reduce(DataFrame.unionByName, parts)


def edit_guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edits that lose too much: (doc_id, code), comparing two versions (doc_id, text).

    Versions of the same id are compared; new ids have nothing to lose. Null texts count as empty.
    """
    def m(df: DataFrame, p: str) -> DataFrame:
        t = F.coalesce("text", F.lit(""))
        ls = F.filter(lines(t), lambda x: F.trim(x) != "")
        return df.select("doc_id", count_words(t).alias(f"{p}_n"), F.size(F.filter(ls, lambda x: x.rlike("[“「\"]"))).alias(f"{p}_d"), F.size(ls).alias(f"{p}_p"), F.coalesce(F.try_element_at(ls, F.lit(1)), F.lit("")).startswith("#").alias(f"{p}_t"))

    x = m(before, "b").join(m(after, "a"), "doc_id")
    tests = [("empty", F.col("a_n") == 0), ("under_80", F.col("a_n").between(1, 79)), ("title_lost", F.col("b_t") & ~F.col("a_t")), ("text_lost", (F.col("b_n") >= 400) & (F.col("a_n") < F.col("b_n") * 0.6)), ("dialogue_lost", (F.col("b_d") >= 4) & (F.col("a_d") < F.col("b_d") * 0.4)), ("paragraphs_lost", (F.col("b_p") >= 6) & (F.col("a_p") < F.col("b_p") * 0.5))]
    return x.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in tests]))).alias("code"))


def tampered(locked: DataFrame, texts: DataFrame) -> DataFrame:
    """Locked texts (doc_id, sha) that are missing or differ now: (doc_id, code)."""
    now = texts.select("doc_id", F.sha2("text", 256).alias("now"))
    x = locked.select("doc_id", "sha").join(now, "doc_id", "left").where("not (now <=> sha)")
    return x.select("doc_id", F.when(F.col("now").isNull(), "final_text_missing").otherwise("final_tampered").alias("code"))


