"""Lookups over ledgers and analyses, and packs of context within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrollwork.functions.text import count_words, strip_ws
from scrollwork.operators import ledger, metrics
from scrollwork.operators.sequence import running
from scrollwork.sources import files


def _chapters(df: DataFrame, reason: str) -> DataFrame:
    return df.select("book", "chapter", F.lit(reason).alias("reason")).distinct()


def combined(hits: list[DataFrame]) -> DataFrame:
    """Chapters found by any lookup with all the reasons: (book, chapter, reasons)."""
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.groupBy("book", "chapter").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def keyword(analysis: DataFrame, word: str) -> DataFrame:
    """Chapters whose summary, hook, title or a fact mentions `word`."""
    a = ledger.current(analysis, "title", "summary", "hook", "facts", "location")
    return combined([
        _chapters(a.where(F.col("summary").contains(word)), "summary"),
        _chapters(a.where(F.col("hook").contains(word)), "hook"),
        _chapters(a.where(F.col("title").contains(word)), "title"),
        _chapters(a.where(F.exists("facts", lambda x: F.coalesce(x["name"].contains(word), F.lit(False)) | F.coalesce(x["value"].contains(word), F.lit(False)))), "fact"),
    ])


def location(analysis: DataFrame, word: str) -> DataFrame:
    """Chapters at a place; those without a place count if their summary names it."""
    a = ledger.current(analysis, "location", "summary")
    return _chapters(a.where(F.col("location").contains(word) | (F.col("location").isNull() & F.col("summary").contains(word))), "location")


def character(analysis: DataFrame, characters: DataFrame, name: str) -> DataFrame:
    """Chapters with the characters that have `name` as a name or alias, by any of their names."""
    o = ledger.owners(characters)
    who = o.where(F.col("name") == name).select("book", "character_id").distinct()
    names = o.join(who, ["book", "character_id"], "left_semi").select("book", "name")
    a = ledger.current(analysis, "characters").select("book", "chapter", F.explode(F.array_distinct("characters.name")).alias("name"))
    return _chapters(a.join(names, ["book", "name"], "left_semi"), "character")


def serialized(df: DataFrame, word: str, *keys: str) -> DataFrame:
    """Rows whose JSON, keys included, contains `word`."""
    return df.where(F.to_json(F.struct("*")).contains(word)).select(*keys)


def recent(analysis: DataFrame, n: int = 3) -> DataFrame:
    """The last `n` analysed chapters of each book."""
    r = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("chapter")))
    return ledger.current(analysis, "title").withColumn("r", r).where(f"r <= {n}").select("book", "chapter", "title")


def related(analysis: DataFrame, foreshadows: DataFrame, books: DataFrame, documents: DataFrame, characters: DataFrame, most: int = 6, skip: int = 8, quiet: int = 12) -> DataFrame:
    """Earlier chapters worth rereading before the current one: where threads that its plan names were planted, where its
    cast that is `quiet` chapters away was last seen, the last mention in an event of up to four possessions that its plan
    names, and where setups were made that are `quiet` chapters old and that no later chapter took up. Only analysed
    chapters, not the last `skip`, at most `most` per book, the latest first: (book, chapter, reasons, rank)."""
    from scrollwork.operators import brief

    now = books.groupBy("book").agg(F.max("current_chapter").alias("now")).where("now is not null")
    a = ledger.current(analysis)
    plans = brief.plans_now(books, documents)
    reason = lambda kind, c: F.concat(F.lit(kind + ":"), c).alias("reason")
    threads = brief.plan_threads(foreshadows, books, documents).select("book", "chapter", reason("thread", "id"))
    people = ledger.latest_characters(characters).where("deleted_at is null")
    cast = files.plan_cast(plans).join(plans.select("doc_id", "book", "now"), "doc_id").join(ledger.owners(characters), ["book", "name"]).select("book", "now", F.col("character_id").alias("id")).distinct()
    absent = cast.join(people.select("book", "id", "last_chapter"), ["book", "id"]).where(F.col("now") - F.col("last_chapter") >= quiet).select("book", F.col("last_chapter").alias("chapter"), reason("absent", "id"))
    held = brief.plan_items(analysis, characters, books, documents, skip=skip).select("book", "chapter", reason("item", "item"))
    setups = brief.open_setups(analysis, books, quiet).select("book", "chapter", reason("setup", "setup"))

    x = threads.unionByName(absent).unionByName(held).unionByName(setups).join(now, "book").where(F.col("chapter") < F.col("now") - skip)
    x = x.join(a.select("book", "chapter"), ["book", "chapter"], "left_semi")
    x = x.groupBy("book", "chapter").agg(F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("chapter")))).where(f"rank <= {most}")


def budget(now: Column) -> Column:
    """Characters of a context pack: 8000 and 50 more for every chapter beyond the 80th, at most 16000."""
    return F.least(F.lit(16000), 8000 + F.greatest(F.lit(0), now - 80) * 50)


def folded(sections: DataFrame, caps: dict[str, int], scale: Column) -> DataFrame:
    """Keep each section's rows while their lengths sum to at most its cap times `scale`; the first row always stays.

    sections: (book, section, ord, text). Adds `used` and leaves out what is folded away. Lengths are summed in blocks of `ord`.
    """
    cap = F.lit(None).cast("int")
    for k, v in caps.items():
        cap = F.when(F.col("section") == k, F.floor(F.lit(v) * scale)).otherwise(cap)
    x = running(sections.withColumn("cap", cap), ["book", "section"], F.floor(F.col("ord") / 4096), ["ord"], F.length("text"), "used")
    return x.where((F.col("used") <= F.col("cap")) | F.col("cap").isNull() | (F.col("used") == F.length("text")))


def skeleton(a: DataFrame) -> DataFrame:
    """The first 120 characters of every tenth chapter's summary: (book, ord, text).

    a: (book, chapter, title, summary, now). If they exceed the cap in words, the latest 5 to 10 stay as they are and
    those before are condensed, 50 chapters a row: 24 characters a chapter, at most 150 a row.
    """
    scale = F.greatest(F.lit(0.3), budget(F.col("now")) / 8000)
    brief = F.substring(F.coalesce("summary", F.lit("")), 1, 120)
    x = a.where("chapter % 10 = 0 and chapter > 0").select("book", "chapter", "title", "now", brief.alias("s"))
    x = x.withColumn("line", F.concat(F.lit("第 "), "chapter", F.lit(" 章《"), F.coalesce("title", F.lit("")), F.lit("》:"), "s", F.lit("…")))
    near = F.greatest(F.lit(5), F.least(F.lit(10), F.floor(scale * 5)))
    size = x.groupBy("book").agg(F.sum(count_words(F.col("line"))).alias("n"))
    latest = x.select("book", "chapter").withColumn("r", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("chapter")))).where("r <= 10")
    x = x.join(size, "book").join(latest, ["book", "chapter"], "left")
    x = x.withColumn("far", (F.col("n") > F.floor(scale * CAPS["skeleton"])) & (F.coalesce("r", F.lit(11)) > near))
    lines = x.where("not far").select("book", (-F.col("chapter")).cast("bigint").alias("ord"), F.col("line").alias("text"))
    part = F.concat(strip_ws(F.when(F.col("s") != "", F.substring("s", 1, 24)).otherwise(F.coalesce("title", F.lit("")))), F.when(F.length("s") > 24, "…").otherwise(""))
    g = x.where("far").groupBy("book", F.floor((F.col("chapter") - 1) / 50).alias("g")).agg(F.array_sort(F.collect_list(F.struct("chapter", part.alias("part")))).alias("x"))
    told = F.array_join(F.col("x.part"), "、")
    told = F.when(count_words(told) > 150, F.concat(F.substring(told, 1, 150), F.lit("…"))).otherwise(told)
    text = F.concat(F.lit("第 "), F.col("g") * 50 + 1, F.lit("-"), (F.col("g") + 1) * 50, F.lit(" 章:"), told, F.lit("(章号 "), F.array_join(F.col("x.chapter").cast("array<string>"), ","), F.lit(")"))
    return lines.unionByName(g.select("book", (-F.array_max("x.chapter")).cast("bigint").alias("ord"), text.alias("text")))


#: Caps of the sections in characters; of the skeleton in words, beyond which it is condensed.
CAPS = {"skeleton": 1600, "cast": 2200, "rules": 1200, "facts": 700, "threads": 1800}


def context(analysis: DataFrame, characters: DataFrame, foreshadows: DataFrame, books: DataFrame) -> DataFrame:
    """The context pack for the current chapter of every book: (book, section, ord, text), sections folded to the budget.

    The summaries of the last three chapters are whole and have no cap; the skeleton is condensed, not folded away.
    """
    now = books.groupBy("book").agg(F.max("current_chapter").alias("now")).where("now is not null")
    a = ledger.current(analysis, "title", "summary", "world_facts", "facts").join(now, "book").where("chapter < now")
    last = a.where("summary <> '' and chapter >= now - 3").select("book", F.lit("recent").alias("section"), (-F.col("chapter")).cast("bigint").alias("ord"), F.col("summary").alias("text"))
    far = skeleton(a).select("book", F.lit("skeleton").alias("section"), "ord", "text")
    cast = ledger.latest_characters(characters).join(now, "book").where("deleted_at is null and (role in ('protagonist', 'major') or last_chapter >= now - 5)")
    n = F.try_to_number(F.regexp_extract("id", "([0-9]+)$", 1), F.lit("999999999")).cast("bigint")
    cast = cast.select("book", F.lit("cast").alias("section"), n.alias("ord"), F.concat_ws(" ", "id", "name", "role").alias("text"))
    world = a.select("book", F.lit("rules").alias("section"), "chapter", F.posexplode("world_facts").alias("pos", "x")).select("book", "section", (F.col("chapter") * 100 + F.col("pos")).cast("bigint").alias("ord"), F.col("x.rule").alias("text"))
    facts = a.select("book", F.lit("facts").alias("section"), "chapter", F.posexplode("facts").alias("pos", "x")).select("book", "section", (-(F.col("chapter") * 100 + F.col("pos"))).cast("bigint").alias("ord"), F.concat_ws("=", "x.name", "x.value").alias("text"))
    th = running(ledger.thread_buckets(foreshadows, books).where("bucket <> 'later'"), ["book"], F.concat("bucket", F.lpad(F.floor(F.col("rank") / 4096).cast("string"), 9, "0")), ["bucket", "rank"], F.lit(1), "ord")
    th = th.select("book", F.lit("threads").alias("section"), F.col("ord").cast("bigint").alias("ord"), F.concat_ws(" ", "bucket", "id").alias("text"))
    rows = last.unionByName(far).unionByName(cast).unionByName(world).unionByName(facts).unionByName(th).where("text <> ''").join(now, "book")
    return folded(rows, {k: v for k, v in CAPS.items() if k != "skeleton"}, F.greatest(F.lit(0.3), budget(F.col("now")) / 8000)).select("book", "section", "ord", "text", "used")


def pack(analysis: DataFrame, characters: DataFrame, foreshadows: DataFrame, books: DataFrame, organizations: DataFrame, documents: DataFrame) -> DataFrame:
    """`context` with what the plan calls for: (book, section, ord, text, used).

    Further sections: the type's card, active organizations, terms not revealed yet, chapters worth rereading, the latest eight
    open setups, chunks called to mind and recent events. They are short by themselves and have no cap; `used` sums their lengths.
    """
    from scrollwork.operators import brief

    def section(df: DataFrame, name: str, order: str | Column, text: Column) -> DataFrame:
        return df.select("book", F.lit(name).alias("section"), (F.col(order) if isinstance(order, str) else order).cast("bigint").alias("ord"), text.alias("text"))

    number = F.try_to_number(F.regexp_extract("id", "([0-9]+)$", 1), F.lit("999999999"))
    setups = brief.open_setups(analysis, books).withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("chapter"), "setup"))).where("rank <= 8")
    more = [
        section(brief.type_cards(analysis, books, documents), "type", F.lit(0), F.concat_ws(" | ", "type", "needs", "avoids", "warning")),
        section(brief.active_organizations(organizations, characters, books, documents), "organizations", number, F.concat_ws(" ", "id", "name", "status", "members")),
        section(brief.plan_terms(analysis, books, documents), "terms", "rank", F.concat_ws(" ", "term", "first_chapter")),
        section(related(analysis, foreshadows, books, documents, characters), "related", "rank", F.concat_ws(" ", "chapter", "reasons")),
        section(setups, "setups", "rank", F.concat_ws(" ", "chapter", "setup")),
        section(brief.recall(documents, books), "recall", "rank", F.concat_ws("/", "chapter", "chunk")),
        section(brief.recent_events(analysis, books), "events", "rank", F.concat_ws(" ", "chapter", "event")),
    ]
    rows = more[0]
    for m in more[1:]:
        rows = rows.unionByName(m)
    rows = folded(rows.where("text <> ''"), {}, F.lit(1.0)).select("book", "section", "ord", "text", "used")
    return context(analysis, characters, foreshadows, books).unionByName(rows)


def next_action(books: DataFrame, documents: DataFrame, analysis: DataFrame) -> DataFrame:
    """What each book needs next: plan, write, analyse, review or go on, for its current chapter."""
    b = books.groupBy("book").agg(F.max("current_chapter").alias("chapter")).where("chapter is not null")
    on = ["book", "chapter"]
    has = lambda kind: documents.where(f"doc_kind = '{kind}' and text is not null").select(*on).distinct().withColumn(kind, F.lit(True))
    an = analysis.select(*on).distinct().withColumn("analysed", F.lit(True))
    x = b.join(has("plan"), on, "left").join(metrics.chapters(documents).select(*on).withColumn("written", F.lit(True)), on, "left").join(has("review"), on, "left").join(an, on, "left")
    step = F.when(F.col("plan").isNull() & F.col("written").isNull(), "plan").when(F.col("written").isNull(), "write").when(F.col("analysed").isNull(), "analyse").when(F.col("review").isNull(), "review").otherwise("go_on")
    return x.select("book", "chapter", step.alias("action"))
