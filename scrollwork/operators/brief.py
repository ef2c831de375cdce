"""What must be known before a chapter is written: what its plan names, what is open, who is about; and lookups of cards.

A book's plan is one text, so whatever is compared with it meets one row per book; nothing is paired within a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import dna, jaccard, plan_field, tokens
from scrollwork.operators import ledger, metrics, retrieval
from scrollwork.operators.sequence import running
from scrollwork.sources import files


def _now(books: DataFrame) -> DataFrame:
    return books.groupBy("book").agg(F.max("current_chapter").alias("now")).where("now is not null")


def plans_now(books: DataFrame, documents: DataFrame) -> DataFrame:
    """(book, now, doc_id, text): the plan of each book's current chapter or, while it has none, the last one before; `now` is
    the chapter planned. Of several plans of a chapter the one with the greatest doc_id counts."""
    p = documents.where("doc_kind = 'plan' and text is not null and chapter is not null").select("book", "chapter", "doc_id", "text")
    p = p.join(_now(books), "book").where("chapter <= now")
    r = p.groupBy("book").agg(F.max_by(F.struct("chapter", "doc_id", "text"), F.struct("chapter", "doc_id")).alias("r"))
    return r.select("book", F.col("r.chapter").alias("now"), "r.doc_id", "r.text")


def plan_threads(foreshadows: DataFrame, books: DataFrame, documents: DataFrame) -> DataFrame:
    """Threads that the plan names by id or title, with the chapter they were planted in: (book, id, chapter)."""
    named = F.col("text").contains(F.col("id")) | F.coalesce((F.col("title") != "") & F.col("text").contains(F.col("title")), F.lit(False))
    planted = F.when(F.col("planted_chapter") != 0, F.col("planted_chapter")).otherwise(F.col("planned_chapter"))
    return ledger.live_threads(foreshadows, books).join(plans_now(books, documents).select("book", "text"), "book").where(named).select("book", "id", planted.alias("chapter"))


def possessions(characters: DataFrame) -> DataFrame:
    """(book, item) that undeleted characters hold."""
    p = ledger.latest_characters(characters).where("deleted_at is null")
    return p.select("book", F.explode(F.from_json(F.col("state")["possessions"], "array<string>")).alias("item")).where("length(item) >= 2").distinct()


def plan_items(analysis: DataFrame, characters: DataFrame, books: DataFrame, documents: DataFrame, most: int = 4, skip: int = 8) -> DataFrame:
    """Up to `most` possessions that the plan names, with the last chapter before the last `skip` whose events mention them: (book, item, chapter)."""
    plan = plans_now(books, documents)
    held = possessions(characters).join(plan.select("book", "text"), "book").where(F.col("text").contains(F.col("item")))
    held = held.withColumn("r", F.row_number().over(Window.partitionBy("book").orderBy("item"))).where(f"r <= {most}").select("book", "item")
    events = ledger.current(analysis, "plot_points").join(_now(books), "book").where(F.col("chapter") < F.col("now") - skip).select("book", "chapter", F.explode("plot_points").alias("event"))
    return held.join(events, "book").where(F.col("event").contains(F.col("item"))).groupBy("book", "item").agg(F.max("chapter").alias("chapter"))


def open_setups(analysis: DataFrame, books: DataFrame, quiet: int = 12, core: int = 12) -> DataFrame:
    """Setups `quiet` chapters old that no later chapter took up: (book, chapter, setup).

    An entry that takes one up names its chapter, then how the setup begins; the first `core` characters of that count, so a
    setup's beginnings up to that length meet the entries by equality.
    """
    a = ledger.current(analysis, "sets_up", "depends_on").join(_now(books), "book").where("chapter < now")
    owed = a.where(F.col("now") - F.col("chapter") >= quiet).select("book", "chapter", F.explode("sets_up").alias("setup")).where("setup <> ''").distinct()
    what = F.trim(F.regexp_replace(F.split(F.col("d"), "->")[0], "^\\s*第?\\s*[0-9]+\\s*章?\\s*[:：]", ""))
    taken = a.select("book", F.col("chapter").alias("at"), F.explode("depends_on").alias("d")).select("book", "at", F.substring(what, 1, core).alias("core")).where("core <> ''")
    taken = taken.groupBy("book", "core").agg(F.max("at").alias("at"))
    begins = F.transform(F.sequence(F.lit(1), F.least(F.lit(core), F.length("setup"))), lambda n: F.substring(F.col("setup"), F.lit(1), n))
    closed = owed.withColumn("core", F.explode(begins)).join(taken, ["book", "core"]).where("at >= chapter").select("book", "chapter", "setup").distinct()
    return owed.join(closed, ["book", "chapter", "setup"], "left_anti")


def term_cards(analysis: DataFrame) -> DataFrame:
    """(book, term, brief, truth, first_chapter, reveal_chapter, revealed_chapter): each term as first registered."""
    e = ledger.current(analysis, "terms").select("book", "chapter", F.posexplode("terms").alias("pos", "x")).where("x.term <> ''")
    t = e.groupBy("book", F.col("x.term").alias("term")).agg(F.min_by(F.struct("chapter", "x.brief", "x.truth", "x.reveal_chapter"), F.struct("chapter", "pos")).alias("r"))
    r = ledger.current(analysis, "revealed_terms").select("book", "chapter", F.explode("revealed_terms").alias("term")).groupBy("book", "term").agg(F.min("chapter").alias("revealed_chapter"))
    t = t.select("book", "term", "r.brief", "r.truth", F.col("r.chapter").alias("first_chapter"), "r.reveal_chapter")
    return t.join(r, ["book", "term"], "left")


def fact_cards(analysis: DataFrame) -> DataFrame:
    """(book, name, value, category, note, first_chapter, updated_chapter): each fact's last value; updated_chapter is null if it never changed."""
    e = ledger.current(analysis, "facts").select("book", "chapter", F.posexplode("facts").alias("pos", "x")).select("book", "chapter", "pos", "x.*").where("name <> '' and value is not null")
    f = e.groupBy("book", "name").agg(F.max_by(F.struct("value", "category", "note"), F.struct("chapter", "pos")).alias("r"), F.min("chapter").alias("first_chapter"))
    changed = ledger.fact_revisions(analysis).where("before is not null").groupBy("book", "name").agg(F.max("chapter").alias("updated_chapter"))
    return f.select("book", "name", "r.*", "first_chapter").join(changed, ["book", "name"], "left")


def _named_or_all(cards: DataFrame, key: str, plan: DataFrame, most: int) -> DataFrame:
    """The cards whose name, or its first two characters, the plan has; all of the book's if it has none. The first `most` by chapter and name."""
    x = cards.join(plan.select("book", "text"), "book")
    x = x.withColumn("named", F.col("text").contains(F.col(key)) | F.col("text").contains(F.substring(key, 1, 2))).drop("text")
    x = x.join(x.where("named").select("book").distinct().withColumn("_some", F.lit(True)), "book", "left").where("named or _some is null").drop("_some")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy("first_chapter", key))).where(F.col("rank") <= most)


def plan_terms(analysis: DataFrame, books: DataFrame, documents: DataFrame, most: int = 8) -> DataFrame:
    """Terms not revealed yet that the plan touches, or all: (book, term, first_chapter, reveal_chapter, named, rank)."""
    cards = term_cards(analysis).where("revealed_chapter is null")
    return _named_or_all(cards, "term", plans_now(books, documents), most).select("book", "term", "first_chapter", "reveal_chapter", "named", "rank")


def plan_facts(analysis: DataFrame, books: DataFrame, documents: DataFrame, most: int = 12) -> DataFrame:
    """Facts that the plan touches, or all: (book, name, value, first_chapter, updated_chapter, named, rank)."""
    return _named_or_all(fact_cards(analysis), "name", plans_now(books, documents), most).select("book", "name", "value", "first_chapter", "updated_chapter", "named", "rank")


def decoded(refs: DataFrame, key: str, characters: DataFrame, out: str) -> DataFrame:
    """`refs` with `out`: the name of the character whose id is `key`, or the id itself if the book has none."""
    names = ledger.latest_characters(characters).select("book", F.col("id").alias(key), F.col("name").alias("_name"))
    return refs.join(names, ["book", key], "left").withColumn(out, F.coalesce("_name", F.col(key))).drop("_name")


def relations_named(characters: DataFrame) -> DataFrame:
    """(book, id, pos, with_name, type): each character's relations in order, with names for ids."""
    r = ledger.latest_characters(characters).select("book", "id", F.posexplode("relationships").alias("pos", "r")).select("book", "id", "pos", F.col("r.with_id").alias("with_id"), F.col("r.type").alias("type"))
    return decoded(r, "with_id", characters, "with_name").select("book", "id", "pos", "with_name", "type")


def active_organizations(organizations: DataFrame, characters: DataFrame, books: DataFrame, documents: DataFrame, within: int = 15) -> DataFrame:
    """Organizations seen in the last `within` chapters, or whose status or members name somebody of the plan's cast:
    (book, id, name, status, members), members by name in order."""
    plan = plans_now(books, documents)
    cast = files.plan_cast(plan).join(plan.select("doc_id", "book"), "doc_id").groupBy("book").agg(F.collect_set("name").alias("cast"))
    o = organizations.groupBy("book", "id").agg(F.max_by(F.struct("name", "status", "members", "last_chapter"), "updated_at").alias("r")).select("book", "id", "r.*")
    said = F.concat(F.coalesce("status", F.lit("")), F.coalesce(F.to_json("members"), F.lit("")))
    o = o.join(_now(books), "book").join(cast, "book", "left").where((F.coalesce("last_chapter", F.lit(0)) >= F.col("now") - within) | F.coalesce(F.exists("cast", lambda n: said.contains(n)), F.lit(False)))
    m = decoded(o.select("book", "id", F.posexplode("members.character_id").alias("pos", "character_id")).where("character_id is not null"), "character_id", characters, "who")
    m = m.groupBy("book", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "who"))), lambda x: x["who"]), ", ").alias("members"))
    return o.drop("members").join(m, ["book", "id"], "left").select("book", "id", "name", "status", F.coalesce("members", F.lit("")).alias("members"))


def recent_events(analysis: DataFrame, books: DataFrame, within: int = 2, most: int = 10) -> DataFrame:
    """The last `most` events of the last `within` chapters: (book, chapter, pos, event, rank), the latest first."""
    e = ledger.current(analysis, "plot_points").join(_now(books), "book").where(F.col("chapter") >= F.col("now") - within).select("book", "chapter", F.posexplode("plot_points").alias("pos", "event")).where("event is not null")
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("chapter"), F.desc("pos")))).where(F.col("rank") <= most)


def type_cards(analysis: DataFrame, books: DataFrame, documents: DataFrame, alike: float = 0.8) -> DataFrame:
    """What the planned type of each book's current chapter asks for: (book, type, needs, avoids, warning).

    The warning says that the type is missing or unknown, that the planned hook is like the last chapter's, or is null.
    """
    guide = F.create_map(*[F.lit(x) for k, v in packs.GUIDE.items() for x in (k, v[0])]), F.create_map(*[F.lit(x) for k, v in packs.GUIDE.items() for x in (k, v[1])])
    p = plans_now(books, documents).select("book", "now", plan_field(F.col("text"), "章节类型").alias("type"), plan_field(F.col("text"), "钩子DNA").alias("hook"))
    last = ledger.current(analysis, "hook_dna").select("book", (F.col("chapter") + 1).alias("now"), "hook_dna")
    x = p.join(last, ["book", "now"], "left")
    warn = F.when(F.col("type").isNull(), "no_type").when(~F.col("type").isin(*packs.CHAPTER_TYPES), "unknown_type").when(jaccard(dna(F.col("hook")), dna(F.col("hook_dna"))) > alike, "hook_repeats")
    return x.select("book", "type", guide[0][F.col("type")].alias("needs"), guide[1][F.col("type")].alias("avoids"), warn.alias("warning"))


def urgent_threads(foreshadows: DataFrame, books: DataFrame, within: int = 3) -> DataFrame:
    """Open threads due within `within` chapters or overdue, by tier and deadline: (book, id, left, rank)."""
    t = ledger.live_threads(foreshadows, books).where("status in ('planted', 'advanced')").withColumn("left", F.col("deadline_chapter") - F.col("now")).where(F.col("left") <= within)
    tier = F.coalesce("tier", F.lit(9))
    block = F.concat(F.lpad((tier + 1_000_000).cast("string"), 8, "0"), F.lpad((F.floor(F.col("deadline_chapter") / 16) + 1_000_000).cast("string"), 8, "0"))
    x = running(t, ["book"], block, [tier, F.col("deadline_chapter"), F.col("id")], F.lit(1), "rank")
    return x.select("book", "id", "left", F.col("rank").cast("int").alias("rank"))


def recall(documents: DataFrame, books: DataFrame, first: int = 20, most: int = 5, least: float = 4.0, least_chars: int = 40, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Chunks of a book's own chapters that its current plan calls to mind: (book, chapter, chunk, score, rank).

    BM25 within the book: its chunks meet the terms of its one plan by equality. Of the `first` by score those count that have
    at least `least`, stand before the chapter before last and have `least_chars` characters; of them the first `most`.
    """
    chap = metrics.chapters(documents)
    parts = retrieval.chunks(chap.select("doc_id", "text")).join(chap.select("doc_id", "book", "chapter"), "doc_id")
    toks = parts.select("book", "chapter", "chunk", F.length("body").alias("chars"), tokens(F.col("body")).alias("toks")).withColumn("dl", F.size("toks"))
    plan = plans_now(books, documents)
    size = toks.groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
    asked = plan.select("book", "now", F.explode(F.array_distinct(tokens(F.col("text")))).alias("t"))
    tf = toks.select("book", "chapter", "chunk", "chars", "dl", F.explode("toks").alias("t")).join(asked, ["book", "t"]).groupBy("book", "now", "chapter", "chunk", "chars", "dl", "t").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("book", "t").agg(F.count(F.lit(1)).alias("df"))
    x = tf.join(df, ["book", "t"]).join(size, "book")
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * ((1 - b) + b * F.col("dl") / F.greatest(F.lit(1.0), F.col("total") / F.col("n"))))
    x = x.groupBy("book", "now", "chapter", "chunk", "chars").agg(F.round(F.sum(part), 6).alias("score"))
    by = lambda *c: F.row_number().over(Window.partitionBy("book").orderBy(*c))
    x = x.withColumn("r", by(F.desc("score"), F.desc("chapter"), F.desc("chunk"))).where(F.col("r") <= first)
    x = x.where((F.col("score") >= least) & (F.col("chapter") < F.col("now") - 1) & (F.col("chars") >= least_chars))
    return x.withColumn("rank", by("r")).where(F.col("rank") <= most).select("book", "chapter", "chunk", "score", "rank")


# -- cards and lookups ----------------------------------------------------------------------------


def _state_line(state: Column) -> Column:
    e = F.array_sort(F.filter(F.map_entries(state), lambda x: F.coalesce(x["value"], F.lit("")) != ""))
    return F.coalesce(F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit(":"), x["value"])), " / "), F.lit(""))


def character_cards(characters: DataFrame, name: str) -> DataFrame:
    """The characters that have `name` as a name or alias: (book, id, name, role, first_chapter, last_chapter, state, relations)."""
    who = ledger.owners(characters).where(F.col("name") == name).select("book", F.col("character_id").alias("id")).distinct()
    c = ledger.latest_characters(characters).join(who, ["book", "id"], "left_semi")
    r = relations_named(characters).join(who, ["book", "id"], "left_semi")
    r = r.groupBy("book", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("with_name", F.lit("("), F.coalesce("type", F.lit("")), F.lit(")")).alias("s")))), lambda x: x["s"]), ";").alias("relations"))
    return c.join(r, ["book", "id"], "left").select("book", "id", "name", "role", "first_chapter", "last_chapter", _state_line(F.col("state")).alias("state"), F.coalesce("relations", F.lit("")).alias("relations"))


def thread_cards(foreshadows: DataFrame, word: str) -> DataFrame:
    """Threads whose row mentions `word` in any column, with their beats in order: (book, id, title, status, beats)."""
    f = foreshadows.where(F.to_json(F.struct("book", "id", "title", "description", "status", "payoff_plan", "beats")).contains(word))
    f = f.groupBy("book", "id").agg(F.max_by(F.struct("title", "status", "beats"), "created_at").alias("r")).select("book", "id", "r.*")
    beat = lambda b: F.concat(F.lit("第"), F.coalesce(b["chapter"].cast("string"), F.lit("?")), F.lit("章"), F.coalesce(b["action"], F.lit("")), F.lit("("), F.coalesce(b["note"], F.lit("")), F.lit(")"))
    return f.select("book", "id", "title", "status", F.coalesce(F.array_join(F.transform("beats", beat), " → "), F.lit("")).alias("beats"))


def state_report(characters: DataFrame, organizations: DataFrame, foreshadows: DataFrame, analysis: DataFrame, books: DataFrame) -> DataFrame:
    """What stands where in each book: (book, section, ord, text): main characters, organizations, open threads by tier and
    deadline, world rules, and the last fifteen events, the latest first."""
    number = F.try_to_number(F.regexp_extract("id", "([0-9]+)$", 1), F.lit("999999999")).cast("bigint")
    c = ledger.latest_characters(characters).where("deleted_at is null and role in ('protagonist', 'major')").select("book", F.lit("characters").alias("section"), number.alias("ord"), F.concat_ws(" ", "id", "name", _state_line(F.col("state"))).alias("text"))
    o = organizations.groupBy("book", "id").agg(F.max_by(F.struct("name", "status"), "updated_at").alias("r")).select("book", F.lit("organizations").alias("section"), number.alias("ord"), F.concat_ws(" ", "id", "r.name", "r.status").alias("text"))
    t = ledger.thread_buckets(foreshadows, books).select("book", F.concat(F.lit("threads "), "bucket").alias("section"), F.col("rank").cast("bigint").alias("ord"), F.concat_ws(" ", "id", "tier", "deadline_chapter").alias("text"))
    w = ledger.first_of(analysis, "world_facts", "rule").select("book", F.lit("rules").alias("section"), F.col("first_chapter").cast("bigint").alias("ord"), F.col("key").alias("text"))
    e = recent_events(analysis, books, within=1_000_000, most=15).select("book", F.lit("events").alias("section"), F.col("rank").cast("bigint").alias("ord"), F.concat_ws(" ", "chapter", "event").alias("text"))
    return c.unionByName(o).unionByName(t).unionByName(w).unionByName(e)


def thread_chapters(analysis: DataFrame, word: str) -> DataFrame:
    """Chapters with an operation on a thread that mentions `word`; of several the first: (book, chapter, id, action)."""
    e = ledger.current(analysis, "foreshadow_ops").select("book", "chapter", F.posexplode("foreshadow_ops").alias("pos", "o"))
    o = F.concat_ws("\n", "o.id", "o.action", "o.note", "o.new_item.title", "o.new_item.description", "o.new_item.payoff_plan")
    e = e.where(o.contains(word)).groupBy("book", "chapter").agg(F.min_by(F.struct("o.id", "o.action"), "pos").alias("r"))
    return e.select("book", "chapter", "r.id", "r.action")


def item(analysis: DataFrame, characters: DataFrame, word: str) -> DataFrame:
    """Who holds a thing, and the events and chapters that mention it: (book, kind, chapter, entity)."""
    held = ledger.latest_characters(characters).where(F.exists(F.map_values("state"), lambda v: F.coalesce(v.contains(word), F.lit(False))))
    a = ledger.current(analysis, "summary", "hook", "plot_points")
    events = a.select("book", "chapter", F.explode("plot_points").alias("e")).where(F.col("e").contains(word)).distinct()
    told = a.where(F.concat_ws("\n", "summary", "hook", F.array_join("plot_points", "\n")).contains(word))
    null = F.lit(None).cast("int")
    return held.select("book", F.lit("holder").alias("kind"), null.alias("chapter"), F.col("id").alias("entity")).unionByName(events.select("book", F.lit("event").alias("kind"), "chapter", F.col("e").alias("entity"))).unionByName(told.select("book", F.lit("chapter").alias("kind"), "chapter", F.lit(None).cast("string").alias("entity")))


def term(analysis: DataFrame, word: str) -> DataFrame:
    """Terms whose name, brief or truth mentions `word`: (book, term, first_chapter, state)."""
    state = F.when(F.col("revealed_chapter").isNotNull(), F.concat(F.lit("revealed "), "revealed_chapter")).when(F.col("reveal_chapter").isNotNull(), F.concat(F.lit("planned "), "reveal_chapter")).otherwise("open")
    return term_cards(analysis).where(F.concat_ws("", "term", "brief", "truth").contains(word)).select("book", "term", "first_chapter", state.alias("state"))


def fact(analysis: DataFrame, word: str) -> DataFrame:
    """Facts that mention `word` anywhere: (book, name, value, category, first_chapter, updated_chapter)."""
    return fact_cards(analysis).where(F.concat_ws("\n", "name", "value", "category", "note").contains(word)).select("book", "name", "value", "category", "first_chapter", "updated_chapter")
