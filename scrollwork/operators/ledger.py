"""The event-sourced ledger: chapter analyses are the events, everything else is a view of them.

A chapter analysed again replaces its earlier analysis, so applying one twice, or out of order,
changes nothing. Every ledger is a last-value-per-key aggregate over events up to a chapter; no
state is folded row by row and nothing is ordered beyond what an aggregate needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import dna, fingerprint, jaccard, strip_ws
from scrollwork.operators.sequence import next_in_group, previous, running


def current(analysis: DataFrame, *cols: str) -> DataFrame:
    """One analysis per (book, chapter): the one submitted last, ties by the greater id."""
    a = analysis.where("book is not null and chapter is not null")
    r = a.groupBy("book", "chapter").agg(F.max_by(F.struct("analysis_id", *cols), F.struct("submitted_at", "analysis_id")).alias("r"))
    return r.select("book", "chapter", "r.*")


def owners(characters: DataFrame) -> DataFrame:
    """(book, name, character_id) of names and aliases that one character of the book has."""
    n = characters.select("book", "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).dropna()
    return n.groupBy("book", "name").agg(F.min("id").alias("character_id"), F.max("id").alias("o")).where("character_id = o").drop("o")


def latest_characters(characters: DataFrame) -> DataFrame:
    c = characters.groupBy("book", "id").agg(F.max_by(F.struct("name", "role", "state", "relationships", "first_chapter", "last_chapter", "deleted_at"), "updated_at").alias("r"))
    return c.select("book", "id", "r.*")


def state_events(analysis: DataFrame, characters: DataFrame) -> DataFrame:
    """(book, character_id, chapter, pos, state_key, value): every update of a known character."""
    e = current(analysis, "characters").select("book", "chapter", F.posexplode("characters").alias("pos", "c"))
    e = e.select("book", "chapter", "pos", F.col("c.name").alias("name"), F.explode("c.updates").alias("state_key", "value"))
    return e.join(owners(characters), ["book", "name"]).select("book", "character_id", "chapter", "pos", "state_key", "value")


def replay(analysis: DataFrame, characters: DataFrame, upto: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """State of every character after chapter `upto`: (book, character_id, state_key, value, chapter).

    base: rows of the same shape, e.g. of a snapshot; its chapter is where the replay goes on. The
    last value of a key counts, of several in one chapter the one that stands last; null values are kept.
    """
    e = state_events(analysis, characters)
    if upto is not None:
        e = e.where(F.col("chapter") <= upto)
    if base is not None:
        at = base.groupBy("book").agg(F.max("chapter").alias("_at"))
        e = e.join(at, "book", "left").where("_at is null or chapter > _at").drop("_at").unionByName(base.select("book", "character_id", "chapter", F.lit(-1).alias("pos"), "state_key", "value"))
    r = e.groupBy("book", "character_id", "state_key").agg(F.max_by(F.struct("value", "chapter"), F.struct("chapter", "pos")).alias("r"))
    return r.select("book", "character_id", "state_key", "r.value", "r.chapter")


def snapshot_at(snapshots: DataFrame, books: DataFrame) -> DataFrame:
    """The newest snapshot of each book not after its current chapter: (book, chapter, snapshot_id, n_characters)."""
    s = snapshots.join(books.select("book", "current_chapter").distinct(), "book").where("chapter <= coalesce(current_chapter, chapter)")
    r = s.groupBy("book").agg(F.max_by(F.struct("chapter", "snapshot_id", F.size("characters").alias("n")), F.struct("chapter", "taken_at")).alias("r"))
    return r.select("book", "r.chapter", "r.snapshot_id", F.greatest(F.col("r.n"), F.lit(0)).alias("n_characters"))


def snapshot_state(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each book as a base of `replay`."""
    s = snapshots.groupBy("book").agg(F.max_by(F.struct("chapter", "characters"), F.struct("chapter", "taken_at")).alias("r"))
    s = s.select("book", "r.chapter", F.explode("r.characters").alias("c"))
    return s.select("book", F.col("c.id").alias("character_id"), "chapter", F.explode("c.state").alias("state_key", "value"))


def drift(analysis: DataFrame, characters: DataFrame) -> DataFrame:
    """Keys on which the replayed state and the ledger disagree: (book, character_id, state_key, expected, actual, kind)."""
    exp = replay(analysis, characters).select("book", "character_id", "state_key", F.col("value").alias("expected"), F.lit(True).alias("e"))
    act = latest_characters(characters).select("book", F.col("id").alias("character_id"), F.explode("state").alias("state_key", "actual")).withColumn("a", F.lit(True))
    d = exp.join(act, ["book", "character_id", "state_key"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))
    return d.select("book", "character_id", "state_key", "expected", "actual", F.when(F.col("a").isNull(), "only_replay").when(F.col("e").isNull(), "only_ledger").otherwise("differs").alias("kind"))


def relations(analysis: DataFrame, characters: DataFrame) -> DataFrame:
    """Relations between known characters, both ways: the last type and note that were given."""
    e = current(analysis, "relationships").select("book", "chapter", F.posexplode("relationships").alias("pos", "r")).select("book", "chapter", "pos", "r.*")
    o = owners(characters)
    e = e.join(o.withColumnsRenamed({"name": "a", "character_id": "ida"}), ["book", "a"]).join(o.withColumnsRenamed({"name": "b", "character_id": "idb"}), ["book", "b"]).where("ida <> idb")
    both = e.select("book", F.col("ida").alias("character_id"), F.col("idb").alias("with_id"), "chapter", "pos", "type", "note").unionByName(e.select("book", F.col("idb").alias("character_id"), F.col("ida").alias("with_id"), "chapter", "pos", "type", "note"))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("chapter", "pos"))).alias(c)
    return both.groupBy("book", "character_id", "with_id").agg(last("type"), last("note"), F.max("chapter").alias("as_of_chapter"))


def memberships(analysis: DataFrame) -> DataFrame:
    """Members of organizations after all analyses: last action wins, the role last given stays."""
    e = current(analysis, "organizations").select("book", "chapter", F.posexplode("organizations").alias("i", "o"))
    e = e.select("book", "chapter", "i", F.col("o.name").alias("organization"), F.posexplode("o.members").alias("j", "m")).select("book", "organization", "chapter", "i", "j", "m.*").where("character is not null and organization is not null")
    o = F.struct("chapter", "i", "j")
    r = e.groupBy("book", "organization", "character").agg(F.max_by("action", o).alias("action"), F.max_by("role", F.when(F.col("role").isNotNull(), o)).alias("role"), F.min("chapter").alias("since_chapter"))
    return r.where("coalesce(action, 'join') not in ('leave', '离开', '退出')").select("book", "organization", "character", "role", "since_chapter")


def thread_id(c: Column) -> Column:
    return F.upper(strip_ws(c))


def beats(analysis: DataFrame) -> DataFrame:
    """(book, thread, chapter, pos, action, note): operations on threads in order; untidy ids made plain, null ones left out."""
    e = current(analysis, "foreshadow_ops").select("book", "chapter", F.posexplode("foreshadow_ops").alias("pos", "o"))
    return e.select("book", thread_id(F.col("o.id")).alias("thread"), "chapter", "pos", F.col("o.action").alias("action"), F.col("o.note").alias("note")).where("thread <> ''")


def thread_status(analysis: DataFrame) -> DataFrame:
    """Each thread's state from its beats: resolved before abandoned before advanced before planted."""
    has = lambda *a: F.bool_or(F.col("action").isin(*a))
    status = F.when(has("payoff"), "resolved").when(has("abandon"), "abandoned").when(has("advance", "setback"), "advanced").when(has("plant"), "planted").otherwise("planned")
    return beats(analysis).groupBy("book", "thread").agg(status.alias("status"), F.min(F.when(F.col("action") == "plant", F.col("chapter"))).alias("planted_chapter"), F.max("chapter").alias("last_touched"), F.count(F.lit(1)).alias("n_beats"))


def thread_faults(analysis: DataFrame) -> DataFrame:
    """Beats that the state machine forbids: (book, thread, chapter, pos, code).

    What came before a beat is told by the places of its thread's first planting, payoff and end; no thread is one sorted group.
    """
    b = beats(analysis).withColumn("at", F.struct("chapter", "pos"))
    first = lambda *a: F.min(F.when(F.col("action").isin(*a), F.col("at")))
    t = b.groupBy("book", "thread").agg(first("plant").alias("planted"), first("payoff").alias("paid"), first("payoff", "abandon").alias("closed"))
    before = lambda c: F.coalesce(F.col(c) < F.col("at"), F.lit(False))
    code = (
        F.when(F.col("action").isNull() | ~F.col("action").isin("plant", "advance", "setback", "payoff", "abandon"), "beat_bad_action")
        .when((F.col("action") == "payoff") & before("paid"), "double_payoff")
        .when((F.col("action") != "plant") & ~before("planted"), "beat_before_plant")
        .when(F.col("action").isin("advance", "setback") & before("closed"), "beat_after_close")
    )
    return b.join(t, ["book", "thread"]).withColumn("code", code).where("code is not null").select("book", "thread", "chapter", "pos", "code")


def live_threads(foreshadows: DataFrame, books: DataFrame) -> DataFrame:
    """One row per undeleted thread with the book's current chapter."""
    f = foreshadows.where("deleted_at is null").groupBy("book", "id").agg(F.max_by(F.struct("title", "fp", "status", "tier", "scope", "cross_volume", "min_payoff_spacing", "planned_chapter", "planted_chapter", "deadline_chapter", "last_touched"), "created_at").alias("r")).select("book", "id", "r.*")
    return f.join(books.groupBy("book").agg(F.max("current_chapter").alias("now")), "book")


def thread_buckets(foreshadows: DataFrame, books: DataFrame) -> DataFrame:
    """Open threads as a writer needs them: missed, plant_now, must, soon, later, in order of tier, deadline and id."""
    t = live_threads(foreshadows, books).where("status in ('planned', 'planted', 'advanced') and now is not null")
    left = F.col("deadline_chapter") - F.col("now")
    bucket = F.when((F.col("status") == "planned") & (F.col("planned_chapter") < F.col("now")), "missed").when((F.col("status") == "planned") & (F.col("planned_chapter") == F.col("now")), "plant_now").when(left <= 3, "must").when(left <= 10, "soon").otherwise("later")
    tier, due = F.coalesce("tier", F.lit(9)), F.coalesce("deadline_chapter", F.lit(9999))
    # Blocks rise with the order: tier, then sixteen chapters of deadlines, then what the id begins with.
    block = F.concat(F.lpad((tier + 1_000_000).cast("string"), 8, "0"), F.lpad((F.floor(due / 16) + 1_000_000).cast("string"), 8, "0"), F.when(due == 9999, F.substring("id", 1, 4)).otherwise(""))
    x = running(t.withColumn("bucket", bucket), ["book", "bucket"], block, [tier, due, F.col("id")], F.lit(1), "rank")
    return x.withColumn("rank", F.col("rank").cast("int")).select("book", "bucket", "rank", "id", "tier", "deadline_chapter")


def tier_counts(foreshadows: DataFrame, books: DataFrame) -> DataFrame:
    t = live_threads(foreshadows, books)
    return t.groupBy("book").agg(*[F.count_if(F.col("tier") == k).alias(f"t{k}") for k in (1, 2, 3)], F.count_if(F.col("tier").isNull()).alias("untiered"), F.count_if((F.col("tier") == 1) & F.col("status").isin("planted", "advanced")).alias("active_t1"))


def duplicate_fingerprints(foreshadows: DataFrame) -> DataFrame:
    """Titles of a book that are the same but for case, spaces and marks, under more than one id."""
    f = foreshadows.where("deleted_at is null").select("book", "id", fingerprint(F.col("title")).alias("fp")).where("fp <> ''").distinct()
    return f.groupBy("book", "fp").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"), F.count(F.lit(1)).alias("n")).where("n > 1")


def first_of(analysis: DataFrame, array: str, key: str) -> DataFrame:
    """Insert-if-absent of a list (world rules, terms): the first chapter that has each key and how often it came again."""
    e = current(analysis, array).select("book", "chapter", F.explode(array).alias("x")).select("book", "chapter", strip_ws(F.col(f"x.{key}")).alias("key")).where("key <> ''")
    return e.groupBy("book", "key").agg(F.min("chapter").alias("first_chapter"), F.count(F.lit(1)).alias("n"))


def terms(analysis: DataFrame) -> DataFrame:
    """Terms with their first chapter, the chapter they are to be revealed in and the one they were."""
    e = current(analysis, "terms").select("book", "chapter", F.explode("terms").alias("x")).select("book", "chapter", "x.term", "x.reveal_chapter").where("term <> ''")
    t = e.groupBy("book", "term").agg(F.min_by(F.struct("chapter", "reveal_chapter"), "chapter").alias("r")).select("book", "term", F.col("r.chapter").alias("first_chapter"), "r.reveal_chapter")
    r = current(analysis, "revealed_terms").select("book", "chapter", F.explode("revealed_terms").alias("term")).groupBy("book", "term").agg(F.min("chapter").alias("revealed_chapter"))
    return t.join(r, ["book", "term"], "left")


def fact_revisions(analysis: DataFrame) -> DataFrame:
    """Each change of a fact's value: (book, name, chapter, before, value); the first value has before null."""
    e = current(analysis, "facts").select("book", "chapter", F.posexplode("facts").alias("pos", "x")).select("book", "chapter", "pos", "x.name", "x.value").where("name <> '' and value is not null")
    e = previous(e.withColumn("at", F.col("chapter").cast("bigint") * (1 << 20) + F.col("pos")), ["book", "name"], "at", {"before": "value"}, 256 << 20)
    return e.where("before is null or before <> value").select("book", "name", "chapter", "before", "value")


def items(analysis: DataFrame, kind: str) -> DataFrame:
    """Gains or costs as rows (book, chapter, pos, name, type, major): plain strings and objects alike."""
    e = current(analysis, kind).select("book", "chapter", F.posexplode(kind).alias("pos", "x")).where("x is not null")
    o = F.from_json("x", "type string, name string, event string, major boolean")
    obj = F.col("x").startswith("{")
    e = e.withColumn("o", F.when(obj, o))
    name = F.when(obj, F.coalesce("o.name", "o.event")).otherwise(F.col("x"))
    return e.select("book", "chapter", "pos", name.alias("name"), F.when(obj, F.col("o.type")).alias("type"), F.when(obj, F.coalesce("o.major", F.coalesce(F.col("o.type").isin("breakthrough", "power", "treasure"), F.lit(False)))).otherwise(F.lit(False)).alias("major"))


def unpaid_gains(analysis: DataFrame, within: int = 5) -> DataFrame:
    """Major gains without a cost in the same or the next `within` chapters.

    Chapters are whole numbers, so the interval is unfolded and met by equality instead of a range.
    """
    g = items(analysis, "gains").where("major")
    c = items(analysis, "costs").select("book", "chapter").distinct().withColumn("gain_chapter", F.explode(F.sequence(F.col("chapter") - within, F.col("chapter")))).select("book", F.col("gain_chapter").alias("chapter")).distinct()
    return g.join(c, ["book", "chapter"], "left_anti").select("book", "chapter", "pos", "name")


def last_mentions(analysis: DataFrame, characters: DataFrame) -> DataFrame:
    """Last chapter of every character over its mentions and relations, by any of its names."""
    a = current(analysis, "characters", "relationships")
    n = a.select("book", "chapter", F.explode(F.flatten(F.array(F.coalesce("characters.name", F.array().cast("array<string>")), F.coalesce("relationships.a", F.array().cast("array<string>")), F.coalesce("relationships.b", F.array().cast("array<string>"))))).alias("name"))
    return n.join(owners(characters), ["book", "name"]).groupBy("book", "character_id").agg(F.max("chapter").alias("last_chapter"))


def next_ids(characters: DataFrame) -> DataFrame:
    """The next free id of each book: the greatest number plus one, of three digits or more."""
    n = F.max(F.try_to_number(F.regexp_extract("id", "^C-([0-9]+)$", 1), F.lit("999999999")).cast("int"))
    return characters.groupBy("book").agg(F.format_string("C-%03d", F.coalesce(n, F.lit(0)) + 1).alias("next_id"))


# -- sequences of chapters ----------------------------------------------------------------------


def _spans(a: DataFrame, n: int, *cols: str) -> DataFrame:
    """Every chapter as a member of the spans of `n` chapters that it can be in: (book, chapter of the span's start, cols).

    Aggregated by (book, chapter), so no book is one group.
    """
    return a.select("book", F.explode(F.sequence(F.col("chapter") - (n - 1), F.col("chapter"))).alias("chapter"), *cols)


def type_streaks(analysis: DataFrame) -> DataFrame:
    """The first three chapters in a row, without a gap, of the same slow type: (book, chapter, type)."""
    a = current(analysis, "type").where("type in ('过渡', '关系', '线索')")
    a = _spans(a, 3, "type").groupBy("book", "chapter", "type").agg(F.count(F.lit(1)).alias("n")).where("n = 3")
    return a.groupBy("book").agg(F.min_by(F.struct("chapter", "type"), "chapter").alias("r")).select("book", "r.*")


def no_climax(analysis: DataFrame, span: int = 10) -> DataFrame:
    """Books whose last `span` chapters are all there and have no climax."""
    a = current(analysis, "type")
    last = a.groupBy("book").agg(F.max("chapter").alias("_last"))
    a = a.join(last, "book").where(F.col("chapter") > F.col("_last") - span)
    a = a.groupBy("book").agg(F.max("_last").alias("chapter"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "高潮").alias("k"))
    return a.where(f"n = {span} and k = 0").select("book", "chapter")


def conflict_runs(analysis: DataFrame) -> DataFrame:
    """The first run of three chapters of conflict 4 or more, and of five of 2 or less: (book, code, chapter)."""
    a = current(analysis, "conflict").where("conflict between 1 and 5")
    runs = []
    for code, n, test in (("conflict_fatigue", 3, "conflict >= 4"), ("conflict_slump", 5, "conflict <= 2")):
        full = _spans(a.where(test), n).groupBy("book", "chapter").agg(F.count(F.lit(1)).alias("n")).where(f"n = {n}")
        runs.append(full.groupBy("book").agg(F.min("chapter").alias("chapter")).withColumn("code", F.lit(code)))
    return runs[0].unionByName(runs[1])


def gain_only_streaks(analysis: DataFrame) -> DataFrame:
    """Chapters with gains and no costs right after another such chapter."""
    a = current(analysis, "gains", "costs").where("size(gains) > 0 and coalesce(size(costs), 0) <= 0").select("book", "chapter")
    return a.join(a.select("book", (F.col("chapter") + 1).alias("chapter")), ["book", "chapter"], "left_semi")


def gaps(analysis: DataFrame) -> DataFrame:
    """Missing chapters between the first and the last of a book, as ranges: (book, from_chapter, to_chapter)."""
    c = next_in_group(analysis.where("chapter is not null").select("book", "chapter").distinct(), ["book"], "chapter", "n")
    return c.where("n > chapter + 1").select("book", (F.col("chapter") + 1).alias("from_chapter"), (F.col("n") - 1).alias("to_chapter"))


def tension_lines(analysis: DataFrame, last: int = 10) -> DataFrame:
    """The conflict of the last chapters of each book as a line of bars."""
    a = current(analysis, "conflict").where("conflict between 1 and 5")
    a = a.withColumn("r", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("chapter")))).where(f"r <= {last}")
    bar = F.substring(F.lit("▁▂▃▄▅"), F.col("conflict"), F.lit(1))
    s = a.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter", bar.alias("b")))).alias("s"))
    return s.select("book", F.array_join("s.b", "").alias("line"))


def hook_overlap(analysis: DataFrame) -> DataFrame:
    """Overlap of each chapter's hook with the one of the chapter before: (book, chapter, overlap)."""
    a = current(analysis, "hook_dna").select("book", "chapter", dna(F.col("hook_dna")).alias("d"))
    before = a.select("book", (F.col("chapter") + 1).alias("chapter"), F.col("d").alias("p"))
    return a.join(before, ["book", "chapter"]).select("book", "chapter", jaccard(F.col("d"), F.col("p")).alias("overlap"))


def type_counts(analysis: DataFrame) -> DataFrame:
    return current(analysis, "type").groupBy("book", "type").agg(F.count(F.lit(1)).alias("n"))


def digest(analysis: DataFrame, span: int = 50) -> DataFrame:
    """Summaries folded into buckets of `span` chapters: fragments of 24 characters, cut at 150."""
    a = current(analysis, "summary").where("summary <> ''").select("book", "chapter", F.floor((F.col("chapter") - 1) / span).cast("int").alias("bucket"), F.substring("summary", 1, 24).alias("s"))
    g = a.groupBy("book", "bucket").agg(F.array_sort(F.collect_list(F.struct("chapter", "s"))).alias("x"))
    return g.select("book", "bucket", F.substring(F.array_join("x.s", "、"), 1, 150).alias("digest"))


def progress(books: DataFrame) -> DataFrame:
    """Chapters done, words and the mean length of each book."""
    w = F.aggregate(F.map_values("chapter_word_counts"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    n = F.size(F.map_keys("chapter_word_counts"))
    return books.select("book", F.greatest(F.size("completed_chapters"), F.lit(0)).alias("n_completed"), F.coalesce(w, F.lit(0)).alias("words"), F.when(n > 0, F.floor(w / n)).otherwise(0).alias("mean_words"))


def stale_limit(tier: Column) -> Column:
    c = F.lit(15)
    for k, v in packs.STALE.items():
        c = F.when(tier == k, v).otherwise(c)
    return c
