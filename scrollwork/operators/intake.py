"""What comes in: checks of analyses before they are applied, threads matched by title, snapshots and what is written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrollwork.functions.text import count_words, fingerprint, strip_ws
from scrollwork.operators import ledger, metrics
from scrollwork.operators.sequence import next_in_group

ACTIONS = ("plant", "advance", "setback", "payoff", "abandon")


def unknown_relations(analysis: DataFrame, characters: DataFrame) -> DataFrame:
    """Names in relations that neither the ledger nor the same analysis knows: (book, chapter, side, name)."""
    a = ledger.current(analysis, "relationships", "characters")
    r = a.select("book", "chapter", F.explode("relationships").alias("r")).select("book", "chapter", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("r.a").alias("name")), F.struct(F.lit("b").alias("side"), F.col("r.b").alias("name")))).alias("x")).select("book", "chapter", "x.*").where("name is not null").distinct()
    listed = characters.select("book", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).dropna().distinct()
    new = a.select("book", "chapter", F.explode("characters.name").alias("name")).dropna().distinct()
    return r.join(listed, ["book", "name"], "left_anti").join(new, ["book", "chapter", "name"], "left_anti").select("book", "chapter", "side", "name")


def _plants(analysis: DataFrame) -> DataFrame:
    """(book, chapter, pos, title) of the operations that plant a thread without naming an id."""
    e = ledger.current(analysis, "foreshadow_ops").select("book", "chapter", F.posexplode("foreshadow_ops").alias("pos", "o"))
    e = e.where((F.col("o.action") == "plant") & (strip_ws(F.coalesce(F.col("o.id"), F.lit(""))) == ""))
    return e.select("book", "chapter", "pos", strip_ws(F.coalesce(F.col("o.new_item.title"), F.lit(""))).alias("title"))


def matched_plants(analysis: DataFrame, foreshadows: DataFrame) -> DataFrame:
    """The thread that a plant without an id means: (book, chapter, pos, title, thread, step).

    Step 1 is a planned thread with the same fingerprint, 2 a planned one of exactly that title, 3 any of exactly that title; of
    several the one with the least id. Each step is a join by equality; the least step counts. thread is null if none fits.
    """
    p = _plants(analysis).where("title <> ''").withColumn("fp", fingerprint(F.col("title")))
    f = foreshadows.where("deleted_at is null").select("book", "id", "status", strip_ws(F.coalesce("title", F.lit(""))).alias("title"), fingerprint(F.col("title")).alias("own"), F.coalesce("fp", F.lit("")).alias("stored"))
    planned = f.where("status = 'planned'")
    by_fp = planned.select("book", "id", F.explode(F.array_distinct(F.array("own", "stored"))).alias("fp")).where("fp <> ''").groupBy("book", "fp").agg(F.min("id").alias("i1"))
    by_title = planned.groupBy("book", "title").agg(F.min("id").alias("i2"))
    any_ = f.groupBy("book", "title").agg(F.min("id").alias("i3"))
    x = p.join(by_fp, ["book", "fp"], "left").join(by_title, ["book", "title"], "left").join(any_, ["book", "title"], "left")
    step = F.when(F.col("i1").isNotNull(), 1).when(F.col("i2").isNotNull(), 2).when(F.col("i3").isNotNull(), 3)
    return x.select("book", "chapter", "pos", "title", F.coalesce("i1", "i2", "i3").alias("thread"), step.alias("step"))


def operation_faults(analysis: DataFrame, foreshadows: DataFrame) -> DataFrame:
    """Operations on threads that can't be applied: (book, chapter, pos, code).

    An unknown action, an id that the ledger lacks, another action than planting without an id, planting without a title. What
    the order of a thread's operations forbids is `ledger.thread_faults`.
    """
    e = ledger.current(analysis, "foreshadow_ops").select("book", "chapter", F.posexplode("foreshadow_ops").alias("pos", "o"))
    e = e.select("book", "chapter", "pos", F.col("o.action").alias("action"), ledger.thread_id(F.coalesce(F.col("o.id"), F.lit(""))).alias("id"), strip_ws(F.coalesce(F.col("o.new_item.title"), F.lit(""))).alias("title"))
    known = foreshadows.select("book", "id").distinct().withColumn("_known", F.lit(True))
    x = e.join(known, ["book", "id"], "left")
    code = F.when(F.col("action").isNull() | ~F.col("action").isin(*ACTIONS), "op_bad_action").when((F.col("id") != "") & F.col("_known").isNull(), "op_unknown_id").when((F.col("id") == "") & (F.col("action") != "plant"), "op_without_id").when((F.col("id") == "") & (F.col("title") == ""), "plant_without_title")
    return x.withColumn("code", code).where("code is not null").select("book", "chapter", "pos", "code")


def verdicts(analysis: DataFrame, characters: DataFrame, foreshadows: DataFrame, books: DataFrame) -> DataFrame:
    """What applying would do with each chapter's current analysis: (book, chapter, analysis_id, verdict, n_faults).

    `locked` if the chapter is final and the analysis isn't its first, `refused` if it has a fault, else `applied`.
    """
    a = ledger.current(analysis, "submitted_at").select("book", "chapter", "analysis_id")
    final = books.select("book", F.explode("finalized_chapters").alias("chapter")).distinct().withColumn("final", F.lit(True))
    first = analysis.groupBy("book", "chapter").agg(F.min("analysis_id").alias("first_id"))
    n = operation_faults(analysis, foreshadows).select("book", "chapter").unionByName(unknown_relations(analysis, characters).select("book", "chapter")).groupBy("book", "chapter").agg(F.count(F.lit(1)).alias("n_faults"))
    x = a.join(final, ["book", "chapter"], "left").join(first, ["book", "chapter"]).join(n, ["book", "chapter"], "left")
    verdict = F.when(F.col("final") & (F.col("analysis_id") != F.col("first_id")), "locked").when(F.col("n_faults") > 0, "refused").otherwise("applied")
    return x.select("book", "chapter", "analysis_id", verdict.alias("verdict"), F.coalesce("n_faults", F.lit(0)).cast("bigint").alias("n_faults"))


def duplicate_terms(analysis: DataFrame) -> DataFrame:
    """Terms registered more than once: (book, term, n, first_chapter)."""
    return ledger.first_of(analysis, "terms", "term").where("n > 1").select("book", F.col("key").alias("term"), "n", "first_chapter")


def main_payoffs(analysis: DataFrame, foreshadows: DataFrame, books: DataFrame) -> DataFrame:
    """Main threads paid off in a chapter of transition: (book, chapter, thread)."""
    e = ledger.current(analysis, "type", "foreshadow_ops").where("type = '过渡'").select("book", "chapter", F.explode("foreshadow_ops").alias("o")).where("o.action = 'payoff'")
    e = e.select("book", "chapter", ledger.thread_id(F.col("o.id")).alias("thread")).distinct()
    t = ledger.live_threads(foreshadows, books).where("tier = 1").select("book", F.col("id").alias("thread"))
    return e.join(t, ["book", "thread"]).select("book", "chapter", "thread")


def scope(books: DataFrame, documents: DataFrame, last: int = 2) -> DataFrame:
    """The chapters that a check looks at by default: each book's `last` completed ones and those with a text that aren't completed."""
    done = books.select("book", F.explode("completed_chapters").alias("chapter")).distinct()
    recent = done.withColumn("r", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("chapter")))).where(F.col("r") <= last).select("book", "chapter", F.lit("done").alias("why"))
    pending = metrics.chapters(documents).select("book", "chapter").join(books.select("book").distinct(), "book", "left_semi").join(done, ["book", "chapter"], "left_anti")
    return recent.unionByName(pending.select("book", "chapter", F.lit("pending").alias("why")))


def snapshot(analysis: DataFrame, characters: DataFrame, at: DataFrame, block: int = 256) -> DataFrame:
    """The replayed state of each character after the chapters that `at` (book, chapter) names: (book, chapter, character_id, state_key, value).

    Each value holds from its chapter to the key's next one and is unfolded into the blocks of chapters it covers, where it meets
    the chapters asked for: no event meets those that a later one has replaced it for.
    """
    on = ["book", "character_id", "state_key"]
    e = ledger.state_events(analysis, characters).groupBy(*on, "chapter").agg(F.max_by("value", "pos").alias("value"))
    e = next_in_group(e, on, "chapter", "until")
    cell = lambda c: F.floor(c / F.lit(block))
    top = at.groupBy("book").agg(F.max("chapter").alias("top"))
    final = F.least(F.coalesce(F.col("until") - 1, F.col("top")), F.col("top"))
    e = e.join(top, "book").where("chapter <= top").select(*on, "value", F.col("chapter").alias("since"), "until", F.explode(F.sequence(cell(F.col("chapter")), cell(final))).alias("_blk"))
    x = e.join(at.select("book", "chapter", cell(F.col("chapter")).alias("_blk")).distinct(), ["book", "_blk"])
    return x.where("since <= chapter and (until is null or chapter < until)").select("book", "chapter", "character_id", "state_key", "value")


def before_current(books: DataFrame) -> DataFrame:
    """(book, chapter): the chapter before each book's current one, where a first snapshot is taken."""
    return books.groupBy("book").agg((F.max("current_chapter") - 1).alias("chapter")).where("chapter >= 1")


def written_back(analysis: DataFrame, characters: DataFrame) -> DataFrame:
    """The ledger's states with the replayed values written over them: (book, character_id, state_key, value, source)."""
    on = ["book", "character_id", "state_key"]
    exp = ledger.replay(analysis, characters).select(*on, F.col("value").alias("new"), F.lit(True).alias("e"))
    act = ledger.latest_characters(characters).select("book", F.col("id").alias("character_id"), F.explode("state").alias("state_key", "old"))
    return exp.join(act, on, "full_outer").select(*on, F.when(F.col("e"), F.col("new")).otherwise(F.col("old")).alias("value"), F.when(F.col("e"), "replay").otherwise("ledger").alias("source"))


def locks(books: DataFrame, documents: DataFrame) -> DataFrame:
    """Final chapters with what is kept of them: (book, chapter, completed, sha, words); sha is null where the text is missing."""
    final = books.select("book", F.explode("finalized_chapters").alias("chapter")).distinct()
    done = books.select("book", F.explode("completed_chapters").alias("chapter")).distinct().withColumn("done", F.lit(True))
    text = metrics.chapters(documents).select("book", "chapter", F.sha2("text", 256).alias("sha"), count_words(F.col("text")).alias("words"))
    x = final.join(done, ["book", "chapter"], "left").join(text, ["book", "chapter"], "left")
    return x.select("book", "chapter", F.coalesce("done", F.lit(False)).alias("completed"), "sha", "words")


def versions(documents: DataFrame) -> DataFrame:
    """The texts of a chapter as numbered versions, each with the one before: (book, chapter, version, doc_id, before_id).

    They are numbered by doc_id; identical rows of a document count once.
    """
    d = documents.where("doc_kind = 'chapter' and book is not null and chapter is not null and text is not null").select("book", "chapter", "doc_id").distinct()
    w = Window.partitionBy("book", "chapter").orderBy("doc_id")
    return d.select("book", "chapter", F.row_number().over(w).alias("version"), "doc_id", F.lag("doc_id").over(w).alias("before_id"))
