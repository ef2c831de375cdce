"""Per-text measurements and sequence analytics within and across chapters.

All of them take `docs` with at least (doc_id, text) and ignore other columns. Null and empty
texts count as empty. Work on one text stays in array expressions of its row; only sequences that
cross texts shuffle, by book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import bound, count_words, grams, hits, lines, narration, sentences, strip_ws
from scrollwork.operators.sequence import coalesce_intervals, numbered, previous


def _text(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"))


def _bare(c: Column) -> Column:
    return count_words(c)


def _speech_ends(c: Column, pattern: str) -> Column:
    body = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), strip_ws)
    return F.size(F.filter(body, lambda b: (F.length(b) >= 3) & ~F.regexp_replace(b, "、", "").rlike(packs.NOISE)))


def counts(docs: DataFrame) -> DataFrame:
    """One row per text: words, pattern counts of the pack over text and narration, speech that breaks off."""
    d = _text(docs).withColumn("narr", narration(F.col("text")))
    t, n = F.col("text"), F.col("narr")
    return d.select(
        "doc_id", _bare(t).alias("words"), _bare(n).alias("narr_words"),
        *[hits(t, p).alias(f"n_{k}") for k, p in packs.COUNTS.items()],
        *[hits(n, p).alias(f"n_{k}") for k, p in packs.NARRATION_COUNTS.items()],
        _speech_ends(t, packs.DASH_END).alias("n_cut_off"), _speech_ends(t, packs.ELLIPSIS_END).alias("n_trailing"),
    )


def densities(docs: DataFrame) -> DataFrame:
    """Counts per 1000 characters; 0 for an empty text."""
    def per(k: str, w: str) -> Column:
        return F.when(F.col(w) > 0, F.col(f"n_{k}") * 1000 / F.col(w)).otherwise(F.lit(0.0)).alias(k)

    return counts(docs).select("doc_id", "words", *[per(k, "words") for k in packs.DENSITY_LIMITS], *[per(k, "narr_words") for k in (*packs.NARRATION_LIMITS, "action", "tension")])


def flags(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, flag) for every limit of the pack that a text exceeds."""
    c = counts(docs)
    tests = [F.when(F.col(f"n_{k}") * 1000 > F.lit(v) * F.col("words"), k) for k, v in packs.DENSITY_LIMITS.items()]
    tests += [F.when(F.col(f"n_{k}") > v, k) for k, v in packs.COUNT_LIMITS.items()]
    tests += [F.when(F.col(f"n_{k}") * 1000 > F.lit(v) * F.col("words"), k) for k, v in packs.NARRATION_LIMITS.items()]
    tests += [F.when(F.col("n_punct_repeat") > 0, "punct_repeat"), F.when(F.col("n_halfwidth") > 0, "halfwidth"), F.when(F.col("n_mechanism") > 0, "mechanism"), F.when((F.col("n_hearing") + F.col("n_smell") + F.col("n_taste") + F.col("n_touch")) * 1000 < F.col("words"), "few_senses")]
    return c.where("words > 0").select("doc_id", F.explode(F.array_compact(F.array(*tests))).alias("flag"))


def sentence_stats(docs: DataFrame) -> DataFrame:
    """Lengths of narrated sentences: n, total, upper median, population deviation, short share, longest, most commas."""
    s = _text(docs).select("doc_id", sentences(narration(F.col("text"))).alias("s")).where(F.size("s") > 0)
    s = s.select("doc_id", F.transform("s", _bare).alias("n"), F.transform("s", lambda x: hits(x, "[，,]")).alias("commas"))
    n, total = F.size("n"), F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sq = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    s = s.select("doc_id", n.alias("n_sent"), total.alias("total"), sq.alias("sq"), F.element_at(F.array_sort("n"), F.floor(n / 2).cast("int") + 1).alias("median"), F.size(F.filter("n", lambda x: x < packs.SHORT)).alias("n_short"), F.array_max("n").alias("longest"), F.array_max("commas").alias("comma_max"))
    return s.select("doc_id", "n_sent", "total", "median", F.sqrt((F.col("n_sent") * F.col("sq") - F.col("total") * F.col("total")) / (F.col("n_sent") * F.col("n_sent"))).alias("deviation"), "n_short", "longest", "comma_max")


def _longest_run(flag: Column) -> Column:
    """struct(best, start): the longest run of true in an array of booleans and the place (from 1) of its first element; the first of several."""
    init = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("start"))

    def step(a: Column, x: Column) -> Column:
        cur = F.when(x, a["cur"] + 1).otherwise(F.lit(0))
        at = a["at"] + 1
        return F.struct(cur.alias("cur"), F.greatest(a["best"], cur).alias("best"), at.alias("at"), F.when(cur > a["best"], at - cur + 1).otherwise(a["start"]).alias("start"))

    return F.aggregate(flag, init, step)


def _numbered(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, p): p = array of (line number, trimmed line) of lines that are neither blank nor headings."""
    all_ = F.transform(lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("no"), strip_ws(x).alias("line")))
    return _text(docs, *more).select("doc_id", *more, F.filter(all_, lambda x: (x["line"] != "") & ~x["line"].startswith("#")).alias("p"), _bare(F.col("text")).alias("words"))


def paragraph_rhythm(docs: DataFrame) -> DataFrame:
    """Paragraphs, how many are of one sentence, their longest run with its first line, and short ones."""
    one = F.transform("p", lambda x: F.size(sentences(x["line"])) <= 1)
    p = _numbered(docs).where(F.size("p") > 0).withColumn("run", _longest_run(one)).withColumn("one", F.size(F.filter(one, lambda x: x)))
    return p.select("doc_id", F.size("p").alias("n_para"), F.col("one").alias("n_one"), F.col("run.best").alias("longest_run"), F.when(F.col("run.best") > 0, F.try_element_at("p", F.greatest(F.lit(1), F.col("run.start")))["no"]).otherwise(0).alias("run_line"), F.size(F.filter("p", lambda x: F.length(x["line"]) <= 20)).alias("n_short20"), "words")


def start_runs(docs: DataFrame) -> DataFrame:
    """The longest run of lines that begin with the same two characters; the first of several."""
    head = F.filter(F.transform(lines(F.col("text")), lambda x: F.substring(strip_ws(x), 1, 2)), lambda h: h != "")
    d = _text(docs).select("doc_id", head.alias("h")).where(F.size("h") > 0)
    init = F.struct(F.lit("").alias("prev"), F.lit(0).alias("cur"), F.lit(0).alias("best"), F.lit("").alias("head"))

    def step(a: Column, x: Column) -> Column:
        cur = F.when(a["prev"] == x, a["cur"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("prev"), cur.alias("cur"), F.greatest(a["best"], cur).alias("best"), F.when(cur > a["best"], x).otherwise(a["head"]).alias("head"))

    r = F.aggregate("h", init, step)
    return d.select("doc_id", r["best"].alias("run"), r["head"].alias("head"))


def _islands(p: DataFrame, hit: Column, keep: list[Column]) -> DataFrame:
    """Explode `p`, mark paragraphs by `hit`, and number runs of neighbouring hits within the text."""
    x = p.select("doc_id", F.posexplode("p").alias("pos", "x")).select("doc_id", "pos", F.col("x.no").alias("no"), F.col("x.line").alias("line"))
    x = x.where(hit)
    w = Window.partitionBy("doc_id").orderBy("pos")
    return x.withColumn("island", F.col("pos") - F.row_number().over(w)).select("doc_id", "island", "no", "line", *keep)


def exposition_runs(docs: DataFrame) -> DataFrame:
    """Runs of two or more neighbouring paragraphs that explain instead of showing."""
    body = F.regexp_replace(F.regexp_replace(F.col("line"), packs.SPEECH, ""), r"[\s　]", "")
    hit = (F.length(body) >= 12) & ~body.rlike(packs.EXPO_ACTION) & (body.rlike(packs.EXPO_TERM) | (hits(body, packs.EXPO_CONNECTOR) >= 2))
    runs = _islands(_numbered(docs), hit, []).groupBy("doc_id", "island").agg(F.min("no").alias("first_line"), F.max("no").alias("last_line"), F.count(F.lit(1)).alias("n_para"), F.min_by("line", "no").alias("sample"))
    return runs.where("n_para >= 2").select("doc_id", "first_line", "last_line", "n_para", F.substring("sample", 1, 34).alias("sample"))


def _scene(narr: Column) -> dict[str, Column]:
    found = F.regexp_extract_all(narr, F.lit(packs.NARRATION_COUNTS["action"]), F.lit(0))
    again = F.size(F.filter(found, lambda w: F.size(F.filter(found, lambda v: v == w)) >= 2))
    tense = F.size(F.array_distinct(F.regexp_extract_all(narr, F.lit(packs.NARRATION_COUNTS["tension"]), F.lit(0))))
    return {"n_action": again, "n_tension": tense, "scene": F.when(again >= 3, "action").when(tense >= 3, "tension").otherwise("plain")}


def _functions(s: Column) -> Column:
    """Which functions the sentences of an array have among acting, feeling, judging and summing up."""
    def any_(p: str, name: str) -> Column:
        return F.when(F.exists(s, lambda x: x.rlike(p)), name)

    return F.array_compact(F.array(any_(packs.NARRATION_COUNTS["action"] + "|" + packs.NARRATION_COUNTS["tension"], "act"), any_(packs.FEEL, "feel"), any_(packs.JUDGE, "judge"), any_(packs.SUM_UP, "sum")))


def _beats(docs: DataFrame) -> DataFrame:
    x = _numbered(docs).select("doc_id", F.explode("p").alias("x")).select("doc_id", F.col("x.no").alias("no"), F.regexp_replace(F.col("x.line"), packs.SPEECH, "").alias("narr"))
    x = x.select("doc_id", "no", "narr", _bare(F.col("narr")).alias("chars"), sentences(F.col("narr")).alias("s"))
    short = F.transform("s", lambda t: _bare(t) < packs.SHORT)
    x = x.where(F.size("s") >= 3).withColumn("run", _longest_run(short)).withColumn("n_short", F.size(F.filter(short, lambda b: b)))
    return x.withColumns(_scene(F.col("narr"))).withColumn("functions", _functions(F.slice("s", F.greatest(F.lit(1), F.col("run.start")), F.col("run.best"))))


def short_runs(docs: DataFrame) -> DataFrame:
    """Paragraphs of piled-up short sentences; neighbours at most two lines apart in the same kind of scene are one."""
    x = _beats(docs).where((F.col("chars") >= 20) & (F.size("s") >= 5) & (F.col("run.best") >= 5) & (F.col("n_short") * 4 >= F.size("s") * 3))
    w = Window.partitionBy("doc_id").orderBy("no")
    fresh = F.when((F.col("no") - F.lag("no").over(w) <= 2) & (F.col("scene") == F.lag("scene").over(w)), 0).otherwise(1)
    x = x.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(w))
    return x.groupBy("doc_id", "g").agg(F.min("no").alias("first_line"), F.max("no").alias("last_line"), F.first("scene").alias("scene"), F.sum(F.size("s")).alias("n_sent"), F.sum("n_short").alias("n_short"), F.sum("n_action").alias("n_action"), F.max("n_tension").alias("n_tension")).drop("g")


def emphasis_runs(docs: DataFrame) -> DataFrame:
    """Three or more short sentences in a row with three or more functions, outside the plain piles of `short_runs`."""
    x = _beats(docs).where((F.col("chars") >= 12) & (F.col("run.best") >= 3) & (F.size("functions") >= 3))
    piles = short_runs(docs).where("scene = 'plain'").select(F.col("doc_id").alias("d"), "first_line", "last_line")
    x = x.join(piles, (F.col("doc_id") == F.col("d")) & F.col("no").between(F.col("first_line"), F.col("last_line")), "left_anti")
    return x.select("doc_id", F.col("no").alias("line"), F.col("run.best").alias("run"), F.array_join("functions", ",").alias("functions"), "scene")


def frames(docs: DataFrame, *more: str) -> DataFrame:
    """How each text opens and closes."""
    f = F.try_element_at("p", F.lit(1))["line"]
    e = F.try_element_at("p", F.lit(-1))["line"]
    opening = F.when(f.rlike("^[“「『]") | F.substring(f, 1, 6).rlike("[“「\"]"), "speech").when(f.rlike(packs.OPEN_TIME), "time").otherwise("other")
    closing = F.when(e.rlike("[”」』\"]$"), "speech").when(e.rlike("[？?]$"), "question").when(e.endswith("…"), "ellipsis").when(e.rlike(packs.COUNTS["theme"]) | e.rlike(packs.COUNTS["emotion"]), "summary").otherwise("other")
    return _numbered(docs, *more).select("doc_id", *more, F.when(F.size("p") > 0, opening).otherwise("empty").alias("opening"), F.when(F.size("p") > 0, closing).otherwise("empty").alias("closing"))


def chapters(docs: DataFrame) -> DataFrame:
    """One text per (book, chapter), the one with the greatest doc_id, of documents that are chapters."""
    c = docs.where("doc_kind = 'chapter' and book is not null and chapter is not null and text is not null")
    return c.groupBy("book", "chapter").agg(F.max_by(F.struct("doc_id", "text"), "doc_id").alias("r")).select("book", "chapter", "r.doc_id", "r.text")


def frame_runs(docs: DataFrame, least: int = 3) -> DataFrame:
    """Runs of `least` or more present chapters of a book that open, or close, the same way."""
    f = frames(numbered(chapters(docs), ["book"], "chapter", "place"), "book", "chapter", "place")
    f = f.select("book", "chapter", "place", F.explode(F.array(F.struct(F.lit("opening").alias("side"), F.col("opening").alias("kind")), F.struct(F.lit("closing").alias("side"), F.col("closing").alias("kind")))).alias("x")).select("book", "chapter", "x.side", "x.kind", "place", (F.col("place") + 1).alias("then"))
    runs = coalesce_intervals(f, ["book", "side"], "kind", "place", "then").where((F.col("then") - F.col("place") >= least) & ~F.col("kind").isin("other", "empty"))
    at = f.select("book", "side", "place", "chapter").distinct()
    r = runs.join(at.withColumnRenamed("chapter", "first_chapter"), ["book", "side", "place"])
    r = r.join(at.select("book", "side", (F.col("place") + 1).alias("then"), F.col("chapter").alias("last_chapter")), ["book", "side", "then"])
    return r.select("book", "side", "kind", "first_chapter", "last_chapter", (F.col("then") - F.col("place")).cast("bigint").alias("n_chapters"))


def quota_windows(docs: DataFrame, window: int = 3) -> DataFrame:
    """Chapters that end a window of present chapters without any broken-off speech or setback."""
    c = chapters(docs)
    q = counts(c).select("doc_id", (F.col("n_cut_off") + F.col("n_interrupt")).alias("broken"), F.col("n_setback").alias("setback")).join(c.select("doc_id", "book", "chapter"), "doc_id")
    q = numbered(q, ["book"], "chapter", "place")
    # Every chapter goes to the windows it is in, so no book is one group.
    w = q.select("book", F.explode(F.sequence(F.col("place"), F.col("place") + (window - 1))).alias("place"), "broken", "setback").groupBy("book", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("broken").alias("b"), F.sum("setback").alias("s"))
    return q.select("book", "place", "chapter").join(w.where((F.col("n") == window) & (F.col("b") == 0) & (F.col("s") == 0)), ["book", "place"]).select("book", "chapter")


def side_flips(docs: DataFrame, parts: tuple[str, ...] = ("手", "臂", "肩", "腿", "眼")) -> DataFrame:
    """Chapters where the side mentioned most for a part of the body differs from the chapter before that has one."""
    cols = [F.struct(F.lit(p).alias("part"), hits(F.col("text"), f"左.{{0,1}}{p}").alias("l"), hits(F.col("text"), f"右.{{0,1}}{p}").alias("r")) for p in parts]
    x = chapters(docs).select("book", "chapter", F.explode(F.array(*cols)).alias("x")).select("book", "chapter", "x.*").where("l <> r")
    x = x.select("book", "chapter", "part", F.when(F.col("l") > F.col("r"), "left").otherwise("right").alias("side"))
    return previous(x, ["book", "part"], "chapter", {"before": "side"}).where("before <> side").select("book", "part", "chapter", "before", "side")


def duplicate_sentences(docs: DataFrame, least: int = 12) -> DataFrame:
    """Sentences of a text that it repeats word for word."""
    s = _text(docs).select("doc_id", F.explode(sentences(F.regexp_replace("text", "(?md)^#.*$", ""), least)).alias("sentence"))
    return s.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def dialogue_gap(docs: DataFrame) -> DataFrame:
    """The widest distance between neighbouring opening quotes, or the number of words where there are fewer than two."""
    pieces = F.split(F.col("text"), "[“「\"『]")
    d = _text(docs).select("doc_id", F.transform(pieces, F.length).alias("len"), _bare(F.col("text")).alias("words"))
    inner = F.slice("len", F.lit(2), F.greatest(F.lit(0), F.size("len") - 2))
    return d.select("doc_id", (F.size("len") - 1).alias("n_quotes"), F.when(F.size("len") >= 3, F.array_max(inner) + 1).otherwise(F.col("words")).alias("gap"))


def endings(docs: DataFrame) -> DataFrame:
    """Texts whose last line is a maxim of 4 to 40 characters without speech."""
    e = F.try_element_at("p", F.lit(-1))["line"]
    bare = strip_ws(F.regexp_replace(e, packs.SPEECH, ""))
    d = _numbered(docs).where(F.size("p") > 0).select("doc_id", bare.alias("ending"))
    return d.where(F.length("ending").between(4, 40) & F.col("ending").rlike(packs.APHORISM))


def scenes(docs: DataFrame, pattern: str, before: int = 12, after: int = 16) -> DataFrame:
    """Every match of `pattern` with up to `before` characters in front and `after` behind it, one row each, also where excerpts overlap.

    Places come from running lengths of the pieces between matches; the text is cut once for each match.
    """
    d = _text(docs).select("doc_id", "text", F.split(F.col("text"), pattern).alias("parts"), F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0)).alias("m")).where(F.size("m") > 0)
    step = F.zip_with(F.transform("parts", F.length), F.transform("m", F.length), lambda p, m: F.struct(p.alias("p"), F.coalesce(m, F.lit(0)).alias("m")))
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(step, init, lambda a, x: F.struct((a["at"] + x["p"] + x["m"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["p"])).alias("starts")), lambda a: a["starts"])
    x = d.select("doc_id", "text", F.posexplode(F.arrays_zip("m", F.slice(starts, F.lit(1), F.size("m")).alias("at"))).alias("no", "r"))
    start = F.greatest(F.lit(0), F.col("r.at") - before)
    return x.select("doc_id", (F.col("no") + 1).alias("no"), F.col("r.m").alias("hit"), F.substring("text", start + 1, F.col("r.at") - start + F.length("r.m") + after).alias("excerpt"))


def voices(docs: DataFrame, names: DataFrame, width: int = 20, least: int = 8) -> DataFrame:
    """Speech per speaker: lines, characters, exclamations, literary and colloquial words.

    A quote belongs to a name of the book (names: book, name) if exactly one of them stands in the
    `width` characters before it. What stands there is cut into pieces of a name's length and met by equality.
    """
    pat = f"([^”」]{{0,{width}}})" + packs.QUOTE
    d = docs.where("book is not null and text is not null").select("doc_id", "book", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pat), F.lit(1)).alias("pre"), F.regexp_extract_all("text", F.lit(pat), F.lit(2)).alias("said"))).alias("pos", "q")).select("doc_id", "book", "pos", "q.pre", "q.said")
    pieces = bound(F.col("pre"), lambda p: F.array_distinct(F.concat(grams(p, 2), grams(p, 3), grams(p, 4))))
    met = d.select("doc_id", "book", "pos", F.explode(pieces).alias("name")).join(names.select("book", "name").where(F.length("name").between(2, 4)).distinct(), ["book", "name"])
    one = met.groupBy("doc_id", "book", "pos").agg(F.min("name").alias("speaker"), F.count(F.lit(1)).alias("n")).where("n = 1")
    said = d.select("doc_id", "pos", F.length("said").alias("chars"), hits(F.col("said"), "[！!]").alias("excl"), hits(F.col("said"), packs.LITERARY).alias("literary"), hits(F.col("said"), packs.COLLOQUIAL).alias("colloquial"))
    one = one.join(said, ["doc_id", "pos"])
    return one.groupBy("book", "speaker").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("chars").alias("n_chars"), F.sum("excl").alias("n_excl"), F.sum("literary").alias("n_literary"), F.sum("colloquial").alias("n_colloquial")).where(f"n_lines >= {least}")
