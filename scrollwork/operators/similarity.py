"""Repetition across texts and phrases that return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import WS_CLASS, grams, sentences
from scrollwork.operators.metrics import chapters
from scrollwork.operators.sequence import numbered


def shingles(docs: DataFrame, n: int = 3) -> DataFrame:
    """(book, chapter, h, c): counted character n-grams, as 64-bit hashes, of each chapter without white space."""
    t = F.regexp_replace("text", f"{WS_CLASS}+", "")
    g = chapters(docs).select("book", "chapter", F.explode(F.transform(grams(t, n), lambda x: F.xxhash64(x))).alias("h"))
    return g.groupBy("book", "chapter", "h").agg(F.count(F.lit(1)).alias("c"))


def repeats(docs: DataFrame, window: int = 5) -> DataFrame:
    """Share of each chapter's 3-grams found in each of its `window` predecessors: (book, chapter, other, shared, total).

    Chapters are numbered within the book and every gram is sent to the places of its followers, so the
    join is on equal keys (book, place, gram) and not on a range. Pairs that share nothing are kept.
    """
    c = numbered(chapters(docs).select("book", "chapter"), ["book"], "chapter", "place")
    g = shingles(docs).join(c, ["book", "chapter"])
    total = g.groupBy("book", "chapter", "place").agg(F.sum("c").alias("total"))
    ahead = g.select("book", F.col("chapter").alias("other"), "h", F.col("c").alias("oc"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda k: F.col("place") + k)).alias("place"))
    both = g.join(ahead, ["book", "place", "h"]).groupBy("book", "chapter", "other").agg(F.sum(F.least("c", "oc")).alias("shared"))
    pairs = total.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(window)))).select("book", "chapter", "total", (F.col("place") - F.col("p")).alias("before"))
    pairs = pairs.join(c.select("book", F.col("chapter").alias("other"), F.col("place").alias("before")), ["book", "before"])
    return pairs.join(both, ["book", "chapter", "other"], "left").select("book", "chapter", "other", F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared"), "total")


def repeat_peaks(docs: DataFrame) -> DataFrame:
    """Each chapter's largest share and the nearest predecessor that has it."""
    r = repeats(docs).withColumn("share", F.col("shared") / F.col("total"))
    return r.groupBy("book", "chapter").agg(F.max(F.struct("share", "other")).alias("m")).select("book", "chapter", F.col("m.other").alias("other"), F.col("m.share").alias("share"))


def repeat_baseline(docs: DataFrame, factor: float = 1.8, floor: float = 0.15, cells: int = 4096) -> DataFrame:
    """Per book the upper median of all pairs' shares and the threshold max(floor, factor * median).

    Shares are counted in `cells` of equal width; the equal ones of the cell that holds the middle are then counted alone.
    """
    r = repeats(docs).select("book", (F.col("shared") / F.col("total")).alias("share"))
    r = r.groupBy("book", F.floor(F.col("share") * cells).alias("cell"), "share").agg(F.count(F.lit(1)).alias("k"))
    upto = lambda *by: Window.partitionBy("book", *by).rowsBetween(Window.unboundedPreceding, 0)
    whole = r.groupBy("book", "cell").agg(F.sum("k").alias("c")).withColumn("end", F.sum("c").over(upto().orderBy("cell")))
    n = whole.groupBy("book").agg(F.sum("c").alias("n"))
    mid = whole.join(n, "book").withColumn("want", F.floor(F.col("n") / 2) + 1).where("end >= want and end - c < want").select("book", "cell", "n", (F.col("want") - F.col("end") + F.col("c")).alias("want"))
    x = r.join(mid, ["book", "cell"]).withColumn("end", F.sum("k").over(upto().orderBy("share"))).where("end >= want and end - k < want")
    return x.select("book", F.col("n").alias("n_pairs"), F.col("share").alias("median"), F.greatest(F.lit(floor), F.lit(factor) * F.col("share")).alias("threshold"))


def repeated_sentences(docs: DataFrame, least: int = 12) -> DataFrame:
    """Sentences of a chapter that an earlier chapter of the book has: (book, chapter, sentence, latest).

    Chapters of one sentence are ordered by a window, so no pairs of chapters are formed.
    """
    s = chapters(docs).select("book", "chapter", F.explode(F.array_distinct(sentences(F.regexp_replace("text", "(?md)^#.*$", ""), least))).alias("sentence"))
    w = Window.partitionBy("book", "sentence").orderBy("chapter")
    return s.withColumn("latest", F.lag("chapter").over(w)).where("latest is not null").select("book", "chapter", "sentence", "latest")


def _runs(docs: DataFrame, n: int) -> DataFrame:
    runs = F.regexp_extract_all("text", F.lit(f"[{packs.HAN}]+"), F.lit(0))
    return docs.select("book", "chapter", F.explode(F.flatten(F.transform(runs, lambda r: grams(r, n)))).alias("gram"))


def _without_nouns(p: DataFrame, characters: DataFrame) -> DataFrame:
    """The rows (book, gram, ...) of 4-grams that contain no name or alias of two or more characters of their book.

    A gram is cut into its pieces of two to four characters, which meet the names by equality; no book's names are gathered.
    """
    n = characters.select("book", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("piece")).where(F.length("piece").between(2, 4)).distinct()
    pieces = F.explode(F.concat(grams(F.col("gram"), 2), grams(F.col("gram"), 3), F.array("gram"))).alias("piece")
    named = p.select("book", "gram", pieces).join(n, ["book", "piece"], "left_semi").select("book", "gram").distinct()
    return p.join(named, ["book", "gram"], "left_anti")


def phrases(docs: DataFrame, n: int = 4) -> DataFrame:
    """(book, gram, df, total) of the n-grams of each book's Chinese runs, counted per chapter first."""
    per = _runs(chapters(docs), n).groupBy("book", "chapter", "gram").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("book", "gram").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("total"))


def catchphrases(docs: DataFrame, characters: DataFrame, top: int = 12) -> DataFrame:
    """The `top` 4-grams by chapters that have them, at least max(3, a third) of the book's, without names."""
    n = chapters(docs).groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    p = phrases(docs).where("df >= 3").join(n, "book").where("df >= greatest(3, floor(n / 3))")
    p = _without_nouns(p, characters)
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("df"), "gram"))
    return p.withColumn("rank", rank).where(f"rank <= {top}").select("book", "gram", "df", "rank")


def gestures(docs: DataFrame, characters: DataFrame, cap: int = 8) -> DataFrame:
    """4-grams with a gesture in three or more chapters and six or more places, without names; `over` marks those above the cap."""
    p = phrases(docs).where(F.col("gram").rlike(packs.GESTURE) & (F.col("df") >= 3) & (F.col("total") >= 6))
    p = _without_nouns(p, characters)
    return p.select("book", "gram", "df", "total", (F.col("total") > cap).alias("over"))


def corpus_phrases(docs: DataFrame, top: int = 20) -> DataFrame:
    """The `top` 4-grams of each source's texts with at least three places; ties by gram."""
    runs = F.regexp_extract_all("text", F.lit(f"[{packs.HAN}]+"), F.lit(0))
    g = docs.where("source is not null").select("source", F.explode(F.flatten(F.transform(runs, lambda r: grams(r, 4)))).alias("gram"))
    g = g.groupBy("source", "gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "gram"))).where(f"rank <= {top}")


def corpus_table(docs: DataFrame) -> DataFrame:
    """Measures per source in long form: (source, measure, value), over texts that have enough sentences or paragraphs."""
    from scrollwork.operators import metrics as m

    src = docs.select("doc_id", "source").where("source is not null")
    s = m.sentence_stats(docs).where("n_sent >= 20")
    p = m.paragraph_rhythm(docs).where("n_para >= 20")
    c = m.counts(docs)
    x = src.join(c, "doc_id").join(s.drop("n_short"), "doc_id", "left").join(p.select("doc_id", "n_para", "n_one", "n_short20"), "doc_id", "left")
    a = x.groupBy("source").agg(
        F.sum("words").cast("double").alias("words"),
        F.median("median").alias("sentence_median"),
        (F.sum("n_one") / F.sum("n_para")).alias("one_ratio"),
        (F.sum("n_short20") / F.sum("n_para")).alias("short20_ratio"),
        (F.sum("n_ellipsis") * 1000 / F.sum("words")).alias("ellipsis"),
        (F.sum("n_excl") * 1000 / F.sum("words")).alias("excl"),
    )
    return a.unpivot("source", ["words", "sentence_median", "one_ratio", "short20_ratio", "ellipsis", "excl"], "measure", "value").where("value is not null")


def corpus_baseline(docs: DataFrame) -> DataFrame:
    """Median of each measure over sources; null unless half of them have it."""
    n = docs.where("source is not null").agg(F.count_distinct("source").alias("n"))
    t = corpus_table(docs).groupBy("measure").agg(F.median("value").alias("median"), F.count(F.lit(1)).alias("k")).join(F.broadcast(n))
    return t.select("measure", F.when(F.col("k") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)), F.col("median")).alias("median"))
