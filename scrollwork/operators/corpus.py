"""Measures of a corpus: chapters within files, the comparison of sources, anchors taken from it, verdicts on single texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import WS_CLASS, count_words, grams, lines, strip_ws
from scrollwork.operators import metrics, similarity

#: Measures per thousand characters of a source, with the counts that they add up.
DENSITIES = {"nonvisual": ("hearing", "smell", "taste", "touch"), "dash": ("dash",), "pacer": ("pacer",), "simile": ("simile",), "buzz": ("buzz",), "sci": ("sci",)}
MEASURES = ("chapters", "chapter_words", "sentence_deviation", "short_ratio", "dialogue_ratio", "paragraph_density", "ends_in_speech", "ends_short", *DENSITIES)


def split_chapters(texts: DataFrame) -> DataFrame:
    """(doc_id, no, title, body) of the chapters of texts that have at least two headings; what stands before the first is left out.

    The text is split at its headings in its own row; null texts and those with fewer headings have no rows.
    """
    head = "(?m)" + packs.CHAPTER_HEAD
    x = texts.where("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit(head), F.lit(0)).alias("heads"), F.split("text", head).alias("parts")).where(F.size("heads") >= 2)
    x = x.select("doc_id", F.posexplode(F.arrays_zip("heads", F.slice("parts", F.lit(2), F.size("heads")).alias("body"))).alias("no", "r"))
    return x.select("doc_id", (F.col("no") + 1).alias("no"), strip_ws(F.regexp_replace(strip_ws(F.col("r.heads")), "^#+", "")).alias("title"), F.col("r.body").alias("body"))


def speech_and_ending(docs: DataFrame) -> DataFrame:
    """(doc_id, words, speech, ends_in_speech, ends_short): characters in quotes with the quotes, and what the last line is like."""
    said = F.aggregate(F.regexp_extract_all("text", F.lit(packs.SPEECH), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    last = F.coalesce(F.try_element_at(F.filter(F.transform(lines(F.col("text")), strip_ws), lambda x: x != ""), F.lit(-1)), F.lit(""))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("last", last)
    return d.select("doc_id", count_words(F.col("text")).alias("words"), said.alias("speech"), F.col("last").rlike("[」”]").alias("ends_in_speech"), F.length("last").between(1, 20).alias("ends_short"))


def measures(docs: DataFrame) -> DataFrame:
    """The measures of each source beyond those of `similarity.corpus_table`: (source, measure, value)."""
    src = docs.select("doc_id", "source", "doc_kind").where("source is not null")
    c = metrics.counts(docs).drop("words")
    e = speech_and_ending(docs)
    s = metrics.sentence_stats(docs).where("n_sent >= 20").select("doc_id", "n_sent", "deviation", "n_short")
    p = metrics.paragraph_rhythm(docs).where("n_para >= 20").select("doc_id", "n_para", F.col("words").alias("p_words"))
    x = src.join(c, "doc_id").join(e, "doc_id").join(s, "doc_id", "left").join(p, "doc_id", "left")
    chapter = lambda v: F.when(F.col("doc_kind") == "chapter", v)
    words = F.sum("words")
    ratio = lambda a, b: F.when(b > 0, a / b)
    n = F.count_if(F.col("doc_kind") == "chapter")
    a = x.groupBy("source").agg(
        n.cast("double").alias("chapters"),
        F.median(chapter(F.col("words"))).alias("chapter_words"),
        F.median("deviation").alias("sentence_deviation"),
        ratio(F.sum("n_short"), F.sum("n_sent")).alias("short_ratio"),
        ratio(F.sum("speech"), words).alias("dialogue_ratio"),
        ratio(F.sum("n_para") * 1000, F.sum("p_words")).alias("paragraph_density"),
        ratio(F.count_if(chapter(F.col("ends_in_speech"))), n).alias("ends_in_speech"),
        ratio(F.count_if(chapter(F.col("ends_short"))), n).alias("ends_short"),
        *[ratio(sum((F.sum(f"n_{k}") for k in ks), F.lit(0)) * 1000, words).alias(m) for m, ks in DENSITIES.items()],
    )
    return a.unpivot("source", list(MEASURES), "measure", "value").where("value is not null")


def anchors(baseline: DataFrame, builtin: dict[str, float] = packs.ANCHORS) -> DataFrame:
    """One row of anchors (sentence_median, short20_ratio, ellipsis, origin): the baseline's if it has all three within
    their range, else the built-in ones."""
    b = baseline.where(F.col("measure").isin(*builtin)).groupBy().pivot("measure", list(builtin)).agg(F.max("median"))
    fit = F.lit(True)
    for k, (lo, hi) in packs.ANCHOR_RANGES.items():
        fit = fit & F.coalesce(F.col(k).between(lo, hi), F.lit(False))
    return b.select(*[F.when(fit, F.round(F.col(k), packs.ANCHOR_DIGITS[k])).otherwise(F.lit(v)).alias(k) for k, v in builtin.items()], F.when(fit, "corpus").otherwise("builtin").alias("origin"))


def extremes(docs: DataFrame) -> DataFrame:
    """Of each density the text with the greatest value, of several the one with the least id: (measure, doc_id, value)."""
    d = metrics.densities(docs).drop("words")
    m = [c for c in d.columns if c != "doc_id"]
    x = d.unpivot("doc_id", m, "measure", "value").where("value > 0")
    return x.groupBy("measure").agg(F.max_by(F.struct("doc_id", "value"), F.struct(F.col("value"), -F.col("doc_id"))).alias("r")).select("measure", "r.*")


def verdicts(docs: DataFrame) -> DataFrame:
    """(book, chapter, n_flags, flags, verdict) of every chapter: the limits it exceeds, in order of their names; ok if none."""
    c = metrics.chapters(docs)
    f = metrics.flags(c).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"), F.count_distinct("flag").alias("n"))
    x = c.select("book", "chapter", "doc_id").join(f, "doc_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("int")
    return x.select("book", "chapter", n.alias("n_flags"), F.coalesce("flags", F.lit("")).alias("flags"), F.when(n == 0, "ok").when(n <= 3, "look").otherwise("mend").alias("verdict"))


def shared_samples(docs: DataFrame, least: float = 0.05, n: int = 3, k: int = 3) -> DataFrame:
    """The first `k` n-grams that a chapter shares with the predecessor it repeats most, where that is a share of `least`: (book, chapter, other, samples)."""
    peaks = similarity.repeat_peaks(docs).where(F.col("share") >= least).select("book", "chapter", "other")
    t = F.regexp_replace("text", f"{WS_CLASS}+", "")
    g = metrics.chapters(docs).select("book", "chapter", F.explode(F.array_distinct(grams(t, n))).alias("gram"))
    mine = peaks.join(g, ["book", "chapter"])
    both = mine.join(g.withColumnRenamed("chapter", "other"), ["book", "other", "gram"], "left_semi")
    r = both.withColumn("r", F.row_number().over(Window.partitionBy("book", "chapter").orderBy("gram"))).where(f"r <= {k}")
    return r.groupBy("book", "chapter", "other").agg(F.array_join(F.array_sort(F.collect_list("gram")), " ").alias("samples"))


def section_lines(texts: DataFrame, keep: int = 2) -> DataFrame:
    """The first `keep` lines below each heading of a text: (doc_id, section, no, line); blank lines don't count."""
    x = texts.where("text is not null").select("doc_id", F.posexplode(F.transform(lines(F.col("text")), strip_ws)).alias("pos", "line")).where("line <> ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    head: Column = F.col("line").startswith("#")
    x = x.withColumn("section", F.last(F.when(head, F.col("pos")), ignorenulls=True).over(w)).where("section is not null").where(~F.col("line").startswith("#"))
    x = x.withColumn("no", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("pos"))).where(F.col("no") <= keep)
    return x.select("doc_id", (F.col("section") + 1).alias("section"), "no", "line")
