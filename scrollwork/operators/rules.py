"""Rule libraries over texts: scans, counts, calibration, evasion and repair of punctuation.

A library is data: (id, level, mode, kind, pattern, hint). Its patterns become literals of the
plan, so every text is read once, whatever the number of rules, and nothing is joined.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollwork.functions import packs
from scrollwork.functions.text import count_words, lines

Rule = tuple[str, str, str, str, str, str]


def library(spark: SparkSession, level: str = "wide", rules: Sequence[Rule] = packs.LIBRARY) -> DataFrame:
    """The rules up to a level as a table; each level holds those before it."""
    rows = [r for r in rules if packs.LEVELS[r[1]] <= packs.LEVELS[level]]
    return spark.createDataFrame(rows, "id string, level string, mode string, kind string, pattern string, hint string")


def occurrences(c: Column, rule: Rule) -> Column:
    """How often a rule matches, without overlaps."""
    if rule[3] == "word":
        return F.floor((F.length(c) - F.length(F.replace(c, F.lit(rule[4]), F.lit("")))) / len(rule[4])).cast("int")
    return F.regexp_count(c, F.lit(rule[4]))


def counts(docs: DataFrame, rules: Sequence[Rule] = packs.RULES) -> DataFrame:
    """(doc_id, rule, n) of the rules that a text breaks."""
    cells = F.array(*[F.struct(F.lit(r[0]).alias("rule"), occurrences(F.col("text"), r).alias("n")) for r in rules])
    return docs.where("text is not null").select("doc_id", F.explode(F.filter(cells, lambda x: x["n"] > 0)).alias("x")).select("doc_id", "x.rule", "x.n")


def scan(docs: DataFrame, rules: Sequence[Rule] = packs.RULES) -> DataFrame:
    """(doc_id, line, rule, hit): the first match of each banned rule in each line."""
    banned = [r for r in rules if r[2] == "ban"]

    def first(c: Column, r: Rule) -> Column:
        return F.when(c.contains(r[4]), r[4]) if r[3] == "word" else F.when(c.rlike(r[4]), F.regexp_extract(c, r[4], 0))

    x = docs.where("text is not null").select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    cells = F.array(*[F.struct(F.lit(r[0]).alias("rule"), first(F.col("line"), r).alias("hit")) for r in banned])
    x = x.select("doc_id", (F.col("pos") + 1).alias("line"), F.explode(F.filter(cells, lambda c: c["hit"].isNotNull())).alias("x"))
    return x.select("doc_id", "line", "x.rule", "x.hit")


def hottest(docs: DataFrame, rules: Sequence[Rule] = packs.RULES, top: int = 8) -> DataFrame:
    """The `top` rules by number of lines that break them; ties by rule."""
    return scan(docs, rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule").limit(top)


def book_totals(docs: DataFrame, rules: Sequence[Rule] = packs.RULES) -> DataFrame:
    """(book, rule, total, n_docs, most): matches per book with the greatest count in one text."""
    c = counts(docs, rules).join(docs.where("book is not null").select("doc_id", "book"), "doc_id")
    return c.groupBy("book", "rule").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_docs"), F.max("n").alias("most"))


def calibration(docs: DataFrame, rules: Sequence[Rule] = packs.RULES, least_docs: int = 3) -> DataFrame:
    """Coverage and density of each rule in the chapters, against the samples, with a verdict."""
    t = docs.where("text is not null and doc_kind in ('chapter', 'sample')").select("doc_id", "text", F.when(F.col("doc_kind") == "chapter", "own").otherwise("ref").alias("side"))
    size = t.groupBy("side").agg(F.count(F.lit(1)).alias("docs"), F.sum(count_words(F.col("text"))).alias("words"))
    hit = counts(t, rules).join(t.select("doc_id", "side"), "doc_id").groupBy("rule", "side").agg(F.count(F.lit(1)).alias("hit_docs"), F.sum("n").alias("total"))
    grid = size.select("side", "docs", "words", F.explode(F.array(*[F.lit(r[0]) for r in rules])).alias("rule"))
    x = grid.join(hit, ["side", "rule"], "left").fillna(0, ["hit_docs", "total"])
    x = x.groupBy("rule").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("own", "ref") for c in ("docs", "words", "hit_docs", "total")])
    own, ref = F.col("own_total") * 1000 / F.col("own_words"), F.col("ref_total") * 1000 / F.col("ref_words")
    verdict = (
        F.when(F.coalesce("own_docs", F.lit(0)) < least_docs, "too_few")
        .when(F.col("own_total") == 0, "silent")
        .when((F.coalesce("ref_words", F.lit(0)) >= 3000) & (ref >= own), "habit_of_the_genre")
        .when(F.col("own_hit_docs") * 2 >= F.col("own_docs"), "everywhere")
        .when(F.col("own_hit_docs") * 10 < F.col("own_docs"), "rare")
        .otherwise("useful")
    )
    return x.select("rule", F.col("own_hit_docs").alias("hit_docs"), F.col("own_docs").alias("n_docs"), F.col("own_total").alias("total"), own.alias("density"), ref.alias("ref_density"), verdict.alias("verdict"))


def evasions(docs: DataFrame, banned: Sequence[str] = packs.BANNED, least: int = 3, ratio: int = 3) -> DataFrame:
    """Banned phrases of three or more characters whose commonest pair of characters is far more frequent than they: (doc_id, phrase, pair, n)."""
    def n(c: Column, p: str) -> Column:
        return F.floor((F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / len(p)).cast("int")

    t = F.col("text")
    cells = []
    for p in banned:
        if len(p) < 3:
            continue
        pairs = [F.struct(n(t, p[i : i + 2]).alias("n"), F.lit(-i).alias("o"), F.lit(p[i : i + 2]).alias("pair")) for i in range(len(p) - 1)]
        cells.append(F.struct(F.lit(p).alias("phrase"), n(t, p).alias("own"), F.array_max(F.array(*pairs)).alias("best")))
    x = docs.where("text is not null").select("doc_id", F.explode(F.array(*cells)).alias("x"))
    return x.select("doc_id", "x.phrase", F.col("x.best.pair").alias("pair"), F.col("x.best.n").alias("n"), F.col("x.own").alias("own")).where((F.col("n") >= least) & (F.col("n") > F.col("own") * ratio)).drop("own")


def repaired(c: Column, ops: Sequence[tuple[str, str]] = ()) -> Column:
    """Half-width marks between Chinese characters made full-width, repeated marks made single, then the (pattern, replacement)
    pairs that a library's rules bring along, in their order."""
    for half, full in packs.HALFWIDTH.items():
        c = F.regexp_replace(c, f"(?<=[{packs.HAN}]){re.escape(half)}(?=[{packs.HAN}])", full)
    for mark in "！？。，、；":
        c = F.regexp_replace(c, f"{mark}{mark}+", mark)
    for pattern, new in ops:
        c = F.regexp_replace(c, pattern, new)
    return c


def signature(c: Column) -> Column:
    """Chinese characters, ASCII letters, digits and spaces only: what a repair must not change."""
    return F.regexp_replace(c, f"[^{packs.HAN} A-Za-z0-9]", "")


def repairs(docs: DataFrame, ops: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(doc_id, text, same_prose) of the texts that a repair changes."""
    d = docs.where("text is not null").select("doc_id", F.col("text").alias("old"), repaired(F.col("text"), ops).alias("text"))
    return d.where("old <> text").select("doc_id", "text", (signature(F.col("old")) == signature(F.col("text"))).alias("same_prose"))


def validate(rules: Sequence[Rule], examples: dict[str, tuple[Sequence[str], Sequence[str]]] | None = None) -> list[tuple[str, str]]:
    """Faults of a library as (rule, fault): repeated ids, unknown levels, modes or kinds, bad patterns, examples that fail."""
    out, seen = [], set()
    for rid, level, mode, kind, pattern, hint in rules:
        if rid in seen:
            out.append((rid, "repeated id"))
        seen.add(rid)
        if level not in packs.LEVELS:
            out.append((rid, "unknown level"))
        if mode not in ("ban", "watch"):
            out.append((rid, "unknown mode"))
        if kind not in ("word", "regex"):
            out.append((rid, "unknown kind"))
        if not hint:
            out.append((rid, "no hint"))
        try:
            find = re.compile(re.escape(pattern) if kind == "word" else pattern).search
        except re.error:
            out.append((rid, "bad pattern"))
            continue
        hit, miss = (examples or {}).get(rid, ((), ()))
        out += [(rid, "example not hit") for x in hit if not find(x)] + [(rid, "example hit") for x in miss if find(x)]
    return out


def merged_bans(manual: DataFrame, rules: DataFrame) -> DataFrame:
    """A hand-made ban list (pattern) joined with the library's bans: manual entries that the library has are dropped."""
    lib = rules.where("mode = 'ban'").select("pattern", F.col("id").alias("source"))
    return manual.select("pattern").distinct().join(lib, "pattern", "left_anti").withColumn("source", F.lit("manual")).unionByName(lib)
