"""Readers of project folders: chapters, JSON ledgers, line logs, plans, ban lists and samples.

Everything is a lazy scan with a stated schema. Missing optional files give an empty table.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollwork.functions.text import lines, strip_ws

#: Schemas of the JSON files; free maps hold strings, objects within them as JSON text.
CHARACTERS = "id string, name string, aliases array<string>, role string, bio string, voice string, state map<string,string>, relationships array<struct<`with`:string,type:string,note:string,as_of_chapter:int>>, first_chapter int, last_chapter int"
TIMELINE = "chapter int, entity string, type string, event string, note string"
ANALYSIS = "chapter int, title string, location string, timeline string, summary string, type string, conflict int, hook string, hook_dna string, plot_points array<string>, characters array<struct<name:string,role:string,updates:map<string,string>,note:string>>, relationships array<struct<a:string,b:string,type:string,note:string>>, foreshadow_ops array<struct<id:string,action:string,note:string>>, gains array<string>, costs array<string>, depends_on array<string>, sets_up array<string>"


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """(n, text) of files named by a number; other names are left out."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    n = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.md$", 1)
    return raw.select(n.alias("n"), F.col("value").alias("text")).where("n <> ''").select(F.col("n").cast("int").alias("n"), "text")


def resolve_corpus(path: str) -> str:
    """Where a project keeps its samples: the folder itself, or `material/style-sample` within it or within its parent's."""
    for p in (os.path.join(path, "material", "style-sample"), os.path.join(path, "style-sample")):
        if os.path.isdir(p):
            return p
    return path


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text) of the .txt and .md files that lie directly in a folder; empty and blank ones are left out."""
    raw = spark.read.option("pathGlobFilter", "*.{txt,md}").option("recursiveFileLookup", "false").text(folder, wholetext=True)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), "\\.(txt|md)$", "").alias("source"), strip_ws(F.col("value")).alias("text")).where("text <> ''")


def rule_library(spark: SparkSession, path: str, level: str = "wide") -> DataFrame:
    """A rule library from a JSON file {"rules": [...]} up to a level."""
    from scrollwork.functions import packs

    r = json_file(spark, path, "id string, level string, mode string, kind string, pattern string, hint string", "rules")
    rank = F.create_map(*[F.lit(x) for kv in packs.LEVELS.items() for x in kv])
    return r.where(rank[F.col("level")] <= packs.LEVELS[level])


def bad_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of chapter files that aren't numbers."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("name")).where(~F.col("name").rlike(r"^\d+\.md$"))


def json_file(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Rows of a JSON file, or of the list under `key`; a missing file is an empty table."""
    try:
        if key is None:
            return spark.read.schema(schema).option("multiLine", True).json(path)
        outer = spark.read.schema(f"`{key}` array<struct<{_nested(schema)}>>").option("multiLine", True).json(path)
        return outer.select(F.explode(key).alias("x")).select("x.*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _nested(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def json_lines(spark: SparkSession, path: str, schema: str = TIMELINE, strict: bool = False) -> DataFrame:
    """A log of JSON lines; bad lines are left out, or fail the job if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def analyses(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """Chapter analyses, one file each; unreadable ones are left out."""
    a = spark.read.schema(ANALYSIS + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(folder)
    a = a.where("_bad is null and chapter is not null").drop("_bad")
    return a if upto is None else a.where(F.col("chapter") <= upto)


def bad_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Files that aren't analyses: (name, code)."""
    a = spark.read.schema(ANALYSIS + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(folder).withColumn("name", F.col("_metadata.file_name"))
    n = F.regexp_extract("name", r"^(\d+)", 1).try_cast("int")
    code = F.when(F.col("_bad").isNotNull(), "analysis_bad_json").when(F.col("chapter").isNull(), "no_chapter").when(F.col("chapter") != n, "name_mismatch")
    return a.select("name", code.alias("code")).where("code is not null")


def ban_list(texts: DataFrame, header: str = "禁用清单") -> DataFrame:
    """(doc_id, pattern, regex): the list items below the heading that contains `header`, without a tag in brackets at the end."""
    x = texts.select("doc_id", F.posexplode(lines(F.col("text"))).alias("no", "line")).withColumn("line", strip_ws(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("no")
    x = x.withColumn("head", F.last(F.when(F.col("line").startswith("#"), F.col("line")), ignorenulls=True).over(w))
    x = x.where(F.col("head").contains(header) & F.col("line").startswith("- ")).withColumn("p", strip_ws(F.regexp_replace(F.substring("line", 3, 1 << 20), r"\s+\[[A-Za-z0-9_-]+\]\s*$", "")))
    return x.where("p <> ''").select("doc_id", F.regexp_replace("p", "^regex:", "").alias("pattern"), F.col("p").startswith("regex:").alias("regex"))


def plan_cast(plan: DataFrame) -> DataFrame:
    """(doc_id, name): the names in a plan's 出场角色, without what stands in brackets behind them."""
    from scrollwork.functions.text import plan_field

    v = F.split(F.coalesce(plan_field(F.col("text"), "出场角色"), F.lit("")), "[,，、;；]")
    return plan.select("doc_id", F.explode(F.transform(v, lambda x: strip_ws(F.regexp_replace(x, "[（(].*$", "")))).alias("name")).where("name <> ''")


def arcs(texts: DataFrame) -> DataFrame:
    """(doc_id, from_chapter, to_chapter) of outlines that state a range of chapters."""
    p = "(?:第|起止章[:：])\\s*(\\d+)\\s*[-–—~～至]\\s*(\\d+)\\s*章?"
    return texts.select("doc_id", F.regexp_extract("text", p, 1).try_cast("int").alias("from_chapter"), F.regexp_extract("text", p, 2).try_cast("int").alias("to_chapter")).where("to_chapter is not null")


def arc_of(ranges: DataFrame, chapter: int) -> DataFrame:
    """The first arc that ends at `chapter` or later, or the last one if all end before."""
    r = ranges.agg(F.min_by(F.struct("doc_id", "to_chapter"), F.when(F.col("to_chapter") >= chapter, F.struct("to_chapter", "doc_id"))).alias("a"), F.max_by(F.struct("doc_id", "to_chapter"), F.struct("to_chapter", "doc_id")).alias("z"))
    return r.select(F.coalesce("a", "z").alias("r")).select("r.*")
