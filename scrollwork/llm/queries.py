"""The queries of the problems on text and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollwork.llm import bpe, confusables, mojibake, names, packing, setjoin
from scrollwork.sources.tables import table

#: What separates the values of hook_dna.
DNA_SEPARATORS = r"\-—–－/／／、,，;；|:： \t　"


def _hooks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "analysis").select(F.col("analysis_id").alias("id"), setjoin.pieces(F.col("hook_dna"), DNA_SEPARATORS, 2).alias("vals"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_records(_hooks(spark, d), 3, 5).toDF("analysis_id_a", "analysis_id_b")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per analysis with values: its class of equal value sets and the number of analyses similar to it."""
    return setjoin.similar_links(_hooks(spark, d), 3, 5).toDF("analysis_id", "class_id", "n_links")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "analysis").select("book", F.explode("characters.name").alias("spelling"))
    return names.linked(typed, table(spark, d, "characters"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "characters").select(F.lit("characters").alias("table_name"), "book", F.col("id").alias("row_key"), F.col("name").alias("text"))
    a = table(spark, d, "analysis").select(F.lit("analysis").alias("table_name"), "book", F.col("analysis_id").cast("string").alias("row_key"), F.col("summary").alias("text"))
    return c.unionByName(a)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.normalized(_texts(spark, d), "text").where("posing").select("table_name", "book", "row_key").distinct()


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """The affected records with the consistent form of each of their texts."""
    return confusables.normalized(_texts(spark, d), "text").where("posing").select("table_name", "book", "row_key", "form").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"))


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.packs(table(spark, d, "documents"), table(spark, d, "pack_budgets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"), restore=False)


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents with what could be undone replaced."""
    return mojibake.garbled(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p3_found": p3_found, "p6_found": p6_found, "p6_forms": p6_forms, "p7_ids": p7_ids, "p8_packs": p8_packs, "p9_found": p9_found, "p9_restored": p9_restored}

_P1 = r"""
with r as (
  select distinct analysis_id, list_distinct(list_filter(string_split_regex(hook_dna, '[-—–－/／、,，;；|:： \t\x{3000}]'), lambda x: length(x) >= 2)) as v from analysis where hook_dna is not null),
t as (select analysis_id, len(v) as n, unnest(v) as t from r),
p as (select a.analysis_id as analysis_id_a, b.analysis_id as analysis_id_b
from t a join t b on a.t = b.t and a.analysis_id < b.analysis_id
group by a.analysis_id, b.analysis_id, a.n, b.n
having 5 * count(*) >= 3 * (a.n + b.n - count(*)))"""

ORACLE = {
    "p1_found": _P1 + " select * from p",
    "p1_classes": _P1 + """, k as (select analysis_id, array_to_string(list_sort(v), chr(1)) as k from r where len(v) > 0),
l as (select analysis_id, count(*) as n from (select analysis_id_a as analysis_id from p union all select analysis_id_b from p) group by analysis_id)
select analysis_id, min(analysis_id) over (partition by k) as class_id, coalesce(n, 0)::bigint as n_links from k left join l using (analysis_id)""",
}
