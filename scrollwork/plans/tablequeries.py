"""Queries over the general tables: event logs, references between them, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollwork.sources import files
from scrollwork.sources.tables import table


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys without a parent, with how many rows use them; distinct keys meet the parents once."""
    def check(child: str, key: str, parent: str, pk: str) -> DataFrame:
        n = table(spark, d, child).where(f"{key} is not null").groupBy(F.col(key).cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n_rows"))
        return n.join(table(spark, d, parent).select(F.col(pk).cast("bigint").alias("k")), "k", "left_anti").select(F.lit(f"{child}.{key}").alias("reference"), "k", "n_rows")

    parts = [check("orders", "o_custkey", "customer", "c_custkey"), check("lineitem", "l_orderkey", "orders", "o_orderkey"), check("lineitem", "l_partkey", "part", "p_partkey"), check("customer", "c_nationkey", "nation", "n_nationkey"), check("nation", "n_regionkey", "region", "r_regionkey")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def event_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events per user and type with subtotals."""
    return table(spark, d, "events").rollup("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


def last_events(spark: SparkSession, d: str) -> DataFrame:
    """The last fifteen events of each user."""
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("r", r).where("r <= 15").select("user_id", "event_id", "r")


def unpaid_events(spark: SparkSession, d: str) -> DataFrame:
    """Purchases without an error of the same user within the next day, day by day."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.datediff(F.to_date("ts"), F.lit("2000-01-01").cast("date")).alias("day"))
    cost = e.where("event_type = 'error'").select("user_id", F.explode(F.array(F.col("day"), F.col("day") - 1)).alias("day")).distinct()
    return e.where("event_type = 'purchase'").join(cost, ["user_id", "day"], "left_anti").select("event_id", "user_id")


def plan_cast(spark: SparkSession, d: str) -> DataFrame:
    return files.plan_cast(table(spark, d, "documents").where("doc_kind = 'plan' and text is not null"))


def orphan_parts(spark: SparkSession, d: str) -> DataFrame:
    """Part keys looked up among the suppliers: references to a parent table that lacks most of them."""
    n = table(spark, d, "lineitem").where("l_partkey is not null").groupBy(F.col("l_partkey").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.join(table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k")), "k", "left_anti")


QUERIES = {"JN-01_orphans": orphans, "JN-01_orphan_parts": orphan_parts, "AG-22_rollup": event_rollup, "WN-17_last_events": last_events, "JN-11_events": unpaid_events, "SC-13_plan_cast": plan_cast}


def _o(child: str, key: str, parent: str, pk: str) -> str:
    return f"select '{child}.{key}' as reference, {key}::bigint as k, count(*) as n_rows from {child} where {key} is not null and not exists (select 1 from {parent} where {pk} = {key}) group by {key}"


ORACLE = {
    "JN-01_orphans": " union all ".join([_o("orders", "o_custkey", "customer", "c_custkey"), _o("lineitem", "l_orderkey", "orders", "o_orderkey"), _o("lineitem", "l_partkey", "part", "p_partkey"), _o("customer", "c_nationkey", "nation", "n_nationkey"), _o("nation", "n_regionkey", "region", "r_regionkey")]),
    "JN-01_orphan_parts": "select l_partkey::bigint as k, count(*) as n_rows from lineitem where l_partkey is not null and not exists (select 1 from supplier where s_suppkey = l_partkey) group by all",
    "AG-22_rollup": "select event_type, cast(ts as date) as day, count(*) as n, count(distinct user_id) as n_users from events group by rollup (event_type, cast(ts as date))",
    "WN-17_last_events": "select user_id, event_id, r from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 15",
    "JN-11_events": "select event_id, user_id from events p where event_type = 'purchase' and not exists (select 1 from events c where c.event_type = 'error' and c.user_id = p.user_id and cast(c.ts as date) - cast(p.ts as date) between 0 and 1)",
    "SC-13_plan_cast": "with p as (select doc_id, unnest(string_split_regex(coalesce(nullif(regexp_extract(text, '(?m)^[ \\t]*(?:[-*+][ \\t]+)?\\*{0,2}出场角色\\*{0,2}[ \\t]*[:：][ \\t]*([^\\n\\r]*)', 1), ''), ''), '[,，、;；]')) as n from documents where doc_kind = 'plan' and text is not null), s as (select doc_id, regexp_replace(regexp_replace(n, '[（(].*$', ''), '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g') as name from p) select * from s where name <> ''",
}
