"""References to records that are missing, deleted or later than the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrollwork.functions.text import strip_ws


def _ref(c: Column) -> Column:
    return F.upper(strip_ws(c))


def references(analysis: DataFrame, characters: DataFrame, organizations: DataFrame) -> DataFrame:
    """Rows (table_name, target, book, holder_id, ref_id, at); null and blank ids are no references."""
    a = analysis.select(F.lit("analysis").alias("table_name"), F.lit("foreshadows").alias("target"), "book", F.col("analysis_id").cast("string").alias("holder_id"), F.explode("foreshadow_ops.id").alias("ref_id"), F.col("submitted_at").alias("at"))
    c = characters.select(F.lit("characters").alias("table_name"), F.lit("characters").alias("target"), "book", F.col("id").alias("holder_id"), F.explode("relationships.with_id").alias("ref_id"), F.col("updated_at").alias("at"))
    o = organizations.select(F.lit("organizations").alias("table_name"), F.lit("characters").alias("target"), "book", F.col("id").alias("holder_id"), F.explode("members.character_id").alias("ref_id"), F.col("updated_at").alias("at"))
    return a.unionByName(c).unionByName(o).withColumn("ref_id", _ref(F.col("ref_id"))).where("ref_id <> ''")


def targets(characters: DataFrame, foreshadows: DataFrame) -> DataFrame:
    """Rows (target, book, ref_id, created_at, deleted_at), one per record that can be referred to."""
    c = characters.groupBy("book", F.col("id").alias("ref_id")).agg(F.max_by(F.struct("created_at", "deleted_at"), "updated_at").alias("r"))
    f = foreshadows.groupBy("book", F.col("id").alias("ref_id")).agg(F.max_by(F.struct("created_at", "deleted_at"), "created_at").alias("r"))
    both = c.withColumn("target", F.lit("characters")).unionByName(f.withColumn("target", F.lit("foreshadows")))
    return both.select("target", "book", "ref_id", "r.created_at", "r.deleted_at")


def broken(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a valid target at their time, with status and period.

    The distinct keys, with the span of times they are used at, meet the parents first. Only keys
    that can be at fault are joined back to their references, so that a key used by a third of all
    rows crosses the first join once. A reference without a time can only be `missing`.
    """
    keys = refs.groupBy("target", "book", "ref_id").agg(F.min("at").alias("_first"), F.max("at").alias("_final"))
    suspects = (
        keys.join(parents.withColumn("_found", F.lit(True)), ["target", "book", "ref_id"], "left")
        .where("_found is null or created_at > _first or deleted_at <= _final")
        .select("target", "book", "ref_id", "_found", "created_at", "deleted_at")
    )
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("created_at") > F.col("at"), "late").when(F.col("deleted_at") <= F.col("at"), "deleted")
    return (
        refs.join(suspects, ["target", "book", "ref_id"])
        .withColumn("status", status)
        .where("status is not null")
        .select("table_name", "book", "holder_id", "ref_id", "status", F.substring(F.col("at").cast("string"), 1, 7).alias("period"))
    )


def found(analysis: DataFrame, characters: DataFrame, organizations: DataFrame, foreshadows: DataFrame) -> DataFrame:
    """Each distinct broken reference. Empty tables give no rows; extra columns are ignored."""
    return broken(references(analysis, characters, organizations), targets(characters, foreshadows)).distinct()


def report(analysis: DataFrame, characters: DataFrame, organizations: DataFrame, foreshadows: DataFrame) -> DataFrame:
    """Counts of distinct broken references per table, status and period."""
    return found(analysis, characters, organizations, foreshadows).groupBy("table_name", "status", "period").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("book", "ref_id").alias("n_keys"))
