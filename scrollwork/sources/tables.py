"""Readers of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are dear to work on.
TEXTS = ("documents",)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. A table of texts with fewer file splits than cores is spread over them;
    one with as many or more, as on a cluster, is read as it lies and not shuffled."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


#: The tables of a ledger, in the order they refer to each other.
LEDGER = ("books", "characters", "organizations", "foreshadows", "analysis", "snapshots", "documents")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = LEDGER) -> list[str]:
    """Make the tables of a folder temporary views, so that SQL can use all of them; returns the names."""
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)
    return list(names)
