"""The given tables, and column helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def write_clean(df: DataFrame, label: str) -> DataFrame:
    """``materialize``, and the files shuffled for it are removed once it is written."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return materialize(df, label)
    finally:
        spark.conf.set(key, before)


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Enough tasks for ``rows``, and not fewer than the session's shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
