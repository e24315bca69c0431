"""The given ``events`` table read as labelled transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def events_as_transactions(events: DataFrame) -> DataFrame:
    """Column-by-column mapping; a pure projection, so scans stay pruned."""
    ts = F.col("ts").cast("timestamp")
    seconds = F.unix_seconds(ts) - F.unix_seconds(F.lit(EPOCH).cast("timestamp"))
    return events.select(
        F.col("event_id").alias("transaction_id"),
        ts.alias("tx_datetime"),
        F.col("user_id").alias("customer_id"),
        F.get_json_object("props", "$.k").cast("long").alias("terminal_id"),
        F.col("value").alias("tx_amount"),
        seconds.alias("tx_time_seconds"),
        F.floor(seconds / 86400).cast("int").alias("tx_time_days"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("tx_fraud"),
        F.lit(0).alias("tx_fraud_scenario"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_transactions(read_events(spark, sf_dir))
