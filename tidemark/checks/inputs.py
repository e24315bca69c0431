"""Inputs the named queries share, all derived from the given ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import add_features
from tidemark.functions.scoring import apply_scorer
from tidemark.operators.split import side, stratified_split
from tidemark.schema import DATETIME_FORMAT, TRANSACTION_COLUMNS
from tidemark.session import scratch_path
from tidemark.sources.tables import transactions


def scorer_a():
    """Rule scorer: a third of all amounts reach the threshold."""
    return F.col("tx_amount") / F.lit(100.0)


def scorer_b():
    """Rule scorer on the hour: few distinct scores, large ties."""
    return F.col("tx_hour") / F.lit(24.0)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_features(transactions(spark, sf_dir))


def split_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(featured(spark, sf_dir))


def test_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return side(split_features(spark, sf_dir), "test")


def train_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return side(split_features(spark, sf_dir), "train")


def scored(spark: SparkSession, sf_dir: str, scorer=None) -> DataFrame:
    """The test side with a rule score and its flag."""
    return apply_scorer(test_side(spark, sf_dir), scorer_a() if scorer is None else scorer)


def text_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns as the text a file would hold."""
    tx = transactions(spark, sf_dir)
    text = {c: F.col(c).cast("string") for c in TRANSACTION_COLUMNS if c != "tx_datetime"}
    return tx.withColumns({**text, "tx_datetime": F.date_format("tx_datetime", DATETIME_FORMAT)})


def dirty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows with stray blanks, unreadable amounts and dates, and gaps.

    What goes wrong depends on hour and terminal of the row.
    """
    tx = text_transactions(spark, sf_dir)
    terminal, amount, when = F.col("terminal_id").cast("int"), F.col("tx_amount"), F.col("tx_datetime")
    hour = F.substring(when, 12, 2).cast("int")
    return tx.withColumns(
        {
            "tx_amount": F.when(terminal < 10, "abc")
            .when(terminal < 30, F.concat(F.lit("  "), amount, F.lit(" ")))
            .otherwise(amount),
            "tx_datetime": F.when(hour == 3, "bad")
            .when(hour < 8, F.concat(F.lit(" "), when))
            .otherwise(when),
            "tx_time_days": F.when(terminal > 95, "").otherwise(F.col("tx_time_days")),
            "tx_fraud": F.when(hour == 23, F.lit(None)).otherwise(F.col("tx_fraud")),
        }
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value, timestamp): readable and broken payloads by terminal."""
    typed = transactions(spark, sf_dir).withColumn("sent", F.col("tx_datetime"))
    text = typed.withColumn("tx_datetime", F.date_format("tx_datetime", DATETIME_FORMAT))
    good = F.to_json(F.struct(*TRANSACTION_COLUMNS))
    quoted = F.regexp_replace(good, '"transaction_id":([0-9]+)', '"transaction_id":"$1"')
    no_amount = F.regexp_replace(good, '"tx_amount":[-+0-9.eE]+', '"tx_amount":"abc"')
    terminal = F.col("terminal_id")
    value = (
        F.when(terminal < 5, F.lit("garbage"))
        .when(terminal < 10, quoted)
        .when(terminal < 20, no_amount)
        .when(terminal < 25, F.concat(good, F.lit(" trailing")))
        .otherwise(good)
    )
    return text.select(
        F.col("transaction_id").cast("string").alias("key"),
        value.alias("value"),
        F.col("sent").alias("timestamp"),
    )


def message_files(spark: SparkSession, sf_dir: str) -> str:
    """The raw messages as Parquet files; returns their folder."""
    path = scratch_path(spark, "messages")
    raw_messages(spark, sf_dir).write.parquet(path)
    return path
