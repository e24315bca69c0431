"""Calendar features and zero filling, shared by batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import DATETIME_FORMAT, MODEL_FEATURES


def parse_datetime(text: Column) -> Column:
    """Strict parse of the fixed pattern; anything else becomes null."""
    return F.try_to_timestamp(text, F.lit(DATETIME_FORMAT))


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Hour, weekday (1 = Sunday), month and weekend flag of a timestamp.

    A null timestamp gives null fields and a weekend flag of 0.
    """
    weekday = F.dayofweek(ts)
    return {
        "tx_hour": F.hour(ts),
        "tx_day_of_week": weekday,
        "tx_month": F.month(ts),
        "is_weekend": F.when(weekday.isin(1, 7), 1).otherwise(0),
    }


def fill_zero(df: DataFrame, columns=MODEL_FEATURES) -> DataFrame:
    """Null and NaN to 0 in the listed columns that exist."""
    return df.fillna(0, subset=[c for c in columns if c in df.columns])


def add_features(df: DataFrame) -> DataFrame:
    """Calendar features of ``tx_datetime``, then zeros for what is absent.

    Text timestamps (messages) stay as they are and the parsed value is added
    as ``tx_timestamp``; typed ones (tables) are used directly.
    """
    if dict(df.dtypes)["tx_datetime"] == "string":
        df = df.withColumn("tx_timestamp", parse_datetime(F.col("tx_datetime")))
        ts = F.col("tx_timestamp")
    else:
        ts = F.col("tx_datetime")
    return fill_zero(df.withColumns(calendar_columns(ts)))
