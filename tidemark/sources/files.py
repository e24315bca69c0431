"""Transaction files: Parquet, headerless text and headered CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.cleaning import clean_batch, clean_replay, reject_empty, trim_all
from tidemark.schema import BATCH_REQUIRED, COMMENT_MARK, TEXT_SCHEMA, require_columns

REPLAY_SUFFIXES = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".txt": "txt"}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Headerless comma-separated text, nine string columns.

    Declaring the schema avoids an inference pass; short lines end in nulls,
    surplus fields are dropped, blank and comment lines are skipped.
    """
    return spark.read.csv(path, schema=TEXT_SCHEMA, header=False, sep=",", comment=COMMENT_MARK)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header line; every column stays a string."""
    return spark.read.csv(path, header=True, inferSchema=False)


def batch_format(path: str, declared: str = "auto") -> str:
    """``parquet`` or ``txt``; ``auto`` goes by the suffix."""
    kind = declared.lower()
    if kind == "auto":
        return "parquet" if path.lower().endswith(".parquet") else "txt"
    if kind not in ("parquet", "txt"):
        raise ValueError(f"unsupported input format: {declared}")
    return kind


def replay_format(path: str) -> str:
    for suffix, kind in REPLAY_SUFFIXES.items():
        if path.lower().endswith(suffix):
            return kind
    raise ValueError(f"unsupported file format: {path}")


def load_transactions(spark: SparkSession, path: str, declared: str = "auto") -> DataFrame:
    """Read and clean training input; raises when nothing is left.

    Only text is trimmed, Parquet values are taken as they are.
    """
    if batch_format(path, declared) == "parquet":
        raw = require_columns(read_parquet(spark, path), BATCH_REQUIRED, path)
    else:
        raw = trim_all(read_text(spark, path))
    return reject_empty(clean_batch(raw), "cleaned transaction data")


def load_replay(spark: SparkSession, path: str) -> DataFrame:
    """Read replay input by suffix; only text input is cleaned."""
    kind = replay_format(path)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "csv":
        return read_csv(spark, path)
    return clean_replay(trim_all(read_text(spark, path)))


def write_text(df: DataFrame, path: str) -> str:
    """Write rows in the headerless text form :func:`read_text` reads."""
    df.write.csv(path, header=False, sep=",")
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.csv(path, header=True)
    return path
