"""Trimming, safe casts and required-value filters as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import parse_datetime
from tidemark.schema import (
    BATCH_REQUIRED,
    DATETIME_FORMAT,
    NUMERIC_TYPES,
    REPLAY_REQUIRED,
    require_columns,
)

#: sign, whole digits, then a fraction to cut off
WHOLE_WITH_FRACTION = r"^\s*([+-]?)(\d*)\.\d*\s*$"


def trim_all(df: DataFrame) -> DataFrame:
    """Strip blanks around every column, in one projection."""
    return df.select([F.trim(F.col(c).cast("string")).alias(c) for c in df.columns])


def number_column(df: DataFrame, name: str) -> Column:
    """The column cast to its canonical type; a bad value becomes null.

    ANSI casts raise on bad text and refuse a decimal point in a whole number.
    Stored files hold values such as ``25863.0``: where the cast of a text for
    a whole number fails, it is tried again without the fraction.
    """
    kind = NUMERIC_TYPES[name]
    value = F.col(name)
    if dict(df.dtypes)[name] == "string" and kind != "double":
        # sign, a 0 in case no digit follows, digits (there is no group 10)
        whole = F.regexp_replace(value, WHOLE_WITH_FRACTION, "$10$2")
        return F.coalesce(value.try_cast(kind), whole.try_cast(kind))
    return value.try_cast(kind)


def to_timestamp_column(df: DataFrame, name: str = "tx_datetime") -> Column:
    """Timestamp of a text or already typed column."""
    kind = dict(df.dtypes)[name]
    return parse_datetime(F.col(name)) if kind == "string" else F.col(name).cast("timestamp")


def present(columns) -> Column:
    """True where none of the columns is null. NaN counts as present."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _converted(df: DataFrame, casts: dict[str, Column]) -> DataFrame:
    """``df`` with columns replaced, each converted once.

    The values come out of a generator: a filter on them is not pushed below it,
    where it would convert them a second time.
    """
    kept = [c for c in df.columns if c not in casts]
    made = F.inline(F.array(F.struct(*[value.alias(c) for c, value in casts.items()])))
    return df.select(*kept, made).select(*df.columns)


def clean_batch(df: DataFrame) -> DataFrame:
    """Typed training input: cast what models use, drop incomplete rows.

    Identifiers keep the type they came with. NaN amounts survive here and
    become 0 in feature preparation.
    """
    require_columns(df, BATCH_REQUIRED, "transaction data")
    casts = {c: number_column(df, c) for c in BATCH_REQUIRED if c != "tx_datetime"}
    casts["tx_datetime"] = to_timestamp_column(df)
    return _converted(df, casts).filter(present(BATCH_REQUIRED))


def canonical_datetime(df: DataFrame) -> Column:
    """The timestamp written back in the fixed text pattern."""
    return F.date_format(to_timestamp_column(df), DATETIME_FORMAT)


def clean_replay(df: DataFrame) -> DataFrame:
    """Typed replay input: all numbers cast, text timestamp, NaN dropped."""
    casts = {c: number_column(df, c) for c in NUMERIC_TYPES}
    casts["tx_datetime"] = canonical_datetime(df)
    return _converted(df, casts).dropna(subset=list(REPLAY_REQUIRED))


def reject_empty(df: DataFrame, what: str) -> DataFrame:
    """Return ``df``, or raise if it has no row. Reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
