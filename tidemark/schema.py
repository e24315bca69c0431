"""The transaction data model: column order, types and vocabularies."""

from __future__ import annotations

# Column names, their order, formats and messages that callers
# and stored files rely on.
TRANSACTION_COLUMNS = (
    "transaction_id",
    "tx_datetime",
    "customer_id",
    "terminal_id",
    "tx_amount",
    "tx_time_seconds",
    "tx_time_days",
    "tx_fraud",
    "tx_fraud_scenario",
)
BATCH_REQUIRED = (
    "tx_datetime",
    "tx_amount",
    "tx_time_seconds",
    "tx_time_days",
    "tx_fraud",
)
REPLAY_REQUIRED = ("transaction_id",) + BATCH_REQUIRED
MODEL_FEATURES = (
    "tx_amount",
    "tx_time_seconds",
    "tx_time_days",
    "tx_hour",
    "tx_day_of_week",
    "tx_month",
    "is_weekend",
)
REQUEST_FEATURES = ("customer_id", "terminal_id") + MODEL_FEATURES
LABEL = "tx_fraud"
WEIGHT = "class_weight"
DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
COMMENT_MARK = "#"
DEAD_LETTER_REASON = "transaction_id is null or JSON parse failed"
PREDICTION_FIELDS = (
    "transaction_id",
    "tx_datetime",
    "customer_id",
    "terminal_id",
    "tx_amount",
    "tx_time_seconds",
    "tx_time_days",
    "tx_hour",
    "tx_day_of_week",
    "tx_month",
    "is_weekend",
    "score",
    "prediction",
    "tx_fraud",
    "processed_at",
    "kafka_timestamp",
    "latency_seconds",
)
CHAMPION = "champion"
CHALLENGER = "challenger"

#: numeric column -> Spark type, for text input that has to be cast
NUMERIC_TYPES = {
    "transaction_id": "long",
    "customer_id": "long",
    "terminal_id": "long",
    "tx_amount": "double",
    "tx_time_seconds": "long",
    "tx_time_days": "int",
    "tx_fraud": "int",
    "tx_fraud_scenario": "int",
}

#: headerless text: every field arrives as a string
TEXT_SCHEMA = ", ".join(f"{c} string" for c in TRANSACTION_COLUMNS)

#: what one JSON message holds; the timestamp travels as text
MESSAGE_SCHEMA = ", ".join(f"{c} {NUMERIC_TYPES.get(c, 'string')}" for c in TRANSACTION_COLUMNS)

REQUEST_SCHEMA = (
    "transaction_id long, customer_id long, terminal_id long, tx_amount double, "
    "tx_time_seconds long, tx_time_days int, tx_hour int, tx_day_of_week int, "
    "tx_month int, is_weekend int"
)


def missing_columns(have, need) -> list[str]:
    """Needed names that are absent, sorted."""
    return sorted(set(need).difference(have))


def require_columns(df, need, what: str = "input"):
    """Return ``df`` unchanged, or raise naming every absent column."""
    absent = missing_columns(df.columns, need)
    if absent:
        raise ValueError(f"{what} lacks required columns: {absent}")
    return df
