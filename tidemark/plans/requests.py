"""Scoring of request batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import reject_empty
from tidemark.functions.scoring import DEFAULT_THRESHOLD, apply_scorer
from tidemark.schema import REQUEST_FEATURES


def impute_requests(requests: DataFrame, features=REQUEST_FEATURES) -> DataFrame:
    """Add absent feature columns as 0 and replace missing feature values by 0.

    Other columns, such as the id, keep their nulls.
    """
    absent = {c: F.lit(0) for c in features if c not in requests.columns}
    return requests.withColumns(absent).fillna(0, subset=list(features))


def score_requests(
    requests: DataFrame,
    scorer,
    threshold: float = DEFAULT_THRESHOLD,
    features=REQUEST_FEATURES,
) -> DataFrame:
    """(transaction_id, fraud_probability, fraud_prediction) per request.

    An empty batch is an error. The flag follows the threshold, never the
    model's own decision.
    """
    reject_empty(requests, "request batch")
    scored = apply_scorer(impute_requests(requests, features), scorer, threshold)
    return scored.select(
        "transaction_id",
        F.col("score").cast("double").alias("fraud_probability"),
        F.col("prediction").alias("fraud_prediction"),
    )
