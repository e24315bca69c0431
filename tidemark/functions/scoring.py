"""From model output to score, flag and latency."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 0.5


def flag(score: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """1 from the threshold upwards, else 0."""
    return F.when(score >= F.lit(float(threshold)), 1).otherwise(0)


def extract_score(transformed: DataFrame) -> Column:
    """Probability of class 1, or the bare prediction if there is none."""
    have = transformed.columns
    if "probability" in have:
        return vector_to_array(F.col("probability")).getItem(1).cast("double")
    if "prediction" in have:
        return F.col("prediction").cast("double")
    raise ValueError(f"model output has neither probability nor prediction: {have}")


def apply_scorer(df: DataFrame, scorer, threshold: float | None = DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``score`` and ``prediction`` to ``df``.

    ``scorer`` is a fitted model (anything with ``transform``) or a Column
    that computes the score from the features. ``threshold=None`` keeps the
    model's own class decision, which differs from 0.5 only at an exact tie.
    """
    if isinstance(scorer, Column):
        scored = df.withColumn("score", scorer)
    else:
        out = scorer.transform(df)
        scored = out.withColumn("score", extract_score(out))
        scored = scored.drop("rawPrediction", "probability", "features")
    if threshold is None and "prediction" in scored.columns:
        return scored.withColumn("prediction", F.col("prediction").cast("int"))
    cut = DEFAULT_THRESHOLD if threshold is None else threshold
    return scored.withColumn("prediction", flag(F.col("score"), cut))


def add_latency(scored: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Processing time and whole seconds since the message timestamp."""
    scored = scored.withColumn("processed_at", F.current_timestamp() if processed_at is None else processed_at)
    return scored.withColumn(
        "latency_seconds",
        F.unix_seconds(F.col("processed_at").cast("timestamp"))
        - F.unix_seconds(F.col("kafka_timestamp").cast("timestamp")),
    )
