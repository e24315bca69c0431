"""Scoring of message streams.

The frame functions work on batch and stream alike; a stream is only a
different source and sink around them.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.calendar import add_features
from tidemark.functions.messages import (
    dead_letter_envelope,
    dead_letter_value,
    invalid_messages,
    is_valid,
    parse_messages,
    prediction_envelope,
    prediction_value,
    valid_messages,
)
from tidemark.functions.scoring import add_latency, apply_scorer
from tidemark.operators.forest_nodes import is_plain_forest, score_forest_rows
from tidemark.schema import MODEL_FEATURES, NUMERIC_TYPES, require_columns
from tidemark.sources.topics import start_write

# Names of the two branches, of their topics and of the input.
INPUT_TOPIC = "fraud.input.transactions"
PREDICTION_TOPIC = "fraud.output.predictions"
DEAD_LETTER_TOPIC = "fraud.dead_letter"
PREDICTIONS, DEAD_LETTERS = "predictions", "dead_letter"
DEFAULT_RUN_SECONDS = 300


def score_messages(parsed: DataFrame, scorer, features=MODEL_FEATURES, processed_at=None) -> DataFrame:
    """Features, score, flag and latency for parsed messages."""
    featured = require_columns(add_features(parsed), features, "message stream")
    scored = score_forest_rows(featured, scorer) if is_plain_forest(scorer) else apply_scorer(featured, scorer)
    return add_latency(scored, processed_at)


def branches(raw: DataFrame, scorer, features=MODEL_FEATURES) -> tuple[DataFrame, DataFrame]:
    """(predictions, dead letters) as message frames."""
    parsed = parse_messages(raw)
    scored = score_messages(valid_messages(parsed), scorer, features)
    return prediction_envelope(scored), dead_letter_envelope(invalid_messages(parsed))


def routed(
    raw: DataFrame,
    scorer,
    features=MODEL_FEATURES,
    prediction_topic: str = PREDICTION_TOPIC,
    dead_letter_topic: str = DEAD_LETTER_TOPIC,
) -> DataFrame:
    """Both branches in one frame, each row with its own topic.

    The source is read and parsed once instead of once per branch. Unreadable
    payloads pass the model with zeros in every number, so that none is skipped
    whatever columns it uses, and their score is discarded.
    """
    readable, parsed = is_valid(), parse_messages(raw)
    numbers = [c for c in NUMERIC_TYPES if c in parsed.columns and c != "transaction_id"]
    filled = {c: F.when(readable, F.col(c)).otherwise(F.lit(0).cast(dict(parsed.dtypes)[c])) for c in numbers}
    scored = score_messages(parsed.withColumns(filled), scorer, features)
    return scored.select(
        F.when(readable, F.lit(prediction_topic)).otherwise(F.lit(dead_letter_topic)).alias("topic"),
        F.col("transaction_id").cast("string").alias("key"),
        F.when(readable, prediction_value()).otherwise(dead_letter_value()).alias("value"),
    )


def start_branches(
    raw: DataFrame,
    scorer,
    sink,
    checkpoint_root: str,
    features=MODEL_FEATURES,
    trigger: Mapping | None = None,
    prediction_topic: str = PREDICTION_TOPIC,
    dead_letter_topic: str = DEAD_LETTER_TOPIC,
) -> list[StreamingQuery]:
    """Two independent queries, each with its own checkpoint.

    One branch can fail or be restarted without the other, at the price of
    reading the source twice; :func:`start_routed` reads it once.
    """
    predictions, dead_letters = branches(raw, scorer, features)
    root = checkpoint_root.rstrip("/")
    return [
        start_write(predictions, sink, f"{root}/{PREDICTIONS}", prediction_topic, trigger),
        start_write(dead_letters, sink, f"{root}/{DEAD_LETTERS}", dead_letter_topic, trigger),
    ]


def start_routed(
    raw: DataFrame,
    scorer,
    sink,
    checkpoint_root: str,
    features=MODEL_FEATURES,
    trigger: Mapping | None = None,
    **topics: str,
) -> list[StreamingQuery]:
    """One query for both branches."""
    root = checkpoint_root.rstrip("/")
    return [start_write(routed(raw, scorer, features, **topics), sink, f"{root}/routed", None, trigger)]


def run_bounded(queries: list[StreamingQuery], seconds: float = DEFAULT_RUN_SECONDS, poll: float = 0.5) -> None:
    """Let queries run at most ``seconds``; raise the first failure, stop all.

    Every query is watched, so a failing branch ends the run at once instead
    of being noticed after the other one is done.
    """
    deadline = time.monotonic() + seconds
    try:
        while time.monotonic() < deadline and any(q.isActive for q in queries):
            for query in queries:
                if query.exception() is not None:
                    raise query.exception()
            time.sleep(poll)
        for query in queries:
            if query.exception() is not None:
                raise query.exception()
    finally:
        for query in queries:
            if query.isActive:
                query.stop()
