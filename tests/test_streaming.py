from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.checks import inputs
from tidemark.functions import messages
from tidemark.functions.scoring import add_latency, apply_scorer
from tidemark.operators.forest import ForestParams, fit_forest
from tidemark.schema import PREDICTION_FIELDS, REQUEST_FEATURES, TRANSACTION_COLUMNS
from tidemark.session import scratch_path
from tidemark.sources.tables import transactions
from tidemark.sources.topics import FileSink, TopicSink, Broker, read_message_files
from tidemark.streaming import scoring as S

DRAIN = {"availableNow": True}


def finish(queries):
    for q in queries:
        q.awaitTermination()


def topics(spark, root):
    return spark.read.schema("key string, value string, topic string").parquet(root)


def test_batch_equals_stream(spark):
    raw = inputs.raw_messages(spark, SMALL)
    want = messages.prediction_envelope(S.score_messages(messages.valid_messages(messages.parse_messages(raw)), inputs.scorer_a()))
    sink = FileSink(scratch_path(spark, "t"))
    finish(S.start_branches(read_message_files(spark, inputs.message_files(spark, SMALL)), inputs.scorer_a(), sink, scratch_path(spark, "c"), trigger=DRAIN))
    fields = "transaction_id long, score double, prediction int, tx_hour int, is_weekend int"
    written = topics(spark, sink.root)

    def rows(df):
        return sorted(map(tuple, df.select("key", F.from_json("value", fields).alias("p")).select("key", "p.*").collect()))

    assert rows(written.filter(F.col("topic") == S.PREDICTION_TOPIC)) == rows(want)
    assert written.count() == raw.count()


def test_routed_equals_branches(spark):
    source = inputs.message_files(spark, SMALL)
    one, two = FileSink(scratch_path(spark, "one")), FileSink(scratch_path(spark, "two"))
    finish(S.start_routed(read_message_files(spark, source), inputs.scorer_a(), one, scratch_path(spark, "c1"), trigger=DRAIN))
    finish(S.start_branches(read_message_files(spark, source), inputs.scorer_a(), two, scratch_path(spark, "c2"), trigger=DRAIN))

    def rows(root):
        body = F.regexp_replace("value", '"(processed_at|failed_at)":"[^"]*"|"latency_seconds":[0-9]+', "")
        return sorted(map(str, topics(spark, root).select("topic", "key", body).collect()))

    assert rows(one.root) == rows(two.root)


def test_routed_parses_each_payload_once(spark):
    plan = S.routed(inputs.raw_messages(spark, SMALL), inputs.scorer_a())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_restart_adds_nothing(spark):
    source, sink, offsets = inputs.message_files(spark, SMALL), FileSink(scratch_path(spark, "t")), scratch_path(spark, "c")
    for _ in range(2):
        finish(S.start_routed(read_message_files(spark, source), inputs.scorer_a(), sink, offsets, trigger=DRAIN))
    assert topics(spark, sink.root).count() == 1000


def test_model_that_skips_gaps_loses_no_dead_letter(spark):
    """With ids among the features, unreadable payloads have null features."""
    train = inputs.train_side(spark, SMALL)
    model, _ = fit_forest(train, ForestParams(numTrees=2, maxDepth=2), REQUEST_FEATURES)
    raw = inputs.raw_messages(spark, SMALL)
    out = S.routed(raw, model, REQUEST_FEATURES)
    assert out.count() == raw.count()
    dead = messages.invalid_messages(messages.parse_messages(raw)).count()
    assert out.filter(F.col("topic") == S.DEAD_LETTER_TOPIC).count() == dead


def test_unparsed_timestamp_is_scored_with_zeros(spark):
    raw = spark.createDataFrame([("1", '{"transaction_id":1,"tx_datetime":"bad","tx_amount":80}')], "key string, value string")
    parsed = messages.parse_messages(raw.withColumn("timestamp", F.current_timestamp()))
    row = S.score_messages(messages.valid_messages(parsed), inputs.scorer_a()).first()
    assert (row.tx_hour, row.tx_day_of_week, row.tx_month, row.is_weekend) == (0, 0, 0, 0)
    assert row.tx_timestamp is None and row.prediction == 1 and row.tx_datetime == "bad"


def test_missing_feature_column_is_named(spark):
    parsed = messages.parse_messages(inputs.raw_messages(spark, SMALL))
    with pytest.raises(ValueError, match="no_such"):
        S.score_messages(parsed, inputs.scorer_a(), ("tx_amount", "no_such"))


def test_envelope_field_order(spark):
    scored = S.score_messages(messages.valid_messages(messages.parse_messages(inputs.raw_messages(spark, SMALL))), inputs.scorer_a())
    value = messages.prediction_envelope(scored.filter("tx_amount > 0")).first().value
    places = [value.index(f'"{f}"') for f in PREDICTION_FIELDS]
    assert places == sorted(places)


def test_whole_second_latency(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00.9' AS kafka_timestamp")
    assert add_latency(df, F.lit("2024-01-01 00:00:02.1").cast("timestamp")).first().latency_seconds == 2


def test_bounded_run_stops_everything(spark):
    source, sink = read_message_files(spark, inputs.message_files(spark, SMALL)), FileSink(scratch_path(spark, "t"))
    queries = S.start_branches(source, inputs.scorer_a(), sink, scratch_path(spark, "c"), trigger={"processingTime": "1 second"})
    start = time.monotonic()
    S.run_bounded(queries, seconds=8)
    assert time.monotonic() - start < 30 and not any(q.isActive for q in queries)
    assert topics(spark, sink.root).count() == 1000


def test_bounded_run_raises_the_failure_of_any_branch(spark):
    source = inputs.message_files(spark, SMALL)
    fine = S.start_routed(read_message_files(spark, source), inputs.scorer_a(), FileSink(scratch_path(spark, "t")), scratch_path(spark, "c"), trigger={"processingTime": "1 second"})
    broken = S.start_routed(read_message_files(spark, source), F.raise_error(F.lit("broken scorer")).cast("double"), FileSink(scratch_path(spark, "t")), scratch_path(spark, "c"), trigger={"processingTime": "1 second"})
    with pytest.raises(Exception, match="broken scorer"):
        S.run_bounded(fine + broken, seconds=60)
    assert not any(q.isActive for q in fine + broken)


def test_topic_sink_options():
    class Writer(dict):
        def format(self, kind):
            self["format"] = kind
            return self

        def options(self, **kw):
            self.update(kw)
            return self

        def option(self, key, value):
            self[key] = value
            return self

    assert TopicSink(Broker("h", "u", "p")).attach(Writer(), "t")["topic"] == "t"
    assert "topic" not in TopicSink(Broker("h", "u", "p")).attach(Writer(), None)


def test_scores_of_stored_columns(spark):
    assert apply_scorer(transactions(spark, SMALL), inputs.scorer_a(), threshold=0.9).filter("score >= 0.9 AND prediction = 0").count() == 0
    assert len(TRANSACTION_COLUMNS) == 9
