"""The named queries: each takes (spark, sf_dir) and returns a DataFrame.

All of them read the whole ``events`` table through the transaction view.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checks import inputs
from tidemark.functions import cleaning, messages
from tidemark.functions.calendar import add_features, calendar_columns, fill_zero, parse_datetime
from tidemark.functions.scoring import add_latency, apply_scorer, flag
from tidemark.operators import compare, metrics, registry, resample, weights
from tidemark.operators.forest import DEPTHS, MIN_INSTANCES, SUBSETS, TREES, ForestParams, fit_forest, search_forest
from tidemark.operators.forest_nodes import forest_nodes, score_by_nodes
from tidemark.operators.ranking import dense_row_ids, first_in_order
from tidemark.operators.registry import Registry
from tidemark.operators.split import side, validation_split
from tidemark.plans.ab_test import cells_of, compare_cells, run_ab_test
from tidemark.plans.replay import replay_messages, start_paced, time_keys, time_slots
from tidemark.plans.requests import impute_requests, score_requests
from tidemark.schema import (
    DATETIME_FORMAT,
    MESSAGE_SCHEMA,
    MODEL_FEATURES,
    NUMERIC_TYPES,
    PREDICTION_FIELDS,
    TRANSACTION_COLUMNS,
)
from tidemark.session import materialize, scratch_path
from tidemark.sources import files
from tidemark.sources.models import load_model, save_model
from tidemark.sources.tables import transactions
from tidemark.sources.topics import MESSAGE_FRAME, FileSink, read_message_files
from tidemark.streaming import scoring as stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

ITERATIONS = 100
SEED = 42
#: rows of the query about the head of a replay
HEAD = 5000
#: messages a second, and seconds published at once, of the query about a paced replay
PACE, PACE_SECONDS = 1200.5, 2
DRAIN = {"availableNow": True}


def query(function: Query) -> Query:
    """Register under the function's name; a trailing _ only avoids a clash."""
    REGISTERED[function.__name__.rstrip("_")] = function
    return function


def rounded(df: DataFrame, digits: int = 10, keep=()) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(
        *[
            F.round(c, digits).alias(c) if kind == "double" and c not in keep else F.col(c)
            for c, kind in df.dtypes
        ]
    )


# --- scans ---------------------------------------------------------------


@query
def scan_parquet(spark, sf_dir):
    return transactions(spark, sf_dir)


@query
def scan_text_roundtrip(spark, sf_dir):
    path = files.write_text(inputs.text_transactions(spark, sf_dir), scratch_path(spark, "text"))
    return files.load_transactions(spark, path, "txt")


@query
def scan_csv_header_roundtrip(spark, sf_dir):
    path = files.write_csv(inputs.text_transactions(spark, sf_dir), scratch_path(spark, "csv"))
    return files.read_csv(spark, path)


# --- cleaning and features ----------------------------------------------


def _trimmed(spark, sf_dir):
    return cleaning.trim_all(inputs.dirty_transactions(spark, sf_dir))


@query
def clean_trim(spark, sf_dir):
    return _trimmed(spark, sf_dir)


@query
def clean_cast(spark, sf_dir):
    df = _trimmed(spark, sf_dir)
    return df.select([cleaning.number_column(df, c).alias(c) for c in NUMERIC_TYPES])


@query
def clean_timestamp(spark, sf_dir):
    parsed = parse_datetime(F.col("tx_datetime")).alias("tx_datetime")
    return _trimmed(spark, sf_dir).select("transaction_id", parsed)


@query
def clean_datetime_string(spark, sf_dir):
    df = _trimmed(spark, sf_dir)
    return df.select("transaction_id", cleaning.canonical_datetime(df).alias("tx_datetime"))


@query
def clean_required(spark, sf_dir):
    return cleaning.clean_batch(_trimmed(spark, sf_dir))


@query
def clean_replay(spark, sf_dir):
    return cleaning.clean_replay(_trimmed(spark, sf_dir))


@query
def fill_zero_(spark, sf_dir):
    df = _trimmed(spark, sf_dir)
    amount = cleaning.number_column(df, "tx_amount")
    gaps = F.coalesce(amount, F.lit(float("nan"))).alias("tx_amount")
    rest = [cleaning.number_column(df, c).alias(c) for c in ("tx_time_seconds", "tx_time_days")]
    return fill_zero(df.select("transaction_id", gaps, *rest))


@query
def class_distribution(spark, sf_dir):
    return weights.class_counts(inputs.split_features(spark, sf_dir), ("split", "tx_fraud"))


@query
def time_features(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return tx.select("transaction_id", "tx_datetime").withColumns(calendar_columns(F.col("tx_datetime"))).drop("tx_datetime")


@query
def features_batch(spark, sf_dir):
    return inputs.featured(spark, sf_dir).select("transaction_id", "tx_fraud", *MODEL_FEATURES)


@query
def features_stream(spark, sf_dir):
    parsed = messages.parse_messages(inputs.raw_messages(spark, sf_dir))
    return add_features(parsed).select("message_key", "transaction_id", "tx_timestamp", *MODEL_FEATURES)


@query
def request_impute(spark, sf_dir):
    tx = transactions(spark, sf_dir).withColumn("tx_hour", F.when(F.col("terminal_id") > 50, F.hour("tx_datetime")))
    requests = tx.select("transaction_id", "customer_id", "terminal_id", "tx_amount", "tx_time_seconds", "tx_time_days", "tx_hour")
    return impute_requests(requests)


@query
def latency_seconds(spark, sf_dir):
    sent = transactions(spark, sf_dir).withColumn("kafka_timestamp", F.col("tx_datetime"))
    done = F.timestamp_seconds(F.unix_seconds("kafka_timestamp") + F.col("terminal_id"))
    return add_latency(sent, done).select("transaction_id", "latency_seconds")


# --- messages -------------------------------------------------------------


@query
def json_parse(spark, sf_dir):
    parsed = messages.parse_messages(inputs.raw_messages(spark, sf_dir))
    return parsed.select("message_key", *TRANSACTION_COLUMNS)


def _parsed_back(sent: DataFrame) -> DataFrame:
    return sent.withColumn("payload", F.from_json("value", MESSAGE_SCHEMA)).select("key", "payload.*")


@query
def json_roundtrip(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    text = tx.withColumn("tx_datetime", F.date_format("tx_datetime", DATETIME_FORMAT))
    return _parsed_back(messages.to_messages(text))


def _scored_messages(spark, sf_dir):
    parsed = messages.valid_messages(messages.parse_messages(inputs.raw_messages(spark, sf_dir)))
    done = F.timestamp_seconds(F.unix_seconds("kafka_timestamp") + 90)
    return stream.score_messages(parsed, inputs.scorer_a(), processed_at=done)


@query
def prediction_envelope(spark, sf_dir):
    scored = _scored_messages(spark, sf_dir)
    kinds = dict(scored.dtypes)
    payload = ", ".join(f"{c} {kinds[c]}" for c in PREDICTION_FIELDS)
    sent = messages.prediction_envelope(scored)
    return sent.withColumn("payload", F.from_json("value", payload)).select("key", "payload.*")


@query
def dead_letter_envelope(spark, sf_dir):
    invalid = messages.invalid_messages(messages.parse_messages(inputs.raw_messages(spark, sf_dir)))
    sent = messages.dead_letter_envelope(invalid)
    return sent.select("key", F.from_json("value", "raw_payload string, error_message string").alias("p")).select("key", "p.*")


# --- split, order ------------------------------------------------------------


@query
def stratified_split(spark, sf_dir):
    return inputs.split_features(spark, sf_dir).select("transaction_id", "tx_fraud", "split")


@query
def split_quota_summary(spark, sf_dir):
    split = inputs.split_features(spark, sf_dir)
    by_class = split.groupBy("tx_fraud").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
    )
    return by_class


@query
def validation_split_(spark, sf_dir):
    inner = validation_split(inputs.train_side(spark, sf_dir))
    return inner.select("transaction_id", "tx_fraud", "split")


@query
def dense_row_id(spark, sf_dir):
    scored = inputs.scored(spark, sf_dir).select(
        "transaction_id", F.col("tx_fraud").alias("y_true"), F.col("prediction").alias("y_pred")
    )
    return dense_row_ids(scored, [F.col("transaction_id")])


@query
def replay_first_n(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return first_in_order(tx, time_keys(tx), HEAD)


@query
def replay_slots(spark, sf_dir):
    return time_slots(transactions(spark, sf_dir)).select("transaction_id", "seq", "slot")


def _as_sent(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return tx.withColumn("tx_datetime", F.date_format("tx_datetime", DATETIME_FORMAT))


@query
def replay_messages_(spark, sf_dir):
    """One named batch, written twice by a job that is repeated, and read back."""
    sink = FileSink(scratch_path(spark, "batches"))
    for _ in range(2):
        sink.write_batch(replay_messages(_as_sent(spark, sf_dir)), stream.INPUT_TOPIC, "replay")
    return _parsed_back(sink.read_batches(spark))


@query
def replay_paced(spark, sf_dir):
    """All rows through a paced stream: the span each one was published in, and what was sent."""
    sink = FileSink(scratch_path(spark, "paced-topic"))
    fast = {"processingTime": "0 seconds"}
    replay = start_paced(_as_sent(spark, sf_dir), sink, stream.INPUT_TOPIC, scratch_path(spark, "offsets"), PACE, PACE_SECONDS, trigger=fast)
    replay.finish()
    sent = sink.read_batches(spark).withColumn("payload", F.from_json("value", MESSAGE_SCHEMA))
    return sent.select(F.col("batch").cast("int").alias("span"), "key", "payload.*")


# --- weights and metrics -------------------------------------------------------


@query
def class_weights(spark, sf_dir):
    return weights.weight_table(inputs.train_side(spark, sf_dir))


@query
def weighted_rows(spark, sf_dir):
    weighted, _ = weights.add_class_weights(inputs.train_side(spark, sf_dir))
    return weighted.select("transaction_id", "tx_fraud", "class_weight")


@query
def threshold_flag(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return tx.select("transaction_id", flag(inputs.scorer_a()).alias("prediction"))


@query
def confusion(spark, sf_dir):
    return metrics.confusion(inputs.scored(spark, sf_dir))


@query
def precision_recall(spark, sf_dir):
    rated = metrics.with_rates(metrics.confusion(inputs.scored(spark, sf_dir)))
    return rated.select("fraud_precision", "fraud_recall")


@query
def fraud_f1(spark, sf_dir):
    return rounded(metrics.with_rates(metrics.confusion(inputs.scored(spark, sf_dir))).select("fraud_f1"))


@query
def auc_roc(spark, sf_dir):
    return rounded(metrics.evaluate(inputs.scored(spark, sf_dir)).select("auc"))


@query
def auc_pr(spark, sf_dir):
    return rounded(metrics.evaluate(inputs.scored(spark, sf_dir)).select("pr_auc"))


@query
def accuracy(spark, sf_dir):
    return rounded(metrics.class_scores(inputs.scored(spark, sf_dir)).select("accuracy"))


@query
def weighted_f1(spark, sf_dir):
    return rounded(metrics.class_scores(inputs.scored(spark, sf_dir)).select(F.col("f1").alias("weighted_f1")))


@query
def evaluate_scores(spark, sf_dir):
    """Few distinct scores, so nearly every score group is a tie."""
    return rounded(metrics.evaluate(inputs.scored(spark, sf_dir, inputs.scorer_b())))


# --- resampling and comparison -----------------------------------------------


def _predictions(spark, sf_dir, scorer):
    scored = inputs.scored(spark, sf_dir, scorer).select(
        "transaction_id", F.col("tx_fraud").alias("y_true"), F.col("prediction").alias("y_pred")
    )
    return dense_row_ids(scored, [F.col("transaction_id")])


def _cells(spark, sf_dir):
    """Cells of both rule scorers on the test side."""
    test = materialize(inputs.test_side(spark, sf_dir).select("tx_amount", "tx_hour", "tx_fraud"), "test")
    return [cells_of(apply_scorer(test, s)) for s in (inputs.scorer_a(), inputs.scorer_b())]


def _stats(spark, cells):
    counts = resample.bootstrap_by_cells(spark, cells, ITERATIONS, SEED)
    return resample.replicate_stats(resample.replicate_scores(counts))


def _comparison(spark, sf_dir):
    stats = [_stats(spark, cells) for cells in _cells(spark, sf_dir)]
    return compare.compare(*stats, metrics=resample.SCORES)


@query
def bootstrap_join(spark, sf_dir):
    return resample.bootstrap_by_rows(_predictions(spark, sf_dir, inputs.scorer_a()), ITERATIONS, SEED)


@query
def bootstrap_cells(spark, sf_dir):
    return resample.bootstrap_by_cells(spark, _cells(spark, sf_dir)[0], ITERATIONS, SEED)


@query
def bootstrap_scores(spark, sf_dir):
    counts = resample.bootstrap_by_cells(spark, _cells(spark, sf_dir)[0], ITERATIONS, SEED)
    return rounded(resample.replicate_scores(counts).orderBy("iter_id"))


@query
def replicate_stats(spark, sf_dir):
    return rounded(_stats(spark, _cells(spark, sf_dir)[0]))


@query
def welch_t(spark, sf_dir):
    return rounded(_comparison(spark, sf_dir).select("metric", "t_statistic", "degrees"), 6)


@query
def welch_p(spark, sf_dir):
    return rounded(_comparison(spark, sf_dir).select("metric", "p_value", "is_significant"), 8)


@query
def effect_size(spark, sf_dir):
    return rounded(_comparison(spark, sf_dir).select("metric", "effect_size"), 8)


@query
def model_improvement(spark, sf_dir):
    return rounded(_comparison(spark, sf_dir).select("metric", "base_mean", "candidate_mean", "improvement"))


@query
def verdict_label(spark, sf_dir):
    return _comparison(spark, sf_dir).select("metric", "verdict")


@query
def deploy_decision(spark, sf_dir):
    return compare.decide(_comparison(spark, sf_dir)).select("should_deploy")


@query
def ab_test(spark, sf_dir):
    """Both scorers on the test side: cells, replicates, test and decision."""
    return rounded(compare_cells(spark, *_cells(spark, sf_dir), iterations=ITERATIONS, seed=SEED), 6)


# --- models ------------------------------------------------------------------


@query
def score_requests_(spark, sf_dir):
    tx = transactions(spark, sf_dir).drop("tx_fraud", "tx_fraud_scenario", "tx_datetime")
    return score_requests(tx, inputs.scorer_a(), threshold=0.75)


@query
def fit_forest_(spark, sf_dir):
    model, found = fit_forest(inputs.train_side(spark, sf_dir))
    importances = [(c, float(v)) for c, v in zip(MODEL_FEATURES, model.stages[-1].featureImportances.toArray())]
    table = spark.createDataFrame(importances, "feature string, importance double")
    return table.withColumns({k: F.lit(v) for k, v in found.as_dict().items()})


def _model(spark, sf_dir):
    return fit_forest(inputs.train_side(spark, sf_dir))[0]


@query
def score_forest(spark, sf_dir):
    split = materialize(inputs.split_features(spark, sf_dir).select("transaction_id", "split", "tx_fraud", *MODEL_FEATURES), "split")
    model, _ = fit_forest(side(split, "train"))
    return apply_scorer(side(split, "test"), model).select("transaction_id", "score", "prediction")


@query
def score_forest_check(spark, sf_dir):
    """How many test rows the default forest scores, and how many scores and flags are in order."""
    split = materialize(inputs.split_features(spark, sf_dir).select("transaction_id", "split", "tx_fraud", *MODEL_FEATURES), "split")
    scored = apply_scorer(side(split, "test"), fit_forest(side(split, "train"))[0])
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("score").between(0, 1)).alias("in_range"),
        F.count_if((F.col("prediction") == 1) == (F.col("score") >= 0.5)).alias("flags_agree"),
    )


@query
def fit_forest_layout(spark, sf_dir):
    """The same forest from two layouts of the training side: equal scores on the test side."""
    train, test = inputs.train_side(spark, sf_dir), inputs.test_side(spark, sf_dir)
    models = [fit_forest(train.repartition(n))[0] for n in (3, 7)]
    return _agreement(*[apply_scorer(test, model) for model in models])


@query
def stored_forest(spark, sf_dir):
    """Scores of a model after storing and loading it."""
    path = save_model(_model(spark, sf_dir), scratch_path(spark, "model"))
    return apply_scorer(inputs.test_side(spark, sf_dir), load_model(path)).select("transaction_id", "score", "prediction")


def _agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """How many transactions both frames score, and how many of them alike."""
    both = one.join(two.select("transaction_id", F.col("score").alias("again")), "transaction_id")
    alike = F.count_if((F.col("score") == F.col("again")) & F.col("score").between(0, 1))
    return both.agg(F.count(F.lit(1)).alias("rows"), alike.alias("equal_scores"))


@query
def stored_forest_agrees(spark, sf_dir):
    """A stored and reloaded model scores the test side as before."""
    model, test = _model(spark, sf_dir), inputs.test_side(spark, sf_dir)
    again = load_model(save_model(model, scratch_path(spark, "model")))
    return _agreement(apply_scorer(test, model), apply_scorer(test, again))


@query
def forest_nodes_agree(spark, sf_dir):
    """Scores of a stored forest by walking its table of nodes, against the fitted, the loaded and the streaming model."""
    model = _model(spark, sf_dir)
    path = save_model(model, scratch_path(spark, "model"))
    nodes = forest_nodes(spark, path)
    test = materialize(inputs.test_side(spark, sf_dir).select("transaction_id", *MODEL_FEATURES), "test")
    walked = materialize(score_by_nodes(test, nodes, MODEL_FEATURES).select("transaction_id", "score"), "walked")
    raw = inputs.message_files(spark, sf_dir)
    valid = [messages.valid_messages(messages.parse_messages(m)) for m in (read_message_files(spark, raw), spark.read.schema(MESSAGE_FRAME).parquet(raw))]
    streamed = _drained(spark, stream.score_messages(valid[0], model).select("transaction_id", "score"))
    sent = score_by_nodes(add_features(valid[1]), nodes, MODEL_FEATURES).select("transaction_id", "score")
    sides = {"fitted": (apply_scorer(test, model), walked), "loaded": (apply_scorer(test, load_model(path)), walked), "streamed": (streamed, sent)}
    found = [_agreement(a, b).withColumn("model", F.lit(name)) for name, (a, b) in sides.items()]
    return reduce(DataFrame.unionByName, found)


@query
def ab_test_stored(spark, sf_dir):
    """Two stored forests found by alias, tested, and the winner promoted; what the result holds is checked.

    Replicates of both sides, those with scores from 0 to 1, means that the comparison
    took from them, scores of the loaded champion that are those of the fitted one,
    and whether the champion afterwards is the one the decision names.
    """
    split = materialize(inputs.split_features(spark, sf_dir), "split")
    registry, models = Registry(spark, scratch_path(spark, "registry")), []
    for number, size in enumerate((ForestParams(numTrees=2, maxDepth=1), ForestParams(numTrees=10, maxDepth=6))):
        models.append(fit_forest(side(split, "train"), size)[0])
        registry.register("card", save_model(models[-1], scratch_path(spark, f"model-{number}")))
    path = scratch_path(spark, "table") + ".parquet"
    transactions(spark, sf_dir).write.parquet(path)
    loaded, test = registry.load("card"), side(split, "test")
    result = run_ab_test(spark, path, registry, "card", iterations=ITERATIONS, auto_deploy=True, seed=SEED)
    score = [F.col(c).between(0, 1) for c in resample.SCORES]
    kept = result.replicates.agg(
        F.count("*").alias("replicates"),
        F.count_if(score[0] & score[1] & score[2]).alias("in_range"),
    )
    means = result.replicates.unpivot(["side"], list(resample.SCORES), "metric", "value").groupBy("metric").pivot("side", ["champion", "challenger"]).avg("value")
    alike = (F.abs(F.col("champion") - F.col("base_mean")) < 1e-9) & (F.abs(F.col("challenger") - F.col("candidate_mean")) < 1e-9)
    compared = result.comparison.join(means, "metric").agg(F.count_if(alike).alias("means_agree"))
    same = _agreement(apply_scorer(test, models[0]), apply_scorer(test, loaded))
    now = registry.resolve("card", "champion")
    right = now == (2 if result.should_deploy else 1) and result.promoted == (2 if result.should_deploy else None)
    numbers = {c: F.lit(v) for frame in (kept, compared, same) for c, v in frame.first().asDict().items()}
    return spark.range(1).select(*[v.alias(c) for c, v in numbers.items()], F.lit(right).alias("promoted_as_decided"))


@query
def tune_trials_check(spark, sf_dir):
    """The search's default number of trials, those inside the space, different ones, and whether the best is the maximum."""
    best, score, trials = search_forest(inputs.train_side(spark, sf_dir))
    inside = F.col("numTrees").isin(*TREES) & F.col("maxDepth").isin(*DEPTHS) & F.col("minInstancesPerNode").isin(*MIN_INSTANCES) & F.col("featureSubsetStrategy").isin(*SUBSETS)
    params = ("numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy")
    chosen = reduce(lambda a, b: a & b, [F.col(c) == best.as_dict()[c] for c in params], F.col("fraud_f1") == score)
    rates = [F.col(c).between(0, 1) for c in ("fraud_f1", "fraud_precision", "fraud_recall", "auc", "pr_auc", "weighted_f1")]
    return trials.agg(
        F.count("*").alias("trials"),
        F.count_if(inside).alias("in_space"),
        F.count_if(reduce(lambda a, b: a & b, rates)).alias("in_range"),
        (F.max("fraud_f1") == score).alias("best_is_maximum"),
        F.bool_or(chosen).alias("best_is_a_trial"),
    )


@query
def tune_trials(spark, sf_dir):
    return search_forest(inputs.train_side(spark, sf_dir))[2]


# --- run log and aliases --------------------------------------------------------

RUN_METRICS = ("tp", "fp", "tn", "fn", "fraud_precision", "fraud_recall")


@query
def run_log_pivot(spark, sf_dir):
    """One run per day: metrics appended in long form, then read as columns."""
    scored = apply_scorer(inputs.featured(spark, sf_dir), inputs.scorer_a())
    cells = scored.groupBy("tx_time_days").agg(*[e.alias(n) for n, e in metrics.cell_counts().items()])
    rated = metrics.with_rates(cells).select(
        F.concat(F.lit("day-"), F.col("tx_time_days")).alias("run_id"),
        F.lit("metric").alias("kind"),
        *[F.col(c).cast("double").alias(c) for c in RUN_METRICS],
    )
    log = rated.unpivot(["run_id", "kind"], list(RUN_METRICS), "name", "value")
    stored = materialize(log.withColumn("value", F.col("value").cast("string")), "runs")
    return rounded(registry.pivot_runs(stored, RUN_METRICS))


def _registrations(spark, sf_dir):
    """One model per customer, one version per transaction."""
    return transactions(spark, sf_dir).select(
        F.concat(F.lit("model-"), F.col("customer_id")).alias("model"),
        F.col("transaction_id").alias("version"),
        F.col("transaction_id").alias("event_seq"),
    )


def _alias_events(spark, sf_dir):
    return materialize(registry.alias_registrations(_registrations(spark, sf_dir)), "aliases")


@query
def register_alias(spark, sf_dir):
    return registry.alias_registrations(_registrations(spark, sf_dir))


@query
def resolve_alias(spark, sf_dir):
    return registry.current_aliases(_alias_events(spark, sf_dir))


@query
def promote_alias(spark, sf_dir):
    """Models that had a large transaction win; their challenger is promoted."""
    events = _alias_events(spark, sf_dir)
    winners = transactions(spark, sf_dir).filter("tx_amount >= 200").select(
        F.concat(F.lit("model-"), F.col("customer_id")).alias("model")
    )
    last = events.agg(F.max("event_seq")).first()[0]
    won = registry.promotions(registry.current_aliases(events), winners, last + 1)
    return registry.current_aliases(events.unionByName(won))


# --- streams -------------------------------------------------------------------


def _drained(spark, frame: DataFrame) -> DataFrame:
    """Run a stream over everything available into files and read those."""
    path = scratch_path(spark, "stream")
    writer = frame.writeStream.format("parquet").outputMode("append").trigger(**DRAIN)
    writer.option("checkpointLocation", f"{path}-checkpoint").start(path).awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


def _stream(spark, sf_dir):
    return read_message_files(spark, inputs.message_files(spark, sf_dir))


@query
def stream_source_rows(spark, sf_dir):
    return _drained(spark, _stream(spark, sf_dir))


@query
def stream_parse(spark, sf_dir):
    parsed = _drained(spark, messages.parse_messages(_stream(spark, sf_dir)))
    return parsed.select("message_key", "kafka_timestamp", *TRANSACTION_COLUMNS)


@query
def stream_valid(spark, sf_dir):
    valid = messages.valid_messages(messages.parse_messages(_stream(spark, sf_dir)))
    return _drained(spark, valid).select("message_key", "transaction_id")


@query
def stream_dead_letter(spark, sf_dir):
    invalid = messages.invalid_messages(messages.parse_messages(_stream(spark, sf_dir)))
    sent = _drained(spark, messages.dead_letter_envelope(invalid))
    return sent.select("key", F.from_json("value", "raw_payload string, error_message string").alias("p")).select("key", "p.*")


@query
def stream_features(spark, sf_dir):
    valid = messages.valid_messages(messages.parse_messages(_stream(spark, sf_dir)))
    return _drained(spark, add_features(valid)).select("transaction_id", *MODEL_FEATURES)


@query
def stream_scored(spark, sf_dir):
    """Both topics written by one routed query, the prediction side parsed back."""
    sink, path = FileSink(scratch_path(spark, "topics")), scratch_path(spark, "offsets")
    for running in stream.start_routed(_stream(spark, sf_dir), inputs.scorer_a(), sink, path, trigger=DRAIN):
        running.awaitTermination()
    written = spark.read.schema("key string, value string, topic string").parquet(sink.root)
    kinds = {**dict(_scored_messages(spark, sf_dir).dtypes), "raw_payload": "string", "error_message": "string", "failed_at": "timestamp"}
    payload = ", ".join(f"{c} {kinds[c]}" for c in (*PREDICTION_FIELDS, "raw_payload", "error_message", "failed_at"))
    parsed = written.select("topic", "key", F.from_json("value", payload).alias("p")).select("topic", "key", "p.*")
    # clocks are read when the stream runs
    clocks = ("processed_at", "latency_seconds", "failed_at")
    return parsed.select(*[F.col(c).isNotNull().alias(f"has_{c}") if c in clocks else F.col(c) for c in parsed.columns])


@query
def stream_branches(spark, sf_dir):
    """Rows per topic written by two independent queries."""
    sink, path = FileSink(scratch_path(spark, "topics")), scratch_path(spark, "offsets")
    started = stream.start_branches(_stream(spark, sf_dir), inputs.scorer_a(), sink, path, trigger=DRAIN)
    for running in started:
        running.awaitTermination()
    written = spark.read.schema("key string, value string, topic string").parquet(sink.root)
    return written.groupBy("topic").agg(F.count(F.lit(1)).alias("rows"))


@query
def stream_scored_forest(spark, sf_dir):
    model = _model(spark, sf_dir)
    valid = messages.valid_messages(messages.parse_messages(_stream(spark, sf_dir)))
    scored = stream.score_messages(valid, model)
    return _drained(spark, scored.select("transaction_id", "score", "prediction"))


@query
def stream_forest_agrees(spark, sf_dir):
    """The forest scores a stream as it scores the same messages in batch."""
    model, path = _model(spark, sf_dir), inputs.message_files(spark, sf_dir)
    batch = spark.read.schema(MESSAGE_FRAME).parquet(path)
    streamed, stored = (
        stream.score_messages(messages.valid_messages(messages.parse_messages(raw)), model).select("transaction_id", "score")
        for raw in (read_message_files(spark, path), batch)
    )
    return _agreement(_drained(spark, streamed), stored)
