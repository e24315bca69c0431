"""Command line jobs, one per plan; also usable as a spark-submit script.

    python -m tidemark.jobs train --input tx.txt --output models/1 --registry reg --model card
    python -m tidemark.jobs ab-test --input tx.txt --registry reg --model card --auto-deploy
    python -m tidemark.jobs replay --input tx.txt --servers host:9091 --username u --topic t
    python -m tidemark.jobs score-stream --registry reg --model card --checkpoint c --servers host:9091 --username u
    python -m tidemark.jobs score-requests --input requests.parquet --output answers --registry reg --model card

The broker password is read from BROKER_PASSWORD unless given.
"""

from __future__ import annotations

import argparse
import os

from tidemark.operators.forest import DEFAULT_TRIALS
from tidemark.operators.registry import Registry
from tidemark.plans import replay as replay_plan
from tidemark.plans.ab_test import run_ab_test
from tidemark.plans.requests import score_requests
from tidemark.plans.training import MODES, train_model
from tidemark.schema import CHAMPION
from tidemark.session import drop_scratch, session_builder
from tidemark.sources.models import feature_columns
from tidemark.sources.topics import Broker, TopicSink, read_topic
from tidemark.streaming import scoring as stream


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *groups) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        for group in groups:
            group(sub)
        return sub

    def stored(sub):
        by_suffix(sub)
        sub.add_argument("--input-format", default="auto", choices=["auto", "txt", "parquet"])

    def by_suffix(sub):
        sub.add_argument("--input", required=True)
        for key in ("endpoint-url", "access-key", "secret-key"):
            sub.add_argument(f"--s3-{key}")

    def versions(sub):
        sub.add_argument("--registry", required=True)
        sub.add_argument("--model", required=True)

    def broker(sub):
        sub.add_argument("--servers", required=True)
        sub.add_argument("--username", required=True)
        sub.add_argument("--password", default=os.environ.get("BROKER_PASSWORD", ""))

    train = job("train", stored)
    train.add_argument("--output", required=True)
    train.add_argument("--mode", default="baseline", choices=MODES)
    train.add_argument("--trials", type=int, default=DEFAULT_TRIALS)
    train.add_argument("--registry")
    train.add_argument("--model", help="register the model under this name")

    ab = job("ab-test", stored, versions)
    ab.add_argument("--iterations", type=int, default=100)
    ab.add_argument("--alpha", type=float, default=0.01)
    ab.add_argument("--auto-deploy", action="store_true")

    replay = job("replay", by_suffix, broker)
    replay.add_argument("--topic", default=stream.INPUT_TOPIC)
    replay.add_argument("--key-column", default="transaction_id")
    replay.add_argument("--max-messages", type=int, help="stop after so many; all messages if not given")
    replay.add_argument("--rate", type=float, help="messages a second, paced by a stream; one batch if not given")
    replay.add_argument("--every", type=int, default=1, help="seconds that a paced replay publishes at once")
    replay.add_argument("--checkpoint", help="where a paced replay keeps how far it came")

    score = job("score-stream", versions, broker)
    score.add_argument("--alias", default=CHAMPION)
    score.add_argument("--input-topic", default=stream.INPUT_TOPIC)
    score.add_argument("--output-topic", default=stream.PREDICTION_TOPIC)
    score.add_argument("--dead-letter-topic", default=stream.DEAD_LETTER_TOPIC)
    score.add_argument("--checkpoint", required=True)
    score.add_argument("--trigger-seconds", type=int, default=15)
    score.add_argument("--stop-after-seconds", type=int, default=stream.DEFAULT_RUN_SECONDS)
    score.add_argument("--max-offsets", type=int, help="bound of one micro-batch")
    score.add_argument("--features", help="comma-separated; those of the model if not given")
    score.add_argument("--separate-queries", action="store_true", help="one query per topic, each reading the source")

    requests = job("score-requests", by_suffix, versions)
    requests.add_argument("--output", required=True)
    requests.add_argument("--alias", default=CHAMPION)
    requests.add_argument("--threshold", type=float, default=float(os.environ.get("SCORE_THRESHOLD", "0.5")))
    requests.add_argument("--features", help="comma-separated; those of the model if not given")
    return parser


def _features(args, model) -> list[str]:
    if args.features:
        return [name.strip() for name in args.features.split(",") if name.strip()]
    return feature_columns(model)


def _s3(args) -> dict[str, str]:
    given = {k: getattr(args, f"s3_{k}", None) for k in ("endpoint_url", "access_key", "secret_key")}
    return {k: v for k, v in given.items() if v}


def _loaded(registry: Registry, args):
    model = registry.load(args.model, args.alias)
    if model is None:
        raise SystemExit(f"no version of {args.model!r} has the alias {args.alias!r}")
    return model


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = session_builder(f"tidemark-{args.job}", _s3(args)).getOrCreate()
    try:
        run(args, spark)
    finally:
        drop_scratch(spark)
        spark.stop()


def run(args, spark) -> None:
    registry = Registry(spark, args.registry) if getattr(args, "registry", None) else None

    if args.job == "train":
        result = train_model(
            spark, args.input, args.output, args.input_format, args.mode, args.trials, registry, args.model
        )
        print(result)
    elif args.job == "ab-test":
        result = run_ab_test(
            spark,
            args.input,
            registry,
            args.model,
            args.input_format,
            args.iterations,
            args.alpha,
            args.auto_deploy,
        )
        if result is None:
            print("skipped: champion or challenger is missing")
        else:
            result.comparison.show(truncate=False)
            print(f"should_deploy={result.should_deploy} promoted={result.promoted}")
    elif args.job == "replay":
        broker = Broker(args.servers, args.username, args.password)
        what = (spark, args.input, TopicSink(broker), args.topic, args.key_column, args.max_messages)
        if args.rate is None:
            replay_plan.replay_to_topic(*what)
        else:
            replay_plan.paced_to_topic(*what, args.rate, args.every, args.checkpoint)
    elif args.job == "score-stream":
        broker = Broker(args.servers, args.username, args.password)
        model = _loaded(registry, args)
        start = stream.start_branches if args.separate_queries else stream.start_routed
        queries = start(
            read_topic(spark, broker, args.input_topic, args.max_offsets),
            model,
            TopicSink(broker),
            args.checkpoint,
            _features(args, model),
            {"processingTime": f"{args.trigger_seconds} seconds"},
            prediction_topic=args.output_topic,
            dead_letter_topic=args.dead_letter_topic,
        )
        stream.run_bounded(queries, args.stop_after_seconds)
    else:
        model = _loaded(registry, args)
        answers = score_requests(spark.read.parquet(args.input), model, args.threshold, _features(args, model))
        answers.write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
