from __future__ import annotations

import pytest

from tests.conftest import SMALL
from tidemark.checks import inputs
from tidemark import session
from tidemark.jobs import _parser
from tidemark.jobs import run as run_parsed
from tidemark.operators.forest import ForestParams
from tidemark.session import scratch_path
from tidemark.sources import files
from tidemark.sources.tables import transactions


def run(argv, spark):
    run_parsed(_parser().parse_args(argv), spark)


def test_scratch_tables_are_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_HANDED_OUT", {})
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    assert session.materialize(spark.range(5), "one").count() == 5 and len(list(tmp_path.iterdir())) == 1
    session.scratch_path(spark, "never-written")
    assert session.drop_scratch(spark) == 2 and not list(tmp_path.iterdir())


def test_train_score_and_compare(spark, monkeypatch, capsys):
    monkeypatch.setattr("tidemark.plans.training.ForestParams", lambda: ForestParams(numTrees=2, maxDepth=2))
    text = files.write_text(inputs.text_transactions(spark, SMALL), scratch_path(spark, "text"))
    names = ["--registry", scratch_path(spark, "registry"), "--model", "card"]
    for version in (1, 2):
        run(["train", "--input", text, "--input-format", "txt", "--output", scratch_path(spark, f"m{version}"), *names], spark)
    assert "challenger" in capsys.readouterr().out
    run(["ab-test", "--input", text, "--input-format", "txt", "--iterations", "10", *names], spark)
    assert "should_deploy=" in capsys.readouterr().out

    requests, answers = scratch_path(spark, "requests"), scratch_path(spark, "answers")
    transactions(spark, SMALL).drop("tx_fraud", "tx_datetime").write.parquet(requests)
    run(["score-requests", "--input", requests, "--output", answers, *names], spark)
    assert spark.read.parquet(answers).columns == ["transaction_id", "fraud_probability", "fraud_prediction"]
    assert spark.read.parquet(answers).count() == 1000
    with pytest.raises(SystemExit, match="alias"):
        run(["score-requests", "--input", requests, "--output", answers, "--alias", "none", *names], spark)


def test_stream_defaults():
    args = _parser().parse_args("score-stream --registry r --model m --servers s --username u --checkpoint c".split())
    assert (args.trigger_seconds, args.stop_after_seconds) == (15, 300)
    assert args.features is None and args.alias == "champion" and not args.separate_queries
    assert _parser().parse_args("replay --input x --servers s --username u".split()).max_messages is None
