"""A forest walked as a table of nodes, and the registry with several writers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.checks import inputs
from tidemark.functions import cleaning, messages
from tidemark.functions.calendar import add_features
from tidemark.functions.scoring import apply_scorer
from tidemark.operators import forest_nodes as N
from tidemark.operators.forest import ForestParams, fit_forest, forest_pipeline
from tidemark.operators.registry import Registry
from tidemark.schema import MODEL_FEATURES
from tidemark.session import scratch_path
from tidemark.sources.models import save_model
from tidemark.streaming.scoring import score_messages


@pytest.fixture(scope="module")
def stored(spark):
    model, _ = fit_forest(inputs.train_side(spark, SMALL), ForestParams(numTrees=7, maxDepth=5))
    return model, N.forest_nodes(spark, save_model(model, scratch_path(spark, "m")))


def rows(df):
    return sorted((r.transaction_id, r.score, r.prediction) for r in df.collect())


@pytest.mark.parametrize("per_group", [1_000_000, 60])
def test_walked_scores_are_the_models(spark, stored, per_group, monkeypatch):
    monkeypatch.setattr(N, "NODES_PER_GROUP", per_group)
    model, nodes = stored
    test = inputs.test_side(spark, SMALL)
    gaps = test.withColumn("tx_amount", F.when(F.col("transaction_id") % 11 > 0, F.col("tx_amount")))
    gaps = gaps.withColumn("tx_month", F.when(F.col("transaction_id") % 13 == 0, float("nan")).otherwise(F.col("tx_month")))
    for df in (test, gaps):
        got = rows(N.score_by_nodes(df, nodes, MODEL_FEATURES))
        want = rows(apply_scorer(df, model))
        assert [g[0] for g in got] == [w[0] for w in want] and len(got) > 100
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-12)
    if per_group < 100:
        assert N.packed_trees(nodes).count() > 2
    else:
        plan = N.score_by_nodes(test, nodes, MODEL_FEATURES)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_a_tree_of_one_leaf(spark):
    same = spark.createDataFrame([(i, 1.0, i % 2) for i in range(20)], "transaction_id long, a double, tx_fraud int")
    model, _ = fit_forest(same, ForestParams(numTrees=2, maxDepth=3), ["a"])
    nodes = N.forest_nodes(spark, save_model(model, scratch_path(spark, "m")))
    assert nodes.count() == 2
    assert rows(N.score_by_nodes(same, nodes, ["a"])) == rows(apply_scorer(same, model))


def test_many_rows_are_scored_by_nodes(spark, stored):
    """A stream's scores are the model's, digit by digit, by arrays of nodes and not by the model for one row at a time."""
    model, _ = stored
    test = inputs.test_side(spark, SMALL)
    gaps = test.withColumn("tx_amount", F.when(F.col("transaction_id") % 11 > 0, F.col("tx_amount")))
    gaps = gaps.withColumn("tx_month", F.when(F.col("transaction_id") % 13 == 0, float("nan")).otherwise(F.col("tx_month")))
    same = spark.createDataFrame([(i, 1.0, i % 2) for i in range(20)], "transaction_id long, a double, tx_fraud int")
    leaves, _ = fit_forest(same, ForestParams(numTrees=2, maxDepth=3), ["a"])
    for df, scorer in ((test, model), (gaps, model), (test.limit(0), model), (same, leaves)):
        assert N.is_plain_forest(scorer)
        got, want = N.score_forest_rows(df, scorer), apply_scorer(df, scorer)
        assert got.columns == want.columns and rows(got) == rows(want)
    parsed = messages.valid_messages(messages.parse_messages(inputs.raw_messages(spark, SMALL)))
    scored = score_messages(parsed, model).select("transaction_id", "score", "prediction")
    assert rows(scored) == rows(apply_scorer(add_features(parsed), model))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    # each time is parsed once, and the model itself is not called
    assert "MapInArrow" in plan and "UDF(" not in plan and plan.count("gettimestamp(") == 1


def test_other_scorers_keep_their_way(spark, stored):
    model, _ = stored
    assert not N.is_plain_forest(inputs.scorer_a()) and not N.is_plain_forest(PipelineModel(model.stages[1:]))
    kept = model.stages[0].copy().setHandleInvalid("keep")
    assert not N.is_plain_forest(PipelineModel([kept, model.stages[1]]))
    # a split by categories has no threshold
    kind = F.pmod("id", F.lit(4)).cast("double").alias("a", metadata={"ml_attr": {"type": "nominal", "vals": list("0123")}})
    df = spark.range(400).select(F.col("id").alias("transaction_id"), kind, (F.col("id") % 2).cast("int").alias("tx_fraud"))
    by_kind = forest_pipeline(ForestParams(numTrees=3, maxDepth=3), ["a"]).fit(df.withColumn("class_weight", F.lit(1.0)))
    assert rows(N.score_forest_rows(df, by_kind)) == rows(apply_scorer(df, by_kind))


def test_each_value_is_converted_once(spark):
    text = cleaning.trim_all(inputs.dirty_transactions(spark, SMALL))
    plan = cleaning.clean_batch(text)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3 and plan.count("gettimestamp") == 1
    assert cleaning.clean_batch(text).columns == text.columns


def test_writers_at_the_same_time(spark):
    """Two writers of one model: every version once, one champion, one order of events."""
    root = scratch_path(spark, "registry")

    def write(name):
        registry = Registry(spark, root)
        return [registry.register("m", f"/{name}/{i}") for i in range(15)]

    with ThreadPoolExecutor(2) as pool:
        done = [x for found in pool.map(write, "ab") for x in found]
    registry = Registry(spark, root)
    assert sorted(v for v, _ in done) == [*range(1, 31)]
    assert sorted(r.version for r in registry.versions.collect()) == [*range(1, 31)]
    assert [v for v, a in done if a == "champion"] == [1]
    events = registry.aliases.orderBy("event_seq").collect()
    assert [e.event_seq for e in events] == [*range(1, 31)] and [e.version for e in events] == [*range(1, 31)]
    assert registry.promote("m") == 30 and registry.resolve("m", "champion") == 30


def test_a_taken_number_is_not_overwritten(spark):
    from tidemark.sources.paths import publish_new

    path = f"{scratch_path(spark, 'files')}/one.json"
    assert publish_new(spark, "first", path) and not publish_new(spark, "second", path)
    assert [r.value for r in spark.read.text(path).collect()] == ["first"]
    assert spark.read.text(path.rsplit("/", 1)[0]).count() == 1


def test_trees_are_joined_with_blocks_of_rows(spark, stored):
    """A row does not carry the trees: they are joined with blocks, which are walked outside of expressions."""
    _, nodes = stored
    test = inputs.test_side(spark, SMALL)
    plan = N.score_by_nodes(test, nodes, MODEL_FEATURES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "lambda" not in plan.split("Join")[0]
    assert N.score_by_nodes(test.limit(0), nodes, MODEL_FEATURES).count() == 0


def test_larger_fits_have_larger_partitions(spark, monkeypatch):
    from tidemark.operators import forest as R

    assert [R.parts_for(n) for n in (0, 8000, 80_000, 240_000, 4_800_000, 28_800_000)] == [1, 1, 8, 24, 24, 116]
    # in the order of values, the columns with few of them first, whatever the layout of the input
    monkeypatch.setattr(R, "FEW_PARTS", 1)
    monkeypatch.setattr(R, "ROWS_PER_PART", 100)
    monkeypatch.setattr(R, "MANY_ROWS_PER_PART", 200)
    train = inputs.train_side(spark, SMALL).select("tx_amount", "tx_hour", "tx_fraud")
    size = train.count()
    laid = [R.fixed_layout(train.repartition(n), size) for n in (2, 5)]
    assert laid[0].rdd.getNumPartitions() == -(-size // 200) > 1
    one, two = (df.withColumn("part", F.spark_partition_id()).collect() for df in laid)
    assert one == two and len(one) == size
    for part in {r.part for r in one}:
        own = [(r.tx_fraud, r.tx_hour, r.tx_amount) for r in one if r.part == part]
        assert own == sorted(own)
    test = inputs.test_side(spark, SMALL)
    models = [fit_forest(inputs.train_side(spark, SMALL).repartition(n), ForestParams(numTrees=3, maxDepth=4))[0] for n in (2, 5)]
    assert rows(apply_scorer(test, models[0])) == rows(apply_scorer(test, models[1]))
