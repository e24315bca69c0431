from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.checks import inputs
from tidemark.functions.scoring import apply_scorer
from tidemark.operators import forest as M
from tidemark.operators.metrics import EVALUATION
from tidemark.operators.registry import Registry, alias_registrations, current_aliases
from tidemark.plans.ab_test import compare_scorers, run_ab_test
from tidemark.plans.requests import impute_requests, score_requests
from tidemark.plans.training import choose_params, train_model
from tidemark.schema import MODEL_FEATURES, REQUEST_SCHEMA
from tidemark.session import scratch_path
from tidemark.sources import files
from tidemark.sources.models import feature_columns, load_model, save_model

TINY = M.ForestParams(numTrees=3, maxDepth=3)


@pytest.fixture(scope="module")
def text_path(spark):
    return files.write_text(inputs.text_transactions(spark, SMALL), scratch_path(spark, "train"))


@pytest.fixture(scope="module")
def model(spark):
    return M.fit_forest(inputs.train_side(spark, SMALL), TINY)[0]


def test_stored_model_gives_equal_scores(spark, model):
    again = load_model(save_model(model, scratch_path(spark, "m")))
    assert feature_columns(again) == list(MODEL_FEATURES)
    test = inputs.test_side(spark, SMALL)
    one, two = (apply_scorer(test, m).select("transaction_id", "score") for m in (model, again))
    assert one.exceptAll(two).count() == 0 and one.filter("score < 0 OR score > 1").count() == 0


def test_own_decision_and_threshold_agree_off_the_tie(spark, model):
    test = inputs.test_side(spark, SMALL)
    own = apply_scorer(test, model, threshold=None).select("transaction_id", "score", F.col("prediction").alias("own"))
    both = own.withColumn("cut", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    assert both.filter("own <> cut AND score <> 0.5").count() == 0


def test_defaults_and_pipeline():
    assert M.ForestParams() == M.ForestParams(100, 10, 1, "auto", 42)
    assert [p in M.TREES for p in (50, 75, 200, 201)] == [True, True, True, False]
    assert M.DEPTHS[0] == 4 and M.DEPTHS[-1] == 16 and M.MIN_INSTANCES[-1] == 20


def test_pipeline_settings(spark):
    assembler, trees = M.forest_pipeline(TINY, ["a"]).getStages()
    assert assembler.getHandleInvalid() == "skip" and trees.getWeightCol() == "class_weight" and trees.getNumTrees() == 3


def test_search_reports_trials_and_picks_the_best(spark):
    asked = []

    def propose(trial, history):
        asked.append(len(history))
        return M.ForestParams(2 + trial, 3, 1, "sqrt")

    best, score, trials = M.search_forest(inputs.train_side(spark, SMALL), trials=3, propose=propose)
    rows = trials.collect()
    assert asked == [0, 1, 2] and len(rows) == 3
    assert score == max(r.fraud_f1 for r in rows) and best.numTrees in (2, 3, 4) and best.seed == 42
    picks = [M.random_params(1, t) for t in range(40)]
    assert picks == [M.random_params(1, t) for t in range(40)] and len(set(picks)) > 30
    assert all(p.numTrees in M.TREES and p.maxDepth in M.DEPTHS for p in picks)


def test_modes(spark):
    assert choose_params(None, "baseline") == (M.ForestParams(), None)
    with pytest.raises(ValueError, match="unknown training mode"):
        choose_params(None, "best")


def test_training_registers_and_ab_test_runs(spark, text_path, monkeypatch):
    monkeypatch.setattr("tidemark.plans.training.ForestParams", lambda: TINY)
    registry = Registry(spark, scratch_path(spark, "registry"))
    assert run_ab_test(spark, text_path, registry, "m", "txt") is None
    first = train_model(spark, text_path, scratch_path(spark, "m1"), "txt", registry=registry, model_name="m")
    assert (first.version, first.alias) == (1, "champion")
    assert run_ab_test(spark, text_path, registry, "m", "txt") is None
    second = train_model(spark, text_path, scratch_path(spark, "m2"), "txt", registry=registry, model_name="m")
    assert (second.version, second.alias) == (2, "challenger")
    assert set(EVALUATION) | {"fraud_f1"} == set(first.metrics)
    logged = {r.name: r.value for r in registry.runs.filter(F.col("run_id") == first.run_id).collect()}
    assert logged["train_mode"] == "baseline" and logged["feature_cols"] == ",".join(MODEL_FEATURES)
    assert float(logged["auc"]) == first.metrics["auc"] and float(logged["train_class_0_count"]) > 0

    result = run_ab_test(spark, text_path, registry, "m", "txt", iterations=30, auto_deploy=True)
    assert {r.metric for r in result.comparison.collect()} == {"F1", "P"}
    assert result.champion.first().tp + result.champion.first().fn > 0
    assert registry.resolve("m", "champion") == (2 if result.should_deploy else 1)


def test_aliases(spark):
    registry = Registry(spark, scratch_path(spark, "registry"))
    assert registry.resolve("m", "champion") is None and registry.load("m") is None and registry.promote("m") is None
    assert [registry.register("m", f"/p{i}") for i in (1, 2, 3)] == [(1, "champion"), (2, "challenger"), (3, "challenger")]
    assert registry.register("other", "/q") == (1, "champion")
    assert (registry.resolve("m", "champion"), registry.resolve("m", "challenger")) == (1, 3)
    assert registry.promote("m", "won") == 3 and registry.resolve("m", "champion") == 3
    new = spark.createDataFrame([("m", 4, 100), ("new", 1, 101), ("new", 2, 102)], "model string, version long, event_seq long")
    got = {(r.model, r.version): r.alias for r in alias_registrations(new, registry.aliases).collect()}
    assert got == {("m", 4): "challenger", ("new", 1): "champion", ("new", 2): "challenger"}
    assert current_aliases(registry.aliases).count() == 3


def test_compare_scorers(spark):
    rows = compare_scorers(inputs.test_side(spark, SMALL), inputs.scorer_a(), inputs.scorer_b(), iterations=10).collect()
    assert {r.metric for r in rows} == {"F1", "P"}


class FixedScorer:
    """Stands in for a fitted model: probabilities 0.1 and 0.9 by request."""

    def transform(self, df):
        return df.withColumn("prediction", F.when(F.col("transaction_id") == 1, 0.1).otherwise(0.9))


REQUESTS = [
    (1, 101, 1001, 42.5, 3600, 1, 1, 2, 8, 0),
    (2, 102, 1002, 1000.0, 7200, 1, 2, 2, 8, 0),
]


def test_requests_are_scored_at_half(spark):
    requests = spark.createDataFrame(REQUESTS, REQUEST_SCHEMA)
    got = [tuple(r) for r in score_requests(requests, FixedScorer()).orderBy("transaction_id").collect()]
    assert got == [(1, 0.1, 0), (2, 0.9, 1)]


def test_empty_request_is_an_error(spark):
    with pytest.raises(ValueError, match="empty"):
        score_requests(spark.createDataFrame([], REQUEST_SCHEMA), FixedScorer())


def test_request_gaps(spark):
    requests = spark.createDataFrame([(None, 5, None)], "transaction_id long, customer_id long, tx_hour int")
    row = impute_requests(requests).first()
    assert row.transaction_id is None and row.tx_hour == 0 and row.tx_amount == 0 and row.customer_id == 5


def test_model_without_scores_is_refused(spark):
    class Silent:
        def transform(self, df):
            return df

    with pytest.raises(ValueError, match="neither"):
        apply_scorer(spark.createDataFrame(REQUESTS, REQUEST_SCHEMA), Silent())


def test_large_fits_take_rows_alike_as_one(spark, monkeypatch):
    """Counts, not rows, are bagged; nothing is kept per row and tree, and rows decide as they were counted."""
    raw = spark.range(6000).select(
        (F.col("id") % 40).cast("double").alias("a"),
        F.when(F.col("id") % 500 == 7, F.lit(None)).otherwise(F.col("id") % 3).alias("b"),
        F.when((F.col("id") % 40 >= 20) == (F.xxhash64("id") % 10 != 0), 1).otherwise(0).alias("tx_fraud"),
    )
    params = M.ForestParams(numTrees=5, maxDepth=4)
    by_rows, found = M.fit_forest(raw, params, ["a", "b"])
    monkeypatch.setattr(M, "FEW_PARTS", 1)
    monkeypatch.setattr(M, "ROWS_PER_PART", 1000)
    fitted, fit_cells = [], M.fit_cells
    monkeypatch.setattr(M, "fit_cells", lambda cells, *rest: fitted.append(cells.agg(F.sum(M.COPIES), F.count("*")).first()) or fit_cells(cells, *rest))
    models = [M.fit_forest(raw.repartition(n), params, ["a", "b"]) for n in (2, 5)]
    whole = raw.filter("b IS NOT NULL").count()
    # 31 or 32 values of a are told apart, 3 of b and 2 classes
    assert [f[0] for f in fitted] == [whole] * 2 and max(f[1] for f in fitted) <= 192
    assert [w for _, w in models] == [found] * 2
    one, two = (apply_scorer(raw, m).select("a", "b", "score").distinct().toPandas().sort_values(["a", "b"]) for m, _ in models)
    assert one.equals(two) and len(one) == 120
    by = apply_scorer(raw, by_rows).select("a", "b", "score").distinct().toPandas().sort_values(["a", "b"])
    assert abs(one.score.to_numpy() - by.score.to_numpy()).max() < 0.2
    assert ((one.score >= 0.5) == (one.a >= 20)).all()
    forest = models[0][0].stages[-1]
    assert forest.getNumTrees == 5 and len(forest.trees) == 5 and max(t.depth for t in forest.trees) <= 4
    assert len({t.toDebugString for t in forest.trees}) > 1
    again = load_model(save_model(models[0][0], scratch_path(spark, "m")))
    assert again.stages[-1].toDebugString.split("\n", 1)[1] == forest.toDebugString.split("\n", 1)[1]
    # a leaf of so many single rows needs the rows
    M.fit_forest(raw, M.ForestParams(2, 3, 5), ["a", "b"])
    monkeypatch.setattr(M, "ROWS_PER_CELL", 100)
    M.fit_forest(raw, M.ForestParams(2, 3), ["a", "b"])
    assert len(fitted) == 2


def test_the_nearest_value_is_searched(spark):
    """Not by a chain of comparisons: that of 32 values in 7 columns is too long for compiled code."""
    kept = [0.0, 0.1, 0.1 + 2**-56, 5.0, 1e308, 1.7e308]
    asked = [-1.0, 0.05, 0.1, 2.55, 2.6, 4e307, 1.2e308, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(a,) for a in asked], "a double")
    column = M.nearest(F.col("a"), kept)
    chain = F
    for low, high in zip(kept, kept[1:]):
        chain = chain.when(F.col("a") <= F.lit((low + high) / 2.0), F.lit(low))
    got = df.select(column.alias("got"), chain.otherwise(F.lit(kept[-1])).alias("want"))
    assert all(r.got == r.want for r in got.collect())
    assert "CASE" not in df.select(column)._jdf.queryExecution().optimizedPlan().toString()


def test_bins_and_bags(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id")).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    values = M.bin_values(df, ["a", "b"], 5000)
    assert values["b"] == [0, 1, 2, 3, 4, 5, 6] and len(values["a"]) == M.BINS
    put = df.select("a", M.nearest(F.col("a"), values["a"]).alias("bin")).toPandas()
    assert (abs(put.a - put.bin) <= [min(abs(a - v) for v in values["a"]) for a in put.a]).all()
    counts = put.groupby("bin").size()
    assert len(counts) == M.BINS and counts.sum() == 5000 and counts.max() < 400
    # a middle goes to the lower value, as trees send it to the left
    assert [r[0] for r in spark.range(3).select(M.nearest(F.col("id") + 0.5, [0.0, 1.0, 2.0])).collect()] == [0, 1, 2]
    laid = spark.range(400, numPartitions=3).select((F.pmod("id", F.lit(2)) * 1000000).alias(M.COPIES))
    drawn = laid.repartition(2, M.COPIES).mapInArrow(M.draw_bags(50, 3), f"{M.COPIES} long, {M.BAGS} array<int>").toPandas()
    none, many = (drawn[drawn[M.COPIES] == n][M.BAGS] for n in (0, 1000000))
    assert all(max(b) == 0 for b in none) and len(none) == len(many) == 200
    taken = [x for b in many for x in b]
    mean = sum(taken) / len(taken)
    assert len(taken) == 10000 and abs(mean - 1e6) < 100 and 0.9e6 < sum((x - mean) ** 2 for x in taken) / 1e4 < 1.1e6
