"""The forests of a search grow tree by tree in tasks, as MLlib's do, and every validation row is scored by each."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tests.compare import differences, oracle_frame
from tests.conftest import SMALL
from tidemark.functions.scoring import apply_scorer
from tidemark.operators import forest as M
from tidemark.operators import forest_trials as T
from tidemark.operators.metrics import evaluation_record
from tidemark.operators.split import side, validation_split

FEATURES = ["a", "b", "c"]


def kind(number, many):
    return F.pmod(F.xxhash64("transaction_id", F.lit(number)), F.lit(many))


@pytest.fixture(scope="module")
def rows(spark):
    """6000 rows; the label follows a and b, with noise; some lack b."""
    found = spark.range(6000).withColumnRenamed("id", "transaction_id").select(
        "transaction_id",
        kind(1, 30).cast("double").alias("a"),
        F.when(kind(5, 50) > 0, kind(2, 17)).alias("b"),
        kind(3, 5).cast("int").alias("c"),
        F.when((kind(1, 30) * kind(2, 17) > 150) != (kind(4, 10) < 2), 1).otherwise(0).alias("tx_fraud"),
    )
    return found.persist()


def test_a_tree_is_the_one_mllib_grows(rows):
    """On all rows and all features nothing is drawn. Deeper trees meet cuts of equal gain, which rounding decides."""
    weighted, weights = M.add_class_weights(rows)
    values = M.bin_values(rows.na.drop(), FEATURES, 6000)
    middles = {c: [(x + y) / 2 for x, y in zip(values[c], values[c][1:])] for c in FEATURES}
    bins, labels = T.binned(rows, FEATURES, middles)
    whole = rows.na.drop()
    assert bins.shape == (3, whole.count()) and bins.shape[1] < 6000 and bins.max() == 29
    for depth, least in ((1, 1), (5, 1), (9, 6)):
        assembler, forest = M.forest_pipeline(M.ForestParams(1, depth, least, "all"), FEATURES).getStages()
        model = PipelineModel([assembler, forest.setBootstrap(False).fit(assembler.transform(weighted))])
        want = apply_scorer(whole, model, threshold=None).select(*FEATURES, "score", "prediction").distinct().toPandas()
        tree = T.grow_tree(bins, labels, np.ones(len(labels), dtype=int), (weights.weight_0, weights.weight_1), 32, depth, least, 3, np.random.default_rng(1))
        leaf = T.leaves(tree, np.stack([np.searchsorted(middles[c], want[c].to_numpy()) for c in FEATURES]).astype(np.uint8))
        assert np.abs(tree["ones"][leaf] - want.score.to_numpy()).max() < 1e-9
        assert ((tree["ones"] > tree["zeros"])[leaf] == (want.prediction == 1)).all() and (depth == 1 or len(set(leaf)) > 5)


def test_nodes_in_parts_give_the_same_tree(monkeypatch):
    numbers = np.random.default_rng(5)
    bins, labels = numbers.integers(0, 32, (4, 3000)).astype(np.uint8), numbers.integers(0, 2, 3000)
    bag = numbers.poisson(1.0, 3000)
    grown = []
    for size in (8192, 7):
        monkeypatch.setattr(T, "NODES_AT_ONCE", size)
        grown.append(T.grow_tree(bins, labels, bag, (0.5, 2.0), 32, 12, 2, 2, np.random.default_rng(3)))
    assert len(grown[0]["child"]) > 500 and all((grown[0][k] == grown[1][k]).all() for k in grown[0])


def test_the_search_grows_no_forest_on_the_driver(spark, rows, monkeypatch):
    """Trials do not pass through MLlib's fit, which takes several passes over the rows for each level."""
    params = [M.ForestParams(20, 5, 3, "auto"), M.ForestParams(30, 8, 1, "onethird"), M.ForestParams(25, 4, 9, "log2")]
    inner = validation_split(rows)
    train, valid = side(inner, "train"), side(inner, "test")
    by_fit = [evaluation_record(apply_scorer(valid, M.fit_forest(train, p, FEATURES)[0], threshold=None)) for p in params]
    monkeypatch.setattr(M, "random_params", lambda seed, trial: params[trial])
    monkeypatch.setattr(M, "fit_forest", lambda *rest: pytest.fail("fitted one after the other"))
    monkeypatch.setattr(T, "ROWS_PER_BLOCK", 500)
    found = [M.search_forest(rows.repartition(n), FEATURES, trials=3) for n in (2, 5)]
    one, two = ([r.asDict() for r in trials.orderBy("trial").collect()] for *_, trials in found)
    assert one == two and [r["trial"] for r in one] == [0, 1, 2] and found[0][:2] == found[1][:2]
    assert found[0][1] == max(r["fraud_f1"] for r in one) > 0.6
    for got, want, p in zip(one, by_fit, params):
        assert {k: got[k] for k in p.as_dict()} == p.as_dict()
        for name, other in (("fraud_f1", "fraud_f1"), ("auc", "auc"), ("pr_auc", "pr_auc"), ("weighted_f1", "f1")):
            assert got[name] == pytest.approx(want[other], abs=0.05)


def test_all_whole_rows_are_scored(spark, rows, monkeypatch):
    monkeypatch.setattr(T, "VOTES_BYTES", 16 * 6000 * 3)
    monkeypatch.setattr(T, "TREES_PER_TASK", 1)
    picks = [M.ForestParams(7, 3, 1, "sqrt"), M.ForestParams(4, 2, 5, "all")]
    assert T.tree_tasks(picks, 6000) == [(0, 0, 4), (0, 4, 7), (1, 0, 4)]
    weights = M.add_class_weights(rows)[1]
    scores = T.score_trials(rows, rows, FEATURES, picks, weights, M.bin_values(rows.na.drop(), FEATURES, 6000))
    whole = rows.na.drop().groupBy("tx_fraud").count().collect()
    for trial in (0, 1):
        own = scores.filter(F.col("trial") == trial)
        assert sorted(own.groupBy("tx_fraud").count().collect()) == sorted(whole)
        assert own.filter("score < 0 OR score > 1 OR prediction <> cast(score > 0.5 AS int)").count() == 0
        assert own.select("score").distinct().count() > 3
    other = rows.withColumn("tx_fraud", F.when(F.col("transaction_id") == 3, 2).otherwise(F.col("tx_fraud")))
    assert T.score_trials(other, rows, FEATURES, picks, weights, M.bin_values(rows.na.drop(), FEATURES, 6000)) is None


def test_subset_sizes_are_mllibs():
    sizes = {(s, n): T.subset_size(s, 10, n) for s in M.SUBSETS for n in (1, 7, 9, 10)}
    assert [sizes[s, 7] for s in M.SUBSETS] == [3, 3, 3, 3] and [sizes[s, 10] for s in M.SUBSETS] == [4, 4, 4, 4]
    assert [sizes[s, 1] for s in M.SUBSETS] == [1, 1, 1, 1] and [sizes[s, 9] for s in M.SUBSETS] == [3, 3, 4, 3]
    assert T.subset_size("auto", 1, 7) == 7


def test_the_check_of_the_search_gives_its_sql(spark, monkeypatch):
    """All twenty trials of the default search, without a fit of MLlib's for each."""
    monkeypatch.setattr(M, "fit_forest", lambda *rest: pytest.fail("fitted one after the other"))
    found = queries()["tune_trials_check"](spark, SMALL).toPandas()
    assert differences(found, oracle_frame(oracle_sql()["tune_trials_check"], SMALL)) is None
