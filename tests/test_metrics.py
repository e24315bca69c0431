from __future__ import annotations

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.checks import inputs
from tidemark.operators import metrics
from tidemark.operators.metrics import class_scores, confusion, evaluate, evaluation_record, with_rates
from tidemark.operators.weights import add_class_weights, measure_weights, weight_table


def mllib(scored):
    scored = scored.withColumn("prediction", F.col("prediction").cast("double"))
    binary = BinaryClassificationEvaluator(labelCol="tx_fraud", rawPredictionCol="score", numBins=0)
    multi = MulticlassClassificationEvaluator(labelCol="tx_fraud", predictionCol="prediction")
    return {
        "auc": binary.setMetricName("areaUnderROC").evaluate(scored),
        "pr_auc": binary.setMetricName("areaUnderPR").evaluate(scored),
        "accuracy": multi.setMetricName("accuracy").evaluate(scored),
        "f1": multi.setMetricName("f1").evaluate(scored),
    }


@pytest.mark.parametrize("scorer", [inputs.scorer_a, inputs.scorer_b])
def test_same_as_mllib(spark, scorer):
    scored = inputs.scored(spark, SMALL, scorer())
    assert {k: evaluation_record(scored)[k] for k in mllib(scored)} == pytest.approx(mllib(scored), abs=1e-12)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, 0.9, 1), (1, 0.2, 0)],
        [(0, 0.9, 1), (0, 0.2, 0)],
        [(1, 0.5, 1), (0, 0.5, 1)],
        [(1, 0.9, 1), (0, 0.1, 0), (0, 0.9, 1), (1, 0.1, 0), (1, 0.4, 0)],
        [(2, 0.9, 1), (0, 0.1, 0), (1, 0.7, 1), (1, 0.3, 0)],
    ],
)
def test_edges_same_as_mllib(spark, rows):
    scored = spark.createDataFrame(rows, "tx_fraud int, score double, prediction int")
    got = evaluation_record(scored)
    assert {k: got[k] for k in mllib(scored)} == pytest.approx(mllib(scored), abs=1e-12)
    flat = class_scores(scored).first()
    assert (flat.accuracy, flat.f1) == pytest.approx((got["accuracy"], got["f1"]))


@pytest.mark.parametrize("per_block", [500_000, 150, 7])
def test_blocks_of_the_curve_do_not_show(spark, monkeypatch, per_block):
    """One score that half of all rows share, ties and single scores; in one block and in many."""
    score = F.when(F.col("id") % 2 == 0, 0.5).when(F.col("id") % 3 == 0, F.col("id") % 40 / 40.0).otherwise(F.hash("id") / 4e9)
    scored = spark.range(0, 3000, 1, 4).select((F.hash("id") % 5 == 0).cast("int").alias("tx_fraud"), score.alias("score"))
    scored = scored.withColumn("prediction", (F.col("score") > 0.3).cast("int"))
    monkeypatch.setattr(metrics, "ROWS_PER_BLOCK", per_block)
    cuts = metrics.score_cuts(scored)
    assert bool(cuts) == (per_block < 3000) and cuts == sorted(set(cuts))
    assert {k: evaluation_record(scored)[k] for k in mllib(scored)} == pytest.approx(mllib(scored), abs=1e-12)
    curve = metrics.score_curve(scored).orderBy(F.col("score").desc()).collect()
    above = 0
    for row in curve:
        assert row.rows_above == above
        above += row.rows
    assert above == 3000


def test_scores_that_are_no_numbers_have_a_block(spark, monkeypatch):
    rows = [(1, None, 0), (0, None, 0), (1, float("nan"), 1), (0, 0.2, 0), (1, 0.9, 1), (0, 0.9, 1), (1, 0.1, 0)] * 3
    scored = spark.createDataFrame(rows, "tx_fraud int, score double, prediction int")
    whole = evaluation_record(scored)
    monkeypatch.setattr(metrics, "ROWS_PER_BLOCK", 2)
    assert evaluation_record(scored) == pytest.approx(whole, abs=1e-12) and whole["tp"] == 6


def exchanges(df):
    """Shuffles of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hash") + plan.count("Exchange range") + plan.count("Exchange SinglePartition"), plan


def test_shuffles_of_an_evaluation(spark, monkeypatch):
    scored = inputs.scored(spark, SMALL)
    few, plan = exchanges(evaluate(scored))
    assert few == 2 and "range" not in plan
    monkeypatch.setattr(metrics, "ROWS_PER_BLOCK", 20)
    many, plan = exchanges(evaluate(scored))
    # groups, once more by block, block sums twice over some hundred rows, and the end
    assert many <= 6 and "Exchange range" not in plan


def test_rates_without_any_flag_or_positive(spark):
    scored = spark.createDataFrame([(0, 0.1, 0), (0, 0.2, 0)], "tx_fraud int, score double, prediction int")
    row = with_rates(confusion(scored)).first()
    assert row.tn == 2 and (row.fraud_precision, row.fraud_recall, row.fraud_f1) == (0.0, 0.0, 0.0)


def test_metrics_read_only_what_they_need(spark):
    text = evaluate(inputs.scored(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "rowsPartition" not in text
    flat = confusion(inputs.scored(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    schema = flat.split("ReadSchema: ")[1].split("\n")[0]
    assert "user_id" not in schema and "props" not in schema


def test_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "tx_fraud int")
    weighted, w = add_class_weights(df)
    assert (w.count_0, w.count_1, w.weight_0, w.weight_1) == (3, 1, 4 / 6, 2.0)
    assert weighted.agg(F.sum("class_weight")).first()[0] == pytest.approx(4.0)
    assert weight_table(df).first().asDict() == pytest.approx(w.as_dict())
    with pytest.raises(ValueError, match="both classes"):
        measure_weights(df.filter("tx_fraud = 0"))
    with pytest.raises(ValueError, match="both classes"):
        measure_weights(df.filter("tx_fraud = 7"))
