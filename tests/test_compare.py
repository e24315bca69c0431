from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.keys import MASK32, draw
from tidemark.functions.student import log_gamma, two_sided_p
from tidemark.operators import compare as C
from tidemark.operators import resample as R
from tidemark.plans.ab_test import compare_cells

STATS = "metric string, n long, mean double, variance double"


def integrated(t: float, df: float, steps: int = 40_000) -> float:
    """The same probability by Simpson's rule over the density."""
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = abs(t) / steps
    weights = (1 if k in (0, steps) else 4 if k % 2 else 2 for k in range(steps + 1))
    area = sum(w * (1 + (k * h) ** 2 / df) ** (-(df + 1) / 2) for k, w in enumerate(weights))
    return max(0.0, 1 - 2 * front * area * h / 3)


# df = 1 and 2 have closed forms, the others are integrated
P_VALUES = [
    (1.0, 1.0, 0.5),
    (0.0, 5.0, 1.0),
    (12.706204736432095, 1.0, 0.05),
    (math.sqrt(2.0), 2.0, 1 - math.sqrt(2.0) / 2.0),
    (3.0, 2.0, 1 - 3.0 / math.sqrt(11.0)),
    *[(t, df, integrated(t, df)) for t, df in [(2.0, 10.0), (-2.0, 10.0), (0.1, 7.3), (2.626, 100.0), (1.1, 1984.5), (30.0, 200.0)]],
]


@pytest.mark.parametrize("t,df,want", P_VALUES)
def test_p_values(spark, t, df, want):
    got = spark.range(1).select(two_sided_p(F.lit(t), F.lit(df))).first()[0]
    assert got == pytest.approx(want, abs=1e-11)


def test_p_value_of_a_huge_sample_is_nearly_normal(spark):
    got = spark.range(1).select(two_sided_p(F.lit(2.5758293035489004), F.lit(1e6))).first()[0]
    assert got == pytest.approx(0.01, abs=5e-7)


def test_log_gamma(spark):
    points = [0.5, 1.0, 1.5, 2.7, 50.0, 5000.5]
    got = spark.createDataFrame([(p,) for p in points], "z double").select("z", log_gamma(F.col("z")).alias("g")).collect()
    assert {r.z: r.g for r in got} == pytest.approx({p: math.lgamma(p) for p in points}, rel=1e-13, abs=1e-13)


def judged(spark, base, candidate, **how):
    frames = [spark.createDataFrame([("F1", *s)], STATS) for s in (base, candidate)]
    return C.compare(*frames, metrics=("F1",), **how).first()


def test_welch(spark):
    row = judged(spark, (10, 1.0, 4.0), (20, 2.0, 9.0))
    error = 4 / 10 + 9 / 20
    assert row.t_statistic == pytest.approx(-1 / math.sqrt(error))
    assert row.degrees == pytest.approx(error**2 / (0.4**2 / 9 + 0.45**2 / 19))
    assert row.effect_size == pytest.approx(1 / math.sqrt(6.5)) and row.improvement == 1.0
    assert row.verdict == "not significant"


def test_no_variance(spark):
    same = judged(spark, (5, 1.0, 0.0), (5, 1.0, 0.0))
    assert math.isnan(same.t_statistic) and math.isnan(same.p_value) and not same.is_significant
    assert same.effect_size == 0.0
    apart = judged(spark, (5, 1.0, 0.0), (5, 2.0, 0.0))
    assert apart.t_statistic == -math.inf and apart.p_value == 0.0 and apart.verdict == "better"
    assert apart.effect_size == 0.0
    assert judged(spark, (5, 2.0, 0.0), (5, 1.0, 0.0)).verdict == "worse"


def test_single_replicate_is_never_significant(spark):
    row = judged(spark, (1, 1.0, None), (5, 2.0, 0.1))
    assert math.isnan(row.p_value) and not row.is_significant and row.effect_size == 0.0


def test_decision_needs_significance_and_gain(spark):
    schema = "metric string, is_significant boolean, improvement double"
    for significant, gain, want in [(True, 0.1, True), (True, -0.1, False), (False, 0.1, False), (True, 0.0, False)]:
        frame = spark.createDataFrame([("F1", significant, gain), ("P", True, 1.0)], schema)
        assert C.decide(frame).first().should_deploy is want


def test_draws_are_uniform_and_repeatable(spark):
    numbers = spark.range(200_000).select((draw(7, F.col("id")) % 10).alias("d"), draw(7, F.col("id")).alias("w"))
    counts = [r["count"] for r in numbers.groupBy("d").count().collect()]
    assert len(counts) == 10 and max(abs(c - 20_000) for c in counts) < 700
    assert numbers.select("w").distinct().count() == 200_000
    far = spark.range(1 << 40, (1 << 40) + 5, 1, 3).select(draw(7, F.col("id")).alias("w")).collect()
    assert all(0 <= r.w < (1 << 60) for r in far) and MASK32 == 2**32 - 1


def test_cells_add_up_and_follow_the_sample(spark):
    cells = {"tp": 30, "fp": 50, "tn": 400, "fn": 20}
    counts = R.bootstrap_by_cells(spark, cells, 200, 1)
    rows = counts.collect()
    assert len(rows) == 200 and all(r.tp + r.fp + r.tn + r.fn == 500 for r in rows)
    mean = sum(r.tp for r in rows) / 200
    spread = sum((r.tp - mean) ** 2 for r in rows) / 199
    assert abs(mean - 30) < 1.5 and 28.2 * 0.6 < spread < 28.2 * 1.5


def test_one_method_at_every_size(spark):
    few = R.bootstrap_by_cells(spark, {"tp": 3, "fp": 5, "tn": 40, "fn": 2}, 10, 1)
    many = R.bootstrap_by_cells(spark, {"tp": 10**12, "fp": 10**12, "tn": 10**13, "fn": 0}, 100, 1)
    kinds = [re.findall(r"[A-Z]\w+", f._jdf.queryExecution().optimizedPlan().treeString()) for f in (few, many)]
    assert [k for k in kinds[0] if k in ("Aggregate", "Range", "Project")] == [k for k in kinds[1] if k in ("Aggregate", "Range", "Project")]


def test_row_join_equals_cells_when_rows_are_sorted_by_cell(spark):
    sizes = {"tp": 3, "fp": 5, "tn": 40, "fn": 2}
    pairs = {"tp": (1, 1), "fp": (0, 1), "tn": (0, 0), "fn": (1, 0)}
    rows = [pairs[c] for c, n in sizes.items() for _ in range(n)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "row_id long, y_true int, y_pred int")
    by_rows = {tuple(r) for r in R.bootstrap_by_rows(frame, 20, 3).collect()}
    assert by_rows == {tuple(r) for r in R.bootstrap_by_cells(spark, sizes, 20, 3).collect()}


def test_row_join_needs_no_broadcast(spark):
    frame = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(50)], "row_id long, y_true int, y_pred int")
    small = {tuple(r) for r in R.bootstrap_by_rows(frame, 10, 3).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = R.bootstrap_by_rows(frame, 10, 3)
        assert {tuple(r) for r in shuffled.collect()} == small
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_other_labels_are_in_no_cell(spark):
    frame = spark.createDataFrame([(i, (0, 1, 2, None)[i % 4], i % 2) for i in range(40)], "row_id long, y_true int, y_pred int")
    rows = R.bootstrap_by_rows(frame, 30, 5).collect()
    assert len(rows) == 30 and all(r.fp == 0 and r.fn == 0 and r.tn + r.tp < 40 for r in rows)
    with pytest.raises(ValueError, match="row ids"):
        R.bootstrap_by_rows(frame.where("row_id <> 3"), 3, 5)


def test_nothing_to_resample(spark):
    with pytest.raises(ValueError, match="nothing to resample"):
        R.bootstrap_by_cells(spark, dict.fromkeys(("tp", "fp", "tn", "fn"), 0))
    with pytest.raises(ValueError, match="nothing to resample"):
        R.bootstrap_by_rows(spark.createDataFrame([], "row_id long, y_true int, y_pred int"))


def test_scores_guard_empty_ratios(spark):
    counts = spark.createDataFrame([(0, 0, 0, 9, 0), (1, 0, 0, 5, 4), (2, 2, 2, 5, 0)], "iter_id long, tp long, fp long, tn long, fn long")
    got = {r.iter_id: (r.F1, r.P, r.R) for r in R.replicate_scores(counts).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 0, 0), 2: (4 / 6, 0.5, 1.0)}


def test_missing_replicates_are_left_out(spark):
    rows = [(1.0, 1.0, 1.0), (float("nan"), 3.0, None), (3.0, 5.0, 2.0)]
    stats = {r.metric: r for r in R.replicate_stats(spark.createDataFrame(rows, "F1 double, P double, R double")).collect()}
    assert (stats["F1"].n, stats["F1"].mean, stats["F1"].variance) == (2, 2.0, 2.0)
    assert stats["P"].n == 3 and stats["R"].n == 2


def test_clearly_better_cells_are_deployed(spark):
    weak, strong = {"tp": 30, "fp": 50, "tn": 400, "fn": 20}, {"tp": 45, "fp": 20, "tn": 430, "fn": 5}
    assert C.decide(compare_cells(spark, weak, strong)).first().should_deploy
    assert not C.decide(compare_cells(spark, strong, weak)).first().should_deploy
    assert not C.decide(compare_cells(spark, weak, weak)).first().should_deploy
