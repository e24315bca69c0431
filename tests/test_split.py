from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import MEDIUM, SMALL
from tidemark.checks import inputs
from tidemark.functions.keys import row_key
from tidemark.operators import split as S
from tidemark.operators.ranking import dense_row_ids, first_in_order
from tidemark.sources.tables import transactions


def by_class(df):
    return {(r.tx_fraud, r.split): r["count"] for r in df.groupBy("tx_fraud", "split").count().collect()}


def expected(zeros, ones, fraction=0.8):
    def cut(n):
        return min(max(int(n * fraction), 1), n - 1)

    return {
        (c, s): k
        for c, n in ((0, zeros), (1, ones))
        for s, k in (("train", cut(n)), ("test", n - cut(n)))
    }


def test_same_as_a_direct_window(spark):
    tx = transactions(spark, MEDIUM)
    ranked = tx.withColumn(
        "rn", F.row_number().over(Window.partitionBy("tx_fraud").orderBy(row_key(42, F.col("transaction_id"))))
    )
    plan = S.plan_split(tx)
    quota = {c.label: c.quota for c in plan.cuts}
    direct = ranked.withColumn("want", F.when(F.col("rn") <= F.when(F.col("tx_fraud") == 1, quota[1]).otherwise(quota[0]), "train").otherwise("test"))
    joined = S.apply_split(tx, plan).join(direct.select("transaction_id", "want"), "transaction_id")
    assert joined.count() == tx.count() and joined.filter("split <> want").count() == 0


def test_layout_does_not_matter(spark):
    tx = transactions(spark, SMALL)
    again = S.plan_split(tx.repartition(7, "tx_amount"))
    assert again == S.plan_split(tx)


def test_more_digits_reach_the_same_cut(spark, monkeypatch):
    tx = transactions(spark, SMALL)
    plan = S.plan_split(tx)
    monkeypatch.setattr(S, "LIST_LIMIT", 0)
    assert S.plan_split(tx) == plan


def test_many_classes_are_joined_instead_of_broadcast(spark, monkeypatch):
    tx = transactions(spark, SMALL)
    want = S.stratified_split(tx).select("transaction_id", "split")
    monkeypatch.setattr(S, "LITERAL_CLASSES", 0)
    assert {tuple(r) for r in S.stratified_split(tx).select("transaction_id", "split").collect()} == {tuple(r) for r in want.collect()}
    monkeypatch.setattr(S, "BROADCAST_CLASSES", 0)
    assert S.stratified_split(tx).select("transaction_id", "split").exceptAll(want).count() == 0


def test_one_id_on_a_third_of_all_rows(spark):
    tx = transactions(spark, SMALL)
    hot = tx.withColumn("transaction_id", F.when(F.col("customer_id") % 3 == 0, F.lit(7)).otherwise(F.col("transaction_id")))
    sizes = {r.tx_fraud: r["count"] for r in hot.groupBy("tx_fraud").count().collect()}
    for seed in range(4):
        assert by_class(S.stratified_split(hot, seed=seed)) == expected(sizes[0], sizes[1])


def test_copies_of_one_row_are_divided_exactly(spark):
    tx = transactions(spark, SMALL)
    one_each = tx.groupBy("tx_fraud").agg(F.min("transaction_id").alias("transaction_id"))
    singles = tx.join(one_each, ["tx_fraud", "transaction_id"]).select(tx.columns)
    copies = singles.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(501)))).drop("_").repartition(5)
    plan = S.plan_split(copies)
    assert any(c.divides_copies for c in plan.cuts)
    out = S.apply_split(copies, plan)
    assert out.columns == [*copies.columns, "split"]
    assert by_class(out) == expected(501, 501)
    mixed = tx.unionByName(copies)
    sizes = {r.tx_fraud: r["count"] for r in mixed.groupBy("tx_fraud").count().collect()}
    assert by_class(S.stratified_split(mixed)) == expected(sizes[0], sizes[1])


def small(spark, zeros, ones, others=0):
    rows = [(i, 0) for i in range(zeros)] + [(i + 1000, 1) for i in range(ones)] + [(i + 2000, 2) for i in range(others)]
    return spark.createDataFrame(rows, "transaction_id long, tx_fraud int")


@pytest.mark.parametrize("zeros,ones", [(1, 5), (5, 1), (0, 5), (0, 0), (5, 0)])
def test_too_few_rows(spark, zeros, ones):
    with pytest.raises(ValueError, match="two rows"):
        S.plan_split(small(spark, zeros, ones))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(zeros=st.integers(2, 40), ones=st.integers(2, 12), fraction=st.sampled_from([0.05, 0.5, 0.8, 0.99]), seed=st.integers(0, 9))
def test_quota_is_exact(spark, zeros, ones, fraction, seed):
    out = S.stratified_split(small(spark, zeros, ones), fraction=fraction, seed=seed)
    assert by_class(out) == expected(zeros, ones, fraction)
    assert out.select("transaction_id").distinct().count() == zeros + ones


def test_class_of_one_other_label_goes_to_test(spark):
    out = by_class(S.stratified_split(small(spark, 5, 5, 1)))
    assert out == {**expected(5, 5), (2, "test"): 1}


def test_without_an_id_column(spark):
    tx = transactions(spark, SMALL).drop("transaction_id")
    sizes = {r.tx_fraud: r["count"] for r in tx.groupBy("tx_fraud").count().collect()}
    assert by_class(S.stratified_split(tx)) == expected(sizes[0], sizes[1])


def test_validation_split_stays_inside_train(spark):
    train = inputs.train_side(spark, SMALL)
    inner = S.validation_split(train)
    assert inner.count() == train.count()
    sizes = {r.tx_fraud: r["count"] for r in train.groupBy("tx_fraud").count().collect()}
    assert by_class(inner) == expected(sizes[0], sizes[1])


def test_rows_are_split_without_shuffling_them(spark):
    plan = S.stratified_split(transactions(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Exchange" not in plan and "ExistingRDD" not in plan


def test_dense_ids_with_a_hot_key(spark):
    tx = transactions(spark, SMALL).withColumn("k", F.when(F.col("transaction_id") % 3 == 0, 5).otherwise(F.col("transaction_id")))
    out = dense_row_ids(tx.select("k", "transaction_id"), [F.col("k")]).toPandas().sort_values("row_id")
    assert list(out.row_id) == list(range(len(out))) and out.k.is_monotonic_increasing
    assert out.transaction_id.nunique() == len(out)


def test_copies_are_numbered_each(spark):
    copies = spark.range(0, 200_000, 1, 8).select(F.lit(1).alias("k"))
    ids = dense_row_ids(copies, [F.col("k")])
    assert ids.agg(F.min("row_id"), F.max("row_id"), F.countDistinct("row_id")).first()[:] == (0, 199_999, 200_000)


def test_rows_of_a_hot_key_spread_over_blocks(spark):
    from tidemark.operators.ranking import place_in_order

    rows = spark.range(0, 200_000, 1, 8).select(F.lit(1).alias("k"), "id")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # would make one block of so few rows
    spark.conf.set(merging, "false")
    try:
        placed = place_in_order(rows, [F.col("k")])
    finally:
        spark.conf.set(merging, "true")
    assert placed.groupBy("block").count().agg(F.max("count")).first()[0] < 60_000


def heads(spark):
    tx = transactions(spark, SMALL).select("transaction_id", "tx_amount", "tx_datetime")
    gaps = F.when(F.col("transaction_id") % 7 > 0, F.col("tx_datetime"))
    same = tx.withColumn("tx_datetime", gaps).withColumn("day", F.to_date("tx_datetime"))
    far = F.when(F.col("transaction_id") % 2 == 0, F.lit(-(2**63))).otherwise(F.lit(2**63 - 1) - F.col("transaction_id"))
    return same.withColumn("far", far).withColumn("name", F.concat(F.lit("n"), F.col("transaction_id") % 5))


@pytest.mark.parametrize("keys", [["tx_datetime", "transaction_id"], ["day", "transaction_id"], ["far", "transaction_id"], ["day", "name", "tx_amount", "transaction_id"], ["tx_amount"]])
@pytest.mark.parametrize("n", [1, 857, 930, 5000])
def test_heads_by_counting(spark, keys, n):
    df = heads(spark)
    columns = [F.col(k) for k in keys]
    want = df.orderBy(*[c.asc_nulls_last() for c in columns]).limit(n)
    got = first_in_order(df, columns, n)
    assert sorted(map(repr, got.select(*keys).collect())) == sorted(map(repr, want.select(*keys).collect()))


def test_a_long_head_is_a_filter(spark):
    df = transactions(spark, SMALL).unionByName(transactions(spark, SMALL))
    plan = first_in_order(spark.range(300_000).withColumn("t", F.timestamp_seconds(F.col("id") % 200_000)), [F.col("t"), F.col("id")], 150_001)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in text and "Exchange" not in text and plan.count() == 150_001
    # equal throughout: cut by number
    assert first_in_order(df, [F.col("tx_datetime"), F.col("transaction_id")], 101).count() == 101
    assert first_in_order(df, [], 100).count() == 100 and first_in_order(df, [F.col("tx_datetime")], 0).count() == 0
