"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import differences, oracle_frame
from tests.conftest import SMALL


#: operators that pair every row with every other, or leave the JVM per row
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")
#: twenty fits, compared by tests/compare.py; the search has tests of its own in test_models.py
LONG = {"tune_trials_check"}


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - LONG))
def test_matches_sql(spark, name):
    df = queries()[name](spark, SMALL)
    assert differences(df.toPandas(), oracle_frame(oracle_sql()[name], SMALL)) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in FORBIDDEN if p in plan]


@pytest.mark.parametrize("name", ["fit_forest", "stored_forest"])
def test_model_queries_give_rows(spark, name):
    assert queries()[name](spark, SMALL).count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() == 2


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
