"""Histogram sort: shares, slots, hot texts, plans."""

import zlib
from collections import Counter

import pytest

from tests.conftest import MEDIUM
from tidemark.llm import sharding
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import documents


def check_slots(found):
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_awkward(docs, rows):
    found = sharding.shard_documents(docs, 4).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    assert all(r["size"] == len((r.text or "").encode()) + 16 and r.lang == "en" and r.id == "own6" for r in found)
    check_slots(found)
    # a shard is off by no more than the largest text
    total, largest = sum(r["size"] for r in found), max(r["size"] for r in found)
    for shard in range(4):
        assert abs(sum(r["size"] for r in found if r.shard == shard) - total / 4) <= largest


def test_hot_text_is_cut(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text")
    sizes = Counter()
    for r in sharding.shard_documents(docs, 16).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) < 200


def test_rows_alike_stay_together(spark):
    docs = spark.createDataFrame([(7, "same")] * 50 + [(8, "other")] * 50, "doc_id long, text string")
    found = sharding.shard_documents(docs, 5).collect()
    assert len({(r.text, r.shard) for r in found}) == 2
    check_slots(found)


def test_query(spark):
    found = QUERIES["op2_sharding"](spark, MEDIUM)
    rows = {r.doc_id: r for r in found.collect()}
    for d in documents(spark, MEDIUM).collect():
        assert rows[d.doc_id].text_crc32 == zlib.crc32((d.text or "").encode())
    assert set(found.columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    check_slots(rows.values())


@pytest.mark.parametrize("parts", [1, 3])
def test_small_tables(spark, no_docs, parts):
    assert sharding.shard_documents(no_docs, parts).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [(r.slot, r["size"]) for r in sharding.shard_documents(one, parts).collect()] == [(0, 16)]


def test_no_python_in_the_plan(docs):
    plan = sharding.shard_documents(docs, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
