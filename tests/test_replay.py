"""Replay: order, named batches, and publishing at a pace."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.plans import replay as R
from tidemark.session import scratch_path
from tidemark.sources.files import write_csv
from tidemark.sources.tables import transactions
from tidemark.sources.topics import FileSink

FAST = {"processingTime": "0 seconds"}


def test_replay_is_time_ordered_and_limited(spark):
    tx = transactions(spark, SMALL)
    sent = R.replay_messages(tx, max_messages=10).collect()
    first = [str(r.transaction_id) for r in tx.orderBy("tx_datetime", "transaction_id").limit(10).collect()]
    assert sorted(r.key for r in sent) == sorted(first)
    assert R.replay_messages(tx, max_messages=7, ordered=False).count() == 7
    assert R.replay_messages(tx, max_messages=None).count() == 1000
    with pytest.raises(ValueError, match="key column"):
        R.replay_messages(tx, key="none")


def test_times_are_parsed_and_what_is_none_comes_last(spark):
    """Text sorts 'bad' and blanks elsewhere; times decide, then the rest by id."""
    times = ["2024-03-01 00:00:00", "bad", None, "2024-01-05 10:00:00", " ", "2024-01-05 09:00:00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "transaction_id long, tx_datetime string")
    order = [r.transaction_id for r in rows.orderBy(*R.time_order(rows)).collect()]
    assert order == [5, 3, 0, 1, 2, 4]
    for n in range(1, 7):
        assert {r.key for r in R.replay_messages(rows, max_messages=n).collect()} == {str(i) for i in order[:n]}
    slots = {r.transaction_id: r.seq for r in R.time_slots(rows, 1).collect()}
    assert [slots[i] for i in order] == [*range(6)]


def test_a_named_batch_is_added_once(spark, monkeypatch):
    sink, tx = FileSink(scratch_path(spark, "batches")), transactions(spark, SMALL)
    sent = R.replay_messages(tx)
    assert sink.write_batch(sent, "t", "one") and not sink.write_batch(sent, "t", "one")
    assert sink.read_batches(spark).count() == 1000
    # a job that dies while it writes leaves nothing to be read
    broken = sent.withColumn("value", F.when(F.col("key") == "7", F.raise_error(F.lit("dies"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="dies"):
        sink.write_batch(broken, "t", "two")
    assert sink.read_batches(spark).count() == 1000
    assert sink.write_batch(sent.limit(5), "t", "two") and sink.write_batch(sent.limit(3), "u")
    counts = {(r.topic, r.n) for r in sink.read_batches(spark).groupBy("topic", "batch").agg(F.count("*").alias("n")).collect()}
    assert counts == {("t", 1000), ("t", 5), ("u", 3)}
    # two writers of one batch: the one that comes second finds the name taken
    import tidemark.sources.topics as topics

    monkeypatch.setattr(topics, "path_exists", lambda spark, path: False)
    assert not sink.write_batch(sent.limit(4), "t", "two")
    assert sink.read_batches(spark).where("batch = 'two'").count() == 5


def test_replay_of_a_file(spark):
    path = write_csv(transactions(spark, SMALL).limit(20), scratch_path(spark, "in") + ".csv")
    sink = FileSink(scratch_path(spark, "out"))
    for _ in range(2):
        R.replay_to_topic(spark, path, sink, "t", batch="file")
    assert sink.read_batches(spark).count() == 20
    paced = FileSink(scratch_path(spark, "paced"))
    assert R.paced_to_topic(spark, path, paced, "t", max_messages=9, rate=0)
    assert paced.read_batches(spark).count() == 9


@pytest.mark.parametrize(("rate", "every"), [(100, 1), (400.5, 1), (0.5, 40), (0, 1), (-3, 5)])
def test_each_span_is_published_once_and_in_time(spark, rate, every):
    tx = transactions(spark, SMALL).limit(1000 if rate > 1 or rate <= 0 else 90)
    sink = FileSink(scratch_path(spark, "paced"))
    replay = R.start_paced(tx, sink, "t", scratch_path(spark, "offsets"), rate, every, trigger=FAST)
    assert replay.finish(120) and not replay.query.isActive
    ids = [str(r.transaction_id) for r in tx.orderBy("tx_datetime", "transaction_id").select("transaction_id").collect()]
    want = {k: int(i / rate) // every if rate > 0 else 0 for i, k in enumerate(ids)}
    got = sink.read_batches(spark).select("key", F.col("batch").cast("long").alias("span")).collect()
    assert len(got) == len(ids) and {r.key: r.span for r in got} == want


def test_a_replay_goes_on_where_it_ended(spark):
    tx = transactions(spark, SMALL)
    table = R.lay_out(tx, rate=100)
    sink, offsets = FileSink(scratch_path(spark, "paced")), scratch_path(spark, "offsets")
    first = R.PacedReplay(spark, table, sink, "t", offsets, FAST)
    while not sink_count(spark, sink):
        pass
    assert first.finish(0.1) in (True, False)
    # its last batch may have been cut off before its offset was stored
    assert R.PacedReplay(spark, table, sink, "t", offsets, FAST).finish(120)
    counts = {int(r.batch): r.n for r in sink.read_batches(spark).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert counts == dict.fromkeys(range(10), 100)


def sink_count(spark, sink):
    from tidemark.sources.paths import path_exists

    return path_exists(spark, f"{sink.root}/topic=t") and sink.read_batches(spark).count()


def test_one_span_reads_one_folder(spark):
    table = R.lay_out(transactions(spark, SMALL), rate=100)
    files = table.span(spark, 3).inputFiles()
    assert files and all("/span=3/" in f for f in files) and table.span(spark, 99) is None
    assert [r.seq for r in table.span(spark, 3).collect()] == [*range(300, 400)]


def test_a_failing_sink_ends_the_replay(spark):
    class Broken:
        def write_batch(self, *_):
            raise ValueError("sink is closed")

    with pytest.raises(Exception, match="sink is closed"):
        R.start_paced(transactions(spark, SMALL), Broken(), "t", scratch_path(spark, "c"), 0, trigger=FAST).finish(60)


def test_a_long_replay_puts_spans_together(spark, monkeypatch):
    """Beyond so many spans a micro-batch holds several, still a batch each, in order, and none twice."""
    monkeypatch.setattr(R, "ROUNDS", 10)
    tx = transactions(spark, SMALL)
    table = R.lay_out(tx, rate=10)  # 100 spans
    sink, offsets = FileSink(scratch_path(spark, "paced")), scratch_path(spark, "offsets")
    assert table.at_once() == 10 and R.waits(None) and R.waits({"processingTime": "2 seconds"})
    # some were published before the job ended, the checkpoint does not know of them
    assert sink.write_batch(table.span(spark, 4), "t", R.batch_name(4))
    replay = R.PacedReplay(spark, table, sink, "t", offsets, FAST)
    assert replay.finish(120)
    assert replay.query.lastProgress["batchId"] <= 13
    ids = [str(r.transaction_id) for r in tx.orderBy("tx_datetime", "transaction_id").select("transaction_id").collect()]
    got = sink.read_batches(spark).collect()
    assert len(got) == 1000 and {r.key: int(r.batch) for r in got} == {k: i // 10 for i, k in enumerate(ids)}
    in_file = spark.read.parquet(f"{sink.root}/topic=t/batch={R.batch_name(57)}").collect()
    assert [r.key for r in in_file] == ids[570:580]
    assert not sink.write_batches(table.spans(spark, [3, 4]).withColumn("batch", F.lpad("span", 12, "0")), "t", [R.batch_name(3), R.batch_name(4)])
    assert table.spans(spark, [100, 101]) is None
    # a span of many rows is published alone
    assert R.PacedTable("", 1, 10**6, 10**6).at_once() == 1 and R.PacedTable("", 1, 10**6, 2401).at_once() == 208
