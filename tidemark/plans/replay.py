"""Replay of stored transactions as messages."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.calendar import parse_datetime
from tidemark.functions.cleaning import reject_empty
from tidemark.functions.messages import to_messages
from tidemark.operators.ranking import dense_row_ids, first_in_order
from tidemark.session import scratch_path
from tidemark.sources.files import load_replay
from tidemark.sources.paths import path_exists

# Fixed value: default pace of a replay.
DEFAULT_RATE = 50

#: micro-batches after which a replay that does not wait puts several spans in one, and rows that one may hold then
ROUNDS, ROWS_AT_ONCE = 100, 500_000

LAID_OUT = "key string, value string, seq long, slot long"


def time_keys(df: DataFrame) -> list[Column]:
    """Event time first, with what is no time last; the other columns make the order of equals repeatable."""
    kinds, found = dict(df.dtypes), []
    if "tx_datetime" in kinds:
        time = F.col("tx_datetime")
        found = [parse_datetime(time), time] if kinds["tx_datetime"] == "string" else [time]
    first = [c for c in ("transaction_id",) if c in kinds]
    return found[:1] + [F.col(c) for c in first] + found[1:] + [F.col(c) for c in df.columns if c not in ("tx_datetime", *first)]


def time_order(df: DataFrame) -> list[Column]:
    return [key.asc_nulls_last() for key in time_keys(df)]


def replay_messages(
    df: DataFrame,
    key: str = "transaction_id",
    max_messages: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """(key, value) messages of all rows, or of the first ``max_messages``: by
    event time if ``ordered``, else of any rows."""
    if max_messages is not None:
        df = first_in_order(df, time_keys(df) if ordered else [], max_messages)
    return to_messages(df, key)


def replay_to_topic(
    spark: SparkSession,
    path: str,
    sink,
    topic: str,
    key: str = "transaction_id",
    max_messages: int | None = None,
    batch: str | None = None,
) -> bool:
    """Read a stored file and publish it as one batch.

    A job that is repeated with the same ``batch`` adds nothing to a file sink.
    """
    return sink.write_batch(replay_messages(load_replay(spark, path), key, max_messages), topic, batch)


def time_slots(df: DataFrame, rate: float = DEFAULT_RATE) -> DataFrame:
    """Number rows by event time and give each the second it is due in.

    ``rate`` is in messages a second and may be a fraction; without a pace (0 or
    less) all rows are due at once.
    """
    ranked = dense_row_ids(df, time_order(df), "seq")
    return ranked.withColumn("slot", slot_of(F.col("seq"), rate))


def slot_of(seq: Column, rate: float) -> Column:
    return (F.floor(seq / F.lit(float(rate))) if rate > 0 else F.lit(0)).cast("long")


@dataclass(frozen=True)
class PacedTable:
    """Messages laid out by when they are due: a folder for each span of ``every`` seconds."""

    path: str
    every: int
    last: int  # the last span
    rows: float = ROWS_AT_ONCE  # of a full span

    def span(self, spark: SparkSession, number: int) -> DataFrame | None:
        """The messages of one span, read from its folder alone; None if nothing is due in it."""
        folder = f"{self.path}/span={number}"
        return spark.read.schema(LAID_OUT).parquet(folder) if path_exists(spark, folder) else None

    def spans(self, spark: SparkSession, numbers: list[int]) -> DataFrame | None:
        """The messages of several spans with their ``span``, in order within a file; None if nothing is due in them."""
        folders = [f"{self.path}/span={n}" for n in numbers]
        folders = [f for f in folders if path_exists(spark, f)]
        if not folders:
            return None
        return spark.read.schema(f"{LAID_OUT}, span long").option("basePath", self.path).parquet(*folders)

    def at_once(self) -> int:
        """Spans of a micro-batch where none waits for the next."""
        return max(1, min((self.last + 1) // ROUNDS, int(ROWS_AT_ONCE / max(1.0, self.rows))))


def lay_out(df: DataFrame, rate: float = DEFAULT_RATE, every: int = 1, key: str = "transaction_id") -> PacedTable:
    """Write the messages of ``df`` in the spans they are due in, in order within a file.

    ``every`` should be so many seconds that a span has rows enough for a file. The
    numbered rows lie in order already, so they are written without a shuffle.
    """
    spark = reject_empty(df, "replay input").sparkSession
    slotted = time_slots(df, rate)
    sent = slotted.select(
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*df.columns)).alias("value"),
        "seq",
        "slot",
        F.expr(f"slot div {every}").alias("span"),
    )
    path = scratch_path(spark, "paced")
    sent.sortWithinPartitions("span", "seq").write.partitionBy("span").parquet(path)
    last = spark.read.schema(f"{LAID_OUT}, span long").parquet(path).agg(F.max("slot")).first()[0]
    return PacedTable(path, every, last // every, rate * every if rate > 0 else ROWS_AT_ONCE)


def batch_name(span: int) -> str:
    return f"{span:012d}"


def waits(trigger: dict | None) -> bool:
    """Whether micro-batches come at a pace; with a processing time of 0 one follows the other."""
    return not trigger or str(trigger.get("processingTime", "")).split(" ")[0] != "0"


class PacedReplay:
    """A running replay: each micro-batch publishes the span it is the time for and reads nothing else.

    The source is a counter whose offset is the span, so the checkpoint knows how
    far the replay came. A span is a named batch of the sink: one that was published
    when the job ended is not published again by the job that goes on. A long replay
    that does not wait between micro-batches publishes several spans in each, still a
    batch each: the number of micro-batches does not grow with it then, until they are
    full.
    """

    def __init__(self, spark: SparkSession, table: PacedTable, sink, topic: str, checkpoint: str, trigger: dict | None = None):
        self.table, self.sink, self.topic = table, sink, topic
        self._ended = threading.Event()
        spans = 1 if waits(trigger) else table.at_once()
        counter = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", spans).option("numPartitions", 1).load()
        writer = counter.select("value").writeStream.foreachBatch(self._publish)
        pace = trigger or {"processingTime": f"{table.every} seconds"}
        self.query: StreamingQuery = writer.option("checkpointLocation", checkpoint).trigger(**pace).start()

    def _publish(self, due: DataFrame, number: int) -> None:
        # the counter gives as many numbers as a micro-batch has spans
        spans = sorted(row.value for row in due.collect())
        own = [n for n in spans if n <= self.table.last]
        if len(own) > 1:
            self._publish_several(due.sparkSession, own)
        elif own and (messages := self.table.span(due.sparkSession, own[0])) is not None:
            self.sink.write_batch(messages, self.topic, batch_name(own[0]))
        if len(own) < len(spans):  # so the batch of the last span is in the checkpoint
            self._ended.set()

    def _publish_several(self, spark: SparkSession, spans: list[int]) -> None:
        if (messages := self.table.spans(spark, spans)) is not None:
            named = messages.withColumn("batch", F.lpad(F.col("span").cast("string"), 12, "0"))
            self.sink.write_batches(named.sortWithinPartitions("batch", "seq"), self.topic, [batch_name(n) for n in spans])

    def finish(self, seconds: float | None = None) -> bool:
        """Wait until the last row is published, or so long; then stop. True if the replay came to its end.

        A failure of the query is raised here.
        """
        waited = 0.0
        try:
            while not self._ended.wait(0.05):
                waited += 0.05
                if not self.query.isActive:
                    break
                if seconds is not None and waited >= seconds:
                    break
        finally:
            failure = self.query.exception()
            self.query.stop()
        if failure is not None:
            raise failure
        return self._ended.is_set()


def start_paced(
    df: DataFrame,
    sink,
    topic: str,
    checkpoint: str,
    rate: float = DEFAULT_RATE,
    every: int = 1,
    key: str = "transaction_id",
    trigger: dict | None = None,
) -> PacedReplay:
    """Publish ``df`` in time order at ``rate`` messages a second, 0 or less for all at once."""
    return PacedReplay(df.sparkSession, lay_out(df, rate, every, key), sink, topic, checkpoint, trigger)


def paced_to_topic(
    spark: SparkSession,
    path: str,
    sink,
    topic: str,
    key: str = "transaction_id",
    max_messages: int | None = None,
    rate: float = DEFAULT_RATE,
    every: int = 1,
    checkpoint: str | None = None,
) -> bool:
    """Read a stored file and publish it in time order at a pace, to its end."""
    rows = load_replay(spark, path)
    if max_messages is not None:
        rows = first_in_order(rows, time_keys(rows), max_messages)
    return start_paced(rows, sink, topic, checkpoint or scratch_path(spark, "paced-offsets"), rate, every, key).finish()
