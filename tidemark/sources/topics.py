"""Message sources and sinks: a broker topic, or files in its place.

All adapters speak the same frames: (key, value, timestamp) in and
(key, value) out, so everything between them is broker-free. The broker
connector is a separate Spark package and has to be on the classpath.

A batch of messages has a name. The file sink adds a named batch once, however
often the job that writes it is repeated; a broker has no such step and may get
messages again when a job is.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.paths import path_exists, remove, rename_new

# The login module, and the time between micro-batches.
LOGIN_MODULE = "org.apache.kafka.common.security.scram.ScramLoginModule"
DEFAULT_TRIGGER = {"processingTime": "15 seconds"}

MESSAGE_FRAME = "key string, value string, timestamp timestamp"


@dataclass(frozen=True)
class Broker:
    """Connection settings of a broker behind SASL/SCRAM over TLS."""

    servers: str
    username: str
    password: str = field(repr=False)

    def options(self) -> dict[str, str]:
        login = f'{LOGIN_MODULE} required username="{self.username}" password="{self.password}";'
        # Options of the connector.
        return {
            "kafka.bootstrap.servers": self.servers,
            "kafka.security.protocol": "SASL_SSL",
            "kafka.sasl.mechanism": "SCRAM-SHA-512",
            "kafka.sasl.jaas.config": login,
        }


def source_options(broker: Broker, topic: str, max_offsets: int | None = None) -> dict[str, str]:
    """Read from the earliest offset on; lost offsets do not stop the job.

    ``max_offsets`` bounds one micro-batch, so that a first run over a long
    retained topic is not a single batch of everything.
    """
    bound = {} if max_offsets is None else {"maxOffsetsPerTrigger": str(max_offsets)}
    # Options of the connector.
    return {
        **broker.options(),
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
        **bound,
    }


def read_topic(spark: SparkSession, broker: Broker, topic: str, max_offsets: int | None = None) -> DataFrame:
    return spark.readStream.format("kafka").options(**source_options(broker, topic, max_offsets)).load()


def read_message_files(spark: SparkSession, path: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Stream Parquet files of (key, value, timestamp)."""
    return spark.readStream.schema(MESSAGE_FRAME).options(**(options or {})).parquet(path)


@dataclass(frozen=True)
class TopicSink:
    """Stream sink that writes to broker topics."""

    broker: Broker

    def attach(self, writer, topic: str | None):
        writer = writer.format("kafka").options(**self.broker.options())
        return writer.option("topic", topic) if topic else writer

    def write_batch(self, messages: DataFrame, topic: str, batch: str | None = None) -> bool:
        """Send a batch frame. The broker takes messages as they come, so the name is not used."""
        messages.select("key", "value").write.format("kafka").options(**self.broker.options()).option("topic", topic).save()
        return True

    def write_batches(self, messages: DataFrame, topic: str, batches: list[str]) -> int:
        """Send the batches that a column ``batch`` names; how many."""
        self.write_batch(messages, topic)
        return len(batches)


#: below the folder of a file sink; names that begin so are skipped by readers
STAGING = "_staging"
BATCH_FRAME = "key string, value string, topic string, batch string"


@dataclass(frozen=True)
class FileSink:
    """Sink that writes one Parquet folder per topic below ``root``.

    A stream keeps its own log in the folder of its topic, so a folder takes
    either streams or named batches.
    """

    root: str

    def attach(self, writer, topic: str | None):
        writer = writer.format("parquet")
        if topic:
            return writer.option("path", f"{self.root}/topic={topic}")
        return writer.option("path", self.root).partitionBy("topic")

    def write_batch(self, messages: DataFrame, topic: str, batch: str | None = None) -> bool:
        """Add a named batch; False if it was there already.

        The rows go to a staging folder, where Spark lets one attempt of each task
        count, and become visible by one rename. A job that failed before it leaves
        nothing to be read, and one that is repeated after it adds nothing. Of two
        jobs that write a batch at the same time, one wins.
        """
        spark = messages.sparkSession
        batch = batch or uuid.uuid4().hex
        target = f"{self.root}/topic={topic}/batch={batch}"
        if path_exists(spark, target):
            return False
        staged = f"{self.root}/{STAGING}/{topic}-{batch}-{uuid.uuid4().hex}"
        messages.select("key", "value").write.parquet(staged)
        return rename_new(spark, staged, target)

    def write_batches(self, messages: DataFrame, topic: str, batches: list[str]) -> int:
        """Add the named batches that a column ``batch`` tells apart; how many were not there already.

        All are staged by one job. They become visible in the order of ``batches``, each
        by one rename, as by :meth:`write_batch`; a batch without rows is none.
        """
        spark, folder = messages.sparkSession, f"{self.root}/topic={topic}"
        new = [b for b in batches if not path_exists(spark, f"{folder}/batch={b}")]
        if not new:
            return 0
        staged = f"{self.root}/{STAGING}/{topic}-{uuid.uuid4().hex}"
        own = messages if len(new) == len(batches) else messages.where(F.col("batch").isin(new))
        own.select("key", "value", "batch").write.partitionBy("batch").parquet(staged)
        made = [b for b in new if path_exists(spark, f"{staged}/batch={b}")]
        added = sum(rename_new(spark, f"{staged}/batch={b}", f"{folder}/batch={b}") for b in made)
        remove(spark, staged)
        return added

    def read_batches(self, spark: SparkSession) -> DataFrame:
        """(key, value, topic, batch) of all batches that were added."""
        return spark.read.schema(BATCH_FRAME).parquet(self.root)


def start_write(
    messages: DataFrame,
    sink,
    checkpoint: str,
    topic: str | None = None,
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Start an append query with its own checkpoint folder.

    Without a ``topic`` each row names its own in a ``topic`` column.
    """
    writer = messages.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = sink.attach(writer, topic).trigger(**(trigger or DEFAULT_TRIGGER))
    return writer.start()
