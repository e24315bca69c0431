"""Token ids in files: one zstandard frame per document, one shared dictionary.

Documents are sorted by id over range partitions; the task of a partition encodes
its texts in order and packs them into blocks. A block is one row of a Parquet
file: ids of documents with the least and the greatest of them, an offset index, and
the frames laid end to end, each compressed alone with the shared dictionary, so a short document is read by
slicing one frame out. Every block names the dictionary by its hash, and readers
refuse another one. The dictionary is trained on the serialized ids of at most
``SAMPLE_DOCS`` documents (the least by a hash), ``SAMPLE_CHARS`` characters each;
it is at most ``DICTIONARY_BYTES`` and therefore sent to every task. Below ten
documents there is none, and the hash is that of the empty dictionary.

Defined results: null text is empty; null ids come first; rows with the same id
follow each other by a hash of their text; an empty table gives empty files. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import documents
from tidemark.llm.token_ids import encoder
from tidemark.llm.words import slices
from tidemark.session import scratch_path

#: fixed value of the contract
END_ID = 2
DICTIONARY_BYTES = 64 * 1024
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 4000
#: rows drawn for each that the sample takes
DRAWN = 4
LEVEL = 3
#: ids are serialized in two bytes: the vocabulary has fewer than 65536
SERIAL = "<u2"
#: bytes of frames in a block
BLOCK_BYTES = 1 << 20

BLOCKS = (
    "part int, block int, start long, least long, greatest long, doc_ids array<long>, n_tokens array<int>, "
    "offsets array<int>, dictionary string, frames binary"
)
READ = "doc_id long, part int, start long, n_tokens long, ids_crc32 long"


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Layout:
    """What the ids are made with."""

    tokenizer: str
    end_id: int = END_ID
    spaces: bool = True


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def serialized(texts: list[str | None], layout: Layout) -> list[bytes]:
    end = np.array([layout.end_id], dtype=SERIAL).tobytes()
    return [ids + end for ids in encoder(layout.tokenizer, "H", layout.spaces).ids(texts)]


def train_dictionary(docs: DataFrame, layout: Layout) -> bytes:
    """A dictionary from a bounded sample of serialized documents."""
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("_o"))
    # hashes below this are enough for the sample several times over, so tasks send few rows each, however many tasks there are
    share = min(1.0, DRAWN * SAMPLE_DOCS / max(1, docs.count()))
    drawn = hashed.where(F.col("_o") <= int((share - 0.5) * 2.0**64)) if share < 1 else hashed
    text = F.substring("text", 1, SAMPLE_CHARS).alias("text")
    sample = drawn.select(text, "_o").orderBy("_o", "text").limit(SAMPLE_DOCS)
    samples = serialized([row.text for row in sample.collect()], layout)
    if len(samples) < 10:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _zstd_dictionary(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def block_rows(layout: Layout, dictionary: bytes):
    """Blocks of one range partition, which comes sorted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zstd_dictionary(dictionary)).compress
        name, part = dictionary_hash(dictionary), TaskContext.get().partitionId()
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.binary()]
        names = ["part", "block", "start", "least", "greatest", "doc_ids", "n_tokens", "offsets", "dictionary", "frames"]
        block = start = 0
        ids, counts, frames = [], [], []

        def full() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            known = [i for i in ids if i is not None]
            row = [part, block, start, min(known, default=None), max(known, default=None), ids, counts, offsets, name, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        held = 0
        for batch in slices(batches, size=1 << 22):
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), serialized(batch.column("text").to_pylist(), layout), strict=True):
                ids.append(doc_id)
                counts.append(len(own) // 2)
                frames.append(compress(own))
                held += len(frames[-1])
                if held >= BLOCK_BYTES:
                    yield full()
                    block, start, held = block + 1, start + sum(counts), 0
                    ids, counts, frames = [], [], []
        if ids:
            yield full()

    return rows


def write_tokens(docs: DataFrame, path: str, layout: Layout) -> None:
    """Writes ``docs`` (doc_id, text) below ``path``: folders ``dictionary`` and ``blocks``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, layout)
    found = spark.createDataFrame([(dictionary_hash(dictionary), bytearray(dictionary))], "hash string, dictionary binary")
    found.coalesce(1).write.parquet(f"{path}/dictionary")
    placed = docs.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie")
    placed = placed.sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    # frames are compressed already
    placed.mapInArrow(block_rows(layout, dictionary), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def open_frames(row: dict, dictionary: bytes, at: range | list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Ids of the documents at places ``at`` of a block; only their frames are touched."""
    if row["dictionary"] != dictionary_hash(dictionary):
        raise ValueError("the block was written with another dictionary")
    expand = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(dictionary)).decompress
    for i in at:
        frame = row["frames"][row["offsets"][i] : row["offsets"][i + 1]]
        yield i, np.frombuffer(expand(frame, max_output_size=2 * row["n_tokens"][i]), dtype=SERIAL)


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if row.hash != dictionary_hash(dictionary):
        raise ValueError("the dictionary is damaged")
    return dictionary


def digest_rows(dictionary: bytes):
    """doc_id, place in its partition, length and checksum of every document of the blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_tokens"]
                crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in open_frames(row, dictionary, range(len(n)))]
                starts = row["start"] + np.concatenate([[0], np.cumsum(n)])[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([row["part"]] * len(n), pa.int32()),
                        pa.array(starts.astype(np.int64)),
                        pa.array(n, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                )

    return rows


def part_starts(counts: DataFrame) -> DataFrame:
    """Running start of each part, from (part, n); one row per part comes to the driver."""
    rows, at = [], 0
    for row in sorted(counts.collect(), key=lambda r: r.part):
        rows.append((row.part, at))
        at += row.n
    return counts.sparkSession.createDataFrame(rows, "part int, part_start long")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    counts = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    rows = blocks.mapInArrow(digest_rows(read_dictionary(spark, path)), READ)
    return rows.join(part_starts(counts), "part").select(
        "doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the rows stored under one id: the index finds block and frame, no other frame is opened."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # the bounds are pushed to the files, whose row groups that cannot hold the id are not read
    near = blocks.where((F.col("least") <= doc_id) & (F.col("greatest") >= doc_id))
    blocks = near.where(F.array_contains("doc_ids", doc_id))
    dictionary = read_dictionary(spark, path)
    out = []
    for row in blocks.orderBy("part", "block").toLocalIterator():
        at = [i for i, x in enumerate(row.doc_ids) if x == doc_id]
        out += [ids.tolist() for _, ids in open_frames(row.asDict(), dictionary, at)]
    return out


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, Layout(byte_bpe()))
    return read_digests(spark, path)
