"""Packing along a space-filling curve.

Each text becomes a hashed vector: counts of its words in ``BUCKETS`` buckets, by
logarithm and at unit length. A fixed random projection takes it to ``AXES``
numbers, which are cut into ``BITS`` bits each and turned into the text's place on
a Hilbert curve. Documents are range-sorted by that place, so texts with like
words lie next to each other: a sample of the places cuts the curve into ranges of
about ``RANGE_BYTES`` of text, each task gets one range and sorts it, and the ranges
are numbered along the curve. A task lays its documents end to end into sequences;
where a sequence is full, the document is cut and goes on in the next. Only the
last sequence of a task has padding. The counts of sequences per range, one small
row each, turn local into global numbers.

Defined results: null text is empty and packs its end id alone; rows that repeat
are packed each; null ids are allowed; an empty table gives no rows. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import documents, partitions_for
from tidemark.llm.token_files import part_starts
from tidemark.llm.token_ids import KEEP, encoder
from tidemark.llm.words import slices, words_of
from tidemark.session import materialize

#: fixed values of the contract
SEQUENCE = 2048
END_ID = 1

BUCKETS, AXES, BITS = 256, 4, 8
#: bits of a hash that order documents at one place, so that copies can lie in several ranges
TIE_BITS = 31
#: bytes of text in a range, and of how many bytes one is sampled to find the ranges
RANGE_BYTES, SAMPLE_BYTES = 32 << 20, 80_000
SEED = 20240
#: projections of unit vectors beyond this are cut to the border
REACH = 0.25

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_sequence long, offset long"
)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vectors(column: pa.Array) -> np.ndarray:
    """Hashed unit vectors of texts, projected to few axes."""
    words = words_of(column, lower=True)
    cell = words.row() * BUCKETS + (words.hashes() % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.log1p(np.bincount(cell, minlength=len(column) * BUCKETS).reshape(len(column), BUCKETS))
    length = np.sqrt((counts**2).sum(axis=1, keepdims=True))
    return (counts / np.where(length, length, 1)) @ _projection()


def _projection() -> np.ndarray:
    plane = np.random.default_rng(SEED).normal(size=(BUCKETS, AXES))
    plane -= plane.mean(axis=0)  # what all texts have in common says nothing
    return plane / np.sqrt((plane**2).sum(axis=0))


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below 2**bits."""
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    # undo, level by level, the turns and mirrorings of the subcubes
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(axes):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def order_of(text: pa.Array, tie: pa.Array) -> np.ndarray:
    """Place on the curve, then a hash, in one number."""
    place = np.clip((vectors(text) + REACH) / (2 * REACH), 0, 1)
    key = hilbert_key(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
    return (key << TIE_BITS) | (tie.to_numpy() & ((1 << TIE_BITS) - 1))


def sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(order_of(part.column("text"), part.column("tie")))], ["place"])


def place_rows(bounds: np.ndarray):
    """Documents with their place on the curve and the range that holds it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            place = order_of(part.column("text"), part.column("tie"))
            range_ = np.searchsorted(bounds, place, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text"), pa.array(place), pa.array(range_)],
                ["doc_id", "text", "place", "range"],
            )

    return rows


def curve_ranges(docs: DataFrame) -> np.ndarray:
    """Bounds of ranges of the curve with about as many bytes each, from a sample of documents.

    A document is in the sample with a chance in proportion to its size, by its hash.
    There are as many ranges as the bytes ask for, and not fewer than the session's
    shuffle width.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = partitions_for(docs.sparkSession, size, RANGE_BYTES)
    drawn = F.pmod(F.shiftright("tie", TIE_BITS), F.lit(SAMPLE_BYTES)) < F.octet_length("text")
    places = docs.where(drawn).mapInArrow(sample_rows, "place long")
    shares = F.array(*[F.lit(i / count) for i in range(1, count)]) if count > 1 else F.array(F.lit(1.0))
    # a row of as many numbers as there are ranges
    found = places.agg(F.percentile_approx("place", shares, max(10_000, 10 * count))).first()[0]
    return np.unique(np.array(found or [], dtype=np.int64))


def pack_rows(tokenizer: str, length: int, end_id: int, keep: int):
    """Pieces of one range partition, in the order of its documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0  # tokens of the partition so far
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, size=1 << 22):
            out: list[tuple] = []
            texts = encoder(tokenizer, "I", False, keep).ids(batch.column("text").to_pylist())
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                own += end
                n, start = len(own) // 4, 0
                while start < n:
                    sequence, offset = divmod(at, length)
                    take = min(length - offset, n - start)
                    crc = zlib.crc32(own[4 * start : 4 * (start + take)])
                    out.append((doc_id, start, take, crc, n, part, sequence, offset))
                    start, at = start + take, at + take
            kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 2
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local_sequence", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows


def pack_documents(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end_id: int = END_ID, keep: int = KEEP) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and the offset in it that they fill.

    ``keep`` bounds the words whose ids a Python worker keeps; a job whose workers
    hold other tables as well may keep fewer.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("tie"))
    bounds = curve_ranges(docs)
    placed = (
        docs.mapInArrow(place_rows(bounds), "doc_id long, text string, place long, range int")
        # range n to task n, so neighbours on the curve stay neighbours
        .repartitionById(len(bounds) + 1, "range")
        .sortWithinPartitions("place")
        .select("doc_id", "text")
    )
    pieces = materialize(placed.mapInArrow(pack_rows(tokenizer, length, end_id, keep), PIECES), "pieces")
    counts = pieces.groupBy("part").agg((F.max("local_sequence") + 1).alias("n"))
    return pieces.join(part_starts(counts), "part").select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("local_sequence") + F.col("part_start")).alias("sequence_id"),
        "offset",
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(documents(spark, sf_dir), word_bpe())
