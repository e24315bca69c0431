"""Shards of nearly equal bytes by histogram sort, in DataFrame operations only.

Rows are ordered by a key pair: a hash of the text, then a hash of the id, so
copies of a text lie next to each other and a text that fills a third of the
table can still be cut between ids. Splitters are found by counting: each pass
lays ``probes`` candidate boundaries over the part of the key space that can
hold a splitter, sums the exact bytes between neighbouring candidates over all
partitions, and keeps the one interval that holds the target. The passes end
when every splitter is within the tolerance, or when an interval holds a single
key and cannot be cut. Only then the rows move, once.

Defined results: null text counts as empty (its own hash); null ids are one id;
rows alike in text and id are never separated; an empty table gives no rows;
further columns of the input are passed on by :func:`shard_documents`, those named
like its own (size, shard, slot) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import documents
from tidemark.session import materialize

#: fixed values of the contract
N_SHARDS = 40
ROW_OVERHEAD = 16

#: first and later numbers of probes per interval
FIRST_PROBES = 4096
PROBES = 256
#: of the mean bytes of a shard
TOLERANCE = 0.001
#: rows numbered in one task
BLOCK_ROWS = 200_000
#: keys are hashes without their sign bit
TOP = 1 << 63


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def key_pair(text: str = "text", doc_id: str = "doc_id") -> tuple[Column, Column]:
    return F.shiftrightunsigned(F.xxhash64(text), 1), F.shiftrightunsigned(F.xxhash64(F.lit(7), doc_id), 1)


@dataclass(frozen=True)
class Interval:
    """Keys from (low, 0) up to (high, 0); or, ``within`` one first key, low to high of the second."""

    low: int
    high: int
    within: int | None = None

    def holds(self) -> Column:
        key = F.col("_k1") if self.within is None else F.col("_k2")
        inside = (key >= self.low) & (key <= self.high - 1)
        return inside if self.within is None else (F.col("_k1") == self.within) & inside

    def step(self, probes: int) -> int:
        return max(1, -(-(self.high - self.low) // probes))

    def cell(self, probes: int) -> Column:
        key = "_k1" if self.within is None else "_k2"
        return F.expr(f"({key} - {self.low}L) div {self.step(probes)}L")

    def edge(self, cell: int, probes: int) -> tuple[int, int]:
        """The key pair at which a cell begins, or the interval ends."""
        at = min(self.low + cell * self.step(probes), self.high)
        return (at, 0) if self.within is None else (self.within, at)

    def narrowed(self, row) -> Interval | None:
        """The interval between the least and the largest key seen in a cell; None if they are one."""
        if self.within is not None:
            return None if row.low2 == row.high2 else replace(self, low=row.low2, high=row.high2 + 1)
        if row.low1 < row.high1:
            return Interval(row.low1, row.high1 + 1)
        return None if row.low2 == row.high2 else Interval(row.low2, row.high2 + 1, within=row.low1)


def _count(keyed: DataFrame, intervals: list[Interval], probes: int) -> dict[int, list]:
    """Bytes and key bounds of every non-empty cell; at most intervals x probes rows come back."""
    at = cell = F.lit(None).cast("long")
    for i, interval in enumerate(intervals):
        at = F.when(interval.holds(), F.lit(i).cast("long")).otherwise(at)
        cell = F.when(interval.holds(), interval.cell(probes)).otherwise(cell)
    cells = (
        keyed.select("_k1", "_k2", "_w", at.alias("_at"), cell.alias("_cell"))
        .where("_at is not null")
        .groupBy("_at", "_cell")
        .agg(
            F.sum("_w").alias("weight"),
            *[F.min(f"_k{i}").alias(f"low{i}") for i in (1, 2)],
            *[F.max(f"_k{i}").alias(f"high{i}") for i in (1, 2)],
        )
    )
    found: dict[int, list] = {i: [] for i in range(len(intervals))}
    for row in sorted(cells.collect(), key=lambda r: (r["_at"], r["_cell"])):
        found[row["_at"]].append(row)
    return found


def splitters(keyed: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Lower key bounds of parts 1 .. parts-1, from columns _k1, _k2 and _w (weight)."""
    whole = Interval(0, TOP)
    probes = FIRST_PROBES
    counted = {whole: _count(keyed, [whole], probes)[0]}
    total = sum(row.weight for row in counted[whole])
    slack = tolerance * total / parts
    bounds: dict[int, tuple[int, int]] = {}
    # of each open splitter: the interval that holds it, and the bytes below that interval
    open_: dict[int, tuple[Interval, int]] = {j: (whole, 0) for j in range(1, parts)} if total else {}
    while open_:
        still: dict[int, tuple[Interval, int]] = {}
        for j, (interval, below) in open_.items():
            target = total * j / parts
            for row in counted[interval]:
                if below + row.weight >= target:
                    break
                below += row.weight
            low, high = target - below, below + row.weight - target
            inner = interval.narrowed(row)
            if min(low, high) <= slack or inner is None:
                bounds[j] = interval.edge(row["_cell"] + (low > high), probes)
            else:
                still[j] = (inner, below)
        open_, probes = still, PROBES
        intervals = list(dict.fromkeys(interval for interval, _ in open_.values()))
        found = _count(keyed, intervals, probes) if intervals else {}
        counted = {interval: found[i] for i, interval in enumerate(intervals)}
    return [bounds[j] for j in sorted(bounds)]


def part_of(bounds: list[tuple[int, int]], first: int = 0) -> Column:
    """The number of bounds at or below the row's key, by halving."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    k1, k2 = bounds[mid]
    above = (F.col("_k1") > k1) | ((F.col("_k1") == k1) & (F.col("_k2") >= k2))
    return F.when(above, part_of(bounds[mid + 1 :], first + mid + 1)).otherwise(part_of(bounds[:mid], first))


def shard_documents(docs: DataFrame, parts: int = N_SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``size``, ``shard`` and ``slot``."""
    k1, k2 = key_pair()
    return shard_keyed(docs.withColumns({"size": size_of(), "_k1": k1, "_k2": k2}), parts, tolerance)


def shard_keyed(keyed: DataFrame, parts: int = N_SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``keyed`` (with size, _k1 and _k2) with ``shard`` and ``slot``, without the keys.

    Slots number the rows of a shard from 0 without gaps: rows of a shard fall
    into blocks by a hash of their key, blocks are numbered inside, and a block
    starts where the counts of the earlier blocks end.
    """
    bounds = splitters(keyed.select("_k1", "_k2", F.col("size").alias("_w")), parts, tolerance)
    rows = keyed.withColumn("shard", part_of(bounds).cast("int"))
    blocks = max(1, -(-keyed.count() // (parts * BLOCK_ROWS)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_k1", "_k2"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy("_k1", "_k2")
    numbered = rows.withColumn("_in", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, ["shard", "_block"])
        .withColumn("slot", (F.col("_start") + F.col("_in")).cast("long"))
        .drop("_block", "_start", "_in", "_k1", "_k2")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, with the digest of its text."""
    k1, k2 = key_pair()
    narrow = materialize(
        documents(spark, sf_dir).select(
            "doc_id",
            size_of().alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
            k1.alias("_k1"),
            k2.alias("_k2"),
        ),
        "sharding",
    )
    return shard_keyed(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
