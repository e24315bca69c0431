"""Quality rules with an isolation forest on their statistics.

The base rules give counts per text; ratios of them, and of a few more, are the
features. Random trees split a feature at a random place until a row stands alone;
rows that few splits isolate are anomalous. The anomaly score of a text is
2 ** (-mean path / expected path), as usual for such forests.

Every row with an id teaches: it is dealt to one tree, in small tables to as many as
give each tree ``LEAST_ROWS``. All trees grow together, a level at a time, from the
ranges of the features in their open nodes, gathered over the table; they end at
``DEPTH`` levels, where the expected path of as many rows as are left is added. The cut
of the score is at the fewest errors over all labelled rows, when losing a good
document costs ``LOSS`` bad ones. Statistics are made once, on whole texts.

Defined results: null and empty texts have no words and fail the base; every row is
judged, repeated ones each; without labelled rows of both kinds only the base
decides; rows with null ids are judged like others but teach nothing; rows alike in
id and statistics teach once; of several labels for an id the greatest counts; an
empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import documents, table, write_clean
from tidemark.llm.words import WORD_BASES, mix, rolling, slices, text_bytes, within_rows, words_of

#: fixed values of the contract
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_SHARE = 3, 50, 50
#: trees, rows of a tree (if the table has as many), and levels of a tree
TREES, LEAST_ROWS, DEPTH, SEED = 100, 256, 10, 5
LOSS = 4.0
#: ranges of scores that are summed up apart; ranges of nodes that a task holds before it merges them
BLOCKS, HELD_RANGES = 4096, 200_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_distinct", "n_upper", "n_digit", "n_exclaim", "n_lines")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *EXTRA))
FEATURES = ("symbols", "dup_lines", "repeats", "upper", "exclaim", "digits", "word_length", "distinct")
LESSONS = "place int, label int, failed boolean, " + ", ".join(f"{c} double" for c in FEATURES)
RANGES = "node long, rows long, " + ", ".join(f"{e}_{c} double" for e in ("low", "high") for c in FEATURES)


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags in each row."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(hashes: np.ndarray, valid: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Words in windows that their text has twice or more, per row."""
    n = len(valid)
    if not n:
        return np.zeros(rows, np.int64)
    key = mix(rolling(hashes, WINDOW, WORD_BASES[0])[:n])
    at = np.flatnonzero(valid)
    order = at[np.lexsort((key[at], row[at]))]
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(hashes) + 1, dtype=np.int64)
    for hit in (order[1:][same], order[:-1][same]):
        twice[hit] = 1
    covered = np.zeros(len(hashes), dtype=bool)
    for i in range(WINDOW):
        covered[i:] |= twice[: len(hashes) - i] > 0
    return np.bincount(row[covered], minlength=rows)


def statistics(column: pa.Array) -> list[np.ndarray]:
    """COUNTS and EXTRA of each text."""
    words = words_of(column)
    data, bounds = text_bytes(column)
    hashes, row, rows = words.hashes(), words.row(), len(column)
    starts_char = (data & 0xC0) != 0x80
    blank = np.isin(data, [32, *range(9, 14)])
    word_chars = sums(starts_char & ~blank, bounds)
    order = np.lexsort((hashes, row))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    dup, lines = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i, text in enumerate(column.to_pylist()):
        own = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    return [
        np.diff(words.first),
        word_chars,
        sums(np.isin(data, [ord(c) for c in SYMBOLS]), bounds),
        dup,
        repeated_words(hashes, within_rows(words, WINDOW), row, rows),
        np.bincount(row[order][first], minlength=rows),
        sums((data >= 65) & (data <= 90), bounds),
        sums((data >= 48) & (data <= 57), bounds),
        sums(data == ord("!"), bounds),
        lines,
    ]


def stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [pa.array(x.astype(np.int64)) for x in statistics(part.column("text"))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found], ["doc_id", *COUNTS, *EXTRA])


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios whose ordinary values do not depend on the length of a text."""
    n = {k: v.astype(float) for k, v in stats.items()}
    words, chars = np.maximum(n["n_words"], 1), np.maximum(n["word_chars"], 1)
    return np.column_stack(
        [
            n["n_symbols"] / words,
            n["n_dup_lines"] / np.maximum(n["n_lines"], 1),
            n["n_repeat_words"] / words,
            n["n_upper"] / chars,
            n["n_exclaim"] / words,
            n["n_digit"] / chars,
            n["word_chars"] / words,
            # of texts of one kind, distinct words grow like a power of the length
            np.log(np.maximum(n["n_distinct"], 1)) / np.log(words + 1),
        ]
    )


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), n == 2)


@dataclass
class Forest:
    """Trees as flat arrays; a node's children are 2i + 1 and 2i + 2."""

    feature: np.ndarray  # TREES x nodes, -1 at leaves
    split: np.ndarray
    path: np.ndarray  # at leaves: depth and what is expected below
    norm: float
    cut: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                own = feature[node]
                inner = np.flatnonzero(own >= 0)
                if not len(inner):
                    break
                right = x[inner, own[inner]] >= split[node[inner]]
                node[inner] = 2 * node[inner] + 1 + right
            total += path[node]
        return 2 ** (-total / len(self.feature) / self.norm)

    def reached(self, x: np.ndarray, tree: np.ndarray, level: int) -> np.ndarray:
        """The node at most ``level`` levels down that each row reaches in its own tree."""
        node, row = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(level):
            own = self.feature[tree, node]
            right = x[row, own] >= self.split[tree, node]
            node = np.where(own >= 0, 2 * node + 1 + right, node)
        return node

    def divide(self, level: int, depth: int, ranges: Ranges, random: np.random.Generator) -> None:
        """Split the nodes of a level between the ends of their ranges, or make them leaves."""
        tree, node = np.divmod(ranges.node, self.feature.shape[1])
        open_ = ranges.high > ranges.low
        leaf = (ranges.rows < 2) | ~open_.any(axis=1) | (level == depth)
        self.path[tree[leaf], node[leaf]] = level + expected_path(ranges.rows[leaf])
        f = np.where(open_, random.random(open_.shape), -1).argmax(axis=1)[:, None]
        low, high = np.take_along_axis(ranges.low, f, 1)[:, 0], np.take_along_axis(ranges.high, f, 1)[:, 0]
        at = random.uniform(low, high)
        at = np.where(at > low, at, high)  # so both sides have a row
        self.feature[tree[~leaf], node[~leaf]], self.split[tree[~leaf], node[~leaf]] = f[~leaf, 0], at[~leaf]


@dataclass
class Ranges:
    """Rows of nodes (tree and node in one number), and the least and greatest of each feature."""

    node: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def merged(self) -> Ranges:
        """Each node once, in order."""
        if not len(self.node):
            return self
        order = np.argsort(self.node, kind="stable")
        own = self.node[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        return Ranges(
            own[first],
            np.add.reduceat(self.rows[order], first),
            np.minimum.reduceat(self.low[order], first, axis=0),
            np.maximum.reduceat(self.high[order], first, axis=0),
        )

    @staticmethod
    def together(parts: list[Ranges]) -> Ranges:
        return Ranges(*[np.concatenate([getattr(p, c) for p in parts]) for c in ("node", "rows", "low", "high")]).merged()


def ranges_of(forest: Forest, x: np.ndarray, place: np.ndarray, share: int, level: int) -> Ranges:
    """Ranges of the nodes of a level, of rows that are dealt to ``share`` trees from ``place`` on."""
    parts = []
    for i in range(share):
        tree = (place + i) % TREES
        node = forest.reached(x, tree, level)
        there = node >= 2**level - 1  # others ended above
        own = x[there]
        parts.append(Ranges((tree * forest.feature.shape[1] + node)[there], np.ones(len(own), np.int64), own, own).merged())
    return Ranges.together(parts)


def grow_by(gather: Callable[[Forest, int, int], Ranges], rows: int) -> Forest | None:
    """A forest on ``rows`` rows, of whose open nodes ``gather`` finds the ranges (forest, share, level); None for less than two."""
    if rows < 2:
        return None
    share = min(TREES, -(-LEAST_ROWS * TREES // rows))
    depth = min(DEPTH, int(np.ceil(np.log2(max(2, share * rows / TREES)))))
    shape = (TREES, 2 ** (depth + 1) - 1)
    forest = Forest(np.full(shape, -1, dtype=np.int8), np.zeros(shape), np.zeros(shape), 1.0)
    random = np.random.default_rng(SEED)
    for level in range(depth + 1):
        found = gather(forest, share, level)
        if not len(found.node):
            break
        if not level:
            forest.norm = float(expected_path(found.rows).mean())
        forest.divide(level, depth, found, random)
    return forest


def grow(x: np.ndarray) -> Forest | None:
    """A forest over rows of features at hand, dealt in turn."""
    place = np.arange(len(x)) % TREES
    return grow_by(lambda forest, share, level: ranges_of(forest, x, place, share, level), len(x))


def as_arrays(rows: DataFrame) -> dict[str, np.ndarray]:
    found = rows.toArrow()
    return {c: found.column(c).to_numpy() for c in found.column_names}


def in_columns(part: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([part.column(c).to_numpy() for c in names])


def lesson_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        stats = {c: part.column(c).to_numpy() for c in (*COUNTS, *EXTRA)}
        found = [pa.array(x) for x in (base_failed(stats), *features(stats).T)]
        yield pa.RecordBatch.from_arrays([part.column("place"), part.column("label"), *found], ["place", "label", "failed", *FEATURES])


def lessons(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Features, label (-1: none) and first tree of each distinct row of statistics that has an id."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    rows = stats.where("doc_id is not null").dropDuplicates().join(known, "doc_id", "left")
    place = F.pmod(F.xxhash64(F.lit(3), *stats.columns), F.lit(TREES)).cast("int").alias("place")
    label = F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(-1).alias("label")
    return write_clean(rows.select(place, label, *COUNTS, *EXTRA).mapInArrow(lesson_rows, LESSONS), "lessons")


def range_rows(forest: Forest, share: int, level: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Ranges] = []
        for part in batches:
            held.append(ranges_of(forest, in_columns(part, FEATURES), part.column("place").to_numpy(), share, level))
            if sum(len(r.node) for r in held) > HELD_RANGES:
                held = [Ranges.together(held)]
        if held:
            all_ = Ranges.together(held)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (all_.node, all_.rows, *all_.low.T, *all_.high.T)], [f.split()[0] for f in RANGES.split(", ")])

    return rows


def gatherer(taught: DataFrame) -> Callable[[Forest, int, int], Ranges]:
    """Ranges over a table of lessons; at most TREES * 2 ** DEPTH rows reach the driver."""

    def gather(forest: Forest, share: int, level: int) -> Ranges:
        parts = taught.select("place", *FEATURES).mapInArrow(range_rows(forest, share, level), RANGES)
        low = [F.min(f"low_{c}").alias(f"low_{c}") for c in FEATURES]
        high = [F.max(f"high_{c}").alias(f"high_{c}") for c in FEATURES]
        found = as_arrays(parts.groupBy("node").agg(F.sum("rows").alias("rows"), *low, *high))
        ends = [np.column_stack([found[f"{e}_{c}"] for c in FEATURES]) for e in ("low", "high")]
        return Ranges(found["node"], found["rows"], *ends).merged()

    return gather


def anomaly_rows(forest: Forest):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            anomaly = pa.array(forest.scores(in_columns(part, FEATURES)))
            yield pa.RecordBatch.from_arrays([anomaly, part.column("label")], ["anomaly", "label"])

    return rows


def cut_of(scored: DataFrame, loss: float) -> float | None:
    """The anomaly from which on a row is told 0, with the fewest errors; a 1 lost counts ``loss`` times.

    In the middle of its gap, of equal cuts in the widest gap; None without rows of both labels.
    Scores are summed up in ``BLOCKS`` ranges, inside of which running counts are exact.
    """
    ones = F.sum("label").alias("ones")
    levels = scored.groupBy("anomaly").agg(ones, (F.count("*") - F.sum("label")).alias("zeros"))
    levels = write_clean(levels.withColumn("block", F.floor(F.col("anomaly") * BLOCKS)), "levels")
    totals = levels.groupBy("block").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.min("anomaly").alias("low"), F.max("anomaly").alias("high"))
    blocks = totals.orderBy("block").collect()  # at most BLOCKS + 1 rows
    good, bad = sum(b.ones for b in blocks), sum(b.zeros for b in blocks)
    if not good or not bad:
        return None
    before, known = (0, 0, None), []
    for b in blocks:
        known.append((b.block, *before))
        before = (before[0] + b.ones, before[1] + b.zeros, b.high)
    known = scored.sparkSession.createDataFrame(known, "block long, ones_before long, zeros_before long, high_before double")
    inside = Window.partitionBy("block").orderBy("anomaly")
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    below = {c: F.coalesce(F.sum(c).over(above), F.lit(0)) + F.col(f"{c}_before") for c in ("ones", "zeros")}
    # a cut below each score but the least
    cuts = levels.join(F.broadcast(known), "block").select(
        "anomaly",
        F.coalesce(F.lag("anomaly").over(inside), "high_before").alias("last"),
        (F.lit(loss) * (F.lit(good) - below["ones"]) + below["zeros"]).alias("cost"),
    )
    cuts = cuts.where("last is not null").withColumn("gap", F.col("anomaly") - F.col("last"))
    best = cuts.orderBy("cost", F.desc("gap"), F.desc("anomaly")).first()
    if best is not None and best.cost <= min(bad, loss * good):
        return (best.anomaly + best.last) / 2
    return blocks[-1].high + 1 if bad <= loss * good else blocks[0].low - 1


def measured(docs: DataFrame) -> DataFrame:
    """Statistics of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(stat_rows, STATS)


def train_measured(stats: DataFrame, labels: DataFrame) -> Forest | None:
    """Trees from all rows, the cut from all labelled ones that pass the base."""
    taught = lessons(stats, labels)
    forest = grow_by(gatherer(taught), taught.count())
    if forest is None:
        return None
    judged = taught.where("label >= 0 and not failed").select("label", *FEATURES)
    cut = cut_of(judged.mapInArrow(anomaly_rows(forest), "anomaly double, label int"), LOSS)
    if cut is None:
        return None
    forest.cut = cut
    return forest


def train(docs: DataFrame, labels: DataFrame) -> Forest | None:
    return train_measured(measured(docs), labels)


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_SHARE * stats["n_words"])


def judge_rows(forest: Forest | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            stats = {c: part.column(c).to_numpy() for c in (*COUNTS, *EXTRA)}
            failed = base_failed(stats)
            anomaly = forest.scores(features(stats)) if forest else np.zeros(part.num_rows)
            kept = ~failed & (anomaly < (forest.cut if forest else np.inf))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[part.column(c) for c in COUNTS], pa.array(failed), pa.array(kept), pa.array(anomaly)],
                ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"],
            )

    return rows


JUDGED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"


def judge_measured(stats: DataFrame, forest: Forest | None) -> DataFrame:
    return stats.mapInArrow(judge_rows(forest), JUDGED)


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (doc_id, text)."""
    return judge_measured(measured(docs), forest)


def op4_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the base rules and the forest."""
    stats = write_clean(measured(documents(spark, sf_dir)), "statistics")
    return judge_measured(stats, train_measured(stats, table(spark, sf_dir, "labels")))
